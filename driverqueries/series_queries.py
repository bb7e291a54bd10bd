"""Series, peaks, segments, screens, tracks and series statistics (W, A5, A9-A11, J7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driverqueries.common import events, r6
from medloom.functions.time import epoch_days
from medloom.operators import asof, series, stats
from medloom.plans import trajectories as plan

KEYS = ["user_id", "event_type"]

# The split-key forms take the event type alone as key, so five keys hold all rows, and cut them into chunks.
HOT = ["event_type"]
FEW_ROWS = 1000

# Screens that let short segments of the driver's tables pass.
MIN_POINTS = 2
MIN_HEIGHT = 150.0
PROMINENCE = 1.0


def _points(spark, sf_dir, step=None):
    """Events as series rows; ``step`` coarsens the values so that flat tops occur."""
    x = F.col("value") if step is None else F.floor(F.col("value") / step) * float(step)
    return events(spark, sf_dir).select(*KEYS, "event_id", epoch_days(F.col("ts")).alias("t"), x.alias("x"))


def _series(spark, sf_dir, keys=KEYS, **more):
    return series.series(_points(spark, sf_dir), keys, "t", "x", "event_id", **more)


def series_positions(spark, sf_dir):
    return _series(spark, sf_dir).select(*KEYS, "seq", r6(F.col("t")).alias("t"), "x")


def series_positions_split_keys(spark, sf_dir):
    out = _series(spark, sf_dir, HOT, rows_per_task=FEW_ROWS)
    return out.select(*HOT, "seq", r6(F.col("t")).alias("t"), "x")


def _find(spark, sf_dir, step=25, prominence=30.0, edge=True, keys=KEYS, **more):
    return series.find_peaks(
        _points(spark, sf_dir, step), keys, prominence, edge=edge, tie="event_id", **more
    )


def peaks(spark, sf_dir):
    return _find(spark, sf_dir).peaks.select(*KEYS, "peak_seq", "peak_x", "prominence")


def peaks_split_keys(spark, sf_dir):
    found = _find(spark, sf_dir, keys=HOT, rows_per_task=FEW_ROWS)
    return found.peaks.select(*HOT, "peak_seq", "peak_x", "prominence", "ll", "ul")


def peaks_inner(spark, sf_dir):
    found = _find(spark, sf_dir, edge=False, min_height=100.0)
    return found.peaks.select(*KEYS, "peak_seq", "peak_x", "prominence")


def segments(spark, sf_dir):
    found = _find(spark, sf_dir, min_points=2)
    return found.peaks.select(*KEYS, "peak_seq", "ll", "ul")


def segments_peak_to_peak(spark, sf_dir):
    found = _find(spark, sf_dir, mode="peak_to_peak", strict=False)
    return found.peaks.select(*KEYS, "peak_seq", "ll", "ul")


def _all_segment_points(spark, sf_dir):
    found = series.find_peaks(
        _points(spark, sf_dir), KEYS, PROMINENCE, edge=True, include_trough=True, min_points=2, tie="event_id"
    )
    return series.segment_points(found, KEYS)


def segment_screens(spark, sf_dir):
    points = series.screen_segments(_all_segment_points(spark, sf_dir), KEYS, min_points=1, min_height=20.0)
    return points.groupBy(*KEYS, "peak_seq").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("x")).alias("total"))


def half_time(spark, sf_dir):
    out = series.half_times(_all_segment_points(spark, sf_dir), KEYS)
    return out.select(*KEYS, "peak_seq", r6(F.col("half_time"), 5).alias("half_time"))


def tail_cut(spark, sf_dir):
    points = series.cut_tail(_all_segment_points(spark, sf_dir), KEYS, 1)
    return points.groupBy(*KEYS, "peak_seq").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("x")).alias("total"))


def _built(spark, sf_dir):
    return plan.build_trajectories(
        _points(spark, sf_dir), "user_id", "event_type", labs=None, min_points=MIN_POINTS, min_height=MIN_HEIGHT,
        prominence=PROMINENCE, tie="event_id",
    )


def trajectories(spark, sf_dir):
    meta = _built(spark, sf_dir).meta
    return meta.select(
        *KEYS, "traj_id", r6(F.col("t0")).alias("t0"), "t0_date", "index_xt_peak", r6(F.col("tf")).alias("tf"),
        "tf_date", "index_xt_trough", r6(F.col("tlen")).alias("tlen"), "x0", "xf", r6(F.col("xdelta")).alias("xdelta"),
        "n_points",
    )


def run_meta(spark, sf_dir):
    return _built(spark, sf_dir).run_meta.select(
        "num_input_ids", "num_peaks", "num_traj_meeting_criteria", "min_peak2trough", "min_peak_height"
    )


def running_mean(spark, sf_dir):
    pts = _series(spark, sf_dir)
    return series.moving_mean(pts, KEYS, 3).select(*KEYS, "seq", r6(F.col("mean"), 5).alias("mean"))


def running_mean_split_keys(spark, sf_dir):
    pts = _series(spark, sf_dir, HOT)
    out = series.moving_mean(pts, HOT, 3, rows_per_task=FEW_ROWS)
    return out.select(*HOT, "seq", r6(F.col("mean"), 5).alias("mean"))


def excess_decay(spark, sf_dir):
    pts = _series(spark, sf_dir)
    out = series.excess_over_decay(pts, KEYS, 0.44, 18)
    return out.select(*KEYS, "seq", *[r6(F.col(c), 5).alias(c) for c in ("delta", "delta_low", "delta_high")])


def two_point_c(spark, sf_dir):
    pts = _series(spark, sf_dir)
    out = series.two_point_source(pts, KEYS, 0.44)
    return out.select(*KEYS, "seq", r6(F.col("C"), 5).alias("source_c"))


RATES = [round(0.05 * 1.25**k, 6) for k in range(24)]


def three_point_fit(spark, sf_dir):
    pts = _series(spark, sf_dir)
    out = series.three_point_fit(pts, KEYS, RATES)
    return out.select(*KEYS, "seq", r6(F.col("C"), 3).alias("source_c"), "d", r6(F.col("sse"), 3).alias("sse"))


def _residuals(spark, sf_dir):
    return _series(spark, sf_dir).withColumn(
        "residual", F.col("x") - 245.0
    )


def autocorr(spark, sf_dir):
    pts = _residuals(spark, sf_dir)
    one = stats.autocorrelation(pts, KEYS, "residual").withColumnsRenamed({"R": "r1", "z": "z1"})
    two = stats.autocorrelation(pts, KEYS, "residual", 2).select(*KEYS, F.col("R").alias("r2"))
    return one.join(two, KEYS).select(*KEYS, *[r6(F.col(c)).alias(c) for c in ("r1", "z1", "r2")])


def runs_of_signs(spark, sf_dir):
    return stats.runs_of_signs(_residuals(spark, sf_dir), KEYS).select(*KEYS, "n_runs", r6(F.col("z")).alias("z"))


def auc_rect_trapz(spark, sf_dir):
    out = stats.area_under_curve(_points(spark, sf_dir), KEYS, 3, tie="event_id")
    return out.select(*KEYS, r6(F.col("area"), 4).alias("area"))


def auc_rect_trapz_split_keys(spark, sf_dir):
    out = stats.area_under_curve(_points(spark, sf_dir), HOT, 3, tie="event_id", rows_per_task=FEW_ROWS)
    return out.select(*HOT, r6(F.col("area"), 4).alias("area"))


def segment_start_match(spark, sf_dir):
    found = _find(spark, sf_dir).peaks.select("user_id", "event_type", "peak_seq", "peak_t")
    first = found.filter(F.col("event_type") == "view").select("user_id", "peak_seq", "peak_t")
    second = found.filter(F.col("event_type") == "click").select(
        "user_id", F.col("peak_seq").alias("other_seq"), F.col("peak_t").alias("other_t")
    )
    out = asof.match_segment_start(
        first, second, "user_id", "user_id", "peak_t", "other_t", ["other_seq"], "other_seq", 4
    )
    return out.select("user_id", "peak_seq", "other_seq", r6(F.col("t0_dt")).alias("t0_dt"))


# SQL: brute force over positions, no windows over time order except the numbering itself.

_PTS = """
pts AS (
  SELECT user_id, event_type, event_id, epoch_us(ts) / 86400000000.0 AS t, {x} AS x,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS seq FROM events)
"""
_STEP = _PTS.format(x="floor(value / 25) * 25.0")
_HOT_PTS = """
pts AS (
  SELECT 0 AS user_id, event_type, event_id, epoch_us(ts) / 86400000000.0 AS t, {x} AS x,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS seq FROM events)
"""
_HOT_STEP = _HOT_PTS.format(x="floor(value / 25) * 25.0")
_HOT_RAW = _HOT_PTS.format(x="value")
_RAW = _PTS.format(x="value")


def _peaks_sql(pad: str, height: str = "true", prominence: float = 30) -> str:
    """``pad`` stands for the value beyond the ends: the least value of the series, or nothing."""
    return f"""
    ext AS (SELECT user_id, event_type, min(x) AS mn, count(*) AS n FROM pts GROUP BY ALL),
    nb AS (
      SELECT p.*, e.mn, e.n,
        (SELECT max(q.seq) FROM pts q WHERE q.user_id = p.user_id AND q.event_type = p.event_type
          AND q.seq < p.seq AND q.x <> p.x) AS lo,
        (SELECT min(q.seq) FROM pts q WHERE q.user_id = p.user_id AND q.event_type = p.event_type
          AND q.seq > p.seq AND q.x <> p.x) AS hi,
        (SELECT max(q.seq) FROM pts q WHERE q.user_id = p.user_id AND q.event_type = p.event_type
          AND q.seq < p.seq AND q.x > p.x) AS lhi,
        (SELECT min(q.seq) FROM pts q WHERE q.user_id = p.user_id AND q.event_type = p.event_type
          AND q.seq > p.seq AND q.x > p.x) AS rhi
      FROM pts p JOIN ext e ON e.user_id = p.user_id AND e.event_type = p.event_type),
    tops AS (
      SELECT b.*, coalesce(l.x, {pad}) AS lx, coalesce(r.x, {pad}) AS rx FROM nb b
      LEFT JOIN pts l ON l.user_id = b.user_id AND l.event_type = b.event_type AND l.seq = b.lo
      LEFT JOIN pts r ON r.user_id = b.user_id AND r.event_type = b.event_type AND r.seq = b.hi),
    based AS (
      SELECT t.user_id, t.event_type, t.seq, t.t, t.x, t.n,
        t.x - greatest(
          least(min(q.x) FILTER (q.seq <= t.seq AND q.seq > coalesce(t.lhi, -1)),
            CASE WHEN t.lhi IS NULL THEN {pad} END),
          least(min(q.x) FILTER (q.seq >= t.seq AND q.seq < coalesce(t.rhi, 1000000000)),
            CASE WHEN t.rhi IS NULL THEN {pad} END)) AS prominence
      FROM tops t JOIN pts q ON q.user_id = t.user_id AND q.event_type = t.event_type
      WHERE t.lx < t.x AND t.rx < t.x AND {height}
        AND t.seq = (coalesce(t.lo, -1) + 1 + coalesce(t.hi, t.n) - 1) // 2
      GROUP BY t.user_id, t.event_type, t.seq, t.t, t.x, t.n, t.mn, t.lhi, t.rhi),
    peaks AS (
      SELECT *, lead(seq) OVER (PARTITION BY user_id, event_type ORDER BY seq) AS next_seq FROM based
      WHERE prominence >= {prominence})"""


# ul: the end of the stretch, then the first value that does not fall, else (strictly) one before the trough.
_SEGMENTS = """
    stretch AS (
      SELECT k.user_id, k.event_type, k.seq AS ll, k.t AS peak_t, coalesce(k.next_seq, k.n) AS e,
        arg_min(q.seq, struct_pack(x := q.x, s := q.seq)) + 1 AS trough_end
      FROM peaks k JOIN pts q ON q.user_id = k.user_id AND q.event_type = k.event_type
        AND q.seq >= k.seq AND q.seq < coalesce(k.next_seq, k.n)
      GROUP BY ALL),
    viol AS (
      SELECT s.user_id, s.event_type, s.ll, min(b.seq) AS v
      FROM stretch s JOIN pts a ON a.user_id = s.user_id AND a.event_type = s.event_type AND a.seq >= s.ll
      JOIN pts b ON b.user_id = a.user_id AND b.event_type = a.event_type AND b.seq = a.seq + 1
        AND b.seq < s.trough_end AND b.x >= a.x
      GROUP BY ALL),
    segs AS (
      SELECT s.user_id, s.event_type, s.ll, s.peak_t, s.e,
        CASE WHEN v.v IS NOT NULL THEN v.v ELSE {whole} END AS ul
      FROM stretch s LEFT JOIN viol v ON v.user_id = s.user_id AND v.event_type = s.event_type AND v.ll = s.ll)"""
_STRICT = _SEGMENTS.format(whole="greatest(s.trough_end - 1, s.ll)")
_TROUGH = _SEGMENTS.format(whole="s.trough_end")

_SEGPTS = """
    sp AS (
      SELECT s.user_id, s.event_type, s.ll, s.ul, p.seq - s.ll AS pos, p.t, p.x
      FROM segs s JOIN pts p ON p.user_id = s.user_id AND p.event_type = s.event_type
        AND p.seq >= s.ll AND p.seq < s.ul WHERE s.ul - s.ll >= {least}),
    ends AS (
      SELECT user_id, event_type, ll, arg_min(t, pos) AS t0, arg_min(x, pos) AS x0, arg_max(t, pos) AS tz,
        arg_max(x, pos) AS xz FROM sp GROUP BY ALL),
    nx AS (
      SELECT a.*, e.t0, e.x0, e.tz, e.xz, b.t AS t2, b.x AS x2 FROM sp a
      JOIN ends e ON e.user_id = a.user_id AND e.event_type = a.event_type AND e.ll = a.ll
      LEFT JOIN sp b ON b.user_id = a.user_id AND b.event_type = a.event_type AND b.ll = a.ll AND b.pos = a.pos + 1)"""

_SCREEN = """
    steady AS (
      SELECT user_id, event_type, ll,
        max(CASE WHEN pos = 0 AND t2 - t > 5 THEN 1 ELSE 0 END) AS gap,
        min(pos) FILTER ((x - x2) / nullif(t2 - t, 0) / nullif(x0 - xz, 0) < 0.01) AS flat
      FROM nx GROUP BY ALL),
    s1 AS (
      SELECT n.* FROM nx n JOIN steady s ON s.user_id = n.user_id AND s.event_type = n.event_type AND s.ll = n.ll
      WHERE gap = 0 AND (flat IS NULL OR pos <= flat)),
    cnt AS (
      SELECT user_id, event_type, ll, count(*) AS n,
        count(*) FILTER (t < ln(12 / x0) / ln(0.5) * 5 + t0) AS n5,
        count(*) FILTER (t < ln(12 / x0) / ln(0.5) * 10 + t0) AS n10
      FROM s1 GROUP BY ALL),
    s2 AS (
      SELECT s.* FROM s1 s JOIN cnt c ON c.user_id = s.user_id AND c.event_type = s.event_type AND c.ll = s.ll
      WHERE c.n <= {least} OR s.pos < c.n5 + CASE WHEN c.n5 < c.n10 THEN 1 ELSE 0 END),
    traj AS (
      SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type, ll) AS n FROM s2)
      WHERE n > {least} AND x0 > {height})"""

_TRAJ_SQL = (
    f"WITH {_RAW}, {_peaks_sql('mn', f't.x >= {MIN_HEIGHT}', PROMINENCE)}, {_STRICT}, "
    + _SEGPTS.format(least=MIN_POINTS) + ", " + _SCREEN.format(least=MIN_POINTS, height=MIN_HEIGHT)
)
_HALF = """
    mid AS (SELECT *, (x0 - xz) / 2 + xz AS m FROM nx),
    crossing AS (
      SELECT a.user_id, a.event_type, a.ll, a.t0,
        arg_min(a.t + (a.m - a.x) / (a.x2 - a.x) * (a.t2 - a.t), a.pos) - a.t0 AS half_time
      FROM mid a WHERE a.x2 < a.m AND a.x >= a.m GROUP BY a.user_id, a.event_type, a.ll, a.t0)"""
_HALF_BASE = (
    f"WITH {_RAW}, {_peaks_sql('mn', 'true', PROMINENCE)}, {_TROUGH}, " + _SEGPTS.format(least=2) + f", {_HALF}"
)


def _pairs_sql(pts: str) -> str:
    return f"""WITH {pts}, pr AS (
    SELECT a.user_id, a.event_type, a.seq, a.t, a.x, b.t AS t2, b.x AS x2 FROM pts a JOIN pts b
    ON b.user_id = a.user_id AND b.event_type = a.event_type AND b.seq = a.seq + 1)"""


_PAIRS = _pairs_sql(_RAW)


def _excess(d: float) -> str:
    return f"round(x2 - (18 + (x - 18) * exp(-{d} * (t2 - t))), 5) + 0.0"


def _without_user(sql: str) -> str:
    return f"SELECT * EXCLUDE (user_id) FROM ({sql})"


def _positions_sql(pts: str) -> str:
    return f"WITH {pts} SELECT user_id, event_type, seq, round(t, 6) + 0.0 AS t, x FROM pts"


def _means_sql(pts: str) -> str:
    return f"""WITH {pts} SELECT a.user_id, a.event_type, a.seq, round(avg(b.x), 5) + 0.0 AS mean
    FROM pts a JOIN pts b ON b.user_id = a.user_id AND b.event_type = a.event_type
    AND b.seq BETWEEN a.seq - 2 AND a.seq GROUP BY ALL HAVING count(*) = 3"""
def _auc_sql(pts: str) -> str:
    return f"""{_pairs_sql(pts)} SELECT p.user_id, p.event_type, round(coalesce(sum(
    CASE WHEN t2 - pr.t > 3 THEN (t2 - pr.t) * pr.x ELSE (t2 - pr.t) * (pr.x + x2) / 2 END), 0.0), 4) + 0.0 AS area
    FROM pts p LEFT JOIN pr ON pr.user_id = p.user_id AND pr.event_type = p.event_type AND pr.seq = p.seq
    GROUP BY ALL"""

QUERIES = {
    "series": series_positions,
    "series_split_keys": series_positions_split_keys,
    "peaks": peaks,
    "peaks_split_keys": peaks_split_keys,
    "peaks_inner": peaks_inner,
    "segments": segments,
    "segments_peak_to_peak": segments_peak_to_peak,
    "segment_screens": segment_screens,
    "half_time": half_time,
    "tail_cut": tail_cut,
    "trajectories": trajectories,
    "run_meta": run_meta,
    "running_mean": running_mean,
    "running_mean_split_keys": running_mean_split_keys,
    "excess_decay": excess_decay,
    "two_point_c": two_point_c,
    "three_point_fit": three_point_fit,
    "autocorr": autocorr,
    "runs_of_signs": runs_of_signs,
    "auc_rect_trapz": auc_rect_trapz,
    "auc_rect_trapz_split_keys": auc_rect_trapz_split_keys,
    "segment_start_match": segment_start_match,
}

ORACLES = {
    "series": _positions_sql(_RAW),
    "series_split_keys": _without_user(_positions_sql(_HOT_RAW)),
    "peaks": f"""WITH {_STEP}, {_peaks_sql('mn')}
        SELECT user_id, event_type, seq AS peak_seq, x AS peak_x, prominence FROM peaks""",
    "peaks_split_keys": f"""WITH {_HOT_STEP}, {_peaks_sql('mn')}, {_STRICT}
        SELECT p.event_type, p.seq AS peak_seq, p.x AS peak_x, p.prominence, s.ll, s.ul
        FROM peaks p JOIN segs s ON s.event_type = p.event_type AND s.ll = p.seq""",
    "peaks_inner": f"""WITH {_STEP}, {_peaks_sql('NULL', 't.x >= 100')}
        SELECT user_id, event_type, seq AS peak_seq, x AS peak_x, prominence FROM peaks""",
    "segments": f"""WITH {_STEP}, {_peaks_sql('mn')}, {_STRICT}
        SELECT user_id, event_type, ll AS peak_seq, ll, ul FROM segs WHERE ul - ll >= 2""",
    "segments_peak_to_peak": f"""WITH {_STEP}, {_peaks_sql('mn')}
        SELECT user_id, event_type, seq AS peak_seq, seq AS ll, coalesce(next_seq, n) AS ul FROM peaks""",
    "segment_screens": f"WITH {_RAW}, {_peaks_sql('mn', 'true', PROMINENCE)}, {_TROUGH}, "
        + _SEGPTS.format(least=2) + ", " + _SCREEN.format(least=1, height=20)
        + """ SELECT user_id, event_type, ll AS peak_seq, count(*) AS n, round(sum(x), 6) + 0.0 AS total
        FROM traj GROUP BY ALL""",
    "half_time": _HALF_BASE + """ SELECT e.user_id, e.event_type, e.ll AS peak_seq,
        round(c.half_time, 5) + 0.0 AS half_time FROM ends e LEFT JOIN crossing c
        ON c.user_id = e.user_id AND c.event_type = e.event_type AND c.ll = e.ll""",
    "tail_cut": _HALF_BASE + """,
        early AS (
          SELECT n.*, coalesce(n.t - n.t0 < ln(15 / n.x0) / ln(0.5) * 2 * c.half_time, false) AS keep FROM nx n
          LEFT JOIN crossing c ON c.user_id = n.user_id AND c.event_type = n.event_type AND c.ll = n.ll),
        kept AS (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY user_id, event_type, ll) AS k FROM early)
        SELECT user_id, event_type, ll AS peak_seq, count(*) AS n, round(sum(x), 6) + 0.0 AS total
        FROM kept WHERE keep OR k <= 1 GROUP BY ALL""",
    "trajectories": _TRAJ_SQL + """
        SELECT user_id, event_type, user_id || '_' || ll AS traj_id, round(t0, 6) + 0.0 AS t0,
          make_timestamp(CAST(trunc(t0 * 86400) AS BIGINT) * 1000000) AS t0_date, ll AS index_xt_peak,
          round(max(t), 6) + 0.0 AS tf, make_timestamp(CAST(trunc(max(t) * 86400) AS BIGINT) * 1000000) AS tf_date,
          ul AS index_xt_trough, round(max(t) - t0, 6) + 0.0 AS tlen, x0, arg_max(x, pos) AS xf,
          round(x0 - arg_max(x, pos), 6) + 0.0 AS xdelta, count(*) AS n_points
        FROM traj GROUP BY user_id, event_type, ll, ul, t0, x0""",
    "run_meta": _TRAJ_SQL + f"""
        SELECT (SELECT count(DISTINCT user_id) FROM events) AS num_input_ids,
          (SELECT count(*) FROM segs WHERE ul - ll >= {MIN_POINTS}) AS num_peaks,
          (SELECT count(*) FROM traj WHERE pos = 0) AS num_traj_meeting_criteria,
          CAST({MIN_POINTS} AS INT) AS min_peak2trough, CAST({MIN_HEIGHT} AS DOUBLE) AS min_peak_height""",
    "running_mean": _means_sql(_RAW),
    "running_mean_split_keys": _without_user(_means_sql(_HOT_RAW)),
    "excess_decay": f"""{_PAIRS} SELECT user_id, event_type, seq, {_excess(0.44)} AS delta,
        {_excess(0.35)} AS delta_low, {_excess(0.8)} AS delta_high FROM pr""",
    "two_point_c": f"""{_PAIRS} SELECT user_id, event_type, seq, round(greatest(
        0.44 * (x2 - x * exp(-0.44 * (t2 - t))) / nullif(1 - exp(-0.44 * (t2 - t)), 0), 0), 5) + 0.0 AS source_c
        FROM pr""",
    "three_point_fit": f"""{_PAIRS},
        tri AS (
          SELECT a.*, b.t2 AS t3, b.x2 AS x3 FROM pr a JOIN pr b
          ON b.user_id = a.user_id AND b.event_type = a.event_type AND b.seq = a.seq + 1),
        g AS (SELECT tri.*, d, 1 - exp(-d * (t2 - t)) AS z1, 1 - exp(-d * (t3 - t)) AS z2,
            x2 - x * exp(-d * (t2 - t)) AS y1, x3 - x * exp(-d * (t3 - t)) AS y2
          FROM tri, unnest({RATES}::DOUBLE[]) AS r(d)),
        b AS (SELECT *, greatest(coalesce((y1 * z1 + y2 * z2) / nullif(z1 * z1 + z2 * z2, 0), 0), 0) AS lv FROM g),
        e AS (SELECT *, pow(y1 - lv * z1, 2) + pow(y2 - lv * z2, 2) AS sse FROM b),
        k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, seq ORDER BY sse, d) AS rn FROM e)
        SELECT user_id, event_type, seq, round(lv * d, 3) + 0.0 AS source_c, d, round(sse, 3) + 0.0 AS sse
        FROM k WHERE rn = 1""",
    "autocorr": f"""WITH {_RAW},
        m AS (SELECT user_id, event_type, avg(x) AS m, count(*) AS n FROM pts GROUP BY ALL),
        c AS (SELECT a.user_id, a.event_type, m.n, sum((a.x - m) * (a.x - m)) AS c0,
            sum((a.x - m) * (b.x - m)) AS c1, sum((a.x - m) * (d.x - m)) AS c2
          FROM pts a JOIN m ON m.user_id = a.user_id AND m.event_type = a.event_type
          LEFT JOIN pts b ON b.user_id = a.user_id AND b.event_type = a.event_type AND b.seq = a.seq + 1
          LEFT JOIN pts d ON d.user_id = a.user_id AND d.event_type = a.event_type AND d.seq = a.seq + 2
          GROUP BY ALL)
        SELECT user_id, event_type, round(c1 / nullif(c0, 0), 6) + 0.0 AS r1,
          round(c1 / nullif(c0, 0) * sqrt(n), 6) + 0.0 AS z1, round(c2 / nullif(c0, 0), 6) + 0.0 AS r2 FROM c""",
    "runs_of_signs": f"""WITH {_RAW},
        s AS (SELECT user_id, event_type, sign(x - 245.0) AS s,
            row_number() OVER (PARTITION BY user_id, event_type ORDER BY seq) AS k FROM pts WHERE x <> 245.0),
        ch AS (SELECT a.user_id, a.event_type, count(b.s) + 1 AS n_runs FROM s a LEFT JOIN s b
          ON b.user_id = a.user_id AND b.event_type = a.event_type AND b.k = a.k + 1 AND b.s <> a.s GROUP BY ALL),
        c AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (x > 245.0) AS p FROM pts GROUP BY ALL),
        f AS (SELECT c.*, coalesce(n_runs, 1) AS n_runs, 2 * p * (n - p) / n + 1 AS mu
          FROM c LEFT JOIN ch ON ch.user_id = c.user_id AND ch.event_type = c.event_type)
        SELECT user_id, event_type, n_runs, round((n_runs - mu + 0.5) / sqrt(CASE WHEN n > 1 AND (mu - 1) * (mu - 2) > 0
          THEN (mu - 1) * (mu - 2) / (n - 1) END), 6) + 0.0 AS z FROM f""",
    "auc_rect_trapz": _auc_sql(_RAW),
    "auc_rect_trapz_split_keys": _without_user(_auc_sql(_HOT_RAW)),
    "segment_start_match": f"""WITH {_STEP}, {_peaks_sql('mn')},
        c AS (
          SELECT a.user_id, a.seq AS peak_seq, b.seq AS other_seq, b.t - a.t AS d,
            row_number() OVER (PARTITION BY a.user_id, a.seq ORDER BY abs(b.t - a.t), b.t, b.seq) AS rn
          FROM peaks a JOIN peaks b ON b.user_id = a.user_id AND a.event_type = 'view' AND b.event_type = 'click')
        SELECT user_id, peak_seq, other_seq, round(d, 6) + 0.0 AS t0_dt FROM c WHERE rn = 1 AND abs(d) < 4""",
}
