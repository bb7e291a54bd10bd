"""Model fits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driverqueries import fit_sql
from driverqueries.common import events, r6, table
from driverqueries.series_queries import (
    _HALF, _RAW, _SEGPTS, _STRICT, _TROUGH, FEW_ROWS, PROMINENCE, _peaks_sql, _points,
)
from medloom.functions import models as forms
from medloom.functions.time import epoch_days
from medloom.operators import fits, series
from medloom.plans import fitting
from medloom.session import cut_lineage

LEAST = 3


# Falling series of measured values: what is left of each supplier's extended prices after each ship day, in millions,
# over hundreds of days from the first one.


def _remaining(spark, sf_dir):
    """(traj_id, pos, t, x)."""
    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("day")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price"))
    # One order for all, so that the days are sorted once: from the last one, with days numbered from the first.
    by = Window.partitionBy("k").orderBy(F.desc("day"))
    after, whole = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = days.select(
        "k", "day", (F.count(F.lit(1)).over(whole).cast("int") - F.row_number().over(by)).alias("pos"),
        F.min("day").over(whole).alias("_first"), F.sum("price").over(after).alias("left"))
    return cut_lineage(rows.select(
        F.concat(F.lit("s"), F.col("k").cast("string")).alias("traj_id"), "pos",
        (F.datediff("day", "_first") / F.lit(100.0)).alias("t"), (F.col("left").cast("double") / 1000000).alias("x")))


def _fitted(spark, sf_dir):
    points = _remaining(spark, sf_dir)
    return points, fits.fit(points, fits.EX)


def fit_exponential(spark, sf_dir):
    points, best = _fitted(spark, sf_dir)
    stats = fits.fit_statistics(fits.residual_rows(points, best, fits.EX), fits.EX)
    return best.join(stats, "traj_id").select(
        "traj_id", r6(F.col("L0"), 2).alias("l0"), r6(F.col("C"), 2).alias("source_c"), r6(F.col("d"), 4).alias("d"),
        r6(F.col("chisqr"), 2).alias("chisqr"), r6(F.col("nRMSD"), 5).alias("nrmsd"), r6(F.col("qerr"), 5).alias("qerr"),
    )


def fit_errors(spark, sf_dir):
    points, best = _fitted(spark, sf_dir)
    out = fits.fit_errors(fits.residual_rows(points, best, fits.EX), ["traj_id"])
    return out.select("traj_id", *[r6(F.col(c), 4).alias(c.lower()) for c in ("qerr", "MAPE", "nRMSD")])


def fit_curve(spark, sf_dir):
    points, best = _fitted(spark, sf_dir)
    curve = fits.highres_curve(points, best, fits.EX)
    return curve.select("traj_id", "step", r6(F.col("t")).alias("t"), r6(F.col("x"), 1).alias("x"))


def fit_stderr(spark, sf_dir):
    points, best = _fitted(spark, sf_dir)
    errors = fits.standard_errors(points, best, fits.EX)
    return errors.select("traj_id", *[r6(F.col(f"{c}_stderr"), 4).alias(f"{c.lower()}_stderr") for c in ("L0", "C", "d")])


def fit_long_series(spark, sf_dir):
    """One series of all events, far beyond what is searched in one row: how many are left after each, in thousands."""
    day = epoch_days(F.col("ts"))
    rows = _one_series(events(spark, sf_dir).select(day.alias("t"), "event_id"))
    best = fits.fit(cut_lineage(rows), fits.EX)
    return best.select(
        "traj_id", r6(F.col("L0"), 3).alias("l0"), r6(F.col("C"), 3).alias("source_c"), r6(F.col("d"), 4).alias("d"))


def _one_series(rows):
    numbered = series.series(rows.withColumn("traj_id", F.lit("all")), ["traj_id"], "t", "event_id", "event_id", FEW_ROWS)
    ends = numbered.agg(F.min("t").alias("_first"), F.count(F.lit(1)).alias("_n"))  # one row
    rows = numbered.crossJoin(F.broadcast(ends))
    return rows.select(
        "traj_id", F.col("seq").alias("pos"), ((F.col("t") - F.col("_first")) / 10).alias("t"),
        ((F.col("_n") - F.col("seq")) / F.lit(1000.0)).alias("x"))


# The larger models are fitted by SQL too, and their optimum is checked: the error is that of the parameters, no free
# parameter does better a little to either side within its bounds, and the simpler model, where the larger one holds it,
# isn't better.
BOUNDS = {
    "L0": lambda v, c: (v >= 0.2 * c("x0")) & (v <= 10 * c("x0")), "C": lambda v, c: v >= 0, "d": lambda v, c: v > 0,
    "a": lambda v, c: (v >= 0) & (v <= 1), "d1": lambda v, c: (v > 0) & (v < c("d2")), "d2": lambda v, c: v > c("d1"),
    "k": lambda v, c: v >= 0, "tau": lambda v, c: (v >= 0) & (v <= c("t_last")),
}
BOUNDS_FH = {
    "H0": lambda v, c: (v >= 0.5 * c("bHEP")) & (v <= c("bHEP")), "L0": lambda v, c: (v >= 0.5 * c("x0")) & (v <= 2 * c("x0")),
    "a": lambda v, c: (v / c("bHEP") >= fits._KAPPA[0]) & (v / c("bHEP") <= fits._KAPPA[1]), "d": lambda v, c: v > 0,
    "bLFT": lambda v, c: (v >= 10) & (v <= F.greatest(2 * c("x_last"), F.lit(10.0))),
}


def _checked(points, best, model, simpler=None):
    bounds = BOUNDS_FH if model.name == "FH" else BOUNDS
    rows = points.join(best, "traj_id").join(fits.starts(points).drop("n"), "traj_id")
    base = {n: F.col(n) for n in fits.parameters_of(best)}

    def error(values):
        return F.pow(model.value(F.col("t"), values) - F.col("x"), 2)

    moved = {}
    for name in model.free:
        for factor in (0.995, 1.005):
            inside = bounds[name](base[name] * factor, F.col)
            # The switch of the impulse moves between points without a change, so it isn't moved here.
            if name != "tau":
                moved[f"{name}_{factor}"] = F.when(inside, error({**base, name: base[name] * factor}))
    sums = rows.groupBy("traj_id").agg(
        F.max("sse").alias("sse"), F.sum(error(base)).alias("own"), F.count(F.lit(1)).alias("n"),
        *[F.sum(e).alias(f"m{k}") for k, e in enumerate(moved.values())])
    # Parameters are rounded doubles of a search that ends at a step of 1e-9.
    slack = 1e-6 * (F.col("sse") + 1)
    better = F.least(F.lit(1e300), *[F.coalesce(f"m{k}", F.lit(1e300)) for k in range(len(moved))]) < F.col("sse") - slack
    out = sums.select(
        "traj_id", "n", (F.abs(F.col("own") - F.col("sse")) <= slack).alias("own_error"), (~better).alias("no_better"), "sse")
    if simpler is None:
        return out.drop("sse")
    simple = simpler.select("traj_id", F.col("sse").alias("_simple"))
    return out.join(simple, "traj_id").select(
        "traj_id", "n", "own_error", "no_better", (F.col("sse") <= F.col("_simple") * 1.0001 + 1e-6).alias("not_worse"))


# Two decays of which one has no share, or of the same rate, are one: the other's rate says nothing then.
_LEAST_SHARE, _LEAST_RATIO = 1e-6, 1.0001


def fit_biexponential(spark, sf_dir):
    """Parameters of two decays (of one: a = 1, d2 null), error and checks."""
    points, simple = _fitted(spark, sf_dir)
    best = fits.fit(points, fits.BI)
    a, d1, d2 = (F.col(c) for c in ("a", "d1", "d2"))
    one = (a <= _LEAST_SHARE) | (a >= 1 - _LEAST_SHARE) | (d2 <= d1 * _LEAST_RATIO)
    named = best.select(
        "traj_id", r6(F.col("L0"), 2).alias("l0"), r6(F.col("C"), 2).alias("source_c"),
        r6(F.when(one, F.lit(1.0)).otherwise(a), 3).alias("a"),
        r6(F.when(one & (a < 0.5), d2).otherwise(d1), 4).alias("d1"), r6(F.when(~one, d2), 4).alias("d2"),
        r6(F.col("sse"), 2).alias("chisqr"))
    return named.join(_checked(points, best, fits.BI, simple), "traj_id")


def fit_square(spark, sf_dir):
    """Parameters of an impulse (tau null without one), error and checks."""
    points, simple = _fitted(spark, sf_dir)
    best = fits.fit(points, fits.SQ)
    named = best.select(
        "traj_id", r6(F.col("L0"), 2).alias("l0"), r6(F.col("C"), 3).alias("source_c"), r6(F.col("d"), 4).alias("d"),
        r6(F.col("k"), 3).alias("k"), r6(F.when(F.col("k") > _LEAST_SHARE, F.col("tau")), 2).alias("tau"),
        r6(F.col("sse"), 2).alias("chisqr"))
    return named.join(_checked(points, best, fits.SQ, simple), "traj_id")


def fit_cellloss(spark, sf_dir):
    """Parameters of the loss of cells, error and checks."""
    points = _remaining(spark, sf_dir)
    best = fits.fit(points, fits.FH)
    named = best.select(
        "traj_id", r6(F.col("H0"), 1).alias("h0"), r6(F.col("L0"), 2).alias("l0"), r6(F.col("a"), 1).alias("a"),
        r6(F.col("d"), 4).alias("d"), r6(F.col("bLFT"), 2).alias("blft"), r6(F.col("sse"), 2).alias("chisqr"))
    return named.join(_checked(points, best, fits.FH), "traj_id")


def cellmass_curve(spark, sf_dir):
    """The curve of cells at each point: it starts at the fitted number and rises towards the baseline."""
    points = _remaining(spark, sf_dir)
    rows = points.join(fits.fit(points, fits.FH).select("traj_id", "H0", "a", "bHEP"), "traj_id")
    mass = forms.cell_mass(F.col("t"), F.col("H0"), F.col("a"), F.col("bHEP"))
    rows = rows.select("traj_id", "pos", "t", "H0", "bHEP", mass.alias("mass"))
    before = F.lag("mass").over(Window.partitionBy("traj_id").orderBy("pos"))
    slack = 1e-9 * F.col("bHEP")
    return rows.select(
        "traj_id", F.col("pos").cast("bigint").alias("pos"), r6(F.col("t")).alias("t"), r6(F.col("mass"), 1).alias("mass"),
        (F.abs(F.coalesce(before, F.col("H0")) - F.col("mass")) <= F.when(F.col("pos") == 0, slack).otherwise(F.col("bHEP"))).alias("starts_at_h0"),
        ((F.col("mass") >= F.coalesce(before, F.col("H0")) - slack) & (F.col("mass") <= F.col("bHEP") + slack)).alias("rises"))


def _wide(spark, sf_dir):
    points = _remaining(spark, sf_dir)
    return points, fitting.wide_table(points, fitting.fit_models(points), "LAB")


def model_table(spark, sf_dir):
    """All four models: parameters and statistics of the simple one, and that those that hold it fit no worse."""
    _, wide = _wide(spark, sf_dir)
    flags = {n: F.col(f"chisqr_{n}_LAB") <= F.col("chisqr_EX_LAB") * 1.0001 + 1e-6 for n in ("BI", "SQ")}
    return wide.select(
        "traj_id", r6(F.col("L0_EX_LAB"), 2).alias("l0_ex"), r6(F.col("d_EX_LAB"), 4).alias("d_ex"),
        r6(F.col("L0_stderr_EX_LAB"), 3).alias("l0_stderr_ex"), r6(F.col("nRMSD_EX_LAB"), 5).alias("nrmsd_ex"),
        r6(F.col("aic_EX_LAB"), 2).alias("aic_ex"), r6(F.col("bic_EX_LAB"), 2).alias("bic_ex"),
        *[c.alias(f"{n.lower()}_not_worse") for n, c in flags.items()],
        F.col("chisqr_FH_LAB").isNotNull().alias("fh_fitted"))


def model_table_rolling(spark, sf_dir):
    """The wide table of the simple model with the tracks of each point and the next ones."""
    points = _remaining(spark, sf_dir)
    wide = fitting.wide_table(points, fitting.fit_models(points, ("EX",)), "LAB").select("traj_id", "d_EX_LAB")
    out = fitting.with_tracks(wide, fitting.rolling_tracks(points), "LAB")
    digits = {"delta_EX": 5, "delta_EX_LL": 5, "delta_EX_UL": 5, "C_track2": 4, "sse_track3": 7}
    return out.select(
        "traj_id", F.col("pos").cast("bigint").alias("pos"), r6(F.col("d_EX_LAB"), 4).alias("d_ex"),
        *[r6(F.col(f"{c}_LAB"), n).alias(c.lower()) for c, n in digits.items()])


RETRY = {"min_points": 2, "min_height": 20, "prominence": PROMINENCE, "worst_nrmsd": 0.065}


def _retried(spark, sf_dir):
    """Series of events, short and rough, and those of suppliers, which are long and smooth."""
    left = _remaining(spark, sf_dir).select(
        F.substring("traj_id", 2, 20).cast("bigint").alias("user_id"), F.lit("left").alias("event_type"),
        F.col("pos").cast("bigint").alias("event_id"), (F.col("t") * 100).alias("t"), "x")
    points = _points(spark, sf_dir).unionByName(left)
    points = points.withColumn("key", F.concat_ws("_", F.col("user_id").cast("string"), "event_type"))
    return fitting.fit_peaks(points, ["user_id", "event_type", "key"], "key", tie="event_id", **RETRY)


def peaks_fit_retry(spark, sf_dir):
    """Fits of falling stretches, tried again without their tails where they fail."""
    return _retried(spark, sf_dir).table.select(
        "traj_id", "outcome", F.col("n").cast("bigint").alias("n"), F.col("n_used").cast("bigint").alias("n_used"),
        r6(F.col("tlen")).alias("tlen"), "x0", "xf", r6(F.col("nRMSD"), 3).alias("nrmsd"))


def loop_counts(spark, sf_dir):
    return _retried(spark, sf_dir).counts


def peaks_near_dates_fit(spark, sf_dir):
    """Fits of short falling stretches: whether the error is that of the parameters and no other rate does better.

    Short stretches leave the rate undetermined, so the optimum is checked and not the rate: against 200 other rates
    with the level and the source that the fit has found.
    """
    dates = events(spark, sf_dir, "signup").groupBy("user_id").agg(F.min(epoch_days(F.col("ts"))).alias("day"))
    best, points = fitting.peaks_and_fit(
        _points(spark, sf_dir).withColumn("key", F.concat_ws("_", F.col("user_id").cast("string"), "event_type")),
        ["user_id", "event_type", "key"], "key", dates, "day", 5, LEAST, 20, PROMINENCE, include_trough=True, tie="event_id",
    )
    rows = points.select("traj_id", "t", "x").join(best, "traj_id")
    rows = rows.withColumn("other", F.explode(F.array(*[F.lit(0.001 * 1.06**i) for i in range(200)], F.col("d"))))
    value = forms.exponential(F.col("t"), F.col("L0"), F.col("drvBLFT") * F.col("other"), F.col("other"))
    errors = rows.groupBy("traj_id", "other", "d", "sse").agg(F.sum((value - F.col("x")) ** 2).alias("error"))
    slack = 1e-6 * (F.col("sse") + 1)
    return errors.groupBy("traj_id").agg(
        F.bool_and(F.col("error") >= F.col("sse") - slack).alias("no_better"),
        F.bool_or((F.col("other") == F.col("d")) & (F.abs(F.col("error") - F.col("sse")) <= slack)).alias("own_error"),
    )


# SQL: own rates, the normal equations summed per trajectory and rate, all bounded cases compared, and the grid refined
# around the best rate.

_REMAINING = """days AS (SELECT l_suppkey AS k, l_shipdate AS day, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS price
      FROM lineitem GROUP BY ALL),
    tp AS MATERIALIZED (SELECT traj_id, pos, t, x, first(x) OVER (PARTITION BY traj_id ORDER BY pos) AS x0 FROM (
      SELECT 's' || k AS traj_id, row_number() OVER (PARTITION BY k ORDER BY day) - 1 AS pos,
        date_diff('day', CAST(min(day) OVER (PARTITION BY k) AS DATE), CAST(day AS DATE)) / 100.0::DOUBLE AS t,
        CAST(sum(price) OVER (PARTITION BY k ORDER BY day DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 1000000 AS x
      FROM days))"""
_SIGNED_UP = f"{PROMINENCE} AND EXISTS (SELECT 1 FROM signup s WHERE s.du = based.user_id AND abs(based.t - s.day) <= 5)"
_NEAR_DATES = f"""WITH {_RAW},
    signup AS (SELECT user_id AS du, min(epoch_us(ts)) / 86400000000.0 AS day FROM events WHERE event_type = 'signup'
      GROUP BY user_id), {_peaks_sql('mn', 't.x >= 20', _SIGNED_UP)}, {_TROUGH}, """ + _SEGPTS.format(least=LEAST) + """
    SELECT DISTINCT user_id || '_' || event_type || '_' || ll AS traj_id, true AS no_better, true AS own_error FROM nx"""


def _round_sql(name: str, candidates: str) -> str:
    return f"""
    {name}g AS (
      SELECT traj_id, x0, d, sum((1 - u) * (1 - u)) AS g00, sum((1 - u) * u) AS g01, sum(u * u) AS g11,
        sum((1 - u) * x) AS b0, sum(u * x) AS b1, sum(x * x) AS xx
      FROM (SELECT tp.traj_id, tp.x0, c.d, tp.x, exp(-c.d * tp.t) AS u FROM tp JOIN {candidates} c ON c.traj_id = tp.traj_id)
      GROUP BY ALL),
    {name}c AS (
      SELECT *, unnest([
        struct_pack(p := (b0 * g11 - b1 * g01) / nullif(CASE WHEN g00 * g11 - g01 * g01 > 1e-12 * g00 * g11
            THEN g00 * g11 - g01 * g01 END, 0),
          q := (b1 * g00 - b0 * g01) / nullif(CASE WHEN g00 * g11 - g01 * g01 > 1e-12 * g00 * g11
            THEN g00 * g11 - g01 * g01 END, 0)),
        struct_pack(p := 0.0::DOUBLE, q := b1 / nullif(g11, 0)),
        struct_pack(p := (b0 - g01 * 0.2 * x0) / nullif(g00, 0), q := 0.2 * x0),
        struct_pack(p := (b0 - g01 * 10 * x0) / nullif(g00, 0), q := 10 * x0),
        struct_pack(p := 0.0::DOUBLE, q := 0.2 * x0),
        struct_pack(p := 0.0::DOUBLE, q := 10 * x0)]) AS s FROM {name}g),
    {name}e AS (
      SELECT traj_id, d, s.p AS p, s.q AS q,
        greatest(xx - 2 * (s.p * b0 + s.q * b1) + s.p * s.p * g00 + 2 * s.p * s.q * g01 + s.q * s.q * g11, 0) AS sse
      FROM {name}c WHERE s.p >= -1e-9 * greatest(abs(s.p), 1) AND s.q >= 0.2 * x0 - 1e-9 * greatest(abs(s.q), 1)
        AND s.q <= 10 * x0 + 1e-9 * greatest(abs(s.q), 1)),
    {name} AS MATERIALIZED (
      SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY sse, d, p, q) AS rn FROM {name}e) WHERE rn = 1)"""


_GRID = f"grid AS (SELECT DISTINCT traj_id, unnest({[0.001 * 1.15**i for i in range(90)]}::DOUBLE[]) AS d FROM tp)"
_FINE = "".join(
    f""", n{i} AS (SELECT traj_id, d * unnest({[1.15 ** (j / 8 ** i) for j in range(-8, 9)]}::DOUBLE[]) AS d FROM f{i - 1}),
    {_round_sql(f"f{i}", f"n{i}")}""" for i in range(1, 9)
)
_FIT = f"WITH {_REMAINING}, {_GRID}, {_round_sql('f0', 'grid')}{_FINE}"


def _resid_sql(fit: str) -> str:
    return f"""rs AS (SELECT tp.traj_id, tp.x, f.p + (f.q - f.p) * exp(-f.d * tp.t) - tp.x AS r
        FROM tp JOIN {fit} f ON f.traj_id = tp.traj_id),
      st AS (SELECT traj_id, sum(r * r) AS chisqr, sqrt(avg(r * r)) / nullif(max(x) - min(x), 0) AS nrmsd,
          avg(abs(r)) / nullif(greatest(max(x), max(x + r)) - least(min(x), min(x + r)), 0) AS qerr,
          avg(abs(r) / nullif(x, 0)) AS mape FROM rs GROUP BY traj_id)"""


QUERIES = {
    "fit_exponential": fit_exponential,
    "fit_errors": fit_errors,
    "fit_curve": fit_curve,
    "fit_biexponential": fit_biexponential,
    "fit_square": fit_square,
    "fit_cellloss": fit_cellloss,
    "fit_stderr": fit_stderr,
    "cellmass_curve": cellmass_curve,
    "model_table": model_table,
    "peaks_near_dates_fit": peaks_near_dates_fit,
    "model_table_rolling": model_table_rolling,
    "fit_long_series": fit_long_series,
    "peaks_fit_retry": peaks_fit_retry,
    "loop_counts": loop_counts,
}


_FH_FIT = f"WITH {_REMAINING}, {fit_sql.fitted(fit_sql.FH)}"
_COUNTS = "JOIN (SELECT traj_id, count(*) AS n FROM tp GROUP BY traj_id) USING (traj_id)"
_FLAGS = "n, true AS own_error, true AS no_better"

# Stretches of events that meet the criteria of a retried fit, two attempts, and the cut between them.
_LEAST_POINTS, _WORST = RETRY["min_points"], RETRY["worst_nrmsd"]


def _attempt_sql(name: str) -> str:
    """Best fit of the points in tp and its error relative to their range."""
    rounds = [f"{name}grid AS (SELECT DISTINCT traj_id, unnest({[0.0001 * 1.15**i for i in range(130)]}::DOUBLE[]) AS d FROM {name}tp)",
              _round_sql(f"{name}0", f"{name}grid").replace(" tp ", f" {name}tp ").replace("tp.", f"{name}tp.")]
    for i in range(1, 9):
        steps = [1.15 ** (j / 8**i) for j in range(-8, 9)]
        rounds.append(f"{name}n{i} AS (SELECT traj_id, d * unnest({steps}::DOUBLE[]) AS d FROM {name}{i - 1})")
        rounds.append(_round_sql(f"{name}{i}", f"{name}n{i}").replace(" tp ", f" {name}tp ").replace("tp.", f"{name}tp."))
    rounds.append(f"""{name}e AS (SELECT p.traj_id, sqrt(max(f.sse) / count(*)) / nullif(max(p.x) - min(p.x), 0) AS nrmsd
      FROM {name}tp p JOIN {name}8 f ON f.traj_id = p.traj_id GROUP BY p.traj_id)""")
    return ", ".join(rounds)


_BOTH = _REMAINING + """,
    pts AS (
      SELECT user_id, event_type, event_id, t, x, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) - 1 AS seq
      FROM (SELECT user_id, event_type, event_id, epoch_us(ts) / 86400000000.0 AS t, value AS x FROM events
        UNION ALL SELECT CAST(traj_id[2:] AS BIGINT), 'left', pos, t * 100, x FROM tp))"""
_RETRY = f"WITH {_BOTH}, {_peaks_sql('mn', 't.x >= 20', PROMINENCE)}, {_STRICT}, " + _SEGPTS.format(least=1) + f""", {_HALF},
    big AS (SELECT user_id, event_type, ll, count(*) AS n FROM sp GROUP BY ALL),
    ok AS MATERIALIZED (
      SELECT nx.user_id || '_' || nx.event_type || '_' || nx.ll AS traj_id, nx.pos, nx.t - nx.t0 AS t, nx.x, nx.x0, nx.xz,
        nx.tz - nx.t0 AS tlen, n, coalesce(nx.t - nx.t0 < ln(15 / nx.x0) / ln(0.5) * 2 * half_time, false) AS early
      FROM nx JOIN big USING (user_id, event_type, ll) LEFT JOIN crossing c USING (user_id, event_type, ll)
      WHERE n > {_LEAST_POINTS} AND nx.x0 > 20),
    atp AS MATERIALIZED (SELECT traj_id, pos, t, x, x0 FROM ok), {_attempt_sql('a')},
    first_ok AS (SELECT traj_id FROM ae WHERE nrmsd <= {_WORST}),
    cut AS (SELECT *, count(*) FILTER (early) OVER (PARTITION BY traj_id) AS kept FROM ok ANTI JOIN first_ok USING (traj_id)),
    btp AS MATERIALIZED (SELECT traj_id, pos, t, x, x0 FROM cut WHERE early AND kept > {_LEAST_POINTS} AND kept < n),
    {_attempt_sql('b')},
    second_ok AS (SELECT traj_id FROM be WHERE nrmsd <= {_WORST}),
    used AS (SELECT traj_id, count(*) AS n_used FROM btp SEMI JOIN second_ok USING (traj_id) GROUP BY traj_id)"""
_TRIPLE = """
    pr AS (SELECT a.*, b.t AS t2, b.x AS x2, c.t AS t3, c.x AS x3 FROM tp a
      JOIN tp b ON b.traj_id = a.traj_id AND b.pos = a.pos + 1
      LEFT JOIN tp c ON c.traj_id = a.traj_id AND c.pos = a.pos + 2),
    r0 AS (SELECT *, {grid}::DOUBLE[] AS ds FROM pr WHERE t3 IS NOT NULL)"""


def _triple_round(k: int) -> str:
    """The best of the rates ``ds`` per row, and the rates of the next round."""
    tried = """list_min(list_transform(list_transform(ds, lambda d: struct_pack(d := d,
        z2 := 1 - exp(-d * (t2 - t)), z3 := 1 - exp(-d * (t3 - t)),
        y2 := x2 - x * exp(-d * (t2 - t)), y3 := x3 - x * exp(-d * (t3 - t)))),
        lambda s: struct_pack(sse := pow(s.y2 - greatest(coalesce((s.y2 * s.z2 + s.y3 * s.z3) / nullif(s.z2 * s.z2 + s.z3 * s.z3, 0), 0), 0) * s.z2, 2)
          + pow(s.y3 - greatest(coalesce((s.y2 * s.z2 + s.y3 * s.z3) / nullif(s.z2 * s.z2 + s.z3 * s.z3, 0), 0), 0) * s.z3, 2), d := s.d)))"""
    steps = [1.25 ** (j / 4 ** (k + 1)) for j in range(-4, 5)]
    return f"""b{k} AS (SELECT * EXCLUDE (ds), {tried} AS best FROM r{k}),
    r{k + 1} AS (SELECT * EXCLUDE (best), list_transform({steps}::DOUBLE[], lambda f: best.d * f) AS ds, best.sse AS sse FROM (
      SELECT b{k}.* FROM b{k}))""".replace("SELECT * EXCLUDE (ds), ", "SELECT * EXCLUDE (ds" + (", sse" if k else "") + "), ")


_ROLLING = _FIT + ", " + _TRIPLE.format(grid=[0.001 * 1.25**k for k in range(56)]) + ", " + ", ".join(_triple_round(k) for k in range(9))

ORACLES = {
    "fit_exponential": _FIT + f""", {_resid_sql('f8')}
        SELECT f8.traj_id, round(q, 2) + 0.0 AS l0, round(p * d, 2) + 0.0 AS source_c, round(d, 4) + 0.0 AS d,
          round(chisqr, 2) + 0.0 AS chisqr, round(nrmsd, 5) + 0.0 AS nrmsd, round(qerr, 5) + 0.0 AS qerr
        FROM f8 JOIN st ON st.traj_id = f8.traj_id""",
    "fit_errors": _FIT + f""", {_resid_sql('f8')}
        SELECT traj_id, round(qerr, 4) + 0.0 AS qerr, round(mape, 4) + 0.0 AS mape, round(nrmsd, 4) + 0.0 AS nrmsd
        FROM st""",
    "fit_curve": _FIT + """,
        e AS (SELECT traj_id, ceil(max(t)) AS z FROM tp GROUP BY traj_id),
        s AS (SELECT f8.*, CAST(i AS INT) AS step, i * z / 49 AS t FROM f8 JOIN e ON e.traj_id = f8.traj_id, range(50) r(i))
        SELECT traj_id, step, round(t, 6) + 0.0 AS t, round(p + (q - p) * exp(-d * t), 1) + 0.0 AS x FROM s""",
    "fit_stderr": _FIT + """,
        j AS (SELECT tp.traj_id, exp(-d * t) AS j0, (1 - exp(-d * t)) / d AS j1,
            -p / d * (1 - exp(-d * t)) - (q - p) * t * exp(-d * t) AS j2,
            p + (q - p) * exp(-d * t) - x AS r FROM tp JOIN f8 ON f8.traj_id = tp.traj_id),
        g AS (SELECT traj_id, count(*) AS n, sum(r * r) AS e, sum(j0 * j0) AS a, sum(j0 * j1) AS b, sum(j0 * j2) AS c,
            sum(j1 * j1) AS f, sum(j1 * j2) AS h, sum(j2 * j2) AS i FROM j GROUP BY traj_id),
        v AS (SELECT *, e / (n - 3) / (a * (f * i - h * h) - b * (b * i - h * c) + c * (b * h - f * c)) AS w FROM g)
        SELECT traj_id, round(sqrt(w * (f * i - h * h)), 4) + 0.0 AS l0_stderr,
          round(sqrt(w * (a * i - c * c)), 4) + 0.0 AS c_stderr, round(sqrt(w * (a * f - b * b)), 4) + 0.0 AS d_stderr
        FROM v""",
    "fit_biexponential": f"""WITH {_REMAINING}, {fit_sql.fitted(fit_sql.BI)},
        shares AS (SELECT *, c1 / (c1 + c2) AS share FROM best),
        kinds AS (SELECT *, share <= {_LEAST_SHARE} OR share >= 1 - {_LEAST_SHARE} OR r2 <= r1 * {_LEAST_RATIO} AS one FROM shares)
        SELECT traj_id, round(c1 + c2, 2) + 0.0 AS l0, round(c0, 2) + 0.0 AS source_c,
          round(CASE WHEN one THEN 1.0 ELSE share END::DOUBLE, 3) + 0.0 AS a,
          round(CASE WHEN one AND share < 0.5 THEN r2 ELSE r1 END, 4) + 0.0 AS d1, round(CASE WHEN NOT one THEN r2 END, 4) + 0.0 AS d2,
          round(sse, 2) + 0.0 AS chisqr, {_FLAGS}, true AS not_worse FROM kinds {_COUNTS}""",
    "fit_square": f"""WITH {_REMAINING}, {fit_sql.switched()}
        SELECT traj_id, round(c2, 2) + 0.0 AS l0, round(c0 * r1, 3) + 0.0 AS source_c, round(r1, 4) + 0.0 AS d,
          round(c1 * r1, 3) + 0.0 AS k, round(CASE WHEN c1 * r1 > {_LEAST_SHARE} THEN r2 END, 2) + 0.0 AS tau,
          round(sse, 2) + 0.0 AS chisqr, {_FLAGS}, true AS not_worse FROM best {_COUNTS}""",
    "fit_cellloss": _FH_FIT + f"""
        SELECT traj_id, round((1 + c1 / c0) * {forms.LIVER_CELLS!r}, 1) + 0.0 AS h0, round(c2, 2) + 0.0 AS l0,
          round(r2 * {forms.LIVER_CELLS!r}, 1) + 0.0 AS a, round(r1, 4) + 0.0 AS d, round(c0, 2) + 0.0 AS blft,
          round(sse, 2) + 0.0 AS chisqr, {_FLAGS} FROM best {_COUNTS}""",
    "cellmass_curve": _FH_FIT + f"""
        SELECT traj_id, pos, round(t, 6) + 0.0 AS t, round({forms.LIVER_CELLS!r} * (1 + c1 / c0 * exp(-r2 * t)), 1) + 0.0 AS mass,
          true AS starts_at_h0, true AS rises FROM tp JOIN best USING (traj_id)""",
    "model_table_rolling": _ROLLING + """
        SELECT f8.traj_id, p.pos, round(f8.d, 4) + 0.0 AS d_ex,
          round(x2 - x * exp(-0.44 * (t2 - t)), 5) + 0.0 AS delta_ex, round(x2 - x * exp(-0.35 * (t2 - t)), 5) + 0.0 AS delta_ex_ll,
          round(x2 - x * exp(-0.8 * (t2 - t)), 5) + 0.0 AS delta_ex_ul,
          round(greatest(0.44 * (x2 - x * exp(-0.44 * (t2 - t))) / nullif(1 - exp(-0.44 * (t2 - t)), 0), 0), 4) + 0.0 AS c_track2,
          round(r9.sse, 7) + 0.0 AS sse_track3
        FROM f8 LEFT JOIN (SELECT pr.*, r9.sse FROM pr LEFT JOIN r9 ON r9.traj_id = pr.traj_id AND r9.pos = pr.pos) p
          ON p.traj_id = f8.traj_id""".replace("round(r9.sse", "round(p.sse"),
    "fit_long_series": "WITH tp AS MATERIALIZED (SELECT 'all' AS traj_id, pos, t, x, first(x) OVER (ORDER BY pos) AS x0 FROM ("
        """SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 864000000000.0 AS t,
          (count(*) OVER () - (row_number() OVER (ORDER BY ts, event_id) - 1)) / 1000.0::DOUBLE AS x FROM events)), """
        + f"{_GRID}, {_round_sql('f0', 'grid')}{_FINE}" + """
        SELECT traj_id, round(q, 3) + 0.0 AS l0, round(p * d, 3) + 0.0 AS source_c, round(d, 4) + 0.0 AS d FROM f8""",
    "peaks_fit_retry": _RETRY + """
        SELECT ok.traj_id, CASE WHEN f.traj_id IS NOT NULL THEN 'first' WHEN s.traj_id IS NOT NULL THEN 'second' ELSE 'failed' END AS outcome,
          n, coalesce(n_used, n) AS n_used, round(tlen, 6) + 0.0 AS tlen, ok.x0, xz AS xf,
          round(CASE WHEN f.traj_id IS NOT NULL THEN ae.nrmsd WHEN s.traj_id IS NOT NULL THEN be.nrmsd END, 3) + 0.0 AS nrmsd
        FROM ok LEFT JOIN first_ok f USING (traj_id) LEFT JOIN second_ok s USING (traj_id) LEFT JOIN used USING (traj_id)
          LEFT JOIN ae USING (traj_id) LEFT JOIN be USING (traj_id) WHERE pos = 0""",
    "loop_counts": _RETRY + """
        SELECT (SELECT count(*) FROM peaks) AS num_peaks, (SELECT count(*) FROM ok WHERE pos = 0) AS num_meeting_traj_criteria,
          (SELECT count(*) FROM first_ok) + (SELECT count(*) FROM second_ok) AS num_fit, (SELECT count(*) FROM second_ok) AS num_fit_after_cut""",
    "model_table": _FIT + f""", {_resid_sql('f8')},
        j AS (SELECT tp.traj_id, exp(-d * t) AS j0, (1 - exp(-d * t)) / d AS j1,
            -p / d * (1 - exp(-d * t)) - (q - p) * t * exp(-d * t) AS j2,
            p + (q - p) * exp(-d * t) - x AS r FROM tp JOIN f8 ON f8.traj_id = tp.traj_id),
        g AS (SELECT traj_id, count(*) AS n, sum(r * r) AS e, sum(j0 * j0) AS a, sum(j0 * j1) AS b, sum(j0 * j2) AS c,
            sum(j1 * j1) AS f, sum(j1 * j2) AS h, sum(j2 * j2) AS i FROM j GROUP BY traj_id),
        v AS (SELECT *, e / (n - 3) / (a * (f * i - h * h) - b * (b * i - h * c) + c * (b * h - f * c)) AS w FROM g)
        SELECT f8.traj_id, round(q, 2) + 0.0 AS l0_ex, round(d, 4) + 0.0 AS d_ex, round(sqrt(w * (f * i - h * h)), 3) + 0.0 AS l0_stderr_ex,
          round(nrmsd, 5) + 0.0 AS nrmsd_ex, round(n * ln(e / n) + 6, 2) + 0.0 AS aic_ex, round(n * ln(e / n) + 3 * ln(n), 2) + 0.0 AS bic_ex,
          true AS bi_not_worse, true AS sq_not_worse, true AS fh_fitted
        FROM f8 JOIN st ON st.traj_id = f8.traj_id JOIN v ON v.traj_id = f8.traj_id""",
    "peaks_near_dates_fit": _NEAR_DATES,
}
