"""Series per key in time order: positions, peaks, peak-to-trough segments, screens and rolling tracks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from medloom.functions.time import date_from_days
from medloom.operators.ordered import ROWS_PER_TASK, Rows, run_by_size, scan
from medloom.operators.peaks import prominences
from medloom.session import cut_lineage

# Fixed values of the screens.
FIRST_GAP_DAYS = 5
STEADY_STATE_CUTOFF = 0.01
NORMAL_VALUE = 12
TAIL_HALF_LIVES = (5, 10)
REFIT_NORMAL_VALUE = 15
REFIT_HALF_LIVES = 2


def series(
    df: DataFrame, keys: list[str], time: str, value: str, tie: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """(keys, seq, t, x): position from 0 in time order, epoch days and value."""
    rows = df.select(*keys, F.col(time).alias("t"), F.col(tie).alias("_tie"), F.col(value).alias("x"))

    def number(rows: Rows) -> DataFrame:
        out = scan(rows, running={"_n": F.lit(1)}).df
        return out.select(*keys, (F.col("_n") - 1).cast("bigint").alias("seq"), "t", "x")

    return run_by_size(rows, keys, ["t", "_tie"], number, rows_per_task)


def one_series(df: DataFrame, key: Column, time: str) -> DataFrame:
    """Rows of one key in time order."""
    return df.filter(key).orderBy(time)


class Peaks(NamedTuple):
    """``points`` with the peak each belongs to, and ``peaks`` with their segments."""

    points: DataFrame
    peaks: DataFrame


def _with_tops(rows: Rows, edge: bool, min_height: float | None) -> Rows:
    """Mark local maxima (a flat top once, at its middle) and count them along the series."""
    x = F.col("x")
    rows = scan(rows, running={"_n": F.lit(1)}, last_before={"_prev": x}, whole={"_min": (F.min, x), "_len": (F.sum, F.lit(1))})
    start = F.col("_prev").isNull() | (F.col("_prev") != x)
    rows = rows.with_df(
        rows.df.withColumn("seq", (F.col("_n") - 1).cast("bigint"))
        .withColumn("_start", start)
        .withColumn("_rise", F.when(F.col("_prev") <= x, 1).otherwise(0))
    )
    # From here on the position is the order, so that rows of equal time stand the same way round in every scan.
    rows = rows._replace(order=["seq"])
    run = F.when(F.col("_start"), F.struct("seq", "_prev"))
    following = F.when(F.col("_start"), F.struct("seq", "x"))
    rows = scan(rows, last={"_run": run}, next_after={"_following": following}, running={"_rises": F.col("_rise")})
    before, after = F.col("_run._prev"), F.col("_following.x")
    if edge:
        before, after = F.coalesce(before, F.col("_min")), F.coalesce(after, F.col("_min"))
    last = F.coalesce(F.col("_following.seq"), F.col("_len")) - 1
    top = (x > before) & (x > after) & (F.col("seq") == F.floor((F.col("_run.seq") + last) / 2))
    if min_height is not None:
        top = top & (x >= min_height)
    rows = rows.with_df(rows.df.withColumn("is_top", F.coalesce(top, F.lit(False))))
    mark = F.col("is_top").cast("int")
    rows = scan(
        rows,
        running={"top_no": mark},
        last={"_top_rises": F.when(F.col("is_top"), F.col("_rises"))},
        whole={"_tops": (F.sum, mark)},
    )
    # Falling: no value since the peak was as high as the one before it.
    falling = (F.col("top_no") > 0) & (F.col("_rises") == F.col("_top_rises"))
    return rows.with_df(
        rows.df.select(
            *rows.parts, "seq", "t", "x", "is_top", F.col("top_no").cast("bigint").alias("top_no"),
            falling.alias("falling"), F.col("_min"), F.col("_tops").cast("bigint").alias("_tops"),
        )
    )


def find_peaks(
    points: DataFrame,
    keys: list[str],
    prominence: float = 25,
    min_height: float | None = None,
    edge: bool = False,
    mode: str = "peak_to_min",
    strict: bool = True,
    include_trough: bool = False,
    min_points: int = 0,
    rows_per_task: int = ROWS_PER_TASK,
    tie: str | None = None,
    choose: Callable[[DataFrame], DataFrame] | None = None,
) -> Peaks:
    """Peaks of (keys, t, x[, tie]) and the segment that follows each.

    A segment runs from its peak to the first minimum before the next peak (``peak_to_min``) or up to the next
    peak (``peak_to_peak``); ``strict`` ends it before the first value that is not lower than its predecessor.
    A strict segment without such a value loses its last point unless ``include_trough``. Segments with fewer
    than ``min_points`` points are dropped with their peak. Positions ``ll`` (first) and ``ul`` (one past the
    last) count from 0. Points of one time are ordered by ``tie``, then by value.

    ``choose`` gets the prominent peaks as (keys, peak_t, ...) and returns the rows to keep; a segment then runs to the
    next kept peak. Points are numbered once and written to the checkpoint folder, as peaks and segments read them.
    """
    if mode not in ("peak_to_min", "peak_to_peak"):
        raise ValueError(f"unknown mode {mode!r}")
    seen: list[Rows] = []

    def mark(rows: Rows) -> DataFrame:
        marked = _with_tops(rows, edge, min_height)
        seen.append(marked)
        return marked.df.drop("_chunk")

    order = ["t", "x"] if tie is None else ["t", tie, "x"]
    marked = cut_lineage(run_by_size(points, keys, order, mark, rows_per_task))
    longest = max(rows.longest for rows in seen)
    peaks = _segments(
        marked, keys, prominence, edge, mode, strict, include_trough, longest, rows_per_task, choose
    ).filter(F.col("ul") - F.col("ll") >= min_points)
    return Peaks(marked.select(*keys, "seq", "t", "x", "top_no", "falling"), peaks)


def _segments(
    marked, keys, prominence, edge, mode, strict, include_trough, longest, rows_per_task, choose=None
) -> DataFrame:
    """One row per peak: a summary of the stretch after every local maximum, then of the stretches up to the
    next peak that is prominent enough."""
    top = F.when(F.col("is_top"), F.struct("seq", "t", "x"))
    stretches = (
        marked.filter(F.col("_tops") > 0)
        .groupBy(*keys, "top_no")
        .agg(
            F.max(top).alias("_top"),
            F.min(F.struct("x", "seq")).alias("_low"),
            F.min(F.when(~F.col("falling"), F.col("seq"))).alias("_broken"),
            F.max("seq").alias("_last"),
            F.max("_tops").alias("_tops"),
            F.max("_min").alias("_min"),
        )
    )
    own = F.struct(F.col("top_no").alias("i"), F.col("_top.x").alias("h"), F.col("_low.x").alias("v"))
    if edge:
        def padding(place):
            return F.struct(place.alias("i"), F.lit(None).cast("double").alias("h"), F.col("_min").alias("v"))

        parts = F.array(
            F.when(F.col("top_no") > 0, own),
            F.when(F.col("top_no") == 1, padding(F.lit(0).cast("bigint"))),
            F.when(F.col("top_no") == F.col("_tops"), padding(F.col("_tops") + 1)),
        )
    else:
        parts = F.array(own)
    nodes = stretches.select(*keys, F.explode(F.array_compact(parts)).alias("_e")).select(*keys, "_e.*")
    prominent = prominences(nodes, keys, longest // 2 + 2).filter(F.col("prominence") >= prominence)
    if choose is not None:
        placed = stretches.select(*keys, F.col("top_no").alias("i"), F.col("_top.t").alias("peak_t"))
        prominent = choose(prominent.join(placed, [*keys, "i"])).select(*keys, "i", "prominence")
    flagged = stretches.filter(F.col("top_no") > 0).join(
        prominent.withColumnRenamed("i", "top_no"), [*keys, "top_no"], "left"
    )
    kept = F.col("prominence").isNotNull()

    def group(rows: Rows) -> DataFrame:
        return scan(rows, running={"_segment": kept.cast("int")}).df.drop("_chunk")

    grouped = run_by_size(flagged, keys, ["top_no"], group, rows_per_task, longest=longest // 2 + 2)
    peaks = (
        grouped.filter(F.col("_segment") > 0)
        .groupBy(*keys, "_segment")
        .agg(
            F.min("top_no").alias("top_no"),
            F.max("top_no").alias("last_top_no"),
            F.min(F.struct("top_no", "_top", "prominence")).alias("_first"),
            # A weaker maximum inside the segment is itself a rise.
            F.min(F.when(kept, F.col("_broken")).otherwise(F.col("_top.seq"))).alias("_broken"),
            F.min("_low").alias("_low"),
            F.max("_last").alias("_last"),
        )
    )
    ll = F.col("_first._top.seq")
    end = F.col("_low.seq") + 1 if mode == "peak_to_min" else F.col("_last") + 1
    if strict:
        whole = end if include_trough else F.greatest(end - 1, ll)
        end = F.when(F.col("_broken") < end, F.col("_broken")).otherwise(whole)
    return peaks.select(
        *keys,
        F.col("_first._top.seq").alias("peak_seq"),
        F.col("_first._top.t").alias("peak_t"),
        F.col("_first._top.x").alias("peak_x"),
        F.col("_first.prominence").alias("prominence"),
        "top_no",
        "last_top_no",
        ll.alias("ll"),
        end.alias("ul"),
    )


def segment_points(found: Peaks, keys: list[str], strict: bool = True) -> DataFrame:
    """(keys, peak_seq, pos, t, x) of every segment; the join is on (key, stretch), not on the key alone."""
    segments = found.peaks.select(*keys, "peak_seq", "ll", "ul", "top_no", "last_top_no")
    points = found.points.filter(F.col("top_no") > 0)
    if strict:
        points = points.filter("falling")
        segments = segments.drop("last_top_no")
    else:
        segments = segments.withColumn("top_no", F.explode(F.sequence("top_no", "last_top_no"))).drop("last_top_no")
    inside = (F.col("seq") >= F.col("ll")) & (F.col("seq") < F.col("ul"))
    return points.join(segments, [*keys, "top_no"]).filter(inside).select(
        *keys, "peak_seq", (F.col("seq") - F.col("ll")).alias("pos"), "t", "x", "ll", "ul"
    )


# Screens. Each takes points with a position per segment and returns those that stay.


class Screens(NamedTuple):
    first_gap: bool = True
    steady_state: bool = True
    steady_state_cutoff: float = STEADY_STATE_CUTOFF
    long_tail: bool = True
    scale_by_half_time: bool = False


def _ends(rows: Rows) -> Rows:
    """First and last point of the segment and the next point, on every row."""
    point = F.struct("pos", "t", "x")
    return scan(
        rows, next_after={"_next": F.struct("t", "x")}, whole={"_first": (F.min, point), "_end": (F.max, point)}
    )


def has_first_gap(max_gap: float = FIRST_GAP_DAYS) -> Column:
    """On the row at position 0: the next point is more than ``max_gap`` days away."""
    return (F.col("pos") == 0) & F.coalesce(F.col("_next.t") - F.col("t") > max_gap, F.lit(False))


def drop_fraction() -> Column:
    """Drop per day to the next point as a fraction of the segment's whole drop."""
    slope = F.try_divide(F.col("x") - F.col("_next.x"), F.col("_next.t") - F.col("t"))
    return F.try_divide(slope, F.col("_first.x") - F.col("_end.x"))


def half_lives(normal: float, x0: Column) -> Column:
    return F.ln(F.lit(float(normal)) / x0) / F.lit(_LN_HALF)


_LN_HALF = -0.6931471805599453


def screen_segments(
    points: DataFrame,
    keys: list[str],
    screens: Screens = Screens(),
    min_points: int = 5,
    min_height: float = 150,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Points of the segments that pass all screens, cut where they become flat or sparse.

    A segment stays when it has more than ``min_points`` points and starts above ``min_height``.
    """
    segment = [*keys, "peak_seq"]

    def screen(rows: Rows) -> DataFrame:
        rows = _ends(rows)
        flat = F.when(drop_fraction() < screens.steady_state_cutoff, F.col("pos"))
        rows = scan(
            rows,
            whole={
                "_gap": (F.max, has_first_gap().cast("int")),
                "_flat": (F.min, flat),
            },
        )
        df = rows.df
        if screens.first_gap:
            df = df.filter(F.col("_gap") == 0)
        if screens.steady_state:
            df = df.filter(F.col("_flat").isNull() | (F.col("pos") <= F.col("_flat")))
        if screens.scale_by_half_time:
            df = _half_time(rows.with_df(df))
        else:
            df = df.withColumn("_scale", F.lit(1.0))
        lives = half_lives(NORMAL_VALUE, F.col("_first.x")) * F.col("_scale")
        since = F.col("t") - F.col("_first.t")
        # From the absolute times, as the limits are days after the first point.
        near = F.col("t") < lives * TAIL_HALF_LIVES[0] + F.col("_first.t")
        far = F.col("t") < lives * TAIL_HALF_LIVES[1] + F.col("_first.t")
        rows = scan(
            rows.with_df(df.withColumn("_since", since)),
            whole={
                "_n": (F.sum, F.lit(1)),
                "_near": (F.sum, near.cast("int")),
                "_far": (F.sum, far.cast("int")),
            },
        )
        df = rows.df
        if screens.long_tail:
            limit = F.col("_near") + F.when(F.col("_near") < F.col("_far"), 1).otherwise(0)
            df = df.filter((F.col("_n") <= min_points) | (F.col("pos") < limit))
        rows = scan(rows.with_df(df), whole={"n": (F.sum, F.lit(1))})
        return rows.df.filter((F.col("n") > min_points) & (F.col("_first.x") > min_height)).select(
            *segment, "pos", "t", "x", "ll", "ul"
        )

    return run_by_size(points, segment, ["pos"], screen, rows_per_task)


def _half_time(rows: Rows) -> DataFrame:
    """Add ``_scale``: days until the value has fallen half way from the first to the last point.

    The first point below the middle and its predecessor are interpolated linearly.
    """
    middle = (F.col("_first.x") - F.col("_end.x")) / 2 + F.col("_end.x")
    rows = scan(rows, last_before={"_prev": F.struct("t", "x")})
    part = F.try_divide(F.col("_prev.x") - middle, F.col("_prev.x") - F.col("x"))
    at = F.col("_prev.t") + part * (F.col("t") - F.col("_prev.t"))
    crossing = F.when((F.col("x") < middle) & F.col("_prev").isNotNull(), F.struct("pos", at.alias("at")))
    rows = scan(rows, whole={"_half": (F.min, crossing)})
    return rows.df.withColumn("_scale", F.col("_half.at") - F.col("_first.t")).drop("_prev", "_half")


def half_times(points: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(segment, half_time) in days; null for a segment of one point."""
    segment = [*keys, "peak_seq"]

    def measure(rows: Rows) -> DataFrame:
        return _half_time(_ends(rows)).filter(F.col("pos") == 0).select(*segment, F.col("_scale").alias("half_time"))

    return run_by_size(points, segment, ["pos"], measure, rows_per_task)


def cut_tail(
    points: DataFrame, keys: list[str], min_points: int, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """The cut made before a second attempt at a fit: keep the points earlier than twice the expected time to
    a normal value, if more than ``min_points`` of them remain; otherwise keep the segment as it is.

    Time counts from the segment's start (``t`` of its first point is 0 for a trajectory).
    """
    segment = [*keys, "peak_seq"]

    def cut(rows: Rows) -> DataFrame:
        rows = rows.with_df(_half_time(_ends(rows)))
        limit = half_lives(REFIT_NORMAL_VALUE, F.col("_first.x")) * REFIT_HALF_LIVES * F.col("_scale")
        early = F.col("t") - F.col("_first.t") < limit
        rows = scan(
            rows.with_df(rows.df.withColumn("_early", F.coalesce(early, F.lit(False)))),
            whole={"_kept": (F.sum, F.col("_early").cast("int"))},
        )
        return rows.df.filter(F.col("_early") | (F.col("_kept") <= min_points)).select(*rows.keys, "pos", "t", "x")

    return run_by_size(points, segment, ["pos"], cut, rows_per_task)


def trajectory_meta(points: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """One row per trajectory: start, end, length and values; ``traj_id`` is id and peak position."""
    segment = [*keys, "peak_seq"]
    point = F.struct("pos", "t", "x")
    ends = points.groupBy(*segment).agg(
        F.min(point).alias("_a"), F.max(point).alias("_z"), F.min("ll").alias("ll"), F.min("ul").alias("ul"),
        F.count(F.lit(1)).alias("n_points"),
    )
    return ends.select(
        *keys,
        "peak_seq",
        F.concat_ws("_", F.col(id_column).cast("string"), F.col("peak_seq").cast("string")).alias("traj_id"),
        F.col("_a.t").alias("t0"),
        date_from_days(F.col("_a.t"), "truncate").alias("t0_date"),
        F.col("ll").alias("index_xt_peak"),
        F.col("_z.t").alias("tf"),
        date_from_days(F.col("_z.t"), "truncate").alias("tf_date"),
        F.col("ul").alias("index_xt_trough"),
        (F.col("_z.t") - F.col("_a.t")).alias("tlen"),
        F.col("_a.x").alias("x0"),
        F.col("_z.x").alias("xf"),
        (F.col("_a.x") - F.col("_z.x")).alias("xdelta"),
        "n_points",
    )


# Tracks along a series or trajectory with a position column.


def _tracked(points, keys, position, build, rows_per_task) -> DataFrame:
    return run_by_size(points, keys, [position], build, rows_per_task)


def moving_mean(
    points: DataFrame, keys: list[str], width: int, position: str = "seq", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Mean of each ``width`` consecutive values, at the position of the last of them."""

    def build(rows: Rows) -> DataFrame:
        if not rows.chunked:
            frame = rows.window().rowsBetween(1 - width, 0)
            means = rows.df.select(
                *keys, position, F.avg("x").over(frame).alias("mean"), F.count("x").over(frame).alias("_n")
            )
        else:
            # Each value is handed to the windows it belongs to, wherever their chunk is.
            windows = F.sequence(F.col(position), F.col(position) + (width - 1))
            means = (
                rows.df.select(*keys, F.explode(windows).alias(position), "x")
                .groupBy(*keys, position)
                .agg(F.avg("x").alias("mean"), F.count("x").alias("_n"))
            )
        return means.filter(F.col("_n") == width).select(*keys, position, "mean")

    return _tracked(points, keys, position, build, rows_per_task)


def expected_decay(t: Column, start: Column, source: Column, rate: Column) -> Column:
    """First-order decay from ``start`` with a constant source towards source / rate."""
    level = source / rate
    return level + (start - level) * F.exp(-rate * t)


def excess_over_decay(
    points: DataFrame, keys: list[str], rate: float = 0.44, baseline: float = 18, rate_high: float = 0.8,
    rate_low: float = 0.35, position: str = "seq", rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Next value minus the value expected from decay alone, at three rates; the last point has none."""

    def build(rows: Rows) -> DataFrame:
        df = scan(rows, next_after={"_next": F.struct("t", "x")}).df.filter(F.col("_next").isNotNull())
        gap = F.col("_next.t") - F.col("t")

        def excess(d: float) -> Column:
            return F.col("_next.x") - expected_decay(gap, F.col("x"), F.lit(d * baseline), F.lit(float(d)))

        return df.select(
            *keys, position, excess(rate).alias("delta"), excess(rate_low).alias("delta_low"),
            excess(rate_high).alias("delta_high"),
        )

    return _tracked(points, keys, position, build, rows_per_task)


def two_point_source(
    points: DataFrame, keys: list[str], rate: float = 0.44, position: str = "seq",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Source C that explains each pair of consecutive points at a fixed rate, not below 0."""

    def build(rows: Rows) -> DataFrame:
        df = scan(rows, next_after={"_next": F.struct("t", "x")}).df.filter(F.col("_next").isNotNull())
        left = F.exp(-F.lit(float(rate)) * (F.col("_next.t") - F.col("t")))
        source = F.try_divide(F.lit(float(rate)) * (F.col("_next.x") - F.col("x") * left), 1 - left)
        return df.select(*keys, position, F.greatest(source, F.lit(0.0)).alias("C"))

    return _tracked(points, keys, position, build, rows_per_task)


RATE_GRID = [0.001 * 1.25**k for k in range(56)]
RATE_ROUNDS = 8
_ROWS_AT_ONCE = 4096


def _best_of_three(gap2, gap3, x1, x2, x3):
    """(C, d, sse) of rows of three points each, by the search that ``three_point_track`` describes."""

    def attempt(d):
        left2, left3 = np.exp(-d * gap2[:, None]), np.exp(-d * gap3[:, None])
        y2, z2, y3, z3 = x2[:, None] - x1[:, None] * left2, 1 - left2, x3[:, None] - x1[:, None] * left3, 1 - left3
        below = z2 * z2 + z3 * z3
        known = below != 0
        level = np.where(known, (y2 * z2 + y3 * z3) / np.where(known, below, 1.0), 0.0)
        # The greater of level and 0; not-a-number stays and counts as the largest error.
        level = np.where(level < 0, 0.0, level)
        off2, off3 = y2 - level * z2, y3 - level * z3
        error = off2 * off2 + off3 * off3
        row, at = np.arange(len(gap2)), np.argmin(np.where(np.isnan(error), np.inf, error), axis=1)
        chosen = np.broadcast_to(d, error.shape)[row, at]
        return level[row, at] * chosen, chosen, error[row, at]

    best = attempt(np.array(RATE_GRID)[None])
    for k in range(1, RATE_ROUNDS + 1):
        best = attempt(best[1][:, None] * np.array([1.25 ** (j / 4**k) for j in range(-4, 5)]))
    return best


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the points at the end of each row by what ``_best_of_three`` finds; an unknown point leaves no error."""
    for batch in batches:
        columns = batch.columns
        points = columns[-6:]
        unknown = np.zeros(batch.num_rows, bool)
        for column in points:
            unknown |= column.is_null().to_numpy(zero_copy_only=False)
        t1, x1, t2, x2, t3, x3 = (column.fill_null(0.0).to_numpy(zero_copy_only=False) for column in points)
        found = [np.empty(batch.num_rows) for _ in range(3)]
        with np.errstate(over="ignore", invalid="ignore"):
            for low in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = slice(low, low + _ROWS_AT_ONCE)
                for out, values in zip(found, _best_of_three(
                        t2[part] - t1[part], t3[part] - t1[part], x1[part], x2[part], x3[part])):
                    out[part] = values
        source, rate, error = found
        least = RATE_GRID[0] * math.prod(1.25 ** (-4 / 4**k) for k in range(1, RATE_ROUNDS + 1))
        source, rate = np.where(unknown, 0.0, source), np.where(unknown, least, rate)
        yield pa.RecordBatch.from_arrays(
            [*columns[:-6], pa.array(source), pa.array(rate), pa.array(error, mask=unknown)],
            names=[*batch.schema.names[:-6], "C", "d", "sse"])


def three_point_track(
    points: DataFrame, keys: list[str], position: str = "seq", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """(C, d, sse) over each three consecutive points with the first value as start; the rate is searched in the row.

    A grid of rates from 0.001 to 200 a day, then rounds of nine rates around the best, each with a quarter of the
    step. For a given rate the level C / d is a linear problem in one unknown, not below 0. No row is multiplied: the
    rates of many rows are tried at once with numpy, where the rows are.
    """

    def build(rows: Rows) -> DataFrame:
        rows = scan(rows, next_after={"_second": F.struct("t", "x")})
        rows = scan(rows, next_after={"_third": F.col("_second")})
        df = rows.df.filter(F.col("_third").isNotNull())
        df = df.select(*keys, position, *[
            F.col(c).cast("double").alias(f"_p{i}")
            for i, c in enumerate(("t", "x", "_second.t", "_second.x", "_third.t", "_third.x"))])
        fields = [*df.select(*keys, position).schema.fields, *[StructField(c, DoubleType()) for c in ("C", "d", "sse")]]
        return df.mapInArrow(_searched, StructType(fields))

    return _tracked(points, keys, position, build, rows_per_task)


def three_point_fit(
    points: DataFrame, keys: list[str], rates: list[float], position: str = "seq",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """(C, d) over each three consecutive points with the first value as start, best of the given rates.

    For a given rate the level C/d is a linear least-squares problem in one unknown, not below 0; the rates
    are tried as constant expressions in the row.
    """

    def build(rows: Rows) -> DataFrame:
        rows = scan(rows, next_after={"_second": F.struct("t", "x")})
        rows = scan(rows, next_after={"_third": F.col("_second")})
        df = rows.df.filter(F.col("_third").isNotNull())

        def attempt(d: Column) -> Column:
            def terms(point: str):
                left = F.exp(-d * (F.col(f"{point}.t") - F.col("t")))
                return F.col(f"{point}.x") - F.col("x") * left, 1 - left

            (y1, z1), (y2, z2) = terms("_second"), terms("_third")
            level = F.greatest(F.coalesce(F.try_divide(y1 * z1 + y2 * z2, z1 * z1 + z2 * z2), F.lit(0.0)), F.lit(0.0))
            error = F.pow(y1 - level * z1, 2) + F.pow(y2 - level * z2, 2)
            return F.struct(error.alias("sse"), d.alias("d"), (level * d).alias("C"))

        tried = df.withColumn("_d", F.explode(F.array(*[F.lit(float(d)) for d in rates])))
        tried = tried.select(*keys, position, attempt(F.col("_d")).alias("_try"))
        best = tried.groupBy(*keys, position).agg(F.min("_try").alias("_best"))
        return best.select(*keys, position, F.col("_best.C").alias("C"), F.col("_best.d").alias("d"), F.col("_best.sse").alias("sse"))

    return _tracked(points, keys, position, build, rows_per_task)
