"""Nearest-in-time joins between event tables, per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.functions.time import MICROS_PER_DAY, days_to_micros, epoch_micros
from medloom.operators.ordered import ROWS_PER_TASK, Rows, run_by_size, scan


def _micros(df: DataFrame, column: str) -> Column:
    """Time of an event in microseconds; epoch-day columns are doubles, all others timestamps."""
    if dict(df.dtypes)[column] in ("double", "float"):
        return F.rint(F.col(column) * float(MICROS_PER_DAY)).cast("bigint")
    return epoch_micros(F.col(column))


def _stack(left, right, left_key, right_key, left_time, right_time, shift, payload, tie, direction, label=None):
    """Both tables in one: key, time, side, tie, the left row and the right row."""
    # Right rows come before a left row of the same time, except when looking forward only.
    left_side, right_side = (0, 1) if direction == "forward" else (1, 0)
    right_fields = [F.col(c) for c in payload]
    right_value = F.struct(_micros(right, right_time).alias("_t"), *right_fields)
    labelled = [] if label is None else [right[label].cast("string").alias("_label")]
    left_rows = left.select(
        *[F.lit(None).cast("string").alias("_label") for _ in labelled],
        F.col(left_key).alias("_key"),
        (_micros(left, left_time) + F.lit(shift)).alias("_time"),
        F.lit(left_side).alias("_side"),
        F.lit(None).cast(right.schema[tie].dataType).alias("_tie"),
        F.struct(*left.columns).alias("_left"),
        F.lit(None).alias("_right"),
    )
    right_rows = right.select(
        *labelled,
        F.col(right_key).alias("_key"),
        _micros(right, right_time).alias("_time"),
        F.lit(right_side).alias("_side"),
        F.col(tie).alias("_tie"),
        F.lit(None).alias("_left"),
        right_value.alias("_right"),
    )
    return left_rows.unionByName(right_rows).filter(F.col("_time").isNotNull())


def _one_per_time(df: DataFrame, group: list[str], tie: str, pick=F.min_by) -> DataFrame:
    others = [c for c in df.columns if c not in group]
    row = pick(F.struct(*others), F.col(tie)).alias("_row")
    return df.groupBy(*group).agg(row).select(*group, *[F.col(f"_row.{c}").alias(c) for c in others])


def attach_nearest(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_time: str,
    right_time: str,
    payload: Sequence[str],
    tie: str,
    *,
    before_days: float | None = None,
    after_days: float | None = None,
    anchor: str = "midpoint",
    direction: str = "nearest",
    strict: bool = False,
    equal_times: str = "adjacent",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Each left row with the nearest right row of the same key in ``match`` (null when there is none).

    The right row must lie from ``before_days`` before to ``after_days`` after the left row. ``anchor`` says
    what "nearest" is measured from: the middle of that window or the left event itself. The earlier row wins
    when two are equally near. Among right rows of equal time the one adjacent to the left row in (time, tie)
    order is taken, or the one with the least tie when ``equal_times='first'``. Left rows without a key or a
    time have no match.

    One shuffle by key of both tables and no pairing of rows, so the work is linear in their size.
    """
    if direction not in ("nearest", "backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    bounded = before_days is not None and after_days is not None
    low, high = (days_to_micros(before_days), days_to_micros(after_days)) if bounded else (0, 0)
    shift = (high - low) // 2 if bounded and anchor == "midpoint" else 0
    payload = list(dict.fromkeys([*payload, tie]))
    if equal_times == "first":
        keep = list(dict.fromkeys([right_key, right_time, *payload]))
        right = _one_per_time(right.select(*keep), [right_key, right_time], tie)
    stacked = _stack(
        left, right, left_key, right_key, left_time, right_time, shift, payload, tie, direction
    )
    here = F.col("_time")

    def pick(rows: Rows) -> DataFrame:
        found = scan(
            rows,
            last_before={"_back": F.col("_right")} if direction != "forward" else {},
            next_after={"_next": F.col("_right")} if direction != "backward" else {},
        ).df.filter(F.col("_left").isNotNull())
        none = F.lit(None).cast(rows.df.schema["_right"].dataType)
        back = F.col("_back") if direction != "forward" else none
        ahead = F.col("_next") if direction != "backward" else none
        if bounded:
            def inside(c):
                gap = c["_t"] - (here - F.lit(shift))
                if strict:
                    return F.when((gap > -low) & (gap < high), c)
                return F.when((gap >= -low) & (gap <= high), c)

            back, ahead = inside(back), inside(ahead)
        nearest = F.when(
            back.isNotNull() & (ahead.isNull() | (here - back["_t"] <= ahead["_t"] - here)), back
        ).otherwise(ahead)
        return found.select("_left", nearest.alias("match"))

    matched = run_by_size(
        stacked, ["_key"], ["_time", "_side", "_tie"], pick, rows_per_task, spread=F.xxhash64("_left")
    )
    keyless = left.filter(F.col(left_key).isNull() | F.col(left_time).isNull()).select(
        F.struct(*left.columns).alias("_left"),
        F.lit(None).cast(matched.schema["match"].dataType).alias("match"),
    )
    return matched.unionByName(keyless).select("_left.*", "match")


def find_within(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_time: str,
    right_time: str,
    payload: Sequence[str],
    tie: str,
    before_days: float = 7,
    after_days: float = 14,
    suffixes: tuple[str, str] = ("_left", "_right"),
    anchor: str = "midpoint",
    direction: str = "nearest",
    rows_per_task: int = ROWS_PER_TASK,
) -> tuple[DataFrame, DataFrame]:
    """(rows with an event in the window, rows without), the first with the event's columns and the gap.

    Columns of the event that the left table has too get the second suffix; ``dt<s2><s1>`` is event time minus
    row time in days.
    """
    matched = attach_nearest(
        left, right, left_key, right_key, left_time, right_time, [right_time, *payload], tie,
        before_days=before_days, after_days=after_days, anchor=anchor, direction=direction,
        rows_per_task=rows_per_task,
    )
    names = {c: c + suffixes[1] if c in left.columns else c for c in dict.fromkeys([right_time, *payload])}
    gap = (F.col("match._t") - _micros(left, left_time)).cast("double") / float(MICROS_PER_DAY)
    kept = matched.filter(F.col("match").isNotNull()).select(
        *left.columns,
        *[F.col(f"match.{c}").alias(n) for c, n in names.items()],
        gap.alias("dt" + suffixes[1] + suffixes[0]),
    )
    removed = matched.filter(F.col("match").isNull()).select(*left.columns)
    return kept, removed


def without_event(*args, **kwargs) -> DataFrame:
    """Rows that have no event in the window, with their own columns only."""
    return find_within(*args, **kwargs)[1]


def nearest_of_labels(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_time: str,
    right_time: str,
    label: str,
    value: str,
    labels: Sequence[str],
    tie: str,
    calling_label: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add value, epoch-day time and gap in days of the nearest row of every label; null where there is none.

    All labels are looked up in one ordered pass; the left rows are not repeated per label.
    """
    labels = [name for name in labels if name != calling_label]
    right = right.filter(F.col(label).isin(labels))
    stacked = _stack(
        left, right, left_key, right_key, left_time, right_time, 0, [value], tie, "nearest", label
    )
    here = F.col("_time")

    def pick(rows: Rows) -> DataFrame:
        of = {name: F.when(F.col("_label") == name, F.col("_right")) for name in labels}
        found = scan(
            rows,
            last_before={f"_b_{name}": col for name, col in of.items()},
            next_after={f"_n_{name}": col for name, col in of.items()},
        ).df.filter(F.col("_left").isNotNull())
        out = []
        for name in labels:
            back, ahead = F.col(f"_b_{name}"), F.col(f"_n_{name}")
            best = F.when(
                back.isNotNull() & (ahead.isNull() | (here - back["_t"] <= ahead["_t"] - here)), back
            ).otherwise(ahead)
            day = float(MICROS_PER_DAY)
            out += [
                best[value].alias(f"{name}_value"),
                (best["_t"].cast("double") / day).alias(f"{name}_epoch"),
                ((best["_t"] - here).cast("double") / day).alias(f"{name}_dt"),
            ]
        return found.select("_left", *out)

    matched = run_by_size(
        stacked, ["_key"], ["_time", "_side", "_label", "_tie"], pick, rows_per_task, spread=F.xxhash64("_left")
    )
    keyless = left.filter(F.col(left_key).isNull() | F.col(left_time).isNull()).select(
        F.struct(*left.columns).alias("_left")
    )
    return matched.unionByName(keyless, allowMissingColumns=True).select(
        "_left.*", *[c for c in matched.columns if c != "_left"]
    )


def nearest_of_label(
    left, right, left_key, right_key, left_time, right_time, value, tie, rows_per_task=ROWS_PER_TASK
) -> DataFrame:
    """Value, time and gap of the nearest right row of the key; nulls when the key has none."""
    matched = attach_nearest(
        left, right, left_key, right_key, left_time, right_time, [value], tie,
        equal_times="first", rows_per_task=rows_per_task,
    )
    day = float(MICROS_PER_DAY)
    return matched.select(
        *left.columns,
        F.col(f"match.{value}").alias("nearest_value"),
        (F.col("match._t").cast("double") / day).alias("nearest_epoch"),
        ((F.col("match._t") - _micros(left, left_time)).cast("double") / day).alias("nearest_dt"),
    )


def nearest_pair(
    left, right, left_key, right_key, left_time, right_time, payload, tie, within_days,
    rows_per_task=ROWS_PER_TASK,
) -> DataFrame:
    """Left rows with their nearest right row, kept when strictly nearer than ``within_days``."""
    matched = attach_nearest(
        left, right, left_key, right_key, left_time, right_time, payload, tie,
        before_days=within_days, after_days=within_days, anchor="event", strict=True,
        equal_times="first", rows_per_task=rows_per_task,
    ).filter(F.col("match").isNotNull())
    gap = (F.col("match._t") - _micros(left, left_time)).cast("double") / float(MICROS_PER_DAY)
    return matched.select(
        *left.columns, *[F.col(f"match.{c}").alias(c) for c in payload], gap.alias("t0_dt")
    )


def near_any_date(
    events: DataFrame, dates: DataFrame, keys: list[str], event_day: str, date_day: str, within_days: float
) -> DataFrame:
    """Events at most ``within_days`` from any of the dates of their key (both columns in epoch days).

    Dates are first spread over day slots as wide as the tolerance and made distinct, so the equi-join is on
    (key, slot): a key with very many events or dates is spread over its slots.
    """
    if not within_days:
        same = dates.select(*keys, F.col(date_day).alias(event_day)).distinct()
        return events.join(same, [*keys, event_day], "left_semi").select(*events.columns)
    slot = F.floor(F.col(event_day) / within_days).cast("bigint")
    spread = dates.select(
        *keys,
        F.col(date_day).alias("_date"),
        F.explode(
            F.array(*[F.floor(F.col(date_day) / within_days).cast("bigint") + F.lit(k) for k in (-1, 0, 1)])
        ).alias("_slot"),
    )
    # In a slot only the extreme dates of each neighbour slot matter, so a slot's dates shrink to four numbers.
    own = F.floor(F.col("_date") / within_days).cast("bigint")
    bounds = spread.groupBy(*keys, "_slot").agg(
        F.max(F.when(own < F.col("_slot"), F.col("_date"))).alias("_latest_before"),
        F.max(F.when(own == F.col("_slot"), F.lit(True))).alias("_inside"),
        F.min(F.when(own > F.col("_slot"), F.col("_date"))).alias("_earliest_after"),
    )
    joined = events.withColumn("_slot", slot).join(bounds, [*keys, "_slot"])
    day = F.col(event_day)
    hit = (
        F.coalesce(F.col("_inside"), F.lit(False))
        | F.coalesce(day - F.col("_latest_before") <= within_days, F.lit(False))
        | F.coalesce(F.col("_earliest_after") - day <= within_days, F.lit(False))
    )
    return joined.filter(hit).select(*events.columns)


def match_segment_start(
    left, right, left_key, right_key, left_start, right_start, payload, tie, within_days=4,
    rows_per_task=ROWS_PER_TASK,
) -> DataFrame:
    """The segment whose start is nearest to the given segment's start, if strictly within the tolerance.

    Where the segments end plays no part.
    """
    return nearest_pair(
        left, right, left_key, right_key, left_start, right_start, payload, tie, within_days, rows_per_task
    )
