"""Work in time order per key, also when one key holds a large part of the table.

A key with up to ``rows_per_task`` rows is one window partition. The rows of larger keys are cut into
consecutive chunks by a range partitioning on (key, order), so no window has more than about
``rows_per_task`` of them; what a chunk needs from the chunks before and after it is carried over through a
summary with one row per chunk. The result is the same in both cases.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medloom.session import use_checkpoint_dir

ROWS_PER_TASK = 1_000_000
# Short chunks share a task of about so many rows: the number of tasks, and of keys sampled for them by the driver,
# then follows the rows and not ``rows_per_task``.
ROWS_PER_RANGE = 100_000
CHUNK = "_chunk"
# A table of so many keys can be sent to every task.
_LARGE_KEYS = 50_000
# Of a generated id: the row's number within its partition.
_ROWS_OF_A_PART = 2**33 - 1


class Rows(NamedTuple):
    """A table with its keys, its order within a key and whether large keys are cut into chunks."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    chunked: bool
    longest: int

    @property
    def parts(self) -> list[str]:
        return [*self.keys, CHUNK] if self.chunked else self.keys

    def window(self, order: list[str] | None = None):
        return Window.partitionBy(*self.parts).orderBy(*(order or self.order))

    def reverse_window(self):
        return Window.partitionBy(*self.parts).orderBy(*[F.desc(c) for c in self.order])

    def with_df(self, df: DataFrame) -> "Rows":
        return self._replace(df=df)


def key_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))


def run_by_size(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    op: Callable[[Rows], DataFrame],
    rows_per_task: int = ROWS_PER_TASK,
    spread: Column | None = None,
    longest: int | None = None,
) -> DataFrame:
    """Apply ``op`` to the small keys as they are and to the large keys in chunks, and put both together.

    One pass over the key columns counts the rows (partial counts before the shuffle) and brings back two
    numbers. ``spread`` tells rows of equal order apart, so that a burst of them can be cut too; it must not
    matter to ``op`` how they are ordered. ``longest`` is a bound on the rows per key if one is known; the count
    is saved when it is low enough. Rows with a null key belong to no series and are left out.
    """
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    if longest is not None and longest <= rows_per_task:
        return op(Rows(df, keys, order, False, longest))
    sizes = key_sizes(df, keys)
    probe = sizes.agg(
        F.max("_rows").alias("longest"),
        F.sum(F.when(F.col("_rows") > rows_per_task, F.col("_rows"))).alias("large"),
    ).first()
    longest = probe["longest"] or 0
    if not probe["large"]:
        return op(Rows(df, keys, order, False, longest))

    large_keys = sizes.filter(F.col("_rows") > rows_per_task).select(*keys)
    if probe["large"] <= rows_per_task * _LARGE_KEYS:
        # So few keys at most; a join by key would bring all rows of a large one to one task.
        large_keys = F.broadcast(large_keys)
    small = op(Rows(df.join(large_keys, keys, "left_anti"), keys, order, False, min(longest, rows_per_task)))
    rows = df.join(large_keys, keys, "left_semi")
    ranges = -(-probe["large"] // max(rows_per_task, ROWS_PER_RANGE))
    use_checkpoint_dir(df.sparkSession)
    # The chunk number is the place in a sampled range partitioning and the row's stretch of it: fixed once by the
    # checkpoint.
    places = [*keys, *order, *([] if spread is None else [spread])]
    rows = rows.repartitionByRange(ranges, *places)
    chunk = F.spark_partition_id().cast("bigint")
    if rows_per_task < ROWS_PER_RANGE:
        rows = rows.sortWithinPartitions(*places)
        row = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROWS_OF_A_PART))
        chunk = F.shiftleft(chunk, 32) + F.floor(row / rows_per_task)
    rows = rows.withColumn(CHUNK, chunk).checkpoint()
    large = op(Rows(rows, keys, order, True, longest))
    return small.unionByName(large)


def scan(
    rows: Rows,
    last: dict[str, Column] | None = None,
    last_before: dict[str, Column] | None = None,
    next_after: dict[str, Column] | None = None,
    running: dict[str, Column] | None = None,
    whole: dict[str, tuple[Callable[[Column], Column], Column]] | None = None,
) -> Rows:
    """Add columns that look back or ahead in a key.

    ``last``: the newest non-null value up to this row; ``last_before``: before this row;
    ``next_after``: the next non-null value after this row; ``running``: sum up to this row;
    ``whole``: a min, max or sum over all rows of the key.
    """
    last, last_before = last or {}, last_before or {}
    next_after, running, whole = next_after or {}, running or {}, whole or {}
    ahead = rows.window().rowsBetween(Window.unboundedPreceding, 0)
    before = rows.window().rowsBetween(Window.unboundedPreceding, -1)
    # A frame that ends at the partition's end is quadratic, the same frame in reverse order is not.
    after = rows.reverse_window().rowsBetween(Window.unboundedPreceding, -1)
    added = {name: F.last(col, ignorenulls=True).over(ahead) for name, col in last.items()}
    added |= {name: F.last(col, ignorenulls=True).over(before) for name, col in last_before.items()}
    added |= {name: F.last(col, ignorenulls=True).over(after) for name, col in next_after.items()}
    added |= {name: F.sum(col).over(ahead) for name, col in running.items()}
    everything = Window.partitionBy(*rows.parts)
    added |= {name: fn(col).over(everything) for name, (fn, col) in whole.items()}
    out = rows.df.select("*", *[col.alias(name) for name, col in added.items()])
    if not rows.chunked:
        return rows.with_df(out)

    position = F.struct(*rows.order)
    totals = []
    for name, col in {**last, **last_before}.items():
        totals.append(F.max_by(col, F.when(col.isNotNull(), position)).alias(name))
    for name, col in next_after.items():
        totals.append(F.min_by(col, F.when(col.isNotNull(), position)).alias(name))
    for name, col in running.items():
        totals.append(F.sum(col).alias(name))
    for name, (fn, col) in whole.items():
        totals.append(fn(col).alias(name))
    summary = rows.df.groupBy(*rows.parts).agg(*totals)
    by_chunk = Window.partitionBy(*rows.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    from_end = Window.partitionBy(*rows.keys).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *rows.parts,
        *[F.last(n, ignorenulls=True).over(by_chunk).alias(f"_c_{n}") for n in {**last, **last_before}],
        *[F.last(n, ignorenulls=True).over(from_end).alias(f"_c_{n}") for n in next_after],
        *[F.sum(n).over(by_chunk).alias(f"_c_{n}") for n in running],
        *[fn(F.col(n)).over(Window.partitionBy(*rows.keys)).alias(f"_c_{n}") for n, (fn, _) in whole.items()],
    )
    out = out.join(carried, rows.parts, "left")
    fixed = []
    for name in added:
        if name in running:
            fixed.append((F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))).alias(name))
        elif name in whole:
            fixed.append(F.col(f"_c_{name}").alias(name))
        else:
            fixed.append(F.coalesce(F.col(name), F.col(f"_c_{name}")).alias(name))
    return rows.with_df(out.select(*rows.df.columns, *fixed).checkpoint())
