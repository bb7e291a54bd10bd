"""Prominence of peaks.

A peak's prominence is its height above the higher of two bases; a base is the least value between the peak and
the nearest strictly higher sample on that side, or the end of the series. Between two peaks only the least
value matters, so a series is reduced to its peaks and the valley after each. Peaks are put in blocks of
``BLOCK``; most bases are found inside the block. For keys with more peaks than that, blocks are the leaves of
a tree with ``BLOCK`` children per node (greatest height, least valley), and a base that reaches beyond its
block is looked up node by node: every step is an equi-join on (key, node), and no task holds more than one
block of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64

# A select that reuses a column's name for its new value would feed that value to the lambdas beside it.
_NEW = {"_new_base": "_base", "_new_at": "_at", "_new_level": "_level"}


def _higher(nodes: Column, start: Column, height: Column, side: str) -> Column:
    """Nearest node on one side of ``start`` with a greater height, or null."""
    if side == "left":
        return F.try_element_at(F.filter(nodes, lambda e: (e["i"] < start) & (e["h"] > height)), F.lit(-1))["i"]
    return F.get(F.filter(nodes, lambda e: (e["i"] > start) & (e["h"] > height)), F.lit(0))["i"]


def _least(nodes: Column, first: Column, last: Column) -> Column:
    """Least valley of the nodes from ``first`` to ``last``; a null bound is open."""
    def inside(e: Column) -> Column:
        return F.coalesce(e["i"] >= first, F.lit(True)) & F.coalesce(e["i"] <= last, F.lit(True))

    return F.array_min(F.transform(F.filter(nodes, inside), lambda e: e["v"]))


def _packed(nodes: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Nodes (keys, i, h, v) by parent, in order."""
    parent = F.floor(F.col("i") / block).cast("bigint")
    return nodes.groupBy(*keys, parent.alias("_parent")).agg(
        F.array_sort(F.collect_list(F.struct("i", "h", "v"))).alias("_nodes")
    )


def _parents(packed: DataFrame, keys: list[str]) -> DataFrame:
    return packed.select(
        *keys,
        F.col("_parent").alias("i"),
        F.array_max(F.transform("_nodes", lambda e: e["h"])).alias("h"),
        F.array_min(F.transform("_nodes", lambda e: e["v"])).alias("v"),
    )


def _far_base(open_peaks: DataFrame, trees: list[DataFrame], keys: list[str], side: str, block: int) -> DataFrame:
    """Finish the bases of peaks whose search left their block: up the tree, then down to the higher peak."""
    pending = open_peaks.select(
        *keys, F.col("i").alias("_peak"), F.col("h").alias("_h"), F.col(f"{side}_base").alias("_base"),
        F.floor(F.col("i") / block).cast("bigint").alias("_at"), F.lit(0).alias("_level"),
    )
    for level in range(1, len(trees)):
        climbing = F.col("_level") == 0
        joined = pending.withColumn("_node", F.floor(F.col("_at") / block).cast("bigint")).join(
            trees[level].withColumnRenamed("_parent", "_node"), [*keys, "_node"], "left"
        )
        # Found once per row, before the lambdas that use it.
        joined = joined.withColumn("_higher", _higher(F.col("_nodes"), F.col("_at"), F.col("_h"), side))
        higher = F.col("_higher")
        hit = climbing & higher.isNotNull()
        # The valleys of the node that holds the higher peak count only in part: added on the way down.
        if side == "left":
            clear = _least(F.col("_nodes"), higher + 1, F.col("_at") - 1)
        else:
            clear = _least(F.col("_nodes"), F.col("_at") + 1, higher - 1)
        pending = joined.select(
            *keys, "_peak", "_h",
            F.when(climbing, F.least("_base", clear)).otherwise(F.col("_base")).alias("_new_base"),
            F.when(hit, higher).when(climbing, F.col("_node")).otherwise(F.col("_at")).alias("_new_at"),
            F.when(hit, F.lit(level)).otherwise(F.col("_level")).alias("_new_level"),
        ).withColumnsRenamed(_NEW)
    for level in range(len(trees) - 1, 0, -1):
        down = F.col("_level") == level
        joined = pending.join(
            trees[level - 1].select(*keys, F.col("_parent").alias("_at"), "_nodes"), [*keys, "_at"], "left"
        )
        edge = F.lit(2**62 if side == "left" else -1)
        joined = joined.withColumn("_higher", _higher(F.col("_nodes"), edge, F.col("_h"), side))
        higher = F.col("_higher")
        if side == "right":
            partial = _least(F.col("_nodes"), F.lit(None).cast("bigint"), higher - 1)
        else:
            # A leaf's valley lies after its peak, so on the left the higher peak's own valley counts.
            partial = _least(F.col("_nodes"), higher if level == 1 else higher + 1, F.lit(None).cast("bigint"))
        pending = joined.select(
            *keys, "_peak", "_h",
            F.when(down, F.least("_base", partial)).otherwise(F.col("_base")).alias("_new_base"),
            F.when(down, higher).otherwise(F.col("_at")).alias("_new_at"),
            F.when(down, F.lit(level - 1)).otherwise(F.col("_level")).alias("_new_level"),
        ).withColumnsRenamed(_NEW)
    return pending.select(*keys, F.col("_peak").alias("i"), F.col("_base").alias(f"_{side}"))


def prominences(stretches: DataFrame, keys: list[str], most: int, block: int = BLOCK) -> DataFrame:
    """(keys, i, prominence) of every peak.

    ``stretches`` has one row (keys, i, h, v) per peak i >= 1 with its height and the least value from it to
    the next peak. Rows with a null height stand for samples (or padding) before the first or after the last
    peak. ``most`` is a bound on i.
    """
    trees = [_packed(stretches, keys, block)]
    while block ** len(trees) <= most:
        trees.append(_packed(_parents(trees[-1], keys), keys, block))

    nodes = F.col("_nodes")
    nearest = F.transform(
        F.filter(nodes, lambda e: e["h"].isNotNull()),
        lambda e: F.struct(
            e["i"].alias("i"), e["h"].alias("h"), e["v"].alias("v"),
            _higher(nodes, e["i"], e["h"], "left").alias("left"),
            _higher(nodes, e["i"], e["h"], "right").alias("right"),
        ),
    )
    bases = F.transform(
        nearest,
        lambda p: F.struct(
            p["i"].alias("i"), p["h"].alias("h"),
            p["left"].isNull().alias("left_open"),
            _least(nodes, p["left"], p["i"] - 1).alias("left_base"),
            p["right"].isNull().alias("right_open"),
            _least(nodes, p["i"], p["right"] - 1).alias("right_base"),
        ),
    )
    near = trees[0].select(*keys, F.explode(bases).alias("_p")).select(*keys, "_p.*")
    if len(trees) > 1:
        for side in ("left", "right"):
            far = _far_base(near.filter(F.col(f"{side}_open")), trees, keys, side, block)
            near = near.join(far, [*keys, "i"], "left").withColumn(
                f"{side}_base", F.coalesce(f"_{side}", f"{side}_base")
            ).drop(f"_{side}")
    # A peak on the first sample has nothing to its left: its base there is the other one.
    base = F.greatest("left_base", "right_base")
    return near.select(*keys, "i", (F.col("h") - base).alias("prominence"))
