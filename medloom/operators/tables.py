"""Row-level table operators: synonyms, audits, status filters, de-duplication, flags, merges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_first_event(
    df: DataFrame, events: DataFrame, key: str, event_key: str, event_time: str, first: str, flag: str
) -> tuple[DataFrame, DataFrame]:
    """(table with the key's earliest event and a flag, the lookup of earliest events)."""
    lookup = (
        events.filter(F.col(event_key).isNotNull())
        .groupBy(F.col(event_key).alias("_event_key"))
        .agg(F.min(event_time).alias(first))
        .withColumn(flag, F.lit(True))
    )
    tagged = (
        df.join(lookup, df[key] == F.col("_event_key"), "left")
        .drop("_event_key")
        .withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    )
    return tagged, lookup.withColumnRenamed("_event_key", event_key)


def name_contains_all(name: Column, words: Sequence[str]) -> Column:
    """Case-sensitive: every word occurs somewhere in the name."""
    hit = F.lit(True)
    for word in words:
        hit = hit & name.contains(word)
    return F.coalesce(hit, F.lit(False))


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"no column {missing[0]!r}")
    return df.withColumnsRenamed(dict(names))


def require_columns(df: DataFrame, *columns: str) -> None:
    for column in columns:
        if column not in df.columns:
            raise ValueError(f"column {column!r} is missing; run the step that adds it first")


def synonym_pairs(wide: DataFrame) -> DataFrame:
    """A wide synonym table (header = canonical name, cells = variants) as (variant, canonical).

    A variant listed under several names goes to the first of them in header order.
    """
    names = wide.columns
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("place"), F.lit(n).alias("canonical"), F.col(f"`{n}`").alias("variant"))
            for i, n in enumerate(names)
        ]
    )
    return (
        wide.select(F.explode(cells).alias("c"))
        .select("c.*")
        .filter(F.col("variant").isNotNull() & (F.col("variant") != ""))
        .groupBy("variant")
        .agg(F.min_by("canonical", "place").alias("canonical"))
    )


def map_synonyms(df: DataFrame, column: str, pairs: DataFrame, out: str | None = None) -> DataFrame:
    """Replace whole values that are listed as variants; others stay as they are."""
    lookup = pairs.select(F.col("variant").alias("_variant"), F.col("canonical").alias("_canonical"))
    joined = df.join(lookup, F.col(column) == F.col("_variant"), "left")
    return joined.withColumn(out or column, F.coalesce("_canonical", column)).drop("_variant", "_canonical")


def audit_names(observed: DataFrame, column: str, expected: DataFrame, expected_column: str) -> DataFrame:
    """(name, status): common to both, additional in the data, or missing from it."""
    seen = observed.select(F.col(column).alias("name")).distinct().withColumn("_seen", F.lit(True))
    wanted = expected.select(F.col(expected_column).alias("name")).distinct().withColumn("_wanted", F.lit(True))
    status = (
        F.when(F.col("_seen") & F.col("_wanted"), "common")
        .when(F.col("_seen"), "additional")
        .otherwise("missing")
    )
    return seen.join(wanted, "name", "full_outer").select("name", status.alias("status"))


def drop_values(df: DataFrame, column: str, unwanted: Sequence[str]) -> DataFrame:
    """Rows whose value is not in the list; a null value stays."""
    return df.filter(~F.coalesce(F.col(column).isin(*unwanted), F.lit(False)))


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("_", *[F.coalesce(p.cast("string"), F.lit("nan")) for p in parts])


def longest_per_key(df: DataFrame, keys: Sequence[str], text: str, ties: Sequence[str] = ()) -> DataFrame:
    """One row per key, the one with the longest text; then by the tie columns and the text, least first.

    One aggregate with partial merging, no window: copies of one report shrink before the shuffle however many
    there are.
    """
    others = [c for c in df.columns if c not in keys and c not in ties and c != text]
    rank = F.struct(F.coalesce(-F.length(text), F.lit(1)).alias("_rank"), *ties, text, *others)
    best = df.groupBy(*keys).agg(F.min(rank).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def overlay(df: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Overwrite columns with the non-null values of another table that has one row per key."""
    renamed = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(renamed, list(keys), "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def set_where(df: DataFrame, eligible: Column, values: Mapping[str, tuple[Column, Column]], update: bool = True):
    """Add columns: ``values[name] = (value, default)``, the value on eligible rows, else the default.

    ``update=False`` returns the eligible rows only.
    """
    if not update:
        df = df.filter(eligible)
        return df.withColumns({name: value for name, (value, _) in values.items()})
    hit = F.coalesce(eligible, F.lit(False))
    return df.withColumns({name: F.when(hit, value).otherwise(default) for name, (value, default) in values.items()})


def count_flag(df: DataFrame, flag: Column) -> DataFrame:
    """One row: how many rows have the flag and how many do not."""
    return df.agg(
        F.count_if(flag).alias("n_with"), F.count_if(~F.coalesce(flag, F.lit(False))).alias("n_without")
    )


def union_parts(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
