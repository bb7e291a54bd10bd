"""Joins by nearest time."""

from __future__ import annotations

from pyspark.sql import functions as F

from driverqueries.common import events, r6, table
from medloom.functions.time import epoch_days
from medloom.operators import asof, tables

# The split-key forms join on the user's number modulo 3, so three keys hold all rows, and cut them into chunks.
FEW_ROWS = 500


def _lefts(spark, sf_dir, event_type):
    return events(spark, sf_dir, event_type).select("event_id", "user_id", (F.col("user_id") % 3).alias("site"), "ts")


def _rights(spark, sf_dir, event_type):
    return events(spark, sf_dir, event_type).select(
        F.col("event_id").alias("other_id"), "user_id", (F.col("user_id") % 3).alias("site"), "ts",
        F.col("value").alias("other_value"),
    )


def _within(spark, sf_dir, first, second, before, after, key="user_id", **more):
    return asof.find_within(
        _lefts(spark, sf_dir, first), _rights(spark, sf_dir, second), key, key, "ts", "ts",
        ["other_id", "other_value"], "other_id", before, after, ("_l", "_r"), **more,
    )


def asof_within_nearest(spark, sf_dir, **more):
    kept, _ = _within(spark, sf_dir, "error", "click", 7, 14, **more)
    return kept.select("event_id", "user_id", "other_id", r6(F.col("dt_r_l")).alias("dt_days"))


def asof_within_nearest_split_keys(spark, sf_dir):
    return asof_within_nearest(spark, sf_dir, key="site", rows_per_task=FEW_ROWS)


def asof_within_event_anchor(spark, sf_dir):
    return asof_within_nearest(spark, sf_dir, anchor="event")


def asof_within_backward(spark, sf_dir):
    return asof_within_nearest(spark, sf_dir, direction="backward")


def asof_within_forward(spark, sf_dir):
    return asof_within_nearest(spark, sf_dir, direction="forward")


def asof_within_removed(spark, sf_dir):
    _, removed = _within(spark, sf_dir, "error", "click", 7, 14)
    return removed.select("event_id", "user_id")


def asof_within_anti(spark, sf_dir):
    out = asof.without_event(
        _lefts(spark, sf_dir, "signup"), _rights(spark, sf_dir, "purchase"), "user_id", "user_id", "ts", "ts",
        ["other_id"], "other_id", 1, 2,
    )
    return out.select("event_id", "user_id")


LABELS = ["view", "click", "error", "signup", "purchase"]


def nearest_per_label(spark, sf_dir, key="user_id", **more):
    right = events(spark, sf_dir).select(
        "user_id", (F.col("user_id") % 3).alias("site"), "ts", "event_type", "value",
        F.col("event_id").alias("other_id"),
    )
    out = asof.nearest_of_labels(
        _lefts(spark, sf_dir, "purchase"), right, key, key, "ts", "ts", "event_type", "value",
        LABELS, "other_id", calling_label="purchase", **more,
    )
    cols = [r6(F.col(f"{n}_{c}")).alias(f"{n}_{c}") for n in LABELS[:4] for c in ("value", "epoch", "dt")]
    return out.select("event_id", *cols)


def nearest_per_label_split_keys(spark, sf_dir):
    return nearest_per_label(spark, sf_dir, key="site", rows_per_task=FEW_ROWS)


def nearest_one_label(spark, sf_dir):
    out = asof.nearest_of_label(
        _lefts(spark, sf_dir, "signup"), _rights(spark, sf_dir, "error"), "user_id", "user_id", "ts", "ts",
        "other_value", "other_id",
    )
    return out.select(
        "event_id", *[r6(F.col(c)).alias(c) for c in ("nearest_value", "nearest_epoch", "nearest_dt")]
    )


def nearest_pair_inner(spark, sf_dir):
    out = asof.nearest_pair(
        _lefts(spark, sf_dir, "purchase"), _rights(spark, sf_dir, "click"), "user_id", "user_id", "ts", "ts",
        ["other_id"], "other_id", 0.5,
    )
    return out.select("event_id", "other_id", r6(F.col("t0_dt")).alias("t0_dt"))


def dates_semi(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("day", epoch_days(F.col("ts")))
    dates = events(spark, sf_dir, "signup").select("user_id", epoch_days(F.col("ts")).alias("signup_day"))
    return asof.near_any_date(ev, dates, ["user_id"], "day", "signup_day", 1.0).select("event_id", "user_id")


def first_event_tag(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    qualifying = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    tagged, _ = tables.tag_first_event(
        customers, qualifying, "c_custkey", "o_custkey", "o_orderdate", "first_f_order", "has_f_order"
    )
    return tagged.select("c_custkey", "c_mktsegment", "first_f_order", "has_f_order")


def _range_sql(first, second, before, after, rank, extra=""):
    return f"""
    WITH pairs AS (
      SELECT a.event_id, a.user_id, b.event_id AS other_id,
             (epoch_us(b.ts) - epoch_us(a.ts)) AS gap_us, b.ts AS bts
      FROM events a JOIN events b ON a.user_id = b.user_id
      WHERE a.event_type = '{first}' AND b.event_type = '{second}'
        AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN -{before} * 86400000000 AND {after} * 86400000000 {extra}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY {rank}) AS rn FROM pairs)
    SELECT event_id, user_id, other_id, round(gap_us / 86400000000.0, 6) + 0.0 AS dt_days
    FROM ranked WHERE rn = 1
    """


_MID = 3.5 * 86400000000
_BACK_FIRST = (
    "abs(gap_us - {m}), CASE WHEN gap_us <= {m} THEN 0 ELSE 1 END, "
    "CASE WHEN gap_us <= {m} THEN -other_id ELSE other_id END"
)


def _label_sql(name):
    return f"""
    {name}_r AS (
      SELECT a.event_id, b.value AS {name}_value, epoch_us(b.ts) / 86400000000.0 AS {name}_epoch,
             (epoch_us(b.ts) - epoch_us(a.ts)) / 86400000000.0 AS {name}_dt,
             row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(b.ts) - epoch_us(a.ts)),
               CASE WHEN b.ts <= a.ts THEN 0 ELSE 1 END,
               CASE WHEN b.ts <= a.ts THEN -b.event_id ELSE b.event_id END) AS rn
      FROM events a JOIN events b ON a.user_id = b.user_id
      WHERE a.event_type = 'purchase' AND b.event_type = '{name}')"""


_LABEL_SQL = (
    "WITH " + ",".join(_label_sql(n) for n in LABELS[:4])
    + " SELECT a.event_id, "
    + ", ".join(f"round({n}_{c}, 6) + 0.0 AS {n}_{c}" for n in LABELS[:4] for c in ("value", "epoch", "dt"))
    + " FROM events a "
    + " ".join(f"LEFT JOIN {n}_r ON {n}_r.event_id = a.event_id AND {n}_r.rn = 1" for n in LABELS[:4])
    + " WHERE a.event_type = 'purchase'"
)

_BY_SITE = ("a.user_id = b.user_id", "a.user_id % 3 = b.user_id % 3")
_NEAREST_SQL = _range_sql("error", "click", 7, 14, _BACK_FIRST.format(m=_MID))

QUERIES = {
    "asof_within_nearest": asof_within_nearest,
    "asof_within_nearest_split_keys": asof_within_nearest_split_keys,
    "asof_within_event_anchor": asof_within_event_anchor,
    "asof_within_backward": asof_within_backward,
    "asof_within_forward": asof_within_forward,
    "asof_within_removed": asof_within_removed,
    "asof_within_anti": asof_within_anti,
    "nearest_per_label": nearest_per_label,
    "nearest_per_label_split_keys": nearest_per_label_split_keys,
    "nearest_one_label": nearest_one_label,
    "nearest_pair_inner": nearest_pair_inner,
    "dates_semi": dates_semi,
    "first_event_tag": first_event_tag,
}

ORACLES = {
    "asof_within_nearest": _NEAREST_SQL,
    "asof_within_nearest_split_keys": _NEAREST_SQL.replace(*_BY_SITE),
    "asof_within_event_anchor": _range_sql("error", "click", 7, 14, _BACK_FIRST.format(m=0)),
    "asof_within_backward": _range_sql(
        "error", "click", 7, 14, "gap_us DESC, other_id DESC", f"AND epoch_us(b.ts) - epoch_us(a.ts) <= {_MID}"
    ),
    "asof_within_forward": _range_sql(
        "error", "click", 7, 14, "gap_us, other_id", f"AND epoch_us(b.ts) - epoch_us(a.ts) >= {_MID}"
    ),
    "asof_within_removed": """
        SELECT a.event_id, a.user_id FROM events a WHERE a.event_type = 'error' AND NOT EXISTS (
          SELECT 1 FROM events b WHERE b.event_type = 'click' AND b.user_id = a.user_id
          AND b.ts BETWEEN a.ts - INTERVAL 7 DAY AND a.ts + INTERVAL 14 DAY)""",
    "asof_within_anti": """
        SELECT a.event_id, a.user_id FROM events a WHERE a.event_type = 'signup' AND NOT EXISTS (
          SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id
          AND b.ts BETWEEN a.ts - INTERVAL 1 DAY AND a.ts + INTERVAL 2 DAY)""",
    "nearest_per_label": _LABEL_SQL,
    "nearest_per_label_split_keys": _LABEL_SQL.replace(*_BY_SITE),
    "nearest_one_label": """
        WITH r AS (
          SELECT a.event_id, b.value, epoch_us(b.ts) / 86400000000.0 AS e,
                 (epoch_us(b.ts) - epoch_us(a.ts)) / 86400000000.0 AS d,
                 row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(b.ts) - epoch_us(a.ts)),
                   b.ts, b.event_id) AS rn
          FROM events a JOIN events b ON a.user_id = b.user_id
          WHERE a.event_type = 'signup' AND b.event_type = 'error')
        SELECT a.event_id, round(r.value, 6) + 0.0 AS nearest_value, round(r.e, 6) + 0.0 AS nearest_epoch,
               round(r.d, 6) + 0.0 AS nearest_dt
        FROM events a LEFT JOIN r ON r.event_id = a.event_id AND rn = 1 WHERE a.event_type = 'signup'""",
    "nearest_pair_inner": """
        WITH r AS (
          SELECT a.event_id, b.event_id AS other_id, (epoch_us(b.ts) - epoch_us(a.ts)) / 86400000000.0 AS d,
                 row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(b.ts) - epoch_us(a.ts)),
                   b.ts, b.event_id) AS rn
          FROM events a JOIN events b ON a.user_id = b.user_id
          WHERE a.event_type = 'purchase' AND b.event_type = 'click')
        SELECT event_id, other_id, round(d, 6) + 0.0 AS t0_dt FROM r WHERE rn = 1 AND abs(d) < 0.5""",
    "dates_semi": """
        SELECT e.event_id, e.user_id FROM events e WHERE EXISTS (
          SELECT 1 FROM events s WHERE s.event_type = 'signup' AND s.user_id = e.user_id
          AND abs(epoch_us(s.ts) - epoch_us(e.ts)) <= 86400000000)""",
    "first_event_tag": """
        SELECT c.c_custkey, c.c_mktsegment, f.first_f_order, f.first_f_order IS NOT NULL AS has_f_order
        FROM customer c LEFT JOIN (
          SELECT o_custkey, min(o_orderdate) AS first_f_order FROM orders WHERE o_orderstatus = 'F'
          GROUP BY o_custkey) f ON f.o_custkey = c.c_custkey""",
}
