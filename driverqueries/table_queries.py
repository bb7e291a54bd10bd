"""Row-level table operators and result cleaning (R, F, A1-A3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driverqueries.common import events, r6, table
from medloom.functions import results, text, time
from medloom.operators import stats, tables

SYNONYMS = [("signup", "LOOK", "ACT"), (None, "view", "click"), (None, None, "purchase")]


def _wide_synonyms(spark):
    """Header = canonical name, cells = variants, ragged, as a synonym file holds it."""
    return spark.createDataFrame(SYNONYMS, "REGISTER string, LOOK string, ACT string")


def synonym_map(spark, sf_dir):
    pairs = tables.synonym_pairs(_wide_synonyms(spark))
    out = tables.map_synonyms(events(spark, sf_dir), "event_type", pairs, "test_desc")
    return out.select("event_id", "event_type", "test_desc")


def synonym_audit(spark, sf_dir):
    pairs = tables.synonym_pairs(_wide_synonyms(spark))
    named = tables.map_synonyms(events(spark, sf_dir), "event_type", pairs, "test_desc")
    return tables.audit_names(named, "test_desc", pairs, "canonical")


def dedupe_longest(spark, sf_dir):
    """The longest turn of each role in each conversation."""
    turns = table(spark, sf_dir, "conversations").withColumn(
        "report_id", tables.composite_key(F.col("conv_id").cast("string"), F.col("role"))
    )
    out = tables.longest_per_key(turns.select("report_id", "turn", "text"), ["report_id"], "text", ["turn"])
    return out.select("report_id", F.col("turn").cast("bigint").alias("turn"), F.length("text").cast("bigint").alias("n"))


def status_antifilter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn(
        "status", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus"))
    )
    return tables.drop_values(orders, "status", ["P", "F"]).select("o_orderkey", "status")


def _raw_results(spark, sf_dir):
    """Result strings as a laboratory writes them, from the event's number."""
    v = F.format_string("%.2f", F.col("value"))
    raw = (
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("<"), v))
        .when(F.col("event_id") % 7 == 1, F.concat(F.lit(">"), v))
        .when(F.col("event_id") % 7 == 2, F.concat(F.lit("<="), v))
        .when(F.col("event_id") % 13 == 3, F.lit("HEMOLYZED"))
        .otherwise(v)
    )
    return events(spark, sf_dir).select(
        "event_id", "event_type", raw.alias("result"), F.lit(None).cast("string").alias("Result_Text")
    )


def _cleaned(spark, sf_dir):
    return results.interpret_results(
        _raw_results(spark, sf_dir), "event_type", numeric_tests=["view", "click", "purchase"], titer_tests=["error"]
    )


def censored_results(spark, sf_dir):
    return results.accepted(_cleaned(spark, sf_dir)).select(
        "event_id", "result_orig", r6(F.col("result")).alias("result"), F.col("above_below_assay_limit").alias("flag")
    )


def rejected_results(spark, sf_dir):
    return results.rejects(_cleaned(spark, sf_dir)).select("event_id", "result_orig")


def all_numbers(spark, sf_dir):
    found = results.numbers_in(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(found).cast("bigint").alias("n_numbers"),
        F.get(found, F.lit(0)).alias("first_number"),
        F.array_max(found).alias("largest"),
    )


def numbers_near_word(spark, sf_dir):
    near = results.numbers_near(F.col("text"), "license", 26)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(near).cast("bigint").alias("n_near"), F.get(near, F.lit(0)).alias("first_near")
    )


# Result and comment texts; $1 is a titer made from the event's value.
TITER_TEMPLATES = [
    ("$1", None),
    ("<1:20", None),
    ("POSITIVE - SEE TITER", None),
    ("Negative", None),
    ("Positive 1:$1", None),
    ("Positive 1:40, 1:$1", None),
    ("Positive", "Positive at 1:$1"),
    ("Positive", "see report"),
    ("Positive", None),
    ("Negative at 1:20, positive 1:$1", None),
    ("1:$1", None),
    ("pending", None),
    (None, "ANA negative"),
    (None, "Positive at 1:40 and 1:$1 (endpoint)"),
    (None, "1:$1"),
    (None, "Positive at 1:$1 today, was 1:20 and 1:40"),
    (None, "Negative at 1:20 but positive once"),
    (None, None),
    ("Positive", "positive 1:40 1:80 seen, titer 1:$1"),
    ("positive or negative in the long text of this result: 7 $1", None),
]


def _titer_inputs(spark, sf_dir):
    ev = events(spark, sf_dir)
    power = F.pow(F.lit(2), (F.floor("value").cast("int") % 8).cast("double")).cast("int") * 5
    pick = (F.col("event_id") % len(TITER_TEMPLATES)).cast("int")
    lists = [F.array(*[F.lit(t[side]) for t in TITER_TEMPLATES]) for side in (0, 1)]
    result, comment = [F.replace(F.get(c, pick), F.lit("$1"), power.cast("string")) for c in lists]
    return ev.select("event_id", result.alias("result"), comment.alias("comment"))


def titer_values(spark, sf_dir):
    rows = _titer_inputs(spark, sf_dir)
    return rows.select("event_id", results.titer_value(F.col("result"), F.col("comment")).alias("titer"))


def collapse_spaces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spaced, flat = text.collapse_spaces(F.col("text")), text.collapse_whitespace(F.col("text"))
    return docs.select(
        "doc_id",
        F.md5(spaced).alias("spaced"),
        F.md5(flat).alias("flat"),
        F.size(text.words(F.col("text"))).cast("bigint").alias("n_words"),
    )


def cohort_filter(spark, sf_dir):
    part = tables.rename_columns(table(spark, sf_dir, "part"), {"p_name": "name"})
    part = part.filter(F.col("p_size").isin(1, 5, 10, 15, 20, 25) & F.lower("p_type").startswith("s"))
    part = part.filter(tables.name_contains_all(F.col("name"), ["a", "e"]))
    return part.select("p_partkey", "name", "p_size")


def update_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    docs = tables.set_where(
        docs,
        F.col("lang") == "en",
        {
            "has_the": (F.lower("text").contains(" the "), F.lit(False)),
            "at": (F.locate(" the ", F.lower("text")) - 1, F.lit(-1)),
        },
    ).withColumn("quality", F.lit(-1))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return tables.overlay(docs, labels, ["doc_id"], ["quality"]).select("doc_id", "has_the", "at", "quality")


def status_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = tables.count_flag(docs, F.lower("text").contains("license"))
    values = table(spark, sf_dir, "orders").select("o_orderstatus").distinct().agg(
        F.count("o_orderstatus").alias("n_status")
    )
    # Both sides are one row by construction.
    return counts.crossJoin(F.broadcast(values))


def union_parts(spark, sf_dir):
    ev = events(spark, sf_dir)
    parts = [
        ev.filter(F.col("event_type") == "view").select("event_id", "event_type", "value"),
        ev.filter(F.col("event_type") == "click").select("value", "event_id", "event_type"),
        ev.filter(F.col("event_type") == "error").select("event_id", "event_type"),
    ]
    return tables.union_parts(*parts)


def epoch_roundtrip(spark, sf_dir):
    days = time.epoch_days(F.col("ts"))
    return events(spark, sf_dir).select(
        "event_id",
        days.alias("days"),
        time.date_from_days(days, "truncate").alias("truncated"),
        time.date_from_days(days, "round").alias("rounded"),
    )


def binned_stats(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")
    )
    means = stats.binned(items, "x", "y", 7, "mean")
    sems = stats.binned(items, "x", "y", 7, "sem").select("bin", F.col("stat").alias("sem"))
    return means.join(sems, "bin").select(
        "bin", r6(F.col("center")).alias("center"), r6(F.col("stat"), 4).alias("mean"), r6(F.col("sem"), 4).alias("sem")
    )


_TITER_SQL_VALUES = ", ".join(
    "(%d, %s, %s)" % (i, *["NULL" if t is None else "'" + t + "'" for t in pair]) for i, pair in enumerate(TITER_TEMPLATES)
)

# Written from the list of rules, over macros of its own: p/n say which words a text has, nums/near give numbers.
_TITER_SQL = f"""
WITH templates(i, r, c) AS (VALUES {_TITER_SQL_VALUES}),
inp AS (
  SELECT event_id,
    replace(r, '$1', CAST(CAST(5 * pow(2, CAST(floor(value) AS INT) % 8) AS INT) AS VARCHAR)) AS res,
    replace(c, '$1', CAST(CAST(5 * pow(2, CAST(floor(value) AS INT) % 8) AS INT) AS VARCHAR)) AS com
  FROM events JOIN templates ON i = event_id % {len(TITER_TEMPLATES)}),
parts AS (
  SELECT *, try_cast(res AS DOUBLE) AS num,
    list_transform(regexp_extract_all(res, '-?\\d+\\.?\\d*'), lambda x: CAST(x AS DOUBLE)) AS rn,
    list_transform(regexp_extract_all(com, '-?\\d+\\.?\\d*'), lambda x: CAST(x AS DOUBLE)) AS cn,
    list_transform(regexp_extract_all(substring(res, CAST(instr(lower(res), 'positive') AS INT), 26), '-?\\d+\\.?\\d*'),
      lambda x: CAST(x AS DOUBLE)) AS rw,
    list_transform(regexp_extract_all(substring(res, CAST(instr(lower(res), 'positive') AS INT)), '-?\\d+\\.?\\d*'),
      lambda x: CAST(x AS DOUBLE)) AS rt,
    list_transform(regexp_extract_all(substring(com, CAST(instr(lower(com), 'positive') AS INT), 26), '-?\\d+\\.?\\d*'),
      lambda x: CAST(x AS DOUBLE)) AS cw,
    list_transform(regexp_extract_all(substring(com, CAST(instr(lower(com), 'titer') AS INT), 17), '-?\\d+\\.?\\d*'),
      lambda x: CAST(x AS DOUBLE)) AS ct,
    lower(res) LIKE '%positive%' AS rp, lower(res) LIKE '%negative%' AS rneg,
    lower(com) LIKE '%positive%' AS cp, lower(com) LIKE '%negative%' AS cneg
  FROM inp)
SELECT event_id, CASE
  WHEN num IS NOT NULL THEN CASE WHEN num < 20 THEN 0 ELSE num END
  WHEN res IS NULL AND com IS NULL THEN NULL
  WHEN res IS NULL AND cneg AND NOT cp THEN 0
  WHEN res IS NULL AND cp AND NOT cneg THEN CASE
    WHEN len(cw) = 1 THEN cw[1] WHEN len(cw) = 2 AND cw[1] = 1 THEN cw[2] WHEN len(cw) = 4 AND cw[3] = 1 THEN cw[4]
    WHEN len(cw) > 0 THEN coalesce(
      try_cast(regexp_extract(lower(com), 'positive at 1:(\\d+)', 1) AS DOUBLE), list_max(cw)) END
  WHEN res IS NULL AND cp AND cneg THEN CASE
    WHEN len(cw) = 1 THEN cw[1] WHEN len(cw) = 2 AND cw[1] = 1 THEN cw[2] WHEN len(cw) = 4 THEN list_max(cw)
    WHEN lower(com) LIKE '%negative at%' THEN 0 END
  WHEN res IS NULL THEN CASE WHEN len(cn) = 1 THEN cn[1] WHEN len(cn) = 2 AND cn[1] = 1 THEN cn[2] END
  WHEN res LIKE '%<%' THEN 0
  WHEN res LIKE '%ANA SCREEN POSITIVE, TITRE PERFORMED%' OR res LIKE '%POSITIVE - SEE TITER%' THEN NULL
  WHEN rneg AND NOT rp THEN 0
  WHEN rp AND NOT rneg THEN CASE
    WHEN len(rn) = 1 THEN rn[1] WHEN len(rn) = 2 AND rn[1] = 1 THEN rn[2] WHEN len(rn) = 4 AND rn[3] = 1 THEN rn[4]
    WHEN com IS NULL THEN NULL
    WHEN NOT cp THEN 20
    WHEN len(cw) = 1 THEN cw[1] WHEN len(cw) = 2 AND cw[1] = 1 THEN cw[2]
    WHEN len(cw) > 2 THEN CASE WHEN len(ct) = 1 THEN ct[1] WHEN len(ct) = 2 AND ct[1] = 1 THEN ct[2] END END
  WHEN rp AND rneg THEN CASE
    WHEN len(rw) = 1 THEN rw[1] WHEN len(rw) = 2 AND rw[1] = 1 THEN rw[2] ELSE rt[2] END
  WHEN len(rn) = 1 THEN rn[1] WHEN len(rn) = 2 AND rn[1] = 1 THEN rn[2] END :: DOUBLE AS titer
FROM parts
"""

_RAW_SQL = """
WITH raw AS (
  SELECT event_id, event_type, CASE
    WHEN event_id % 7 = 0 THEN '<' || printf('%.2f', value)
    WHEN event_id % 7 = 1 THEN '>' || printf('%.2f', value)
    WHEN event_id % 7 = 2 THEN '<=' || printf('%.2f', value)
    WHEN event_id % 13 = 3 THEN 'HEMOLYZED' ELSE printf('%.2f', value) END AS result_orig
  FROM events),
parsed AS (
  SELECT *, CASE
    WHEN event_type IN ('view', 'click', 'purchase') THEN try_cast(regexp_replace(result_orig, '^[<>]', '') AS DOUBLE)
    WHEN event_type = 'error' THEN CASE
      WHEN result_orig LIKE '%<%' THEN 0
      WHEN result_orig LIKE '>%' THEN try_cast(replace(result_orig, '>', '') AS DOUBLE)
      WHEN try_cast(result_orig AS DOUBLE) < 20 THEN 0 ELSE try_cast(result_orig AS DOUBLE) END
    ELSE try_cast(result_orig AS DOUBLE) END AS v
  FROM raw)
"""

QUERIES = {
    "synonym_map": synonym_map,
    "synonym_audit": synonym_audit,
    "dedupe_longest": dedupe_longest,
    "status_antifilter": status_antifilter,
    "censored_results": censored_results,
    "rejected_results": rejected_results,
    "all_numbers": all_numbers,
    "numbers_near_word": numbers_near_word,
    "titer_values": titer_values,
    "collapse_spaces": collapse_spaces,
    "cohort_filter": cohort_filter,
    "update_merge": update_merge,
    "status_counts": status_counts,
    "union_parts": union_parts,
    "epoch_roundtrip": epoch_roundtrip,
    "binned_stats": binned_stats,
}

ORACLES = {
    "synonym_map": """
        SELECT event_id, event_type, CASE event_type WHEN 'signup' THEN 'REGISTER' WHEN 'view' THEN 'LOOK'
          WHEN 'click' THEN 'ACT' WHEN 'purchase' THEN 'ACT' ELSE event_type END AS test_desc FROM events""",
    "synonym_audit": """
        WITH seen AS (
          SELECT DISTINCT CASE event_type WHEN 'signup' THEN 'REGISTER' WHEN 'view' THEN 'LOOK'
            WHEN 'click' THEN 'ACT' WHEN 'purchase' THEN 'ACT' ELSE event_type END AS name FROM events),
        wanted AS (SELECT unnest(['REGISTER', 'LOOK', 'ACT']) AS name)
        SELECT coalesce(s.name, w.name) AS name, CASE WHEN w.name IS NULL THEN 'additional'
          WHEN s.name IS NULL THEN 'missing' ELSE 'common' END AS status
        FROM seen s FULL JOIN wanted w ON s.name = w.name""",
    "dedupe_longest": """
        WITH r AS (
          SELECT conv_id || '_' || role AS report_id, CAST(turn AS BIGINT) AS turn, length(text) AS n,
            row_number() OVER (PARTITION BY conv_id, role ORDER BY length(text) DESC, turn, text) AS rn FROM conversations)
        SELECT report_id, turn, n FROM r WHERE rn = 1""",
    "status_antifilter": """
        SELECT o_orderkey, status FROM (
          SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS status FROM orders)
        WHERE status IS NULL OR status NOT IN ('P', 'F')""",
    "censored_results": _RAW_SQL + """
        SELECT event_id, result_orig, round(v, 6) + 0.0 AS result, CAST(CASE
          WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 0
          WHEN result_orig LIKE '%<%' THEN -1 WHEN result_orig LIKE '%>%' THEN 1 ELSE 0 END AS INT) AS flag
        FROM parsed WHERE event_type = 'signup' OR v IS NOT NULL""",
    "rejected_results": _RAW_SQL + "SELECT event_id, result_orig FROM parsed WHERE event_type <> 'signup' AND v IS NULL",
    "all_numbers": """
        SELECT doc_id, len(regexp_extract_all(text, '-?\\d+\\.?\\d*')) AS n_numbers,
          CAST(regexp_extract_all(text, '-?\\d+\\.?\\d*')[1] AS DOUBLE) AS first_number,
          list_max(list_transform(regexp_extract_all(text, '-?\\d+\\.?\\d*'), lambda x: CAST(x AS DOUBLE))) AS largest
        FROM documents""",
    "numbers_near_word": """
        WITH w AS (
          SELECT doc_id, CASE WHEN instr(lower(text), 'license') > 0 THEN list_transform(regexp_extract_all(
            substring(text, CAST(instr(lower(text), 'license') AS INT), 26), '-?\\d+\\.?\\d*'),
            lambda x: CAST(x AS DOUBLE)) ELSE [] END AS near FROM documents)
        SELECT doc_id, len(near) AS n_near, near[1] AS first_near FROM w""",
    "titer_values": _TITER_SQL,
    "collapse_spaces": """
        SELECT doc_id,
          md5(array_to_string(list_filter(string_split(text, ' '), lambda w: w <> ''), ' ')) AS spaced,
          md5(array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''), ' '))
            AS flat,
          len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS n_words
        FROM documents""",
    "cohort_filter": """
        SELECT p_partkey, p_name AS name, p_size FROM part WHERE p_size IN (1, 5, 10, 15, 20, 25)
        AND p_type ILIKE 's%' AND p_name LIKE '%a%' AND p_name LIKE '%e%'""",
    "update_merge": """
        SELECT d.doc_id, lang = 'en' AND lower(text) LIKE '% the %' AS has_the,
          CAST(CASE WHEN lang = 'en' THEN instr(lower(text), ' the ') - 1 ELSE -1 END AS INT) AS at,
          coalesce(CAST(l.quality AS INT), -1) AS quality
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "status_counts": """
        SELECT count(*) FILTER (lower(text) LIKE '%license%') AS n_with,
          count(*) FILTER (lower(text) NOT LIKE '%license%') AS n_without,
          (SELECT count(DISTINCT o_orderstatus) FROM orders) AS n_status FROM documents""",
    "union_parts": """
        SELECT event_id, event_type, value FROM events WHERE event_type = 'view'
        UNION ALL SELECT event_id, event_type, value FROM events WHERE event_type = 'click'
        UNION ALL SELECT event_id, event_type, NULL FROM events WHERE event_type = 'error'""",
    "epoch_roundtrip": """
        SELECT event_id, epoch_us(ts) / 86400000000.0 AS days,
          make_timestamp(CAST(trunc(epoch_us(ts) / 86400000000.0 * 86400) AS BIGINT) * 1000000) AS truncated,
          make_timestamp(CAST(round_even(epoch_us(ts) / 86400000000.0 * 86400, 0) AS BIGINT) * 1000000) AS rounded
        FROM events""",
    "binned_stats": """
        WITH lim AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
        b AS (SELECT CAST(i AS INT) AS bin, lo + i * (hi - lo) / 7 AS a, lo + (i + 1) * (hi - lo) / 7 AS z, hi
              FROM lim, range(7) t(i))
        SELECT bin, round((a + z) / 2, 6) + 0.0 AS center, round(avg(l_extendedprice), 4) + 0.0 AS mean,
          round(stddev_pop(l_extendedprice) / sqrt(count(l_extendedprice)), 4) + 0.0 AS sem
        FROM b LEFT JOIN lineitem ON l_quantity >= a AND (l_quantity < z OR (bin = 6 AND l_quantity <= hi))
        GROUP BY bin, a, z""",
}
