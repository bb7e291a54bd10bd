"""The registered queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.llm.base import documents, table
from medloom.llm.collocations import collocations
from medloom.llm.counting import token_counts
from medloom.llm.decontamination import contamination
from medloom.llm.fingerprints import fingerprints
from medloom.llm.jaccard import near_duplicates
from medloom.llm.language import language_id
from medloom.llm.neighbours import nearest
from medloom.llm.packing import pack
from medloom.llm.quality import quality
from medloom.llm.runs import periodic_runs, run_digests, with_repeated_tails
from medloom.llm.secrets import secret_spans
from medloom.llm.substrings import repeated_substrings
from medloom.llm.toxicity import toxicity


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("spans")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_repeated_tails(documents(spark, sf_dir))))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_substring_dedup, op3_decontamination, op4_toxicity, op5_secret_scan, op6_jaccard_join, op7_token_counts, op8_quality, op9_packing, op10_language_id, op11_periodic_runs, op12_collocations, op13_nearest_neighbours)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
_TOKENS = f"regexp_extract_all({_LOWER}, '[^ \\t\\n\\v\\f\\r]+')"

ORACLES: dict[str, str] = {
    "op3_decontamination": f"""
        WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
        p AS MATERIALIZED (
          SELECT DISTINCT item, unnest(CASE WHEN len(w) > 13 THEN list_transform(range(len(w) - 12), lambda i: w[i + 1 : i + 13])
            WHEN len(w) > 0 THEN [w] ELSE [] END) AS words FROM b),
        places AS (
          SELECT doc_id, n, unnest(range(len(w) - n + 1)) AS i, w
          FROM d, (SELECT DISTINCT len(words) AS n FROM p) WHERE len(w) >= n),
        hits AS MATERIALIZED (
          SELECT places.doc_id, i, n, item FROM places JOIN p ON p.words = places.w[i + 1 : i + n]),
        covered AS (SELECT doc_id, count(*) AS n_hit FROM (
          SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
          sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id""",
    "op6_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
        s AS MATERIALIZED (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 5 THEN
            list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle
          AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
        reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(reach.b), d.doc_id)) AS component_id
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n""",
    "op11_periodic_runs": """
        WITH crc AS (
          SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, x)
            ORDER BY x) AS t FROM range(256) r(x)),
        crc32_of AS (
          SELECT doc_id, xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT)),
            lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) AS h FROM documents, crc),
        base AS (
          SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w,
            crc32_of.h FROM documents JOIN crc32_of USING (doc_id)),
        tail AS (
          SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM base),
        period AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM tail),
        d AS MATERIALIZED (
          SELECT doc_id, n, CASE WHEN a IS NULL THEN w
            ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM period),
        t AS MATERIALIZED (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM d),
        pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
        islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pairs),
        squares AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM islands GROUP BY doc_id, q, g HAVING count(*) >= q),
        runs AS MATERIALIZED (
          SELECT doc_id, s, len, min(q) AS q FROM squares GROUP BY doc_id, s, len HAVING len >= greatest(12, 2 * min(q))),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
        best AS (SELECT doc_id, count(*) AS n_runs, max_by({'s': s, 'len': len, 'q': q}, [len, -s, -q]) AS b,
          string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.len AS length, b.q AS period,
          1000 * b.len // b.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
          sha256(coalesce(words, '')) AS collapsed_sha256
        FROM d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_collocations": f"""
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\n\\v\\f\\r]')) AS piece FROM documents),
        w AS MATERIALIZED (
          SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
        totals AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
        f AS MATERIALIZED (
          SELECT lang, k AS words, array_to_string(w[i + 1 : i + k], ' ') AS phrase, count(*) AS f
          FROM (SELECT lang, w, k, unnest(range(len(w) - k + 1)) AS i FROM w, range(1, 6) r(k) WHERE len(w) >= k)
          GROUP BY ALL HAVING count(*) >= 100),
        inner_phrases AS (
          SELECT DISTINCT x.lang, array_to_string(p[i + 1 : i + k], ' ') AS phrase, max(x.f) AS most
          FROM (SELECT lang, f, words, string_split(phrase, ' ') AS p FROM f) x, range(2, 5) r(k), range(0, 4) s(i)
          WHERE k < words AND i + k <= words GROUP BY ALL),
        cuts AS (
          SELECT c.lang, c.phrase, c.f AS a, k, array_to_string(string_split(c.phrase, ' ')[1 : k], ' ') AS head,
            array_to_string(string_split(c.phrase, ' ')[k + 1 :], ' ') AS tail
          FROM f c LEFT JOIN inner_phrases s ON s.lang = c.lang AND s.phrase = c.phrase, range(1, 5) r(k)
          WHERE words >= 2 AND k < words AND (most IS NULL OR 100 * most < 100 * c.f)),
        scored AS (
          SELECT cuts.lang, cuts.phrase, k, a, x.f AS l, y.f AS r, n,
            CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
          FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail
          JOIN totals ON totals.lang = cuts.lang),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM (
          SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) WHERE rank <= 2000""",
    # All pairs. The search is exact on tables of up to its beam; sums run in the order of the components.
    "op13_nearest_neighbours": """
        WITH v AS (
          SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        n AS MATERIALIZED (
          SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda s, x: s + x, 0.0::DOUBLE)) AS norm FROM v),
        p AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(c.e, q.e), lambda z: z[1] * z[2]),
            lambda s, x: s + x, 0.0::DOUBLE) / (c.norm * q.norm) AS score
          FROM n q JOIN n c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
