"""Collocations against plain counts, whatever the shards are."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from medloom.llm import collocations as op
from .test_operators import ODD, table


def plain_collocations(rows, support, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    candidates = {key: n for key, n in counts.items() if len(key[1]) > 1 and n >= support}
    inside = Counter()
    for (lang, p), n in candidates.items():
        for part in {p[i : i + k] for k in range(2, len(p)) for i in range(len(p) - k + 1)}:
            inside[lang, part] = max(inside[lang, part], n)
    out = []
    for (lang, p), a in candidates.items():
        if inside[lang, p] >= a:
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], totals[lang], score))
    ranked = []
    for lang in totals:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(best)]
    return sorted(ranked)


def texts(seed):
    rnd = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "ünï", "日本", "a-b", "x", "it's"]
    phrases = ["New York City hall", "state of the art", "日本 x x", "x x x x x x x"]
    return [rnd.choice([" ", "  ", "\t"]).join(rnd.choice(phrases if rnd.random() < 0.3 else words) + rnd.choice(["", "", "", ".", ",", "\n", ";"]) for _ in range(rnd.randint(0, 40))) for _ in range(150)]


@pytest.mark.parametrize("shard_bytes", [400, 3000, 1 << 24])
def test_same_as_plain_counts(spark, shard_bytes):
    rows = texts(1) + ODD + [". ".join(texts(2))]
    docs = table(spark, rows, 4).withColumn("phrase", op.F.lit("p")).withColumn("n", op.F.lit(1)).withColumn("words", op.F.lit(2))
    docs = docs.withColumn("lang", op.F.when(op.F.col("doc_id") % 7 == 0, None).otherwise(op.F.col("lang")))
    langs = [None if i % 7 == 0 else ("en", "de")[i % 2] for i in range(len(rows))]
    got = sorted(tuple(r) for r in op.collocations(docs, support=12, top=40, shard_bytes=shard_bytes).collect())
    want = plain_collocations(list(zip(langs, rows)), 12, 40)
    assert got == want and len(want) > 60


def test_any_bit_table_gives_the_same(spark, monkeypatch):
    docs = table(spark, texts(3), 3)
    want = sorted(tuple(r) for r in op.collocations(docs, support=10, shard_bytes=2000).collect())
    monkeypatch.setattr(op, "MOST_BITS", 1 << 6)
    monkeypatch.setattr(op, "LANGUAGES_SENT", 1)
    assert sorted(tuple(r) for r in op.collocations(docs, support=10, shard_bytes=2000).collect()) == want and want


def test_candidates_do_not_grow_with_the_shards(spark):
    """Phrases that can't reach the support in all shards together are no candidates, however small the shards are."""
    docs = table(spark, texts(5), 4).select("lang", "text")
    few, _ = op.candidates(docs, 12, 1 << 24)
    many, _ = op.candidates(docs, 12, 200)
    want = {r[0] for r in few.collect()}
    assert {r[0] for r in many.collect()} == want and 0 < len(want) < 300


def test_rows_of_the_second_scan_do_not_grow_with_the_phrases(spark):
    """A shard gives at most a row per share, and its counts add up to the same whatever the shards are."""
    texts_of = table(spark, texts(6), 1).selectExpr("'en' as lang", "text").coalesce(1)
    packed = op.local_counts(texts_of, lambda h: h == h, 1 << 24)
    sizes = [len(r["n"]) for r in packed.collect()]
    assert len(sizes) <= 1 + op.SHARES and sum(sizes) > 1000
    shards = op.local_counts(texts_of, lambda h: h == h, 400)
    once, parts = ({(r["phrase"], r["words"], r["n"]) for r in op.added_up(df, 3).collect()} for df in (packed, shards))
    assert once == parts and len(once) > 100 and shards.count() > 20


def test_equal_hashes_are_told_apart():
    block = op.Block(op.pa.array(["a b a c a b", "b a. b"]), op.pa.array(["en", "de"]))
    block.hash[:] = 7
    found = Counter()
    for length, places, counts in op.counts_of(block, lambda h: h == h):
        for at, n in zip(places.tolist(), counts.tolist()):
            found[block.lang[at], tuple(block.spelled[int(block.word[at + k])].as_py() for k in range(length))] += n
    assert found[0, (b"a", b"b")] == 2 and found[1, (b"b", b"a")] == 1 and found[1, (b"b",)] == 2
    assert sum(n for (_, p), n in found.items() if len(p) == 1) == 9


def test_products_beyond_64_bits(spark):
    """Scores are exact where 1000 * a * n passes 64 bits."""
    big = 10**11 + 7
    frequent = spark.createDataFrame([("en", "p q", 2, big), ("en", "p", 1, big), ("en", "q", 1, big + 1)], "lang string, phrase string, words int, n long")
    totals = spark.createDataFrame([("en", 10**13 + 1)], "lang string, words long")
    [row] = op.scored_phrases(frequent, totals, 5).collect()
    assert row["score"] == 1000 * big * (10**13 + 1) // (big * (big + 1)) and row["rank"] == 1


def test_no_rows(spark):
    assert op.collocations(table(spark, texts(4)).limit(0)).count() == 0
    assert op.collocations(table(spark, [None, "", " . "], 1), support=1).count() == 0
