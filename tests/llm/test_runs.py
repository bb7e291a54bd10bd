"""Runs of words against a plain search of every lag, and results of odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from medloom.llm.runs import find_runs, periodic_runs, run_digests, with_repeated_tails
from .test_operators import ODD, table


def plain_runs(words, least=12):
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    found = [(s, e - s, q) for (s, e), q in best.items() if e - s >= max(least, 2 * q)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def sequences(rnd):
    number = rnd.randint
    cycles = lambda k, most: [w for _ in range(k) for w in ([number(0, 2) for _ in range(number(1, 4))] * 40)[: number(1, most)]]
    odd = ([0, 1] * number(1, 30))[: number(1, 59)]
    block = [number(0, 200) for _ in range(number(1, 90))]
    zeros = [0] * number(1, 50) + [1]
    return [
        [], [5], [number(0, 1) for _ in range(number(1, 200))], fibonacci(number(1, 300)), ([7, 8, 9, 7] * 60)[: number(1, 240)],
        cycles(5, 90), odd + [1, 0, 0] + odd + odd, block * number(1, 4) + [3], zeros * number(1, 5) + [0] * number(0, 60), [0] * 300]


@pytest.mark.parametrize("seed", range(12))
def test_all_runs_are_found(seed):
    rnd = random.Random(seed)
    texts = sequences(rnd)
    rnd.shuffle(texts)
    bounds = np.cumsum([0, *map(len, texts)])
    for least in (2, 12):
        got = find_runs(np.array(sum(texts, []), np.int32), bounds, least)
        want = [(k, *r) for k, words in enumerate(texts) for r in plain_runs(words, least)]
        assert [tuple(r) for r in got.tolist()] == want


def test_touching_short_runs():
    """A long period made of two stretches of one short period, without anything else around the seam."""
    words = [1] + [0, 1] * 30 + [1, 0] * 30 + [0]
    assert [tuple(r[1:]) for r in find_runs(np.array(words, np.int32), np.array([0, len(words)]), 2).tolist()] == plain_runs(words, 2)


def test_a_long_text_takes_steps_in_proportion():
    rnd = random.Random(1)
    cycle = [rnd.randint(0, 10**6) for _ in range(30_000)]
    words = np.array([rnd.randint(0, 10**6) for _ in range(5_000)] + cycle * 5 + [0] * 200_000, np.int32)
    got = find_runs(words, np.array([0, len(words)]))
    assert [tuple(r) for r in got.tolist()] == [(0, 5_000, 150_000, 30_000), (0, 155_000, 200_000, 1)]


def test_rows(spark):
    rnd = random.Random(2)
    texts = [rnd.choice([" ", "\n", " \t "]).join(map(str, words)) for words in sequences(rnd)] + ODD + ["a b  " * 20, "A a " * 7 + "A"]
    docs = table(spark, texts)
    extra = docs.withColumn("runs", docs.lang).withColumn("collapsed", docs.lang).withColumn("n_words", docs.n_chars)
    got = {r["doc_id"]: r for r in periodic_runs(extra.unionByName(extra.limit(0))).collect()}
    assert len(got) == len(texts)
    for doc_id, text in enumerate(texts):
        words = [w.decode() for w in (text or "").encode().split()]
        runs = plain_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        row = got[doc_id]
        assert row["n_words"] == len(words) and [tuple(r) for r in row["runs"]] == runs
        assert row["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert periodic_runs(docs.limit(0)).count() == 0
    digests = {r["doc_id"]: r for r in run_digests(periodic_runs(docs.union(docs))).collect()}
    assert digests[0]["n_runs"] == len(got[0]["runs"])
    none = next(i for i, r in got.items() if not r["runs"])
    assert [digests[none][c] for c in ("start", "length", "period", "exponent_milli")] == [None] * 4


def test_repeated_tails(spark):
    import zlib

    texts = [f"a{i} b c\td\n e f g  h i j" for i in range(60)] + [None, ""]
    got = {r["doc_id"]: r["text"] for r in with_repeated_tails(table(spark, texts)).collect()}
    changed = 0
    for i, text in enumerate(texts):
        h, words = zlib.crc32(str(i).encode()), (text or "").split()
        if h % 10 or not words:
            assert got[i] == text
            continue
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert got[i].split() == words[:a] + [words[a + k % p] for k in range(n - a)]
        changed += 1
    assert changed
