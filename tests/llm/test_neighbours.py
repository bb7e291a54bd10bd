"""Nearest neighbours against all pairs, ties among equal vectors, and odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from medloom.llm import neighbours as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA).repartition(parts)


def plain(rows, queries, k=5):
    x = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows}
    out = {}
    for q in queries:
        score = {i: float(v @ x[q] / np.sqrt(v @ v) / np.sqrt(x[q] @ x[q])) for i, v in x.items() if i != q}
        out[q] = [(i, score[i]) for i in sorted(score, key=lambda i: (-round(score[i], 12), i))[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 24))
    rows = [(i, centres[i % 6] + 0.7 * rng.standard_normal(24)) for i in range(900)]
    copy = rows[17][1]
    # A third of all rows is one vector, and there are scaled copies.
    return rows + [(i, copy) for i in range(1000, 1450)] + [(2000 + i, 2 * rows[i][1]) for i in range(30)]


def test_recall_and_ties(spark, clustered):
    queries = [i for i, _ in clustered if i % 50 == 0]
    want = plain(clustered, queries)
    got = found(op.nearest(frame(spark, clustered), F.col("vec_id") % 50 == 0))
    assert set(got) == set(want)
    hits = 0
    for q in queries:
        assert len(got[q]) == 5
        hits += len({i for i, _ in got[q]} & {i for i, _ in want[q]})
        for i, score in got[q]:
            v, w = (np.array(dict(clustered)[k], np.float32).astype(np.float64) for k in (i, q))
            assert score == pytest.approx(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w), abs=1e-12)
    assert hits >= 0.9 * 5 * len(queries)
    assert [i for i, _ in got[1000]] == [17, 1001, 1002, 1003, 1004]
    assert [i for i, _ in got[1050]] == [17, 1000, 1001, 1002, 1003]


def test_a_small_beam_still_answers(spark, clustered):
    got = found(op.nearest(frame(spark, clustered), F.col("vec_id") % 50 == 0, k=3, beam=8))
    assert all(len(v) == 3 for v in got.values()) and len(got) == sum(i % 50 == 0 for i, _ in clustered)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (50, [0, 1]), (1, [1, 1]), (2, None), (3, []), (4, [0, 0]), (5, [nan, 1]), (6, [inf, 1]), (7, [None, 1]), (8, [1, 1, 1]), (None, [1, 1])]
    docs = frame(spark, rows + [rows[2]], 2).withColumn("v", F.lit(1)).withColumn("id", F.lit("x")).withColumn("code", F.lit("x"))
    got = found(op.nearest(docs, F.col("vec_id") % 50 == 0))
    half = pytest.approx(0.5**0.5)
    assert got == {0: [(1, half), (50, 0.0)], 50: [(1, half), (0, 0.0)]}
    assert op.nearest(docs.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert op.nearest(frame(spark, [(0, [1, 2])], 1), F.col("vec_id") % 50 == 0).count() == 0
    same = found(op.nearest(frame(spark, [(i, [1, 2]) for i in range(9)], 2), F.col("vec_id") == 3))
    assert [i for i, _ in same[3]] == [0, 1, 2, 4, 5]
