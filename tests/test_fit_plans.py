"""Retried fits, counts, tracks and dates before segments."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from medloom.operators import fits, separable, series
from medloom.plans import fitting
from medloom.plans.trajectories import build_trajectories


def frame(spark, subjects):
    rows = [(k, float(t), float(x)) for k, points in subjects.items() for t, x in points]
    return spark.createDataFrame(rows, "id string, t double, x double").repartition(3)


def falling(start, rate, times, level=20.0):
    return [(t, level + (start - level) * math.exp(-rate * t)) for t in times]


def test_a_failed_fit_is_tried_again_without_its_tail(spark):
    times = [0, 1, 2, 3, 4, 6, 8]
    clean = [(-1, 10.0)] + falling(400, 0.3, times) + [(9, 500.0)]
    # A decay, then a tail that falls in a straight line for a long time: one exponential fits only the first part.
    tail = [(-1, 10.0)] + falling(400, 0.5, times, 150) + [(40 + 30 * k, 149.0 - 14 * k) for k in range(9)]
    rough = [(-1, 5.0)] + [(t, 400.0 - 30 * t - 25 * (t % 2) * (t > 1)) for t in range(9)]
    subjects = {"clean": clean, "tail": tail, "rough": rough}
    kept = fitting.fit_peaks(frame(spark, subjects), ["id"], "id", min_points=4, min_height=150, worst_nrmsd=0.02)
    got = {r.id: r for r in kept.table.collect()}
    assert got["clean"].outcome == "first" and got["clean"].d == pytest.approx(0.3, rel=1e-3)
    assert got["tail"].outcome == "second" and got["tail"].n_used < got["tail"].n and got["tail"].d == pytest.approx(0.5, rel=0.05)
    assert got["rough"].outcome == "failed" and got["rough"].d is None and got["rough"].n_used == got["rough"].n
    counts = kept.counts.first()
    assert (counts.num_meeting_traj_criteria, counts.num_fit, counts.num_fit_after_cut) == (3, 2, 1) and counts.num_peaks >= 3
    curves = kept.curves.groupBy("traj_id").count().collect()
    assert sorted(r["count"] for r in curves) == [50, 50]
    assert {c for c in got["clean"].asDict()} >= {"L0", "C", "d", "d_stderr", "qerr", "nRMSD", "peak", "t0", "tf", "tlen", "x0", "xf"}
    free = fitting.fit_peaks(frame(spark, subjects), ["id"], "id", min_points=4, min_height=150)
    assert {r.outcome for r in free.table.collect()} == {"first"}
    none = fitting.fit_peaks(frame(spark, {"low": [(0, 1.0), (1, 2.0), (2, 1.0)]}), ["id"], "id")
    assert none.table.count() == 0 and none.counts.first().num_fit == 0


def test_dates_choose_peaks_before_segments(spark):
    points = [(0, 10), (1, 300), (2, 200), (3, 250), (4, 100), (5, 50), (6, 40), (7, 10)]
    dates = spark.createDataFrame([("a", 1.0)], "id string, day double")
    near = lambda peaks: peaks.join(dates, "id").filter(F.abs(F.col("peak_t") - F.col("day")) <= 0.5)
    found = series.find_peaks(frame(spark, {"a": points}), ["id"], 1, edge=True, choose=near)
    assert [(r.ll, r.ul) for r in found.peaks.collect()] == [(1, 3)]
    loose = series.find_peaks(frame(spark, {"a": points}), ["id"], 1, edge=True, strict=False, choose=near)
    assert [(r.ll, r.ul) for r in loose.peaks.collect()] == [(1, 8)]


def test_tracks(spark):
    rate, level = 0.6, 30.0
    points = [("s", k, float(t), level + 400 * math.exp(-rate * t)) for k, t in enumerate([0, 1, 2.5, 3, 5, 6])]
    df = spark.createDataFrame(points, "traj_id string, pos long, t double, x double")
    rows = {r.pos: r for r in fitting.rolling_tracks(df, rate).collect()}
    assert set(rows) == set(range(5)) and rows[4].C_track3 is None
    for k in range(4):
        assert rows[k].C_track2 == pytest.approx(rate * level, rel=1e-6)
        assert rows[k].d_track3 == pytest.approx(rate, rel=1e-3) and rows[k].C_track3 == pytest.approx(rate * level, rel=1e-2)
        (_, _, t, x), (_, _, u, y) = points[k], points[k + 1]
        assert rows[k].delta_EX == pytest.approx(y - x * math.exp(-rate * (u - t)))
        assert rows[k].delta_EX_UL == pytest.approx(y - x * math.exp(-0.8 * (u - t)))
    wide = spark.createDataFrame([("s", 1.0), ("z", 2.0)], "traj_id string, d_EX_ALT double")
    out = fitting.with_tracks(wide, fitting.rolling_tracks(df, rate, eval_C_d=False), "ALT")
    assert out.columns == ["traj_id", "d_EX_ALT", "pos", "delta_EX_ALT", "delta_EX_LL_ALT", "delta_EX_UL_ALT", "C_track2_ALT"]
    assert out.count() == 6
    with pytest.raises(ValueError):
        fitting.rolling_tracks(df, delta_EX=False, eval_C=False, eval_C_d=False)


def test_counts_come_from_what_is_there(spark, tmp_path):
    rows = [("p", "ALT", float(t), x) for t, x in enumerate([10.0, 900.0, 500.0, 200.0, 90.0, 50.0])] + [("q", "ALT", 0.0, 5.0)]
    spark.createDataFrame(rows, "id string, lab string, t double, x double").write.parquet(str(tmp_path / "e"))
    built = build_trajectories(spark.read.parquet(str(tmp_path / "e")), "id", "lab", ["ALT"], min_points=2, min_height=100)
    plan = built.run_meta._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan
    row = built.run_meta.first()
    assert (row.num_input_ids, row.num_traj_meeting_criteria) == (2, 1)


def test_trajectories_searched_side_by_side_end_where_each_ends_alone():
    rng = np.random.default_rng(7)
    tracks = []
    for n in (3, 8, 40, 200):
        t = np.concatenate([[0.0], np.cumsum(rng.uniform(0.05, 0.4, n - 1))])
        x = 5 + 80 * np.exp(-0.7 * t) + rng.normal(0, 0.5, n)
        tracks.append((fits._times(t, x), t, x))
    for model in fits.MODELS.values():
        sizes = []

        def basis(t, rates, of=model.shape.basis):
            sizes.append(len(rates))
            return of(t, rates)

        shape = model.shape._replace(basis=basis)
        together = separable.search_all(shape, model.size, tracks)
        alone = [separable.search(model.shape, model.size, *track) for track in tracks]
        for a, b, (times, t, x) in zip(together, alone, tracks):
            assert abs(a.error - b.error) <= 1e-9 * (1 + b.error)
            part = model.shape.basis(t, a.rates[None])[0]
            assert abs(np.sum((part @ a.coefficients - x) ** 2) - a.error) <= 1e-9 * (1 + a.error)
            # No point of the first grid, solved by itself and without any shortcut, is better.
            grid = separable.propose(model.shape, times, separable.begin(model.shape, model.size))
            grid = grid[model.shape.valid(grid, times)]
            sums = separable.sums_of(model.shape.basis(t, grid), x)
            _, errors = separable.solve(*sums, float(x @ x), *model.shape.constraints(times))
            assert a.error <= errors.min() + 1e-6 * (1 + x @ x)
        if model.shape.mix is not None:
            # The basis of a whole grid is never made.
            assert max(sizes[:4]) < len(grid)


def test_three_point_track_gives_the_best_rate_also_where_points_are_unknown(spark):
    rows = [("a", i, 0.5 * i, 3 + 40 * math.exp(-0.9 * 0.5 * i)) for i in range(6)]
    rows += [("b", 0, 0.0, 5.0), ("b", 1, 1.0, None), ("b", 2, 2.0, 3.0), ("b", 3, 3.0, 2.0), ("b", 4, 4.0, 1.5), (None, 0, 0.0, 1.0)]
    rows += [("c", i, 1.0, 7.0) for i in range(3)]
    points = spark.createDataFrame(rows, "id string, pos bigint, t double, x double")
    track = series.three_point_track(points, ["id"], "pos")
    # No rate is tried by expressions in the row, of which each repeats the ones before it.
    assert "MapInArrow" in track._jdf.queryExecution().toString()
    assert track.dtypes == [("id", "string"), ("pos", "bigint"), ("C", "double"), ("d", "double"), ("sse", "double")]
    found = {(r["id"], r["pos"]): r for r in track.collect()}
    assert sorted(found) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1), ("b", 2), ("c", 0)]
    for pos in range(4):
        r = found["a", pos]
        assert r["sse"] < 1e-9 and abs(r["d"] - 0.9) < 1e-3 and abs(r["C"] - 2.7) < 1e-2
    assert found["b", 0]["sse"] is None and found["b", 0]["C"] == 0
    assert found["b", 2]["sse"] >= 0
    assert found["c", 0]["sse"] == 0


@pytest.mark.parametrize("model", fits.MODELS.values(), ids=list(fits.MODELS))
def test_short_sums_and_early_ends_give_the_best_of_all_cases(model):
    """Against the whole basis, and the least feasible solution over every set of active bounds, for fast rates too."""
    random = np.random.default_rng(5)
    t = np.cumsum(random.uniform(0.01, 0.3, 60)) - 0.01
    for x in (random.uniform(0, 50, 60), 30 - t, 5 + 40 * np.exp(-0.3 * t)):
        times = fits._times(t, x)
        rates = separable.propose(model.shape, times, separable.begin(model.shape, model.size))
        rates = rates[model.shape.valid(rates, times)]
        plain, short = separable.plain_sums(model.shape, t, x, rates), separable.grid_sums(model.shape, t, x, rates)
        for wanted, got in zip(plain[:2], short[:2]):
            np.testing.assert_allclose(got, wanted, rtol=1e-9, atol=1e-9 * np.abs(wanted).max())
        a, b = model.shape.constraints(times)
        found, errors = separable.solve(short.gram, short.rhs, float(x @ x), a, b)
        some = np.arange(0, len(rates), 3)
        np.testing.assert_allclose(short.fitted(some, found[some]), plain.fitted(some, found[some]), rtol=1e-9, atol=1e-8)
        least = np.full(len(rates), np.inf)
        for rows, inverse, null in separable._subsets(a):
            start = inverse @ b[rows]
            for k, (gram, rhs) in enumerate(zip(plain.gram, plain.rhs)):
                step = null @ np.linalg.lstsq(null.T @ gram @ null, null.T @ (rhs - gram @ start), rcond=None)[0] if null.size else 0
                c = start + step
                if (a @ c >= b - 1e-9 * np.maximum(np.abs(a) @ np.abs(c), np.maximum(np.abs(b), 1))).all():
                    least[k] = min(least[k], x @ x + c @ gram @ c - 2 * c @ rhs)
        assert np.isfinite(errors).all() and (errors <= least + 1e-7 * (x @ x)).all() and (errors >= least - 1e-7 * (x @ x)).all()


def test_simple_model_is_searched_side_by_side():
    """Trajectories of any lengths in one line are fitted as each by itself, and in few steps of numpy."""
    rnd = np.random.default_rng(3)
    group = []
    for n in [2, 3, 5, 40, 700, 4, 2, 9] * 5:
        t = np.cumsum(rnd.integers(1, 5, n)) / 10.0
        x = rnd.uniform(20, 200) * np.exp(-rnd.uniform(0.01, 2) * (t - t[0])) + rnd.uniform(0, 30) + rnd.normal(0, 1, n)
        group.append((fits._times(t - t[0], x), t - t[0], x))
    group[7] = (group[7][0]._replace(x0=math.nan), *group[7][1:])
    shape = fits.EX.shape
    found = separable.search_all(shape, 2, group)
    limits = [shape.constraints(times) for times, _, _ in group]
    for state, limit, one in zip(found, limits, group):
        [alone] = separable._descend(shape, [one], [limit], [separable.begin(shape, 2)])
        assert np.isfinite(state.error) == np.isfinite(alone.error)
        if np.isfinite(alone.error):
            assert state.error == pytest.approx(alone.error, rel=1e-9, abs=1e-9)
    calls = []
    counted = shape._replace(columns=lambda steps: calls.append(1) or shape.columns(steps))
    separable.search_all(counted, 2, group)
    assert len(calls) < 50 * len(group)


def test_searches_are_dealt_over_all_partitions(spark):
    """Few bytes of points are long work, so adaptive planning doesn't put them into one task."""
    rows = [(f"t{k}", p, float(p), 100.0 * 0.9**p + k) for k in range(40) for p in range(4)]
    points = spark.createDataFrame(rows, "traj_id string, pos long, t double, x double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert fits.fit(points, fits.EX).rdd.getNumPartitions() == parts > 1
