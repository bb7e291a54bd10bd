"""A trajectory searched over several rows has the fit of the one searched in one row."""

from __future__ import annotations

import random

import numpy as np
import pytest

from medloom.operators import fits, separable


def test_switch_of_a_long_trajectory(spark, monkeypatch):
    drawn = random.Random(21)
    steps = [drawn.expovariate(1) for _ in range(60)]
    rows = [("a", k, 0.2 * k, sum(steps[k:])) for k in range(60)]
    points = spark.createDataFrame(rows, "traj_id string, pos int, t double, x double").coalesce(1)
    whole = fits.fit(points, fits.SQ).first()
    monkeypatch.setattr(fits, "STRETCH", 25)
    parts = fits.fit(points, fits.SQ).first()
    for name in whole.asDict():
        assert name == "traj_id" or parts[name] == pytest.approx(whole[name], rel=1e-6)


def lines(count):
    drawn = random.Random(5)
    out = []
    for k in range(count):
        steps = [drawn.expovariate(1) for _ in range(30 + 7 * (k % 5))]
        t = np.array([0.2 * i for i in range(len(steps))])
        x = np.array([sum(steps[i:]) for i in range(len(steps))])
        out.append((fits._times(t, x), t, x))
    return out


@pytest.mark.parametrize("name", ["BI", "SQ", "FH"])
def test_side_by_side_is_one_by_one(monkeypatch, name):
    model, rows, calls = fits.MODELS[name], lines(12), []
    limits = [model.shape.constraints(times) for times, _, _ in rows]
    begun = [separable.begin(model.shape, model.size) for _ in rows]
    alone = separable._descend_each(model.shape, rows, limits, begun, separable.LEAST_STEP, False)
    solve = separable.solve
    monkeypatch.setattr(separable, "solve", lambda *args: calls.append(1) or solve(*args))
    together = separable._descend(model.shape, rows, limits, begun)
    for one, other in zip(alone, together):
        assert other.error == pytest.approx(one.error, rel=1e-9)
    # One small problem for all of a sheet per round, not one per trajectory.
    assert len(calls) < 4 * max(state.rounds for state in together)
