"""Fits of the larger models as queries: parameters of made-up suppliers come back, by the query and by its SQL form."""

from __future__ import annotations

import datetime
import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from driverqueries import fit_queries

CELLS = 99189.0


def biexponential(t, s):
    return 40 + 300 * (0.3 * math.exp(-0.2 * t) + 0.7 * math.exp(-(1.5 + 0.1 * s) * t))


def straight(t, s):
    return 40 + (210 + 3 * s) * (1 - t / 30)


def cellloss(t, s):
    kappa, d, baseline = 0.03, 0.5 + 0.1 * s, 25.0
    lost = d / (d - kappa) * (math.exp(-kappa * t) - math.exp(-d * t))
    return baseline - baseline * 0.4 * lost + (60 - baseline) * math.exp(-d * t)


def impulse(t, s):
    d, tau = 0.5, 7.03 + s
    pulse = 1 - math.exp(-d * t) + (math.exp(-d * (t - tau)) - 1 if t >= tau else 0)
    return 20 + (100 - 20) * math.exp(-d * t) + 90 * pulse


def remaining(tmp_path, value, step):
    """Line items of three suppliers, whose prices from each day on add up to the value in millions."""
    first, rows = datetime.datetime(1992, 1, 1), []
    for s in range(1, 4):
        days = [step * k for k in range(120)]
        left = [round(value(day / 100, s) * 1000000, 2) for day in days] + [0.0]
        rows += [(s, first + datetime.timedelta(days=day), round(a - b, 2)) for day, a, b in zip(days, left, left[1:])]
    columns = dict(zip(("l_suppkey", "l_shipdate", "l_extendedprice"), map(list, zip(*rows))))
    pq.write_table(pa.table(columns), tmp_path / "lineitem.parquet")
    return str(tmp_path)


def both(spark, sf_dir, name):
    got = [r.asDict() for r in fit_queries.QUERIES[name](spark, sf_dir).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf_dir}/lineitem.parquet'")
    want = con.execute(fit_queries.ORACLES[name]).to_arrow_table().to_pylist()
    key = lambda r: (r["traj_id"], r.get("pos", 0))
    assert sorted(got, key=key) == sorted(want, key=key)
    return {r["traj_id"]: r for r in got}


def test_two_decays_come_back(spark, tmp_path):
    for key, row in both(spark, remaining(tmp_path, biexponential, 20), "fit_biexponential").items():
        assert (row["l0"], row["source_c"], row["a"], row["d1"], row["d2"]) == (300.0, 40.0, 0.3, 0.2, round(1.5 + 0.1 * int(key[1:]), 4))
        assert row["n"] == 120 and row["chisqr"] == 0 and row["own_error"] and row["no_better"] and row["not_worse"]


def test_one_decay_has_no_second_rate(spark, tmp_path):
    for row in both(spark, remaining(tmp_path, straight, 20), "fit_biexponential").values():
        assert (row["source_c"], row["a"], row["d2"]) == (0.0, 1.0, None) and row["d1"] > 0 and row["no_better"]


def test_an_impulse_comes_back(spark, tmp_path):
    for key, row in both(spark, remaining(tmp_path, impulse, 20), "fit_square").items():
        assert (row["l0"], row["source_c"], row["d"], row["k"], row["tau"]) == (100.0, 10.0, 0.5, 45.0, round(7.03 + int(key[1:]), 2))
        assert row["n"] == 120 and row["chisqr"] == 0 and row["own_error"] and row["no_better"] and row["not_worse"]


def test_loss_of_cells_comes_back(spark, tmp_path):
    for key, row in both(spark, remaining(tmp_path, cellloss, 50), "fit_cellloss").items():
        assert row["d"] == round(0.5 + 0.1 * int(key[1:]), 4) and row["l0"] == 60.0 and row["own_error"] and row["no_better"]
        assert row["h0"] == pytest.approx(0.6 * CELLS, rel=1e-3) and row["blft"] == 25.0 and row["a"] == pytest.approx(0.03 * CELLS, rel=1e-3)


def test_curve_of_cells_is_returned(spark, tmp_path):
    sf_dir = remaining(tmp_path, cellloss, 50)
    rows = fit_queries.cellmass_curve(spark, sf_dir).filter("traj_id = 's1'").orderBy("pos").collect()
    assert len(rows) == 120 and all(r.starts_at_h0 and r.rises for r in rows)
    for r in rows:
        assert r.mass == pytest.approx(CELLS * (1 - 0.4 * math.exp(-0.03 * r.t)), rel=1e-3)
