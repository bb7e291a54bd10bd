"""Least-squares fits of decay models to all trajectories of a table at once.

Every model is linear in its coefficients once its decay rates (and switch time) are fixed; ``separable`` solves for
the coefficients and searches the rates. A trajectory never has to be in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medloom.functions import models
from medloom.operators.separable import (
    DENT_RISE, DENT_STEP, LEAST_STEP, ROUNDS, UNKNOWN, Shape, Sheet, SheetSums, State, Sums, Times, accept, begin, dents_of, grid_sums,
    least_ones, plain_sums, rate_grid, rounding_of, search_all, solve, usable_rates,
)
from medloom.operators.stats import fit_errors, information_criteria
from medloom.session import cut_lineage


class Model(NamedTuple):
    """A separable model: its search (``shape``, with ``size`` coefficients), the named ``parameters`` from rates and
    coefficients, the ``value`` at t from them, and the names of the ``free`` ones."""

    name: str
    shape: Shape
    size: int
    parameters: Callable[[np.ndarray, np.ndarray], dict[str, float]]
    value: Callable[[Column, dict[str, Column]], Column]
    free: tuple[str, ...]


def _decay(t: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """A row per rate; rates of a grid come again and again, and each is worked out once."""
    values, at = np.unique(rate, return_inverse=True)
    return np.exp(-values[:, None] * t)[at]


def _columns(*parts: np.ndarray) -> np.ndarray:
    """(grid point, time, coefficient), with the times side by side in memory."""
    return np.stack(parts, axis=1).transpose(0, 2, 1)


def _positive(rates: np.ndarray, times: Times) -> np.ndarray:
    return (rates > 0).all(axis=1)


def _ex_basis(t, rates):
    u = _decay(t, rates[:, 0])
    return _columns(1 - u, u)


def _ex_columns(steps):
    u = np.exp(-steps)
    return [1 - u, u]


EX = Model(
    "EX",
    Shape(
        lambda s: [rate_grid(s, 60)], (False,), _ex_basis,
        # B >= 0, 0.2 x0 <= L0 <= 10 x0 for B * (1 - u) + L0 * u
        lambda s: (np.array([[1.0, 0], [0, 1], [0, -1]]), np.array([0, 0.2 * s.x0, -10 * s.x0])),
        _positive, columns=_ex_columns,
    ),
    2,
    lambda r, c: {"L0": c[1], "C": c[0] * r[0], "d": r[0], "drvBLFT": c[0]},
    lambda t, p: models.exponential(t, p["L0"], p["C"], p["d"]),
    ("L0", "C", "d"),
)


def _bi_basis(t, rates):
    first = _decay(t, rates[:, 0])
    return _columns(np.ones_like(first), first, _decay(t, rates[:, 1]))


BI = Model(
    "BI",
    Shape(
        lambda s: [rate_grid(s, 24)] * 2, (False, False), _bi_basis,
        # C, p, q >= 0, 0.2 x0 <= L0 = p + q <= 10 x0
        lambda s: (
            np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1], [0, 1, 1], [0, -1, -1]]),
            np.array([0, 0, 0, 0.2 * s.x0, -10 * s.x0]),
        ),
        lambda r, s: _positive(r, s) & (r[:, 0] < r[:, 1]),
        lambda r: np.broadcast_to(np.eye(3), (len(r), 3, 3)),
    ),
    3,
    lambda r, c: {
        "L0": c[1] + c[2], "C": c[0], "a": c[1] / (c[1] + c[2]) if c[1] + c[2] else 0.0, "d1": r[0], "d2": r[1],
    },
    lambda t, p: models.biexponential(t, p["C"], p["L0"], p["a"], p["d1"], p["d2"]),
    ("L0", "C", "a", "d1", "d2"),
)


def _sq_basis(t, rates):
    u, tau = _decay(t, rates[:, 0]), rates[:, 1:2]
    after = np.where(t >= tau, np.exp(-rates[:, :1] * np.maximum(t - tau, 0)) - 1, 0.0)
    return _columns(1 - u, 1 - u + after, u)


# Beyond this rate times the last time, what is left of a decay is too small to be scaled up again.
_LONGEST_DECAY = 300.0
_SHEET_ROOM = 8.0


def _sq_sums(shape: Shape, t: np.ndarray, x: np.ndarray, rates: np.ndarray) -> Sums:
    """For each rate one decay u: before the switch the impulse is 1 - u, from there on a multiple of u.

    Grid points of a fast rate are summed with their whole basis.
    """
    # The switch may be later than the times of a stretch.
    reach = rates[:, 0] * np.maximum(t[-1], rates[:, 1])
    if (reach > _LONGEST_DECAY).any():
        slow = reach <= _LONGEST_DECAY
        parts = [(np.flatnonzero(~slow), plain_sums(shape, t, x, rates[~slow]))]
        if slow.any():
            parts.append((np.flatnonzero(slow), _sq_sums(shape, t, x, rates[slow])))
        gram, rhs = np.empty((len(rates), 3, 3)), np.empty((len(rates), 3))
        for rows, sums in parts:
            gram[rows], rhs[rows] = sums.gram, sums.rhs
        return Sums(gram, rhs, lambda some, c: plain_sums(shape, t, x, rates[some]).fitted(np.arange(len(some)), c))
    values, at = np.unique(rates[:, 0], return_inverse=True)
    switches, j = np.unique(rates[:, 1], return_inverse=True)
    u = np.exp(-values[:, None] * t)
    rise, on = 1 - u, t >= switches[:, None]
    scale = np.expm1(rates[:, 0] * rates[:, 1])
    early = np.stack([rise * rise, rise * u, rise * x]) @ (~on).T.astype(float)
    late = np.stack([rise * rise, rise * u, rise * x, u * u, u * x]) @ on.T.astype(float)
    rr, ru, rx = (early + late[:3])[:, at, j]
    uu = (u * u).sum(axis=1)[at]
    (err, eru, erx), (_, lru, _, luu, lux) = early[:, at, j], late[:, at, j]
    g01, g12 = err + scale * lru, eru + scale * luu
    gram = np.stack([rr, g01, ru, g01, err + scale * scale * luu, g12, ru, g12, uu], axis=1).reshape(-1, 3, 3)
    rhs = np.stack([rx, erx + scale * lux, (u @ x)[at]], axis=1)

    def fitted(some: np.ndarray, c: np.ndarray) -> np.ndarray:
        level = c[:, 0] + c[:, 1]
        before = level[:, None] + (c[:, 2] - level)[:, None] * u[at[some]]
        after = c[:, :1] + (c[:, 2] - c[:, 0] + c[:, 1] * scale[some])[:, None] * u[at[some]]
        return np.where(on[j[some]], after, before)

    return Sums(gram, rhs, fitted)


def _sq_sheet(shape: Shape, sheet: Sheet, first: np.ndarray, second: np.ndarray) -> SheetSums:
    """As ``_sq_sums``, for a sheet of trajectories."""
    count, (t, x, there) = first.shape[1], sheet
    i, j = np.divmod(np.arange(count * count), count)
    u = np.exp(-first[:, :, None] * t[:, None, :])
    rise, on = (1 - u) * there[:, None, :], (t[:, None, :] >= second[:, :, None]) & (there[:, None, :] > 0)
    off = ((there[:, None, :] > 0) & ~on).astype(float).transpose(0, 2, 1)
    xs, scale = x[:, None, :], np.expm1(first[:, i] * second[:, j])
    parts = np.concatenate([rise * rise, rise * u, rise * xs, u * u, u * xs], axis=1)
    early = (parts[:, :3 * count] @ off).reshape(len(t), 3, count, count)
    late = (parts @ on.astype(float).transpose(0, 2, 1)).reshape(len(t), 5, count, count)
    both = (early + late[:, :3])[:, :, i, j]
    rr, ru, rx = (both[:, k] for k in range(3))
    err, eru, erx = (early[:, k][:, i, j] for k in range(3))
    lru, luu, lux = (late[:, k][:, i, j] for k in (1, 3, 4))
    uu, ux = ((parts[:, k * count:(k + 1) * count].sum(axis=2))[:, i] for k in (3, 4))
    g01, g12 = err + scale * lru, eru + scale * luu
    gram = np.stack([rr, g01, ru, g01, err + scale * scale * luu, g12, ru, g12, uu], axis=2).reshape(len(t), -1, 3, 3)

    def fitted(rows: np.ndarray, some: np.ndarray, c: np.ndarray) -> np.ndarray:
        level, own = (c[:, 0] + c[:, 1])[:, None], u[rows, i[some]]
        after = c[:, :1] + (c[:, 2] - c[:, 0] + c[:, 1] * scale[rows, some])[:, None] * own
        return np.where(on[rows, j[some]], after, level + (c[:, 2][:, None] - level) * own) * there[rows]

    return SheetSums(gram, np.stack([rx, erx + scale * lux, ux], axis=2), fitted)


AROUND = 12


def _sq_scan(t: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Switches at the 12 times before and after the best one and at quarters between, with rates up to 4 % away."""
    j = int(np.searchsorted(t, rates[1]))
    near = np.unique(t[max(j - AROUND, 0) : j + AROUND + 1])
    switches = np.concatenate([*(near[:-1] + np.diff(near) * k / 4 for k in range(4)), near[-1:]])
    switches.sort()
    decays = rates[0] * np.exp(np.linspace(-0.04, 0.04, 7))
    return np.stack(np.broadcast_arrays(decays[None, :], switches[:, None]), axis=2)


SQ = Model(
    "SQ",
    Shape(
        lambda s: [rate_grid(s, 24), np.linspace(0, s.t_last, 13)], (False, True), _sq_basis,
        # B, K >= 0, 0.2 x0 <= L0 <= 10 x0
        lambda s: (
            np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, -1]]), np.array([0, 0, 0.2 * s.x0, -10 * s.x0]),
        ),
        lambda r, s: (r[:, 0] > 0) & (r[:, 1] >= 0) & (r[:, 1] <= s.t_last),
        sums=_sq_sums, scan=_sq_scan, sheet=_sq_sheet,
        # Rates grow by a step at most in a round, and those that would grow beyond are searched one by one.
        fits_sheet=lambda s, r: r[..., 0] * s.t_last * _SHEET_ROOM <= _LONGEST_DECAY,
    ),
    3,
    lambda r, c: {"L0": c[2], "C": c[0] * r[0], "d": r[0], "tau": r[1], "k": c[1] * r[0]},
    lambda t, p: models.square_impulse(t, p["C"], p["L0"], p["k"], p["tau"], p["d"]),
    ("L0", "C", "d", "tau", "k"),
)
# kappa = a / bHEP; the reachable range of a gives the range of kappa.
_KAPPA = (models.BASAL_PRODUCTION * 0.01 / models.LIVER_CELLS, 1 / 30)


def _fh_basis(t, rates):
    d, kappa = rates[:, :1], rates[:, 1:2]
    u = _decay(t, rates[:, 0])
    apart = np.where(np.abs(d - kappa) > 1e-12, d - kappa, 1.0)
    return _columns(1 - u, d / apart * (_decay(t, rates[:, 1]) - u), u)


def _fh_mix(rates):
    d, kappa = rates[:, 0], rates[:, 1]
    share = d / np.where(np.abs(d - kappa) > 1e-12, d - kappa, 1.0)
    out = np.zeros((len(rates), 3, 3))
    out[:, 0, 0], out[:, 0, 1], out[:, 2, 1] = 1, -1, 1
    out[:, 1, 1], out[:, 1, 2] = -share, share
    return out


FH = Model(
    "FH",
    Shape(
        lambda s: [rate_grid(s, 40), np.geomspace(*_KAPPA, 30)], (False, False), _fh_basis,
        # bLFT * (1 - u) + Q * response + L0 * u with Q = bLFT * (H0 / bHEP - 1):
        # 10 <= bLFT <= max(2 x_last, 10), H0 between half of bHEP and bHEP, 0.5 x0 <= L0 <= 2 x0
        lambda s: (
            np.array([[1.0, 0, 0], [-1, 0, 0], [0.5, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]]),
            np.array([10, -max(2 * s.x_last, 10), 0, 0, 0.5 * s.x0, -2 * s.x0]),
        ),
        lambda r, s: (r[:, 0] > 0) & (r[:, 1] >= _KAPPA[0]) & (r[:, 1] <= _KAPPA[1])
        & (np.abs(r[:, 0] - r[:, 1]) > 1e-4 * r[:, 0]),
        _fh_mix,
    ),
    3,
    lambda r, c: {
        "H0": (1 + c[1] / c[0]) * models.LIVER_CELLS, "L0": c[2], "a": r[1] * models.LIVER_CELLS, "d": r[0],
        "bLFT": c[0], "bHEP": models.LIVER_CELLS, "drvK": r[1],
        "drvZ": c[0] * r[0] / (r[1] * models.LIVER_CELLS), "drvFracInjur": -c[1] / c[0],
    },
    lambda t, p: models.cell_loss(t, p["H0"], p["L0"], p["a"], p["d"], p["bLFT"], p["bHEP"]),
    ("H0", "L0", "a", "d", "bLFT"),
)
MODELS = {m.name: m for m in (EX, BI, SQ, FH)}

STRETCH = 4096
# Points of the trajectories that are searched side by side; it bounds memory, not the work.
TOGETHER = 65536
# A short trajectory counts as so many points, as the sums of its grid are as large as those of a long one.
_LEAST_COUNT = 32


def starts(points: DataFrame) -> DataFrame:
    """(traj_id, x0, x_last, t_last, n) of trajectories given as (traj_id, pos, t, x)."""
    point = F.struct("pos", "t", "x")
    ends = points.groupBy("traj_id").agg(
        F.min(point).alias("_a"), F.max(point).alias("_z"), F.count(F.lit(1)).alias("n")
    )
    return ends.select(
        "traj_id", F.col("_a.x").alias("x0"), F.col("_z.x").alias("x_last"), F.col("_z.t").alias("t_last"), "n"
    )


def _stretches(points: DataFrame) -> DataFrame:
    """One row per trajectory and stretch of at most STRETCH positions, with its points in order.

    Searches take long for the size of their points, so they are dealt over all partitions, however small these are.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = points.withColumn("stretch", F.floor(F.col("pos") / STRETCH)).repartition(parts, "traj_id", "stretch")
    rows = rows.groupBy("traj_id", "stretch").agg(
        F.sort_array(F.collect_list(F.struct("pos", "t", "x"))).alias("_p"))
    return rows.select(
        "traj_id", "stretch", *[F.col(f"_p.{c}").cast("array<double>").alias(c) for c in ("t", "x")])


def _times(t: np.ndarray, x: np.ndarray) -> Times:
    gaps = np.diff(t)
    return Times(float(x[0]), float(x[-1]), float(t[-1]), float(gaps[gaps > 0].min()) if (gaps > 0).any() else 0.0)


def _searchable(times: Times) -> bool:
    return times.t_last > 0 and times.gap > 0


def _named(model: Model, traj_id, state: State) -> tuple:
    return traj_id, *model.parameters(state.rates, state.coefficients).values(), max(state.error, 0.0)


def fit(points: DataFrame, model: Model, offset: float = 0.0) -> DataFrame:
    """(traj_id, named parameters, sse) of the best fit of every trajectory (traj_id, pos from 0, t, x).

    ``offset`` shifts the times before the fit. Trajectories without a feasible solution, or with less than two
    times, are left out. A trajectory of up to STRETCH points is searched in one row. A longer one is searched in
    rounds: each stretch gives the sums of the normal equations for the rates of the round, sums are combined per
    task and then per trajectory, so no task holds more than one stretch of points. Both try the same rates to the same
    end, so the fit doesn't depend on where the points are.
    """
    points = points.select("traj_id", "pos", (F.col("t") + F.lit(float(offset))).alias("t"), "x")
    names = list(model.parameters(np.ones(2), np.ones(3)))
    key_type = dict(points.dtypes)["traj_id"]
    schema = f"traj_id {key_type}, " + ", ".join(f"{c} double" for c in [*names, "sse"])

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, ids, group, held = [], [], [], 0

            def finish():
                found = zip(ids, search_all(model.shape, model.size, group)) if group else ()
                out.extend(_named(model, i, state) for i, state in found if np.isfinite(state.error))

            for traj_id, t, x in zip(batch["traj_id"], batch["t"], batch["x"]):
                times = _times(t, x)
                if not _searchable(times):
                    continue
                if group and held + max(len(t), _LEAST_COUNT) > TOGETHER:
                    finish()
                    ids, group, held = [], [], 0
                ids.append(traj_id)
                group.append((times, t, x))
                held += max(len(t), _LEAST_COUNT)
            finish()
            yield pd.DataFrame(out, columns=["traj_id", *names, "sse"])

    long = points.filter(F.col("pos") == STRETCH).select("traj_id")
    if long.isEmpty():
        return cut_lineage(_stretches(points).drop("stretch").mapInPandas(whole, schema))
    long = cut_lineage(long.distinct())
    short = _stretches(points.join(long, "traj_id", "left_anti")).drop("stretch").mapInPandas(whole, schema)
    return cut_lineage(short.unionByName(_fit_long(points.join(long, "traj_id"), model, schema, names)))


# Errors of a round of at least this step differ by more than what rounding takes from sums.
_SURE_STEP = 1e-4
# Rounds of a long trajectory that are worked out in one pass.
_ROUNDS_AHEAD = 4


def _fit_long(points: DataFrame, model: Model, schema: str, names: list[str]) -> DataFrame:
    """The same search, one round of all long trajectories after the other.

    A round takes the sums of all stretches, and, where its errors are as near as rounding, the residuals too.
    """
    rows = cut_lineage(_stretches(points))
    key_type = dict(rows.dtypes)["traj_id"]
    gaps = F.transform(
        F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda v, i: v - F.get("t", i)
    )
    seam = F.lead(F.get("t", F.lit(0))).over(Window.partitionBy("traj_id").orderBy("stretch")) - F.element_at("t", -1)
    ends = rows.select(
        "traj_id", "stretch", F.get("x", F.lit(0)).alias("first"), F.element_at("t", -1).alias("t_end"),
        F.element_at("x", -1).alias("x_end"), F.array_min(F.filter(gaps, lambda g: g > 0)).alias("gap"), F.size("t").alias("n"),
        F.when(seam > 0, seam).alias("seam"), F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v).alias("xx"))
    states = ends.groupBy("traj_id").agg(
        F.min(F.struct("stretch", "first")).alias("_a"), F.max(F.struct("stretch", "t_end", "x_end")).alias("_z"),
        F.min(F.least("gap", "seam")).alias("gap"), F.sum("xx").alias("xx"), F.sum("n").alias("n"),
    ).select(
        "traj_id", F.lit(0).alias("part"), F.col("_a.first").alias("x0"), F.col("_z.x_end").alias("x_last"),
        F.col("_z.t_end").alias("t_last"), F.coalesce("gap", F.lit(0.0)).alias("gap"), "xx", F.col("n").cast("double").alias("n"),
        F.lit(None).cast("array<double>").alias("state"), F.lit(None).cast("array<double>").alias("tried"),
    ).filter("t_last > 0 and gap > 0")
    shape, size, count = model.shape, model.size, len(model.shape.relative)
    keys = ["traj_id", "part"]
    key_schema = f"traj_id {key_type}, part int"
    state_schema = (
        f"{key_schema}, x0 double, x_last double, t_last double, gap double, xx double, n double, state array<double>, tried array<double>")

    def unpack(row) -> tuple[Times, State]:
        times = Times(row.x0, row.x_last, row.t_last, row.gap)
        if row.state is None:
            return times, begin(shape, size)
        v = np.asarray(row.state, float)
        return times, State(v[:count], v[count], int(v[count + 1]), v[count + 2], v[count + 3 :])

    def packed(row, part: int, state: State, tried: np.ndarray | None = None) -> list:
        values = np.concatenate([state.rates, [state.step, state.rounds, state.error], state.coefficients]).tolist()
        tried = None if tried is None else tried.ravel().tolist()
        return [row.traj_id, part, row.x0, row.x_last, row.t_last, row.gap, row.xx, row.n, values, tried]

    def per_task(work, name: str):
        """Adds up what the work gives for each stretch of a task, per search."""

        def run(batches):
            total: dict = {}
            for batch in batches:
                for row in batch.itertuples():
                    key, found = (row.traj_id, row.part), work(row, np.asarray(row.t), np.asarray(row.x))
                    total[key] = total[key] + found if key in total else found
            yield pd.DataFrame(
                {"traj_id": [k for k, _ in total], "part": np.array([p for _, p in total], "int32"), name: list(total.values())})

        return run

    def collected(searches: DataFrame, work, finish) -> DataFrame:
        """Searches after ``finish`` (row of the search, sums of the work over all its points) gave their rows."""

        columns = searches.columns

        def run(rows):
            search = rows["sums"].isna()
            found = finish(next(rows[search].itertuples()), np.sum(list(rows.loc[~search, "sums"]), axis=0))
            return pd.DataFrame(found, columns=columns).astype({"part": "int32"})

        sums = rows.drop("stretch").join(searches, "traj_id").mapInPandas(per_task(work, "sums"), f"{key_schema}, sums array<double>")
        # Not a join of both: its estimated size would be squared in each round.
        both = searches.withColumn("sums", F.lit(None).cast("array<double>")).unionByName(sums, allowMissingColumns=True)
        return both.groupBy(*keys).applyInPandas(run, state_schema)

    def joined(sums) -> np.ndarray:
        return np.concatenate([sums.gram.ravel(), sums.rhs.ravel()])

    def parted(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points = len(total) // (size * size + size)
        cut = points * size * size
        return total[:cut].reshape(points, size, size), total[cut:].reshape(points, size)

    def levels(times: Times, state: State) -> list[np.ndarray]:
        """The rates of this round, and those of the next ones as long as none of them is better."""
        ahead = [state] if state.rounds == 0 else [
            state._replace(step=state.step / 4**k) for k in range(_ROUNDS_AHEAD) if k == 0 or state.step / 4**k >= LEAST_STEP]
        return [usable_rates(shape, times, s) for s in ahead]

    def replayed(times: Times, state: State, rounds: list[tuple]) -> State:
        """After the rounds (rates, coefficients, errors) that were worked out ahead, up to the first that moves on."""
        for tried in rounds:
            before, state = state, accept(shape, times, state, *tried)
            # From this step on errors come from residuals, and the one of the sums is no match for them.
            if before.step >= _SURE_STEP > state.step and np.isfinite(state.error):
                return state._replace(error=UNKNOWN)
            if state.step != before.step / 4 or state.done:
                return state
        return state

    def sums_of_round(row, t, x):
        times, state = unpack(row)
        return joined(grid_sums(shape, t, x, np.concatenate(levels(times, state))))

    def choose(row, total):
        times, state = unpack(row)
        tried, (gram, rhs) = levels(times, state), parted(total)
        xx, rates = np.full(len(gram), row.xx), np.concatenate(tried)
        found, errors = solve(gram, rhs, xx, *shape.constraints(times))
        unsure = rounding_of(gram, found, xx)
        ends = np.cumsum([len(r) for r in tried])
        spans = [slice(end - len(r), end) for r, end in zip(tried, ends)]
        if not 0 < state.step < _SURE_STEP:
            return [packed(row, row.part, replayed(times, state, [(rates[i], found[i], errors[i]) for i in spans]))]
        near = [i.start + least_ones(errors[i], unsure[i]) for i in spans]
        level = np.repeat(np.arange(len(near)), [len(i) for i in near])
        near = np.concatenate(near)
        return [packed(row, row.part, state, np.column_stack([level, rates[near], found[near]]))]

    def tried_of(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tried = np.asarray(row.tried, float).reshape(-1, 1 + count + size)
        return tried[:, 0], tried[:, 1 : 1 + count], tried[:, 1 + count :]

    def residuals_of_round(row, t, x):
        if row.tried is None:
            return np.zeros(1)
        _, rates, given = tried_of(row)
        residual = (shape.basis(t, rates) @ given[:, :, None])[:, :, 0] - x
        return np.einsum("gn,gn->g", residual, residual)

    def settle(row, total):
        times, state = unpack(row)
        if row.tried is None:
            return [packed(row, row.part, state)]
        level, rates, given = tried_of(row)
        rounds = [(rates[level == k], given[level == k], total[level == k]) for k in np.unique(level)]
        return [packed(row, row.part, replayed(times, state, rounds))]

    step, rounds, error = (F.get("state", F.lit(count + i)) for i in range(3))

    def descend(states: DataFrame, least_step: Column) -> DataFrame:
        """All searches until their steps are below the least one, a round each at least."""
        states, finished, least = cut_lineage(states), [], F.lit(LEAST_STEP)
        while True:
            over = F.col("state").isNotNull() & ((step < least) | (rounds >= ROUNDS) | ~(F.abs(error) < np.inf))
            least = least_step
            finished.append(states.filter(over))
            states = states.filter(~over)
            open_ = states.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(step < _SURE_STEP), F.lit(False)).alias("fine")).first()
            if open_.n == 0:
                return reduce(DataFrame.unionByName, finished)
            states = collected(states, sums_of_round, choose)
            if open_.fine:
                states = collected(cut_lineage(states), residuals_of_round, settle)
            states = cut_lineage(states)

    found = descend(states, F.lit(LEAST_STEP))
    if shape.scan is not None:
        found = cut_lineage(found.filter(error < np.inf))
        second = found.select("traj_id", F.get("state", F.lit(1)).alias("second"))
        sides = rows.join(second, "traj_id").groupBy("traj_id").agg(*[
            F.sort_array(F.flatten(F.collect_list(part))).alias(name) for name, part in (
                ("_before", F.reverse(F.slice(F.reverse(F.filter("t", lambda v: v < F.col("second"))), 1, AROUND))),
                ("_after", F.slice(F.filter("t", lambda v: v >= F.col("second")), 1, AROUND + 1)))])
        around = F.concat(F.reverse(F.slice(F.reverse("_before"), 1, AROUND)), F.slice("_after", 1, AROUND + 1))
        near_times = found.drop("tried").join(sides.select("traj_id", around.alias("tried")), "traj_id").select(*found.columns)

        def sums_of_scan(row, t, x):
            grid = shape.scan(np.asarray(row.tried, float), unpack(row)[1].rates)
            return joined(grid_sums(shape, t, x, grid.reshape(-1, count)))

        def begin_dents(row, total):
            (times, state), near = unpack(row), np.asarray(row.tried, float)
            begun = dents_of(
                shape.scan(near, state.rates), *parted(total), row.xx, near, int(row.n), state, shape.constraints(times))
            return [packed(row, part, state) for part, state in enumerate(begun, 1)]

        # Their first steps are small beside the last time; they too are followed to a 16th at least.
        enough = F.least(F.lit(DENT_STEP), F.lit(0.1 / 16) / F.col("n"))
        tried = descend(collected(cut_lineage(near_times), sums_of_scan, begin_dents), enough)
        known = found.select("traj_id", error.alias("known"))
        kept = tried.join(known, "traj_id").filter(error < F.col("known") * DENT_RISE).drop("known")
        found = found.unionByName(descend(kept, F.lit(LEAST_STEP))).groupBy("traj_id").agg(
            F.min_by(F.struct(*[c for c in found.columns if c != "traj_id"]), F.struct(error, "part")).alias("_best"))
        found = found.select("traj_id", "_best.*")

    def name(batches):
        for batch in batches:
            states = [(row.traj_id, unpack(row)[1]) for row in batch.itertuples()]
            yield pd.DataFrame(
                [_named(model, i, s) for i, s in states if np.isfinite(s.error)], columns=["traj_id", *names, "sse"])

    return found.mapInPandas(name, schema)


def parameters_of(fits: DataFrame) -> list[str]:
    return [c for c in fits.columns if c not in ("traj_id", "sse")]


def residual_rows(points: DataFrame, fits: DataFrame, model: Model, offset: float = 0.0) -> DataFrame:
    """Points with the fitted value and the residual (model minus data)."""
    names = parameters_of(fits)
    shifted = points.withColumn("t", F.col("t") + F.lit(float(offset)))
    joined = shifted.join(fits.select("traj_id", *[F.col(n).alias(f"p_{n}") for n in names]), "traj_id")
    value = model.value(F.col("t"), {n: F.col(f"p_{n}") for n in names})
    return joined.withColumn("fitted", value).withColumn("residual", F.col("fitted") - F.col("x")).drop(
        *[f"p_{n}" for n in names]
    )


def fit_statistics(residuals: DataFrame, model: Model) -> DataFrame:
    """qerr, nRMSD, chisqr, redchi, aic and bic per trajectory, from the residuals themselves."""
    residual = F.col("residual")
    sums = fit_errors(residuals, ["traj_id"], also={"_n": F.count(F.lit(1)), "_sse": F.sum(residual * residual)})
    criteria = information_criteria(F.col("_n"), F.col("_sse"), len(model.free))
    return sums.select("traj_id", "qerr", "nRMSD", *[col.alias(name) for name, col in criteria.items()])


def highres_curve(points: DataFrame, fits: DataFrame, model: Model, steps: int = 50) -> DataFrame:
    """The fitted curve at evenly spaced times from 0 to the last time, rounded up to whole days."""
    names = parameters_of(fits)
    ends = starts(points).select("traj_id", F.ceil("t_last").cast("double").alias("_end"))
    at = F.col("step") * F.col("_end") / (steps - 1)
    rows = fits.join(ends, "traj_id").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return rows.withColumn("t", at).select(
        "traj_id", "step", "t", model.value(F.col("t"), {n: F.col(n) for n in names}).alias("x")
    )


def standard_errors(points: DataFrame, fits: DataFrame, model: Model, offset: float = 0.0) -> DataFrame:
    """(traj_id, <parameter>_stderr): root of the diagonal of redchi * inverse(J'J), null where undefined.

    The derivatives are central differences in the row and J'J is a sum; only the inverse of one small matrix
    per trajectory is left to numpy.
    """
    names, size = list(model.free), len(model.free)
    residuals = residual_rows(points, fits, model, offset)
    joined = residuals.join(fits.select("traj_id", *[F.col(n).alias(f"p_{n}") for n in parameters_of(fits)]), "traj_id")
    base = {n: F.col(f"p_{n}") for n in parameters_of(fits)}
    slopes = []
    for i, n in enumerate(names):
        step = F.greatest(F.abs(base[n]) * 1e-5, F.lit(1e-7))
        up = model.value(F.col("t"), {**base, n: base[n] + step})
        down = model.value(F.col("t"), {**base, n: base[n] - step})
        slopes.append(((up - down) / (2 * step)).alias(f"j{i}"))
    rows = joined.select("traj_id", "residual", *slopes)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = rows.groupBy("traj_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("residual") * F.col("residual")).alias("sse"),
        *[F.sum(F.col(f"j{i}") * F.col(f"j{j}")).alias(f"g{i}{j}") for i, j in pairs],
    )
    key_type = dict(sums.dtypes)["traj_id"]

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            count = len(batch)
            square = np.zeros((count, size, size))
            for i, j in pairs:
                square[:, i, j] = square[:, j, i] = batch[f"g{i}{j}"]
            scale = np.sqrt(np.einsum("nii->ni", square))
            known = np.isfinite(square).all(axis=(1, 2)) & (scale > 0).all(axis=1)
            safe = np.where(known[:, None], np.where(scale > 0, scale, 1.0), 1.0)
            scaled = np.where(known[:, None, None], square / safe[:, :, None] / safe[:, None, :], np.eye(size))
            regular = known & (np.abs(np.linalg.det(scaled)) > 1e-13) & (batch["n"].to_numpy() > size)
            scaled[~regular] = np.eye(size)
            diagonal = np.einsum("nii->ni", np.linalg.inv(scaled)) / safe**2
            spare = np.maximum(batch["n"].to_numpy() - size, 1)
            with np.errstate(invalid="ignore"):
                errors = np.sqrt(diagonal * (batch["sse"].to_numpy() / spare)[:, None])
            errors[~regular] = np.nan
            out = pd.DataFrame({f"{n}_stderr": errors[:, i] for i, n in enumerate(names)})
            yield pd.concat([batch[["traj_id"]].reset_index(drop=True), out], axis=1)

    columns = [f"{n}_stderr" for n in names]
    schema = f"traj_id {key_type}, " + ", ".join(f"{c} double" for c in columns)
    raw = sums.mapInPandas(invert, schema)
    return raw.select("traj_id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])
