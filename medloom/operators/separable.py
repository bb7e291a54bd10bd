"""Least squares of models that are linear in their coefficients once their rates are fixed, with numpy.

For given rates the coefficients solve a small problem with linear constraints, from the sums of the normal equations.
The rates are searched on a grid scaled by the trajectory's own times and then by a pattern search: the neighbours of
the best point are tried, the centre moves to the best of them, and the step shrinks when the best is near. The
centre may leave the grid, so the grid is a start and no bound.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

ROUNDS = 300
LEAST_STEP = 1e-9


class Times(NamedTuple):
    """What a search needs to know of a trajectory."""

    x0: float
    x_last: float
    t_last: float
    gap: float


class Shape(NamedTuple):
    """A separable model.

    ``grid``: values to start from per rate, given the times; ``scale``: False for rates searched by factors, True for
    those searched by steps as a share of the last time; ``basis``: (grid point, time, coefficient) from times and
    rates; ``constraints``: A and b of A c >= b; ``valid``: which rates may be tried. ``mix``, where all rates are of decays:
    (grid point, coefficient, 1 + rates), how the basis is made of 1 and the decays. ``sums``: a shorter way to the
    sums of a grid, where the model has one of its own. ``scan``, where the error has many local minima over the second
    rate: (second rate, first rate, 2), rates around the best ones, from the times and these. ``columns``, for models of
    one rate that is searched by factors: the columns of the basis from (grid point, time) times rates. ``sheet``, a way to
    the sums of a whole sheet of trajectories, and ``fits_sheet``, whether it holds for the times and rates of a search.
    """

    grid: Callable[[Times], list[np.ndarray]]
    relative: tuple[bool, ...]
    basis: Callable[[np.ndarray, np.ndarray], np.ndarray]
    constraints: Callable[[Times], tuple[np.ndarray, np.ndarray]]
    valid: Callable[[np.ndarray, Times], np.ndarray]
    mix: Callable[[np.ndarray], np.ndarray] | None = None
    sums: Callable[..., Sums] | None = None
    scan: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    columns: Callable[[np.ndarray], list[np.ndarray]] | None = None
    sheet: Callable[..., SheetSums] | None = None
    fits_sheet: Callable[[Times, np.ndarray], np.ndarray] | None = None


class State(NamedTuple):
    """Of a search: rates of the best point, step (0 before the first grid), rounds, error and coefficients."""

    rates: np.ndarray
    step: float
    rounds: int
    error: float
    coefficients: np.ndarray

    @property
    def done(self) -> bool:
        return self.rounds > 0 and (self.step < LEAST_STEP or self.rounds >= ROUNDS or not np.isfinite(self.error))


def begin(shape: Shape, size: int) -> State:
    return State(np.zeros(len(shape.relative)), 0.0, 0, np.inf, np.zeros(size))


def rate_grid(times: Times, steps: int) -> np.ndarray:
    """From a decay that hardly shows by the last time to one that is over within the shortest gap."""
    return np.geomspace(0.01 / times.t_last, np.maximum(20 / times.gap, 1 / times.t_last), steps)


def sums_of(basis: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the normal equations: basis by basis, and basis by value, per grid point."""
    across = basis.transpose(0, 2, 1)
    return across @ basis, across @ x


class Sums(NamedTuple):
    """Of a grid of rates: the sums of the normal equations, and the ``fitted`` values of some grid points (their numbers
    and coefficients), a row each."""

    gram: np.ndarray
    rhs: np.ndarray
    fitted: Callable[[np.ndarray, np.ndarray], np.ndarray]


def plain_sums(shape: Shape, t: np.ndarray, x: np.ndarray, rates: np.ndarray) -> Sums:
    basis = shape.basis(t, rates)
    return Sums(*sums_of(basis, x), lambda some, c: (basis[some] @ c[:, :, None])[:, :, 0])


def decay_sums(shape: Shape, t: np.ndarray, x: np.ndarray, rates: np.ndarray) -> Sums:
    """For a basis mixed from 1 and decays: each decay of the grid is worked out once, and products of two by one multiplication."""
    parts, place, begins = [np.zeros(1)], [np.zeros(len(rates), int)], 1
    for k in range(rates.shape[1]):
        values, at = np.unique(rates[:, k], return_inverse=True)
        parts.append(values)
        place.append(begins + at)
        begins += len(values)
    curves = np.exp(-np.concatenate(parts)[:, None] * t)
    place = np.stack(place, axis=1)
    products, values, mix = curves @ curves.T, curves @ x, shape.mix(rates)
    gram = mix @ products[place[:, :, None], place[:, None, :]] @ mix.transpose(0, 2, 1)

    def fitted(some: np.ndarray, c: np.ndarray) -> np.ndarray:
        if 2 * len(some) < len(curves):
            return (shape.basis(t, rates[some]) @ c[:, :, None])[:, :, 0]
        weights = np.zeros((len(some), len(curves)))
        weights[np.arange(len(some))[:, None], place[some]] = (c[:, None, :] @ mix[some])[:, 0]
        return weights @ curves

    return Sums(gram, (mix @ values[place][:, :, None])[:, :, 0], fitted)


def grid_sums(shape: Shape, t: np.ndarray, x: np.ndarray, rates: np.ndarray) -> Sums:
    """The shortest way to the sums that the model has."""
    return (shape.sums or (plain_sums if shape.mix is None else decay_sums))(shape, t, x, rates)


_SUBSETS: dict[bytes, list] = {}
_PROVED: dict[bytes, list[int]] = {}


def _subsets(a: np.ndarray) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """Sets of constraints that can be active together: the rows, their pseudo-inverse and their null space.

    The empty set comes first.
    """
    key = a.tobytes() + bytes(a.shape)
    if key not in _SUBSETS:
        found = []
        for size in range(a.shape[1] + 1):
            for rows in itertools.combinations(range(len(a)), size):
                part = a[list(rows)].reshape(size, a.shape[1])
                if size and np.linalg.matrix_rank(part) < size:
                    continue
                null = np.linalg.svd(part)[2][size:].T if size else np.eye(a.shape[1])
                found.append((list(rows), np.linalg.pinv(part) if size else np.zeros((a.shape[1], 0)), null))
        _SUBSETS[key], _PROVED[key] = found, [0] * len(found)
    return _SUBSETS[key]


def _solved(square: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of small symmetric systems (system, row, column) with ones on the diagonal, and which are regular.

    One elimination for all systems at once; the determinant is the product of the pivots.
    """
    size = left.shape[1]
    rest, out = [[square[:, i, j] for j in range(size)] for i in range(size)], [left[:, i] for i in range(size)]
    pivots, determinant = [], np.ones(len(left))
    for k in range(size):
        pivot = rest[k][k]
        determinant = determinant * pivot
        pivot = np.where(np.abs(pivot) > 1e-14, pivot, 1.0)
        pivots.append(pivot)
        for i in range(k + 1, size):
            share = rest[i][k] / pivot
            for j in range(k + 1, size):
                rest[i][j] = rest[i][j] - share * rest[k][j]
            out[i] = out[i] - share * out[k]
    for k in reversed(range(size)):
        for j in range(k + 1, size):
            out[k] = out[k] - rest[k][j] * out[j]
        out[k] = out[k] / pivots[k]
    return np.stack(out, axis=1), np.abs(determinant) > 1e-13


def rounding_of(gram: np.ndarray, trial: np.ndarray, xx: np.ndarray) -> np.ndarray:
    """What rounding may have taken from an error that comes from sums, per grid point."""
    size_of = np.abs(trial)
    return 1e-10 * (xx + np.einsum("gi,gi->g", size_of, np.einsum("gij,gj->gi", np.abs(gram), size_of)))


def solve(gram: np.ndarray, rhs: np.ndarray, xx, a: np.ndarray, b: np.ndarray, groups: list[int] | None = None):
    """Best coefficients with A c >= b, and their errors, per grid point.

    The problem is convex: its solution is the least feasible one over all sets of active constraints, and the free
    solution where that is feasible. Errors are infinite where nothing is feasible. ``xx`` and ``b`` hold for all grid
    points, or have a row for each, so that the points of several trajectories are solved together. With ``groups``, the
    lengths of consecutive groups of points, points that can't be the best of their group are left out on the way: no
    bounded error is below the free one.

    A feasible solution whose active constraints all hold it back (multipliers of the right sign) is the best one, so its
    point is done. Sets that proved most points so far are tried first; the order doesn't change what is best.
    """
    points, size = rhs.shape
    xx, b = np.broadcast_to(xx, points), np.broadcast_to(b, (points, len(a)))
    best, chosen = np.full(points, np.inf), np.full((points, size), np.nan)
    todo, (part, right, whole, bound) = np.arange(points), (gram, rhs, xx, b)
    if groups is not None:
        starts, group = np.concatenate([[0], np.cumsum(groups)[:-1]]), np.repeat(np.arange(len(groups)), groups)
        upper = np.full(points, np.inf)
    subsets, proved = _subsets(a), _PROVED[a.tobytes() + bytes(a.shape)]
    for case in [0, *sorted(range(1, len(subsets)), key=lambda k: -proved[k])]:
        rows, inverse, null = subsets[case]
        trial = bound[:, rows] @ inverse.T
        regular = np.ones(len(todo), bool)
        if null.shape[1]:
            free = null.shape[1]
            square = (part.reshape(-1, size * size) @ np.kron(null, null)).reshape(-1, free, free)
            left = (right - np.einsum("gij,gj->gi", part, trial) if rows else right) @ null
            width = np.sqrt(np.maximum(np.einsum("gii->gi", square), 1e-300))
            step, regular = _solved(square / width[:, :, None] / width[:, None, :], left / width)
            trial = trial + (step / width) @ null.T
        slack = 1e-9 * np.maximum(np.abs(trial) @ np.abs(a).T, np.maximum(np.abs(bound), 1.0))
        usable = regular & (trial @ a.T >= bound - slack).all(axis=1)
        pull = np.einsum("gij,gj->gi", part, trial) - right
        error = whole + np.einsum("gi,gi->g", trial, pull - right)
        better = usable & (error < best[todo])
        best[todo[better]], chosen[todo[better]] = error[better], trial[better]
        if groups is not None:
            upper[todo[better]] = (error + rounding_of(part, trial, whole))[better]
        if not rows:
            least = np.where(regular, error - rounding_of(part, trial, whole), -np.inf)
            keep = ~usable
        else:
            rounding = 1e-12 * (np.einsum("gij,gj->gi", np.abs(part), np.abs(trial)) + np.abs(right)).max(axis=1, keepdims=True)
            best_of_all = usable & (pull @ inverse >= -rounding).all(axis=1)
            proved[case] += int(best_of_all.sum())
            keep = ~best_of_all
            if groups is not None:
                keep &= least[todo] <= np.minimum.reduceat(upper, starts)[group[todo]]
        if not keep.any():
            break
        if not keep.all():
            todo = todo[keep]
            part, right, whole, bound = gram[todo], rhs[todo], xx[todo], b[todo]
    return chosen, best


ONE_RATE = (0, -1, 1, -0.75, 0.75, -0.5, 0.5, -0.25, 0.25)


def usable_rates(shape: Shape, times: Times, state: State) -> np.ndarray:
    """The rates to try next that may be tried."""
    rates = propose(shape, times, state)
    usable = shape.valid(rates, times)
    return rates[usable] if usable.any() else rates[:1]


def propose(shape: Shape, times: Times, state: State) -> np.ndarray:
    """The rates to try next, one row per grid point; the first is the centre except on the first grid."""
    if state.rounds == 0:
        axes = shape.grid(times)
        return np.array(list(itertools.product(*axes)))
    steps = (0, -1, 1, -0.5, 0.5) if len(shape.relative) > 1 else ONE_RATE
    moves = np.array(list(itertools.product(steps, repeat=len(shape.relative)))) * state.step
    out = state.rates * np.exp(moves)
    for k, relative in enumerate(shape.relative):
        if relative:
            out[:, k] = np.clip(state.rates[k] + moves[:, k] * times.t_last, 0, times.t_last)
    return out


def accept(shape: Shape, times: Times, state: State, rates: np.ndarray, coefficients: np.ndarray, errors: np.ndarray) -> State:
    errors = np.where(shape.valid(rates, times), errors, np.inf)
    at = int(np.argmin(errors))
    if state.rounds == 0:
        axis = shape.grid(times)[0]
        step = float(np.log(axis[1] / axis[0])) if len(axis) > 1 and not shape.relative[0] else 0.5
        return State(rates[at], step, 1, float(errors[at]), coefficients[at])
    if errors[at] >= state.error:
        return state._replace(step=state.step / 4, rounds=state.rounds + 1)
    moved = np.abs(np.log(np.maximum(rates[at], 1e-300) / np.maximum(state.rates, 1e-300)))
    for k, relative in enumerate(shape.relative):
        if relative:
            moved[k] = abs(rates[at][k] - state.rates[k]) / times.t_last
    near = moved.max() < 0.7 * state.step
    return State(rates[at], state.step / 2 if near else state.step, state.rounds + 1, float(errors[at]), coefficients[at])


def search(shape: Shape, size: int, times: Times, t: np.ndarray, x: np.ndarray) -> State:
    """The whole search over the points of one trajectory."""
    return search_all(shape, size, [(times, t, x)])[0]


def search_all(shape: Shape, size: int, trajectories: list[tuple[Times, np.ndarray, np.ndarray]]) -> list[State]:
    """The whole search of several trajectories side by side, with errors from the residuals themselves.

    Each has its own rates, steps and end; only the small problems of a round are solved together.
    """
    limits = [shape.constraints(times) for times, _, _ in trajectories]
    if shape.columns is not None:
        return _descend_one_rate(shape, trajectories, limits, size) if trajectories else []
    states = _descend(shape, trajectories, limits, [begin(shape, size) for _ in trajectories])
    if shape.scan is None:
        return states
    # Errors have a dent between each two times of a trajectory, and the search ends in one of them: the ones around are tried too.
    owners, begun = [], []
    for k, (state, limit, (_, t, x)) in enumerate(zip(states, limits, trajectories)):
        if np.isfinite(state.error):
            found = _dents(shape, t, x, state, limit)
            owners += [k] * len(found)
            begun += found
    tried = _descend(shape, [trajectories[k] for k in owners], [limits[k] for k in owners], begun, DENT_STEP)
    # Close to the ground, most can't be the deepest any more.
    kept = [(k, state) for k, state in zip(owners, tried) if state.error < states[k].error * DENT_RISE]
    owners = [k for k, _ in kept]
    tried = _descend(shape, [trajectories[k] for k in owners], [limits[k] for k in owners], [state for _, state in kept])
    for k, state in zip(owners, tried):
        if state.error < states[k].error:
            states[k] = state
    return states


DENTS, DENT_DEPTH = 3, 1e-3
# Dents are followed to this step, and further those whose error is then at most so much above the known one.
DENT_STEP, DENT_RISE = 1e-5, 1 + 1e-6
UNKNOWN = 1e300


def _dents(shape: Shape, t: np.ndarray, x: np.ndarray, state: State, limit: tuple[np.ndarray, np.ndarray]) -> list[State]:
    """Starts at other local minima of the error over the second rate, as far as they may be the best one."""
    grid = shape.scan(t, state.rates)
    sums = grid_sums(shape, t, x, grid.reshape(-1, grid.shape[2]))
    return dents_of(grid, sums.gram, sums.rhs, float(x @ x), t, len(t), state, limit)


def dents_of(
    grid: np.ndarray, gram: np.ndarray, rhs: np.ndarray, xx: float, t: np.ndarray, count: int, state: State,
    limit: tuple[np.ndarray, np.ndarray],
) -> list[State]:
    """The same from the sums of the scanned rates, the times around the switch and the number of all times."""
    given, errors = solve(gram, rhs, xx, *limit)
    errors, given = errors.reshape(grid.shape[:2]), given.reshape(*grid.shape[:2], -1)
    rows, at = np.arange(len(grid)), errors.argmin(axis=1)
    # The least error over the first rate, by a parabola through three of its values.
    middle = np.clip(at, 1, grid.shape[1] - 2)
    low, mid, high = (errors[rows, middle + i] for i in (-1, 0, 1))
    with np.errstate(invalid="ignore", divide="ignore"):
        shift = np.where((low + high > 2 * mid) & (middle == at), (low - high) / (2 * (low - 2 * mid + high)), 0.0)
        shift = np.nan_to_num(shift)
        guess = errors[rows, at] - np.where(shift != 0, shift * (low - high) / 4, 0.0)
    first = grid[rows, at, 0] * (grid[rows, 1, 0] / grid[rows, 0, 0]) ** shift
    around = np.concatenate([[np.inf], guess, [np.inf]])
    dent = (guess <= around[:-2]) & (guess <= around[2:]) & (guess <= state.error * (1 + DENT_DEPTH))
    # Not between the same two times as the one that is known; the best ones between the next two need no dent.
    between, known = np.searchsorted(t, second := grid[:, 0, 1]), np.searchsorted(t, state.rates[1])
    best = sorted(np.flatnonzero(dent & (between != known)), key=lambda i: guess[i])[:DENTS]
    for side in (between < known, between > known):
        next_to = np.flatnonzero(side & (between == (between[side].max() if side[0] else between[side].min()))) if side.any() else ()
        if len(next_to) and (i := next_to[np.argmin(guess[next_to])]) not in best and guess[i] <= state.error * (1 + DENT_DEPTH / 5):
            best.append(i)
    # Their error comes from the residuals of the first round; that of the sums is rounded.
    return [State(np.array([first[i], second[i]]), 0.1 / count, 1, UNKNOWN, given[i, at[i]]) for i in best]


def least_ones(errors: np.ndarray, unsure: np.ndarray) -> np.ndarray:
    """Numbers of the grid points that may have the least error, as far as rounding lets tell."""
    near = np.flatnonzero(np.isfinite(errors))
    return near[errors[near] - unsure[near] <= (errors[near] + unsure[near]).min()] if len(near) else near


def _descend_each(shape: Shape, trajectories, limits, states: list[State], least_step: float, only_first: bool) -> list[State]:
    """The rounds of searches one by one, until each is done or, with ``only_first``, has its first grid."""
    squares = [float(x @ x) for _, _, x in trajectories]
    states = list(states)
    open_ = [k for k, state in enumerate(states) if not (state.rounds if only_first else state.done)]
    while open_:
        tried = []
        for k in open_:
            times, t, x = trajectories[k]
            rates = usable_rates(shape, times, states[k])
            tried.append((rates, grid_sums(shape, t, x, rates)))
        counts = [len(rates) for rates, _ in tried]
        gram, rhs = (np.concatenate([sums[i] for _, sums in tried]) for i in (0, 1))
        xx = np.repeat([squares[k] for k in open_], counts)
        found, errors = solve(
            gram, rhs, xx, limits[0][0], np.repeat([limits[k][1] for k in open_], counts, axis=0), counts)
        lost = rounding_of(gram, found, xx)
        ends = np.cumsum(counts)
        for k, (rates, sums), end, count in zip(open_, tried, ends, counts):
            times, t, x = trajectories[k]
            own, given, unsure = errors[end - count:end], found[end - count:end], lost[end - count:end]
            near = least_ones(own, unsure)
            if len(near):
                residual = sums.fitted(near, given[near]) - x
                own = np.full(count, np.inf)
                own[near] = np.einsum("gn,gn->g", residual, residual)
            states[k] = accept(shape, times, states[k], rates, given, own)
        open_ = [k for k in open_ if not only_first and not states[k].done and states[k].step >= least_step]
    return states


class Sheet(NamedTuple):
    """Trajectories as rows of one table: after the last time of a row t is infinite, x is 0 and ``there`` is 0."""

    t: np.ndarray
    x: np.ndarray
    there: np.ndarray


class SheetSums(NamedTuple):
    """Of five first by five second rates per row: the sums (row, grid point, ...), and the ``fitted`` values of some grid points,
    given by their rows, numbers and coefficients."""

    gram: np.ndarray
    rhs: np.ndarray
    fitted: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _decay_sheet(shape: Shape, sheet: Sheet, first: np.ndarray, second: np.ndarray) -> SheetSums:
    """As ``decay_sums``."""
    decays = np.concatenate([first, second], axis=1)
    curves = np.concatenate([sheet.there[:, None, :], np.exp(-decays[:, :, None] * sheet.t[:, None, :])], axis=1)
    count = first.shape[1]
    i, j = np.divmod(np.arange(count * count), count)
    place = np.stack([np.zeros_like(i), 1 + i, 1 + count + j], axis=1)
    mix = shape.mix(np.stack([first[:, i], second[:, j]], axis=2).reshape(-1, 2)).reshape(len(first), count * count, 3, 3)
    products, values = curves @ curves.transpose(0, 2, 1), (curves @ sheet.x[:, :, None])[:, :, 0]
    gram = mix @ products[:, place[:, :, None], place[:, None, :]] @ mix.transpose(0, 1, 3, 2)

    def fitted(rows: np.ndarray, some: np.ndarray, c: np.ndarray) -> np.ndarray:
        weights = (c[:, None, :] @ mix[rows, some])[:, 0]
        return sum(weights[:, k, None] * curves[rows, place[some, k]] for k in range(3))

    return SheetSums(gram, (mix @ values[:, place][:, :, :, None])[:, :, :, 0], fitted)


def _sheets(trajectories, some: list[int]) -> list[list[int]]:
    """Trajectories of much the same length together, so that little of a sheet is empty."""
    out, width, points = [], 0, 0
    for k in sorted(some, key=lambda k: -len(trajectories[k][1])):
        length = len(trajectories[k][1])
        if not out or 3 * length < 2 * width or points + width > SHEET:
            out.append([])
            width, points = length, 0
        out[-1].append(k)
        points += width
    return out


# Places of a sheet, which bound its memory.
SHEET = 65536


def _descend(shape: Shape, trajectories, limits, states: list[State], least_step: float = LEAST_STEP) -> list[State]:
    """The rounds of all searches, until each is done: from the first grid on, trajectories of a sheet side by side."""
    states = _descend_each(shape, trajectories, limits, states, least_step, True)
    summed = shape.mix is not None or shape.sheet is not None
    within = lambda k: summed and (shape.fits_sheet is None or shape.fits_sheet(trajectories[k][0], states[k].rates))
    alike = [k for k, state in enumerate(states) if not state.done and within(k)]
    for some in _sheets(trajectories, alike):
        found = _descend_sheet(shape, [trajectories[k] for k in some], [limits[k] for k in some], [states[k] for k in some], least_step)
        for k, state in zip(some, found):
            states[k] = state
    apart = [k for k, state in enumerate(states) if not state.done and not within(k)]
    rest = _descend_each(shape, [trajectories[k] for k in apart], [limits[k] for k in apart], [states[k] for k in apart], least_step, False)
    for k, state in zip(apart, rest):
        states[k] = state
    return states


MOVES = np.array((0, -1, 1, -0.5, 0.5))


def _descend_sheet(shape: Shape, trajectories, limits, states: list[State], least_step: float) -> list[State]:
    """The same rounds as ``_descend_each`` after the grid, for a sheet at a time."""
    count, longest = len(trajectories), max(len(t) for _, t, _ in trajectories)
    t, x, there = np.full((count, longest), np.inf), np.zeros((count, longest)), np.zeros((count, longest))
    for k, (_, own_t, own_x) in enumerate(trajectories):
        t[k, :len(own_t)], x[k, :len(own_t)], there[k, :len(own_t)] = own_t, own_x, 1
    whole = Times(*(np.array(v) for v in zip(*(times for times, _, _ in trajectories))))
    a, bounds = limits[0][0], np.array([b for _, b in limits])
    squares = np.array([float(own @ own) for _, _, own in trajectories])
    best, step = np.array([s.rates for s in states]), np.array([s.step for s in states])
    rounds, error = np.array([s.rounds for s in states]), np.array([s.error for s in states])
    chosen, open_ = np.array([s.coefficients for s in states], float), np.arange(count)
    size, kinds = chosen.shape[1], len(MOVES)
    i, j = np.divmod(np.arange(kinds * kinds), kinds)
    while len(open_):
        axes = []
        for k, relative in enumerate(shape.relative):
            moved = MOVES * step[open_, None]
            last = whole.t_last[open_, None]
            axes.append(np.clip(best[open_, k, None] + moved * last, 0, last) if relative else best[open_, k, None] * np.exp(moved))
        rates = np.stack([axes[0][:, i], axes[1][:, j]], axis=2)
        times = Times(*(np.repeat(v[open_], kinds * kinds) for v in whole))
        valid = shape.valid(rates.reshape(-1, 2), times).reshape(len(open_), -1)
        usable = valid.copy()
        usable[:, 0] |= ~usable.any(axis=1)
        sums = (shape.sheet or _decay_sheet)(shape, Sheet(t[open_], x[open_], there[open_]), *axes)
        rows, points = np.nonzero(usable)
        gram, rhs, xx = sums.gram[usable], sums.rhs[usable], squares[open_][rows]
        groups = usable.sum(axis=1)
        found, errors = solve(gram, rhs, xx, a, bounds[open_][rows], groups)
        unsure = rounding_of(gram, found, xx)
        with np.errstate(invalid="ignore"):
            high = np.where(np.isfinite(errors), errors + unsure, np.inf)
            highest = np.minimum.reduceat(high, np.concatenate([[0], np.cumsum(groups)[:-1]]))
            near = np.flatnonzero(np.isfinite(errors) & valid[usable] & (errors - unsure <= highest[rows]))
        own, given = np.full(usable.shape, np.inf), np.zeros((*usable.shape, size))
        given[usable] = found
        for part in np.array_split(near, max(len(near) * longest // (4 * SHEET), 1)):
            residual = sums.fitted(rows[part], points[part], found[part]) - x[open_][rows[part]]
            own[rows[part], points[part]] = np.einsum("gn,gn->g", residual, residual)
        at, line = own.argmin(axis=1), np.arange(len(open_))
        least, rate = own[line, at], rates[line, at]
        better = least < error[open_]
        moved = np.abs(np.log(np.maximum(rate, 1e-300) / np.maximum(best[open_], 1e-300)))
        for k, relative in enumerate(shape.relative):
            if relative:
                moved[:, k] = np.abs(rate[:, k] - best[open_, k]) / whole.t_last[open_]
        close = moved.max(axis=1) < 0.7 * step[open_]
        step[open_] = np.where(better, np.where(close, step[open_] / 2, step[open_]), step[open_] / 4)
        changed = open_[better]
        best[changed], error[changed], chosen[changed] = rate[better], least[better], given[line, at][better]
        rounds[open_] += 1
        open_ = open_[(step[open_] >= max(least_step, LEAST_STEP)) & (rounds[open_] < ROUNDS)]
        if shape.fits_sheet is not None:
            open_ = open_[shape.fits_sheet(Times(*(v[open_] for v in whole)), best[open_])]
    return [State(best[k], step[k], int(rounds[k]), float(error[k]), chosen[k]) for k in range(count)]


# Numbers of a table of (grid point, time) that are worked out at a time, so that they stay near the processor.
_AT_ONCE = 1 << 16


class _Line:
    """The points of several trajectories one after the other."""

    def __init__(self, t: np.ndarray, x: np.ndarray, lengths: np.ndarray):
        self.t, self.x, self.lengths = t, x, lengths
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])

    def only(self, kept: np.ndarray) -> "_Line":
        if kept.all():
            return self
        points = kept[self.owner]
        return _Line(self.t[points], self.x[points], self.lengths[kept])

    def sums(self, columns, rates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the normal equations for rates (trajectory, grid point)."""
        grams, sides = [], []
        for a in range(0, rates.shape[1], most := max(_AT_ONCE // len(self.t), 1)):
            basis = columns(rates.T[a : a + most, self.owner] * self.t)
            size = len(basis)
            gram = np.empty((size, size, len(basis[0]), len(rates)))
            for i in range(size):
                for j in range(i, size):
                    gram[i, j] = gram[j, i] = np.add.reduceat(basis[i] * basis[j], self.starts, axis=1)
            grams.append(gram)
            sides.append(np.stack([np.add.reduceat(c * self.x, self.starts, axis=1) for c in basis]))
        return np.concatenate(grams, axis=2).transpose(3, 2, 0, 1), np.concatenate(sides, axis=1).transpose(2, 1, 0)

    def errors(self, columns, rates: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
        """Sums of the squared residuals for one rate per trajectory."""
        basis = columns(rates[self.owner] * self.t)
        residual = sum(c[self.owner] * b for c, b in zip(coefficients.T, basis)) - self.x
        return np.add.reduceat(residual * residual, self.starts)


def _descend_one_rate(shape: Shape, trajectories, limits, size: int) -> list[State]:
    """The same search as ``_descend`` from the grid on, one step of all trajectories at a time."""
    lengths = np.array([len(t) for _, t, _ in trajectories])
    line = _Line(*(np.concatenate([tr[i] for tr in trajectories]).astype(float) for i in (1, 2)), lengths)
    [grid] = shape.grid(Times(*(np.array(v) for v in zip(*(times for times, _, _ in trajectories)))))
    rates = grid.T
    a, bounds = limits[0][0], np.array([b for _, b in limits])
    squares = np.add.reduceat(line.x * line.x, line.starts)
    count = len(trajectories)
    best, step, error = np.zeros(count), np.log(rates[:, 1] / rates[:, 0]), np.full(count, np.inf)
    chosen, rounds, open_ = np.zeros((count, size)), 0, np.arange(count)
    moves = np.array(ONE_RATE)
    while len(open_):
        if rounds:
            rates = best[open_, None] * np.exp(moves * step[open_, None])
        tried = rates.shape[1]
        gram, rhs = line.sums(shape.columns, rates)
        gram, rhs = gram.reshape(-1, size, size), rhs.reshape(-1, size)
        xx = np.repeat(squares[open_], tried)
        found, own = solve(gram, rhs, xx, a, np.repeat(bounds[open_], tried, axis=0), [tried] * len(open_))
        lost = rounding_of(gram, found, xx).reshape(-1, tried)
        found, own = found.reshape(-1, tried, size), own.reshape(-1, tried)
        with np.errstate(invalid="ignore"):
            usable = np.isfinite(own) & (rates > 0)
            highest = np.where(usable, own + lost, np.inf).min(axis=1, keepdims=True)
            near = usable & (own - lost <= highest)
        # Errors from the residuals themselves, of the next near point of every trajectory that has one.
        order, many = np.argsort(~near, axis=1, kind="stable"), near.sum(axis=1)
        errors = np.full(own.shape, np.inf)
        for k in range(many.max()):
            some = np.flatnonzero(many > k)
            at = order[some, k]
            errors[some, at] = line.only(many > k).errors(shape.columns, rates[some, at], found[some, at])
        at = errors.argmin(axis=1)
        rows = np.arange(len(open_))
        least, rate = errors[rows, at], rates[rows, at]
        better = ~(least >= error[open_]) if rounds else np.ones(len(open_), bool)
        if rounds:
            moved = np.abs(np.log(np.maximum(rate, 1e-300) / np.maximum(best[open_], 1e-300)))
            step[open_] = np.where(better, np.where(moved < 0.7 * step[open_], step[open_] / 2, step[open_]), step[open_] / 4)
        changed = open_[better]
        best[changed], error[changed], chosen[changed] = rate[better], least[better], found[rows, at][better]
        rounds += 1
        kept = np.isfinite(error[open_]) & (step[open_] >= LEAST_STEP) & (rounds < ROUNDS)
        line, open_ = line.only(kept), open_[kept]
    return [State(best[k : k + 1], step[k], rounds, error[k], chosen[k]) for k in range(count)]
