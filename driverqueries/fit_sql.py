"""SQL that fits the models of three coefficients, apart from the operators: rates on a grid of its own, made finer step by step.

For fixed rates a model is linear in three coefficients. The sums of the normal equations are reduced to each case of
bounds that hold with equality, solved by determinants, and the feasible case of least error is taken.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

from medloom.operators.fits import _KAPPA


class Form(NamedTuple):
    """``basis`` per coefficient from t and the rates r1 and r2; ``limits``, four expressions of x0 and xz; ``cases``, per
    case the coefficients as combinations of free values (3 x 3) and of limits (3 x 4); ``inside``, what must hold of c0
    to c2; ``first``, the rates to start from; ``clip``, what a refined rate is kept within."""

    basis: tuple[str, str, str]
    limits: tuple[str, str, str, str]
    cases: list[tuple[list[list[float]], list[list[float]]]]
    inside: str
    first: str
    clip: tuple[str, str]


FREE, NONE, NO_LIMIT = "free", (0, 0, 0), (0, 0, 0, 0)


def _limit(k: int, factor: float = 1.0) -> tuple[float, ...]:
    return tuple(factor if i == k else 0.0 for i in range(4))


def _unit(k: int) -> tuple[float, ...]:
    return tuple(1.0 if i == k else 0.0 for i in range(3))


def _cases(*options):
    """All combinations: an option gives for some coefficients what they are of free values and of limits."""
    for combined in itertools.product(*options):
        parts = {i: v for option in combined for i, v in option.items()}
        yield [list(parts[i][0]) for i in range(3)], [list(parts[i][1]) for i in range(3)]


def _either(k: int, *limits: int, zero: bool = False):
    """Coefficient k is free, at one of the limits, or zero."""
    out = [{k: (_unit(k), NO_LIMIT)}] + [{k: (NONE, _limit(i))} for i in limits]
    return out + ([{k: (NONE, NO_LIMIT)}] if zero else [])


_PAIR = [{1: (_unit(1), NO_LIMIT), 2: (_unit(2), NO_LIMIT)}, {1: (_unit(1), NO_LIMIT), 2: (NONE, NO_LIMIT)},
         {1: (NONE, NO_LIMIT), 2: (_unit(2), NO_LIMIT)}]
for _k in (0, 1):
    _PAIR += [{1: (NONE, _limit(_k)), 2: (NONE, NO_LIMIT)}, {1: (NONE, NO_LIMIT), 2: (NONE, _limit(_k))},
              {1: (_unit(1), NO_LIMIT), 2: ((0, -1, 0), _limit(_k))}]
_LOSS = _either(2, 2, 3)
_EXCESS = [
    {0: (_unit(0), NO_LIMIT), 1: (NONE, NO_LIMIT)}, {0: (_unit(0), NO_LIMIT), 1: (_unit(1), NO_LIMIT)},
    {0: (_unit(0), NO_LIMIT), 1: ((-0.5, 0, 0), NO_LIMIT)}]
for _k in (0, 1):
    _EXCESS += [{0: (NONE, _limit(_k)), 1: (NONE, NO_LIMIT)}, {0: (NONE, _limit(_k)), 1: (_unit(1), NO_LIMIT)},
                {0: (NONE, _limit(_k)), 1: (NONE, _limit(_k, -0.5))}]

RATIO = 1.3
_RATES = [0.001 * RATIO**i for i in range(46)]
_KAPPAS = [_KAPPA[0] * (_KAPPA[1] / _KAPPA[0]) ** (i / 15) for i in range(16)]

BI = Form(
    ("1.0::DOUBLE", "exp(-r1 * t)", "exp(-r2 * t)"), ("0.2 * x0", "10 * x0", "0", "0"),
    list(_cases(_either(0, zero=True), _PAIR)),
    "c0 >= -e AND c1 >= -e AND c2 >= -e AND c1 + c2 >= 0.2 * x0 - e AND c1 + c2 <= 10 * x0 + e",
    f"SELECT a.r AS r1, b.r AS r2 FROM (SELECT unnest({_RATES}::DOUBLE[]) AS r) a, (SELECT unnest({_RATES}::DOUBLE[]) AS r) b WHERE a.r < b.r",
    ("{r}", "{r}"))
FH = Form(
    ("1 - exp(-r1 * t)", "r1 / (r1 - r2) * (exp(-r2 * t) - exp(-r1 * t))", "exp(-r1 * t)"),
    ("10", "greatest(2 * xz, 10)", "0.5 * x0", "2 * x0"),
    list(_cases(_EXCESS, _LOSS)),
    "c0 >= 10 - e AND c0 <= greatest(2 * xz, 10) + e AND c1 <= e AND c1 >= -0.5 * c0 - e AND c2 >= 0.5 * x0 - e AND c2 <= 2 * x0 + e",
    f"SELECT a.r AS r1, b.r AS r2 FROM (SELECT unnest({_RATES}::DOUBLE[]) AS r) a, (SELECT unnest({_KAPPAS}::DOUBLE[]) AS r) b",
    ("{r}", f"greatest(least({{r}}, {_KAPPA[1]!r}), {_KAPPA[0]!r})"))


def _round(form: Form, name: str, candidates: str) -> str:
    """The best rates, coefficients c0 to c2 and error among the candidates (traj_id, cid, r1, r2), per trajectory and cid."""
    both = [(i, j) for i in range(3) for j in range(i, 3)]
    g = lambda i, j: f"g{min(i, j)}{max(i, j)}"
    sums = ", ".join([f"sum(b{i} * b{j}) AS g{i}{j}" for i, j in both] + [f"sum(b{i} * x) AS h{i}" for i in range(3)])
    values = ", ".join(
        "(" + ", ".join([f"{float(v)!r}::DOUBLE" for row in free for v in row] + [f"{float(v)!r}::DOUBLE" for row in at for v in row]) + ")"
        for free, at in form.cases)
    named = ", ".join([f"m{i}{j}" for i in range(3) for j in range(3)] + [f"q{i}{j}" for i in range(3) for j in range(4)])
    fixed = ", ".join(f"q{i}0 * w0 + q{i}1 * w1 + q{i}2 * w2 + q{i}3 * w3 AS k{i}" for i in range(3))
    reduced = ", ".join(
        [f"{' + '.join(f'm{i}{j} * {g(i, l)} * m{l}{n}' for i in range(3) for l in range(3))}"
         + (f" + CASE WHEN m0{j} = 0 AND m1{j} = 0 AND m2{j} = 0 THEN 1 ELSE 0 END" if j == n else "") + f" AS a{j}{n}" for j, n in both]
        + [" + ".join(f"m{i}{j} * (h{i} - {g(i, 0)} * k0 - {g(i, 1)} * k1 - {g(i, 2)} * k2)" for i in range(3)) + f" AS v{j}" for j in range(3)])
    whole = "a00 * (a11 * a22 - a12 * a12) - a01 * (a01 * a22 - a12 * a02) + a02 * (a01 * a12 - a11 * a02)"
    solved = ", ".join([
        "(v0 * (a11 * a22 - a12 * a12) - a01 * (v1 * a22 - a12 * v2) + a02 * (v1 * a12 - a11 * v2)) / det AS y0",
        "(a00 * (v1 * a22 - a12 * v2) - v0 * (a01 * a22 - a12 * a02) + a02 * (a01 * v2 - v1 * a02)) / det AS y1",
        "(a00 * (a11 * v2 - v1 * a12) - a01 * (a01 * v2 - v1 * a02) + v0 * (a01 * a12 - a11 * a02)) / det AS y2"])
    back = ", ".join(f"k{i} + m{i}0 * y0 + m{i}1 * y1 + m{i}2 * y2 AS c{i}" for i in range(3))
    square = " + ".join(f"c{i} * {g(i, j)} * c{j}" for i in range(3) for j in range(3))
    basis = ", ".join(f"{b} AS b{i}" for i, b in enumerate(form.basis))
    limits = ", ".join(f"({w})::DOUBLE AS w{k}" for k, w in enumerate(form.limits))
    return f"""
    {name}s AS (
      SELECT traj_id, cid, x0, xz, r1, r2, sum(x * x) AS xx, {sums} FROM (
        SELECT tp.traj_id, cid, x0, xz, r1, r2, x, {basis} FROM tz tp JOIN {candidates} c ON c.traj_id = tp.traj_id) GROUP BY ALL),
    {name}v AS (SELECT *, {fixed} FROM (SELECT *, {limits} FROM {name}s), (VALUES {values}) cases({named})),
    {name}r AS (SELECT *, {reduced} FROM {name}v),
    {name}d AS (SELECT *, {whole} AS det FROM {name}r),
    {name}y AS (SELECT *, {solved} FROM {name}d WHERE det > 1e-12 * a00 * a11 * a22),
    {name}c AS (SELECT traj_id, cid, x0, xz, r1, r2, xx, {", ".join(f"g{i}{j}" for i, j in both)}, h0, h1, h2, {back} FROM {name}y),
    {name}e AS (
      SELECT traj_id, cid, r1, r2, c0, c1, c2, greatest(xx - 2 * (c0 * h0 + c1 * h1 + c2 * h2) + {square}, 0) AS sse
      FROM (SELECT *, 1e-9 * greatest(abs(c0), abs(c1), abs(c2), 1) AS e FROM {name}c) WHERE {form.inside}),
    {name} AS MATERIALIZED (
      SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, cid ORDER BY sse, r1, r2) AS rn FROM {name}e) WHERE rn = 1)"""


_WHOLE = "(PARTITION BY traj_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_ENDS = f"tz AS MATERIALIZED (SELECT *, last(x) OVER {_WHOLE} AS xz, last(t) OVER {_WHOLE} AS tz FROM tp)"

SQ = Form(
    ("1 - exp(-r1 * t)", "CASE WHEN t >= r2 THEN exp(-r1 * (t - r2)) ELSE 1 END - exp(-r1 * t)", "exp(-r1 * t)"),
    ("0.2 * x0", "10 * x0", "0", "0"),
    list(_cases(_either(0, zero=True), _either(1, zero=True), _either(2, 0, 1))),
    "c0 >= -e AND c1 >= -e AND c2 >= 0.2 * x0 - e AND c2 <= 10 * x0 + e", "", ("", ""))


def switched() -> str:
    """As ``fitted`` for the impulse, r2 being its end.

    The error has a dent between each two times, so the ends around the best one are tried at quarters between the times,
    each for itself, and the deepest dent is followed.
    """

    def finer(k: int, before: str, ratio: float, step: str) -> list[str]:
        factors = [ratio ** (j / 2) for j in range(-2, 3)]
        return [
            f"n{k} AS (SELECT DISTINCT c.traj_id, c.cid, c.r1 * f AS r1, greatest(least(c.r2 + a * {step}, tz), 0) AS r2"
            f" FROM {before} c JOIN ends USING (traj_id), (SELECT unnest({factors}::DOUBLE[]) AS f), (SELECT unnest([-1, -0.5, 0, 0.5, 1]::DOUBLE[]) AS a))",
            _round(SQ, f"z{k}", f"n{k}")]

    out = [
        _ENDS, "ends AS (SELECT traj_id, max(tz) AS tz, max(tz) / count(*) AS gap FROM tz GROUP BY traj_id)",
        f"start AS (SELECT traj_id, i AS cid, r1, tz * i / 20 AS r2 FROM ends, (SELECT unnest({_RATES[::2]}::DOUBLE[]) AS r1), range(21) e(i))",
        _round(SQ, "y0", "start"), "z0 AS (SELECT * FROM y0 QUALIFY row_number() OVER (PARTITION BY traj_id ORDER BY sse, r1, r2) = 1)"]
    for k in range(1, 9):
        # Each step twice: rate and end move together.
        out += finer(2 * k - 1, f"z{2 * k - 2}", RATIO ** (4 / 2**k), f"tz / 20 / {2 ** (k - 1)}")
        out += finer(2 * k, f"z{2 * k - 1}", RATIO ** (4 / 2**k), f"tz / 20 / {2 ** (k - 1)}")
    # All around once more, so that a wide dent isn't kept for the deepest.
    out += [
        f"wide AS (SELECT traj_id, cid, r1 * f AS r1, r2 + tz * j / 250 AS r2 FROM z16 JOIN ends USING (traj_id), (SELECT unnest({[1.015**j for j in range(-8, 9)]}::DOUBLE[]) AS f),"
        " range(-20, 21) w(j) WHERE r2 + tz * j / 250 BETWEEN 0 AND tz)",
        _round(SQ, "v0", "wide")]
    for k in range(40, 44):
        out += finer(k, f"z{k - 1}" if k > 40 else "v0", 1.015 ** (1 / 2 ** (k - 40)), f"tz / 250 / {2 ** (k - 40)}")
    out += [
        "mid AS (SELECT * FROM z43)",
        "times AS (SELECT traj_id, t, lead(t) OVER (PARTITION BY traj_id ORDER BY pos) AS following, row_number() OVER (PARTITION BY traj_id ORDER BY abs(t - r2), pos) AS near"
        " FROM tz JOIN mid USING (traj_id))",
        "around AS (SELECT traj_id, t + (following - t) * q / 4 AS r2, row_number() OVER (PARTITION BY traj_id ORDER BY t, q) AS cid"
        " FROM times, range(4) s(q) WHERE near <= 24 AND following > t)",
        f"scan AS (SELECT a.traj_id, a.cid, mid.r1 * f AS r1, a.r2 FROM around a JOIN mid USING (traj_id), (SELECT unnest({[1.01**j for j in range(-4, 5)]}::DOUBLE[]) AS f))",
        _round(SQ, "w0", "scan"),
        "z17 AS (SELECT * EXCLUDE (least) FROM (SELECT *, min(sse) OVER (PARTITION BY traj_id) AS least FROM w0) WHERE sse <= least * 1.003 + 1e-9)"]
    for k in range(18, 36):
        out += finer(k, f"z{k - 1}" if k != 23 else "deep", 1.01 ** (1 / 2 ** (k - 18)), f"gap / 4 / {2 ** (k - 18)}")
        if k == 22:
            out.append("deep AS (SELECT * EXCLUDE (least) FROM (SELECT *, min(sse) OVER (PARTITION BY traj_id) AS least FROM z22) WHERE sse <= least * (1 + 2e-6) + 1e-9)")
    out.append("best AS (SELECT * FROM z35 QUALIFY row_number() OVER (PARTITION BY traj_id ORDER BY sse, r1, r2) = 1)")
    return ", ".join(out)


def fitted(form: Form, rounds: int = 22) -> str:
    """CTEs after one named tp (traj_id, pos, t, x, x0); the last one, ``best``, has r1, r2, c0, c1, c2 and sse."""
    out = [
        _ENDS,
        f"start AS (SELECT traj_id, 0 AS cid, r1, r2 FROM (SELECT DISTINCT traj_id FROM tp), ({form.first}))", _round(form, "z0", "start")]
    for k in range(1, rounds + 1):
        steps = [RATIO ** (j / 2**k) for j in range(-2, 3)]
        moved = [clip.format(r=f"r{i} * f{i}") for i, clip in enumerate(form.clip, 1)]
        out.append(
            f"n{k} AS (SELECT DISTINCT traj_id, cid, {moved[0]} AS r1, {moved[1]} AS r2 FROM z{k - 1}, (SELECT unnest({steps}::DOUBLE[]) AS f1),"
            f" (SELECT unnest({steps}::DOUBLE[]) AS f2))")
        out.append(_round(form, f"z{k}", f"n{k}"))
    return ", ".join([*out, f"best AS (SELECT * FROM z{rounds})"])
