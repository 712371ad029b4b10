"""Reduction to the pole under angles that vary over the grid, and its transform in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from gridloom.operators import spectral
from gridloom.plans.registry import GRID_SQL, N, add, grid, out

_SIZE, _GAP = 64, 8  # 48 cells and 8 on either side
_INC, _DEC = (-68.0, -64.0, -72.0, -66.0), (-6.0, 8.0, -2.0, 11.0)
_INC_CENTRE, _DEC_CENTRE = -66.0, 4.0


def rtp_variable(s: SparkSession, d: str) -> DataFrame:
    found = spectral.variable_reduction_to_pole(grid(s, d), N, N, spectral.corner_angles(N, N, _INC, _INC_CENTRE), spectral.corner_angles(N, N, _DEC, _DEC_CENTRE))
    return out(found, 3, "v", "base", "inclination", "declination")


def _angle(corners: tuple, centre: float, x: str, y: str) -> str:
    """Weights of the corners nw, ne, sw, se at (x, y) from the south-west, 0..1, and the bump of the centre."""
    nw, ne, sw, se = corners
    return f"({nw} * (1 - {x}) * {y} + {ne} * {x} * {y} + {sw} * (1 - {x}) * (1 - {y}) + {se} * {x} * (1 - {y}) + ({centre} - ({nw} + {ne} + {sw} + {se}) / 4.0) * 16 * {x} * ({x} - 1) * {y} * ({y} - 1))"


def _centre(corners: tuple, centre: float) -> float:
    """In radians at the 25th of 48 columns and rows counted from the south-west."""
    t = 24 / 47
    return math.radians(eval(_angle(corners, centre, str(t), str(t))))


def _pole_sql(inc: float, dec: float) -> tuple[str, str]:
    """Real and imaginary part of the response at (kx, ky)."""
    t, a = "(kx * kx + ky * ky)", f"({math.cos(dec) * math.cos(inc)!r} * ky + {math.sin(dec) * math.cos(inc)!r} * kx)"
    n = repr(math.sin(inc))
    top = f"({n} * {n} * {t} - {a} * {a})"
    under = f"({top} * {top} + 4 * {n} * {n} * {a} * {a} * {t})"
    return f"({t} * {top} / {under})", f"(-2 * {n} * {a} * power({t}, 1.5) / {under})"


def _pass(name: str, source: str, responses: dict[str, tuple[str, str]]) -> str:
    """Relations up to ``name(tag, row, col, v)``: ``source`` padded, transformed, filtered, brought back and cropped."""
    m = _SIZE
    ang = lambda a, b: f"2 * pi() * (({a} * {b}) % {m}) / {m}"
    forms = " UNION ALL ".join(f"SELECT '{t}' AS tag, u, w, re * {a} - im * {b} AS re, re * {b} + im * {a} AS im FROM {name}k" for t, (a, b) in responses.items())
    wave = lambda i: f"(CASE WHEN {i} < {m // 2} THEN {i} + 1 ELSE {i} - {m} END) * 2 * pi() / {m - 1}"
    return f"""{name}x AS (SELECT rm.i AS row, cm.j AS col, s.v * rm.w * cm.w AS x FROM {source} s JOIN cm ON cm.q = s.col JOIN rm ON rm.p = s.row AND rm.kind = cm.kind),
{name}a AS (SELECT row, f.i AS w, sum(x * cos({ang('col', 'f.i')})) AS re, -sum(x * sin({ang('col', 'f.i')})) AS im FROM {name}x, f GROUP BY 1, 2),
{name}s AS MATERIALIZED (SELECT f.i AS u, w, sum(re * cos({ang('row', 'f.i')}) + im * sin({ang('row', 'f.i')})) AS re, sum(im * cos({ang('row', 'f.i')}) - re * sin({ang('row', 'f.i')})) AS im FROM {name}a, f GROUP BY 1, 2),
{name}k AS (SELECT *, {wave('w')} AS kx, {wave('u')} AS ky FROM {name}s), {name}z AS ({forms}),
{name}b AS (SELECT tag, f.i AS row, w, sum(re * cos({ang('u', 'f.i')}) - im * sin({ang('u', 'f.i')})) / {m} AS re, sum(im * cos({ang('u', 'f.i')}) + re * sin({ang('u', 'f.i')})) / {m} AS im FROM {name}z, f GROUP BY 1, 2, 3),
{name} AS MATERIALIZED (SELECT tag, row - {_GAP} AS row, f.i - {_GAP} AS col, sum(re * cos({ang('w', 'f.i')}) - im * sin({ang('w', 'f.i')})) / {m} AS v FROM {name}b, f
  WHERE row BETWEEN {_GAP} AND {_GAP + N - 1} AND f.i BETWEEN {_GAP} AND {_GAP + N - 1} GROUP BY 1, 2, 3)"""


def _sql() -> str:
    inc, dec = _centre(_INC, _INC_CENTRE), _centre(_DEC, _DEC_CENTRE)
    pole = _pole_sql(inc, dec)
    moved = {"i": _pole_sql(inc + 0.01, dec), "d": _pole_sql(inc, dec + 0.01)}
    rate = {k: tuple(f"(({b} - {a}) / 0.01)" for a, b in zip(pole, m)) for k, m in moved.items()}
    w = lambda k: f"((1 + sin({k} * pi() / 8 - pi() / 2)) / 2)"
    passes = [_pass("p0", "near", {"p": pole}), _pass("p1", "whole", rate)]
    for k, r in rate.items():
        passes += [f"{k}1 AS (SELECT row, col, v FROM p1 WHERE tag = '{k}')", _pass(f"{k}2", f"{k}1", {k: r}), _pass(f"{k}3", f"{k}2", {k: r})]
    di, dd = f"(radians(inclination) - {inc!r})", f"(radians(declination) - {dec!r})"
    sums = " + ".join(f"{c} * {k}{n}.v * power({off}, {n})" for k, off in (("i", di), ("d", dd)) for n, c in ((1, 1.0), (2, 0.5), (3, 0.1666666)))
    joins = " ".join(f"JOIN {k}{n} ON {k}{n}.row = fl.row AND {k}{n}.col = fl.col" for k in "id" for n in (1, 2, 3))
    r = lambda c: f"round(CASE WHEN fl.v IS NOT NULL THEN {c} END, 3) + 0.0"
    return f"""WITH {GRID_SQL}, fl AS (SELECT {N - 1} - row AS row, col, v, {_angle(_INC, _INC_CENTRE, 'col / 47.0', f'({N - 1} - row) / 47.0')} AS inclination, {_angle(_DEC, _DEC_CENTRE, 'col / 47.0', f'({N - 1} - row) / 47.0')} AS declination FROM g),
near AS (SELECT h.row, h.col, arg_min(s.v, (h.row - s.row) * (h.row - s.row) + (h.col - s.col) * (h.col - s.col) + s.row / 1e4 + s.col / 1e7) AS v FROM fl h, fl s WHERE s.v IS NOT NULL GROUP BY 1, 2),
whole AS (SELECT row, col, coalesce(v, (SELECT avg(v) FROM g)) AS v FROM fl), f AS (SELECT CAST(range AS INTEGER) AS i FROM range({_SIZE})),
cm AS (SELECT i AS j, CASE WHEN i < 8 THEN 7 - i WHEN i <= 54 THEN i - 8 ELSE 102 - i END AS q, CASE WHEN i < 8 THEN {w('i')} WHEN i <= 54 THEN 1 ELSE {w('(62 - i)')} END AS w, CASE WHEN i BETWEEN 8 AND 54 THEN 0 ELSE 1 END AS kind FROM f WHERE i < 63),
rm AS (SELECT 0 AS kind, i, CASE WHEN i < 8 THEN 7 - i WHEN i <= 55 THEN i - 8 ELSE 103 - i END AS p, CASE WHEN i < 8 THEN {w('i')} WHEN i <= 55 THEN 1 ELSE {w('(63 - i)')} END AS w FROM f
  UNION ALL SELECT 1, i, CASE WHEN i < 8 THEN 0 WHEN i <= 54 THEN i - 8 ELSE 47 END, CASE WHEN i < 8 THEN {w('i')} WHEN i <= 54 THEN 1 ELSE {w('(62 - i)')} END FROM f WHERE i < 63),
{', '.join(passes)}
SELECT {N - 1} - fl.row AS row, fl.col, {r(f'p0.v + {sums}')} AS v, {r('p0.v')} AS base, round(inclination, 3) + 0.0 AS inclination, round(declination, 3) + 0.0 AS declination FROM fl JOIN p0 ON p0.row = fl.row AND p0.col = fl.col {joins}"""


add("rtp_variable", rtp_variable, _sql())
