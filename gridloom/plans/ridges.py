"""Queries of the two-dimensional wavelet maxima."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.operators import wavelet2d
from gridloom.plans.catalog import dft_sql
from gridloom.plans.registry import N, add, grid, out

_SCALES = [1.0, 1.7, 3.0]


def _maxima(s: SparkSession, d: str) -> DataFrame:
    return wavelet2d.maxima(wavelet2d.transform(grid(s, d), N, N, _SCALES), 0.35)


_SLOPES = {f"{axis}{k}": ("0", f"{a} * {'kx' if axis == 'x' else '-ky'} * exp(-0.5 * {a * a} * k * k)") for k, a in enumerate(_SCALES) for axis in "xy"}
_STEPS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
_RIDGES = f""", span AS (SELECT max(v) - min(v) AS span FROM g),
w AS MATERIALIZED (SELECT CAST(right(a.tag, 1) AS INTEGER) AS scale_no, a.row, a.col, sqrt(a.v * a.v + b.v * b.v) / span AS modulus, atan2(b.v, a.v) AS phase
  FROM t a JOIN t b ON a.row = b.row AND a.col = b.col AND a.tag[1] = 'x' AND b.tag = 'y' || right(a.tag, 1) JOIN g ON g.row = a.row AND g.col = a.col AND g.v IS NOT NULL, span),
q AS (SELECT w.*, CAST(((CAST(round(phase / (pi() / 4)) AS INTEGER) % 8) + 8) % 8 AS INTEGER) AS k FROM w WHERE modulus > 0.35 * (SELECT max(modulus) FROM w x WHERE x.scale_no = w.scale_no)),
st(k, r, c) AS (VALUES {', '.join(f'({k}, {r}, {c})' for k, (r, c) in enumerate(_STEPS))}),
mx AS MATERIALIZED (SELECT q.scale_no, q.row, q.col, q.modulus, q.phase + pi() / 2 AS direction FROM q JOIN st USING (k)
  LEFT JOIN w a ON a.scale_no = q.scale_no AND a.row = q.row + r AND a.col = q.col + c LEFT JOIN w b ON b.scale_no = q.scale_no AND b.row = q.row - r AND b.col = q.col - c
  WHERE (a.modulus IS NULL OR q.modulus > a.modulus) AND (b.modulus IS NULL OR q.modulus >= b.modulus))"""
add(
    "ridge_maxima", lambda s, d: out(_maxima(s, d).select("scale_no", "row", "col", "modulus", "direction"), 6, "modulus", "direction"),
    dft_sql(_SLOPES, _RIDGES + " SELECT scale_no, row, col, round(modulus, 6) + 0.0 AS modulus, round(direction, 6) + 0.0 AS direction FROM mx"),
)


def _chains_sql() -> str:
    sql, parts = ", c0 AS (SELECT row AS sr, col AS sc, row, col, direction FROM mx WHERE scale_no = 0)", ["SELECT sr, sc, 0 AS scale_no, row, col FROM c0"]
    for k in (1, 2):
        near = 2.0 * _SCALES[k] / _SCALES[k - 1]
        sql += f""", n{k} AS (SELECT c.sr, c.sc, arg_min((m.row, m.col, m.direction), ((m.row - c.row) * (m.row - c.row) + (m.col - c.col) * (m.col - c.col), m.row, m.col)) AS b FROM c{k - 1} c JOIN mx m ON m.scale_no = {k}
  AND sqrt((m.row - c.row) * (m.row - c.row) + (m.col - c.col) * (m.col - c.col)) < {near} AND cos(m.direction - c.direction) > cos(pi() / 4) GROUP BY 1, 2),
c{k} AS (SELECT c.sr, c.sc, coalesce(b[1], c.row) AS row, coalesce(b[2], c.col) AS col, coalesce(b[3], c.direction) AS direction FROM c{k - 1} c LEFT JOIN n{k} n USING (sr, sc))"""
        parts.append(f"SELECT sr, sc, {k}, b[1], b[2] FROM n{k}")
    return sql + f""", met AS (SELECT *, count(*) OVER (PARTITION BY sr, sc) AS n FROM ({' UNION ALL '.join(parts)}))
SELECT sr AS start_row, sc AS start_col, p.scale_no, p.row, p.col, round(mx.modulus, 6) AS modulus FROM met p JOIN mx ON mx.scale_no = p.scale_no AND mx.row = p.row AND mx.col = p.col WHERE n > 1"""


add("ridge_chains", lambda s, d: out(wavelet2d.chains(_maxima(s, d)), 6, "modulus"), dft_sql(_SLOPES, _RIDGES + _chains_sql()))
