"""Length of the path along an orientation field from every oriented cell."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

TILE = 256


def _mixed(a: np.ndarray, r: np.ndarray, c: np.ndarray, nr: int, nc: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(corner values, weights) of the four cells around each place, clamped to the grid."""
    r0, c0 = np.clip(r.astype(int), 0, nr - 2), np.clip(c.astype(int), 0, nc - 2)
    wr, wc = np.clip(r - r0, 0, 1), np.clip(c - c0, 0, 1)
    return [(a[r0 + i, c0 + j], (wr if i else 1 - wr) * (wc if j else 1 - wc)) for i in (0, 1) for j in (0, 1)]


def follow(strength: np.ndarray, degrees: np.ndarray, rows: np.ndarray, cols: np.ndarray, sense: int, least: float, tolerance: float, step: float, most: int, top: int, left: int, shape: tuple[int, int]) -> np.ndarray:
    """Path lengths of all seeds at once; the arrays are a piece of the grid that begins at ``(top, left)``."""
    r, c = rows.astype(float), cols.astype(float)
    turn = 2 * np.radians(degrees)
    sine, cosine = np.sin(turn), np.cos(turn)
    length, going = np.zeros(len(r)), np.ones(len(r), bool)
    before = degrees[rows - top, cols - left].astype(float)
    nr, nc = strength.shape
    for _ in range(most):
        k = np.flatnonzero(going)
        if not len(k):
            break
        inside = (r[k] >= 0) & (r[k] < shape[0]) & (c[k] >= 0) & (c[k] < shape[1])
        y, x = r[k] - top, c[k] - left
        value = sum(v * w for v, w in _mixed(strength, y, x, nr, nc))
        s, co = (sum(v * w for v, w in _mixed(a, y, x, nr, nc)) for a in (sine, cosine))
        theta = np.degrees(np.arctan2(s, co)) / 2 % 180
        off = np.abs(theta - before[k]) % 180
        on = inside & (value >= least) & (np.minimum(off, 180 - off) <= tolerance)
        going[k[~on]] = False
        k, theta = k[on], theta[on]
        r[k] -= sense * np.sin(np.radians(theta)) * step
        c[k] += sense * np.cos(np.radians(theta)) * step
        length[k] += step
        before[k] = theta
    return length


def streamline_length(texture: DataFrame, nrows: int, ncols: int, least: float = 0.3, tolerance: float = 22.5, step: float = 0.5, most: int = 200, tile: int = TILE) -> DataFrame:
    """``(row, col, v)``: path length both ways from each cell of ``texture(row, col, magnitude, orientation)``; NULL where it is weak.

    A path ends where the magnitude, between the cells, falls below ``least``, where the
    orientation turns by more than ``tolerance`` degrees in a step, at the edge, or after ``most``
    steps.  It can't leave its seed by more than ``step * most`` cells, so a tile with a margin of
    that width holds all that its seeds may see.
    """
    if nrows < 2 or ncols < 2:
        raise ValueError("the grid needs two rows and two columns")
    halo = math.ceil(step * most) + 2
    reach = lambda i, n: F.sequence(F.greatest(F.lit(0), F.floor((F.col(i) - halo) / tile)), F.least(F.lit((n - 1) // tile), F.floor((F.col(i) + halo) / tile)))
    cells = texture.select("row", "col", F.col("magnitude").alias("m"), (F.pmod("orientation", F.lit(180.0))).alias("o"))
    spread = cells.select("*", F.explode(reach("row", nrows)).alias("tr")).select("*", F.explode(reach("col", ncols)).alias("tc"))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tr, tc = (int(k) for k in key)
        top, left = max(0, tr * tile - halo), max(0, tc * tile - halo)
        low, right = min(nrows, (tr + 1) * tile + halo), min(ncols, (tc + 1) * tile + halo)
        m, o = np.zeros((low - top, right - left)), np.zeros((low - top, right - left))
        valid = np.zeros(m.shape, bool)
        g = group[group["row"].between(top, low - 1) & group["col"].between(left, right - 1)]
        at = (g["row"].to_numpy() - top, g["col"].to_numpy() - left)
        m[at], o[at], valid[at] = g["m"].fillna(0.0), g["o"].fillna(0.0), g["m"].notna() & g["o"].notna()
        own = g[(g["row"] // tile == tr) & (g["col"] // tile == tc)]
        rows, cols = own["row"].to_numpy(), own["col"].to_numpy()
        seed = valid[rows - top, cols - left] & (m[rows - top, cols - left] >= least)
        v = np.full(len(rows), np.nan)
        v[seed] = sum(follow(m, o, rows[seed], cols[seed], way, least, tolerance, step, most, top, left, (nrows, ncols)) for way in (1, -1))
        return pd.DataFrame({"row": rows, "col": cols, "v": v})

    found = spread.groupBy("tr", "tc").applyInPandas(run, "row int, col int, v double")
    return found.withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
