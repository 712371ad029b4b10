"""Queries of masks, embedding, window statistics given as functions and placements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.functions import placement
from gridloom.operators import focal, masks
from gridloom.plans.registry import GRID_SQL, N, add, grid, out, rounded
from gridloom.sources import fixtures


def _band(distance: str, size: float, edge: float, rise: str) -> str:
    x = f"(({size / 2} - {distance}) / {edge / 2})"
    return f"(CASE WHEN {x} > 1 THEN 1 WHEN {x} <= 0 THEN 0 ELSE {rise.replace('$', x)} END)"


_HANN, _HAMMING, _LANCZOS = "0.5 * (1 - cos(pi() * $))", "(0.54 - 0.46 * cos(pi() * $))", "coalesce(sin(pi() * ($ - 1)) / nullif(pi() * ($ - 1), 0), 1)"
_MID = (N - 1) / 2


def _scaled(s: SparkSession, d: str) -> DataFrame:
    """The grid times a factor that keeps its values off the halves that rounding decides."""
    return grid(s, d).select("row", "col", (F.col("v") * 0.7310585).alias("v"))


for name, how, weight in (
    ("mask_hann", {}, _band(f"abs(row - {_MID})", N, 0.3 * N, _HANN) + " * " + _band(f"abs(col - {_MID})", N, 0.3 * N, _HANN)),
    ("mask_hamming", {"centre": (20, 25), "size": (30, 36), "edge": (8, 10), "window": "hamming"}, _band("abs(row - 20)", 30, 8, _HAMMING) + " * " + _band("abs(col - 25)", 36, 10, _HAMMING)),
    ("mask_circle", {"shape": "circle", "size": -0.8, "edge": -0.5, "window": "lanczos"}, _band(f"sqrt((row - {_MID}) * (row - {_MID}) + (col - {_MID}) * (col - {_MID}))", 0.8 * N, 0.4 * N, _LANCZOS)),
    ("mask_function", {"edge": 20, "window": lambda x: x * x}, _band(f"abs(row - {_MID})", N, 20, "$ * $") + " * " + _band(f"abs(col - {_MID})", N, 20, "$ * $")),
):
    add(name, lambda s, d, how=how: out(masks.masked(_scaled(s, d), masks.mask(N, N, **how)), 5), rounded(f"WITH {GRID_SQL} SELECT row, col, v * 0.7310585 * {weight} AS v FROM g", 5))


def _embedded(s: SparkSession, d: str) -> DataFrame:
    return out(masks.shifted(masks.embedded(grid(s, d, False), N, N, 61, 57, 4), 61, 57), 2)


add(
    "embedded_shifted", _embedded,
    f"""WITH {GRID_SQL}, b AS (SELECT CAST(r.range AS INTEGER) AS r, CAST(c.range AS INTEGER) AS c FROM range(61) r, range(57) c)
SELECT CAST((r + 30) % 61 AS INTEGER) AS row, CAST((c + 28) % 57 AS INTEGER) AS col, round(CASE WHEN r BETWEEN 2 AND 57 AND c BETWEEN 0 AND 55 THEN f.v - (SELECT avg(v) FROM full_) ELSE 0 END, 2) + 0.0 AS v
FROM b LEFT JOIN full_ f ON f.row = least(greatest(r - 6, 0), {N - 1}) AND f.col = least(greatest(c - 4, 0), {N - 1})""",
)
add(
    "cut_out", lambda s, d: out(masks.cut_out(masks.embedded(grid(s, d, False), N, N, 64, 60), N, N, 64, 60), 2),
    rounded(f"WITH {GRID_SQL} SELECT row, col, v - (SELECT avg(v) FROM full_) AS v FROM full_", 2),
)
# A statistic that the library has no name for: the range of the window.
add(
    "ss_range", lambda s, d: out(focal.windowed_stat(grid(s, d), lambda v: F.max(v) - F.min(v), 5, N, N)),
    f"""WITH {GRID_SQL}, hit AS (SELECT c.row, c.col, s.v, s.row = c.row AND s.col = c.col AS own FROM cells c JOIN g s ON (s.row - c.row) * (s.row - c.row) + (s.col - c.col) * (s.col - c.col) <= 4)
SELECT row, col, round(CASE WHEN count(v) >= 3 AND max(CASE WHEN own THEN v END) IS NOT NULL THEN max(v) - min(v) END, 7) + 0.0 AS v FROM hit GROUP BY row, col""",
)


def _placements(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as grids, turned and scaled by their keys."""
    k = F.col("s_suppkey").cast("double")
    p = fixtures.table(s, d, "supplier").select("s_suppkey", F.array(k, k % 7 + 1, k % 3, F.col("s_acctbal").cast("double"), k % 2, -(k % 5) - 1).alias("t"), (k % 11 + 2).alias("nc"), (k % 13 + 3).alias("nr"))
    t, nc, nr = F.col("t"), F.col("nc"), F.col("nr")
    p = p.select("s_suppkey", placement.cell_size(t).alias("s"), placement.rotation(t).alias("rotation"), placement.centre(t, nc, nr).alias("c"), placement.extent(t, nc, nr).alias("e"), placement.control_points(t, nc, nr)[2].alias("p"))
    return out(p.select("s_suppkey", "s.dx", "s.dy", "rotation", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), "e.west", "e.north", F.col("p.x").alias("px"), F.col("p.y").alias("py")), 6, "rotation", "cx", "cy", "west", "north", "px", "py")


add(
    "placements", _placements,
    """WITH k AS (SELECT s_suppkey, s_suppkey AS x0, s_suppkey % 7 + 1 AS dx, s_suppkey % 3 AS rx, CAST(s_acctbal AS DOUBLE) AS y0, s_suppkey % 2 AS cy, -(s_suppkey % 5) - 1 AS dy, s_suppkey % 11 + 2 AS nc, s_suppkey % 13 + 3 AS nr FROM supplier)
SELECT s_suppkey, round(sqrt(dx * dx + cy * cy), 7) AS dx, round(sqrt(rx * rx + dy * dy), 7) AS dy, round(degrees((exp(2.0 * rx / dy) - 1) / (exp(2.0 * rx / dy) + 1)), 6) + 0.0 AS rotation,
round(x0 + nc / 2.0 * dx + nr / 2.0 * rx, 6) + 0.0 AS cx, round(y0 + nc / 2.0 * cy + nr / 2.0 * dy, 6) + 0.0 AS cy, round(least(x0, x0 + nc * dx, x0 + nr * rx, x0 + nc * dx + nr * rx), 6) + 0.0 AS west,
round(greatest(y0, y0 + nc * cy, y0 + nr * dy, y0 + nc * cy + nr * dy), 6) + 0.0 AS north, round(x0 + nc * dx, 6) + 0.0 AS px, round(y0 + nc * cy, 6) + 0.0 AS py FROM k""",
)
