"""Apodisation masks, embedding in larger grids and the shift that puts zero frequency in the middle."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: From 0 at the rim of a mask to 1 where its flat part begins.
WINDOWS: dict[str, Callable[[Column], Column]] = {
    "hann": lambda x: 0.5 * (1 - F.cos(math.pi * x)),
    "hamming": lambda x: 0.54 - 0.46 * F.cos(math.pi * x),
    "cosine": lambda x: F.sin(math.pi * x / 2),
    "lanczos": lambda x: F.when(x == 1, 1.0).otherwise(F.sin(math.pi * (x - 1)) / (math.pi * (x - 1))),
}


def _pair(value) -> tuple[float, float]:
    return tuple(map(float, value)) if isinstance(value, (tuple, list)) else (float(value), float(value))


def mask(
    nrows: int, ncols: int, centre: tuple[float, float] | float | None = None, size: tuple[float, float] | float | None = None, shape: str = "rectangle",
    edge: tuple[float, float] | float = -0.3, window: str | Callable[[Column], Column] = "hann",
) -> Column:
    """Weight 0..1 over ``(row, col)``: 1 inside, 0 outside, and a band in which ``window`` rises from 0 to 1.

    ``centre``, ``size`` and ``edge`` are in cells, by (row, column) or one number for both; negative
    ones are shares of the grid's size and, for the edge, of the mask's.  Half of ``edge`` lies along
    each side.  ``window`` is a name or a function of a column that grows from 0 at the rim to 1.  A
    circle takes the first of two sizes and edges.
    """
    n = (float(nrows), float(ncols))
    if min(n) < 1:
        raise ValueError("a mask needs a row and a column")
    if shape[:4] not in ("rect", "circ"):
        raise ValueError("shape is rectangle or circle")
    share = lambda v, of: tuple(-a * b for a, b in zip(v, of)) if min(v) < 0 else v
    at = share(_pair(centre), n) if centre is not None else ((nrows - 1) / 2, (ncols - 1) / 2)
    sizes = share(_pair(size), n) if size is not None else n
    edges = share(_pair(edge), sizes)
    if isinstance(window, str) and window not in WINDOWS:
        raise ValueError(f"window is one of {', '.join(WINDOWS)} or a function")
    rise = WINDOWS[window] if isinstance(window, str) else window
    off = [F.abs(F.col("row") - at[0]), F.abs(F.col("col") - at[1])]
    if shape[:4] == "circ":
        off = [F.sqrt(off[0] ** 2 + off[1] ** 2)]

    def weight(distance: Column, length: float, band: float) -> Column:
        x = (F.lit(length / 2) - distance) / F.lit(band / 2 if band else 0.001)
        return F.when(x > 1, 1.0).when(x <= 0, 0.0).otherwise(rise(x))

    parts = [weight(*p) for p in zip(off, sizes, edges)]
    return parts[0] if len(parts) == 1 else parts[0] * parts[1]


def masked(grid: DataFrame, weight: Column) -> DataFrame:
    """``(row, col, v)`` times the weight of each cell."""
    return grid.select("row", "col", (F.col("v") * weight).alias("v"))


def embedded(grid: DataFrame, nrows: int, ncols: int, big_rows: int, big_cols: int, pad: int = 0) -> DataFrame:
    """``(row, col, v)`` of all cells of a larger grid with the grid, less its mean, in the middle.

    Its outermost cells are repeated ``pad`` times around it; all else is 0.  Where the room is odd
    there is one cell more behind the grid than before it.
    """
    if big_rows < nrows or big_cols < ncols:
        raise ValueError("the larger grid is smaller")
    top, left = (big_rows - nrows) // 2, (big_cols - ncols) // 2
    if pad > min(top, left):
        raise ValueError("no room for the padding")
    mean = grid.agg(F.avg("v").alias("mean"))  # one row
    # A cell stands for itself, and a border cell for those beyond it.
    reach = lambda i, n: F.sequence(F.when(F.col(i) == 0, F.lit(-pad)).otherwise(F.col(i)), F.when(F.col(i) == n - 1, F.lit(n - 1 + pad)).otherwise(F.col(i)))
    inner = grid.crossJoin(F.broadcast(mean)).select(F.explode(reach("row", nrows)).alias("r"), "col", (F.col("v") - F.col("mean")).alias("v"))
    inner = inner.select("r", F.explode(reach("col", ncols)).alias("c"), "v").select((F.col("r") + top).alias("row"), (F.col("c") + left).alias("col"), "v", F.lit(True).alias("own"))
    cells = grid.sparkSession.range(big_rows * big_cols).select(F.floor(F.col("id") / big_cols).cast("int").alias("row"), (F.col("id") % big_cols).cast("int").alias("col"))
    return cells.join(inner, ["row", "col"], "left").select("row", "col", F.when(F.col("own"), F.col("v")).otherwise(0.0).alias("v"))


def cut_out(grid: DataFrame, nrows: int, ncols: int, big_rows: int, big_cols: int) -> DataFrame:
    """The middle of a larger grid, as ``embedded`` puts it there."""
    top, left = (big_rows - nrows) // 2, (big_cols - ncols) // 2
    inside = grid.where(F.col("row").between(top, top + nrows - 1) & F.col("col").between(left, left + ncols - 1))
    return inside.select((F.col("row") - top).alias("row"), (F.col("col") - left).alias("col"), "v")


def shifted(grid: DataFrame, nrows: int, ncols: int, back: bool = False) -> DataFrame:
    """Quadrants swapped so that the first cell comes to the middle, or ``back`` from there."""
    by = lambda n: -(n // 2) if back else n // 2
    return grid.select(F.pmod(F.col("row") + by(nrows), F.lit(nrows)).cast("int").alias("row"), F.pmod(F.col("col") + by(ncols), F.lit(ncols)).cast("int").alias("col"), "v")
