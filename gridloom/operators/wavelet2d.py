"""Two-dimensional wavelet modulus maxima: gradients of the smoothed grid on several scales, their ridges, and chains over the scales."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gridloom.operators.spectral import Response, Spectrum
from gridloom.plans.scratch import checkpointed


def scales_of(nrows: int, ncols: int, n: int = 5) -> list[float]:
    """``n`` scales from 1 to a quarter of the shorter side, at even ratios."""
    return np.logspace(0, math.log10(max(min(nrows, ncols) / 4, 1.0)), n).tolist()


def smoothed_slope(axis: str, scale: float) -> Response:
    """Slope along columns (``x``) or rows (``y``, growing with the row) of the grid under a Gaussian of that deviation, times the scale."""
    return lambda kx, ky, k: scale * 1j * (kx if axis == "x" else -ky) * np.exp(-0.5 * (scale * k) ** 2)


def transform(grid: DataFrame, nrows: int, ncols: int, scales: list[float] | None = None, n_scales: int = 5, buffer: int = 0) -> DataFrame:
    """``(scale_no, scale, row, col, modulus, phase)``: length and direction (radians) of the smoothed gradient of the grid scaled to 0..1.

    All scales come from one forward transform.  A grid of one value, and NULL cells, have none.
    """
    scales = scales or scales_of(nrows, ncols, n_scales)
    s = Spectrum(grid, nrows, ncols, buffer=buffer)
    wide = s.several({f"{axis}{k}": smoothed_slope(axis, a) for k, a in enumerate(scales) for axis in "xy"})
    span = s.grid.agg((F.max("v") - F.min("v")).alias("span"))  # one row
    each = F.array(*[F.struct(F.lit(k).alias("scale_no"), F.lit(float(a)).alias("scale"), F.col(f"x{k}").alias("gx"), F.col(f"y{k}").alias("gy")) for k, a in enumerate(scales)])
    cells = wide.crossJoin(F.broadcast(span)).where("span > 0").select("row", "col", "span", F.explode(each).alias("s"))
    cells = cells.select("s.scale_no", "s.scale", "row", "col", (F.col("s.gx") / F.col("span")).alias("gx"), (F.col("s.gy") / F.col("span")).alias("gy")).where("gx IS NOT NULL")
    return cells.select("scale_no", "scale", "row", "col", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2).alias("modulus"), F.atan2("gy", "gx").alias("phase"))


def maxima(coefficients: DataFrame, least: float = 0.2) -> DataFrame:
    """``(scale_no, scale, row, col, modulus, direction)``: cells above ``least`` times their scale's largest modulus that stand out along their gradient.

    The modulus is higher than in the neighbour ahead and not lower than in the one behind, of the
    eight around the cell; neighbours outside the grid do not count.  ``direction`` is that of the
    ridge, a quarter turn from the gradient.
    """
    cells = checkpointed(coefficients)
    top = cells.groupBy("scale_no").agg(F.max("modulus").alias("top"))  # one row for each scale
    high = cells.join(F.broadcast(top), "scale_no").where(F.col("modulus") > F.col("top") * least).drop("top")
    step = F.pmod(F.round(F.col("phase") / (math.pi / 4)).cast("int"), F.lit(8))
    # Fixed values: (row, column) steps of the eight directions from east over south, as rows grow southwards.
    ways = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))])
    asked = high.select("*", F.get(ways, step).alias("w")).select("*", F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"))
    asked = asked.withColumns({"nr": F.col("row") + F.col("side") * F.col("w.r"), "nc": F.col("col") + F.col("side") * F.col("w.c")})
    near = cells.select("scale_no", F.col("row").alias("nr"), F.col("col").alias("nc"), F.col("modulus").alias("other"))
    met = asked.join(near, ["scale_no", "nr", "nc"], "left")
    lower = F.col("other").isNull() | F.when(F.col("side") > 0, F.col("modulus") > F.col("other")).otherwise(F.col("modulus") >= F.col("other"))
    keys = ("scale_no", "scale", "row", "col", "modulus", "phase")
    found = met.groupBy(*keys).agg(F.bool_and(lower).alias("peak")).where("peak")
    return found.select("scale_no", "scale", "row", "col", "modulus", (F.col("phase") + math.pi / 2).alias("direction"))


def chains(found: DataFrame, reach: float = 2.0, tolerance: float = math.pi / 4) -> DataFrame:
    """``(start_row, start_col, scale_no, row, col, modulus)``: maxima followed from the finest scale up, named by where they start.

    A chain takes the nearest maximum of the next scale closer than ``reach`` times the ratio of the
    scales whose direction differs by less than ``tolerance``, the first by row and column of equally
    near ones; where there is none it waits for the scale after.  Chains may share maxima; those of
    one point are dropped.  Places look only into the squares around their own.
    """
    found = checkpointed(found)
    levels = [(r.scale_no, r.scale) for r in found.select("scale_no", "scale").distinct().orderBy("scale").collect()]  # one row for each scale
    place = ("row", "col", "direction")
    here = found.where(F.col("scale_no") == (levels[0][0] if levels else -1))
    ends = here.select(F.col("row").alias("start_row"), F.col("col").alias("start_col"), *place)
    parts = here.select(F.col("row").alias("start_row"), F.col("col").alias("start_col"), "scale_no", "row", "col", "modulus")
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    for (_, before), (k, scale) in zip(levels, levels[1:]):
        near = reach * scale / before
        square = lambda c: F.floor(F.col(c) / near)  # noqa: E731, B023
        nxt = found.where(F.col("scale_no") == k).select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("direction").alias("d"), F.col("modulus").alias("m"), square("row").alias("a"), square("col").alias("b"))
        asked = ends.select(*place).distinct().select("*", F.explode(around).alias("o")).select(*place, (square("row") + F.col("o.a")).alias("a"), (square("col") + F.col("o.b")).alias("b"))
        turn = F.abs(F.pmod(F.col("d") - F.col("direction") + math.pi, F.lit(2 * math.pi)) - math.pi)
        far = (F.col("r") - F.col("row")) ** 2 + (F.col("c") - F.col("col")) ** 2
        met = asked.join(nxt, ["a", "b"]).where((far < near * near) & (turn < tolerance))
        best = met.groupBy(*place).agg(F.min(F.struct(far.alias("far"), "r", "c", "d", "m")).alias("t"))
        moved = checkpointed(ends.join(best, list(place), "left"))
        parts = parts.unionByName(moved.where("t IS NOT NULL").select("start_row", "start_col", F.lit(k).alias("scale_no"), F.col("t.r").alias("row"), F.col("t.c").alias("col"), F.col("t.m").alias("modulus")))
        ends = moved.select("start_row", "start_col", F.coalesce("t.r", "row").alias("row"), F.coalesce("t.c", "col").alias("col"), F.coalesce("t.d", "direction").alias("direction"))
    long_ = parts.groupBy("start_row", "start_col").count().where("count > 1").drop("count")
    return parts.join(long_, ["start_row", "start_col"])
