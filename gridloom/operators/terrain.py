"""Separable smoothing, gain control, slope and curvature, terrain classes and linear cliffs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.operators import focal, graph
from gridloom.plans.scratch import checkpointed

# Fixed values of the class column.
CONCAVE, FLAT, CONVEX, CLIFF, NODATA = -1, 0, 1, 2, -15


def smooth(grid: DataFrame, sigma: float, nrows: int, ncols: int) -> DataFrame:
    """Gaussian by rows and then by columns, symmetric edge; a NULL in reach gives NULL.

    Two passes of ``8 sigma + 1`` offsets instead of their square.
    """
    weights = focal.bell(sigma)
    if weights[-1][0] > min(nrows, ncols):
        raise ValueError("sigma reaches beyond the opposite edge of the grid")
    for offsets in ([(0, o, w) for o, w in weights], [(o, 0, w) for o, w in weights]):
        hit = focal.windows(grid, offsets, nrows, ncols, "symmetric").groupBy("row", "col")
        sums = hit.agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.count("v").alias("n"))
        grid = sums.select("row", "col", F.when(F.col("n") == len(offsets), F.col("s")).alias("v"))
    return grid


def _mirrored(i: Column, n: int, pad: int) -> Column:
    """Places of index ``i`` after padding by reflection that does not repeat the edge, counted from 0."""
    none = F.array().cast("array<int>")
    low = F.when(i.between(1, pad), F.array((-i).cast("int"))).otherwise(none)
    high = F.when(i.between(n - 1 - pad, n - 2), F.array((2 * (n - 1) - i).cast("int"))).otherwise(none)
    return F.transform(F.concat(F.array(i.cast("int")), low, high), lambda j: j + pad)


def gain_control(grid: DataFrame, width: float, nrows: int, ncols: int) -> DataFrame:
    """Each value over the Gaussian mean of the absolute values around it; NULL where the grid is.

    Holes take their nearest value before smoothing and the grid is mirrored by three widths.
    """
    pad = int(3 * width)
    if pad > min(nrows, ncols) - 1:
        raise ValueError("the window is wider than the grid can be mirrored")
    wide = focal.fill_nearest(grid, nrows, ncols).select("row", "col", F.abs("v").alias("v"))
    wide = wide.select(F.explode(_mirrored(F.col("row"), nrows, pad)).alias("row"), "col", "v")
    wide = wide.select("row", F.explode(_mirrored(F.col("col"), ncols, pad)).alias("col"), "v")
    level = smooth(wide, width, nrows + 2 * pad, ncols + 2 * pad)
    level = level.select((F.col("row") - pad).alias("row"), (F.col("col") - pad).alias("col"), F.col("v").alias("level"))
    level = level.where(F.col("row").between(0, nrows - 1) & F.col("col").between(0, ncols - 1))
    least = F.when(F.col("level") == 0, F.lit(2.0**-52)).otherwise(F.col("level"))
    return grid.join(level, ["row", "col"]).select("row", "col", (F.col("v") / least).alias("v"))


def gradient_offsets(size: int) -> list[tuple[int, int, float, float]]:
    """``(dr, dc, wx, wy)`` of the odd gradient kernels, as a true convolution uses them.

    A place at distance ``d`` along the axis and ``e`` across it weighs ``d / (d^2 + e^2)``; both kernels
    are divided by the sum of their absolute weights.
    """
    h = size // 2
    side = range(-h, h + 1)
    along = {(r, c): r / (r * r + c * c) if r else 0.0 for r in side for c in side}
    total = sum(abs(w) for w in along.values())
    return [(-r, -c, along[c, r] / total, along[r, c] / total) for r in side for c in side]


def _difference(v: str, across: str, along: str, cell: float) -> Column:
    """Central difference, one-sided at both ends; a NULL on either side gives NULL."""
    w = Window.partitionBy(across).orderBy(along)
    ahead = F.when(F.lead(along).over(w).isNull(), F.col(v)).otherwise(F.lead(v).over(w))
    behind = F.when(F.lag(along).over(w).isNull(), F.col(v)).otherwise(F.lag(v).over(w))
    steps = F.lead(along).over(w).isNotNull().cast("int") + F.lag(along).over(w).isNotNull().cast("int")
    return (ahead - behind) / (F.nullif(steps, F.lit(0)) * cell)


def slope_curvature(grid: DataFrame, nrows: int, ncols: int, cell_x: float = 1.0, cell_y: float = 1.0, size: int = 3, sigma: float = 1.0) -> DataFrame:
    """``(row, col, slope, curvature)`` of a dense grid: slope in degrees and curvature along the profile.

    Cells beyond the edge count as 0 in the gradient, as the smoothed surface ends there.
    The second differences run down the rows first and along the columns second.
    """
    level = smooth(grid, sigma, nrows, ncols) if sigma > 0 else grid.select("row", "col", "v")
    offsets = gradient_offsets(size)
    hit = focal.windows(level, offsets, nrows, ncols).groupBy("row", "col")
    sums = hit.agg(F.sum(F.col("w") * F.col("v")).alias("x"), F.sum(F.col("w1") * F.col("v")).alias("y"), F.count("v").alias("n"), F.count("*").alias("m"))
    full = F.col("n") == F.col("m")
    d = sums.select("row", "col", F.when(full, F.col("x") / cell_x).alias("dx"), F.when(full, F.col("y") / cell_y).alias("dy"))
    d = d.withColumn("dxx", _difference("dx", "col", "row", cell_y)).withColumn("dyx", _difference("dy", "col", "row", cell_y))
    d = d.withColumn("dxy", _difference("dx", "row", "col", cell_x)).withColumn("dyy", _difference("dy", "row", "col", cell_x))
    p = F.col("dx") ** 2 + F.col("dy") ** 2
    bend = F.col("dx") ** 2 * F.col("dxx") + 2 * F.col("dx") * F.col("dy") * F.col("dxy") + F.col("dy") ** 2 * F.col("dyy")
    curvature = bend / (F.when(p > 0, p).otherwise(F.lit(2.0**-52)) * F.sqrt((p + 1) ** 3))
    return d.select("row", "col", F.degrees(F.atan(F.sqrt(p))).alias("slope"), curvature.alias("curvature"))


def linear_regions(slopes: DataFrame, steepest: float, least_area: int = 5) -> DataFrame:
    """``(row, col)`` of 8-connected steep regions that are long: eccentricity above 0.8 or axis ratio above 3."""
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    found = graph.grid_components(slopes.where(F.col("slope") >= steepest).select("row", "col"), around)
    shape = found.groupBy("component").agg(F.count("*").alias("area"), F.var_pop("row").alias("r"), F.var_pop("col").alias("c"), F.covar_pop("row", "col").alias("rc"))
    half, root = (F.col("r") + F.col("c")) / 2, F.sqrt(((F.col("r") - F.col("c")) / 2) ** 2 + F.col("rc") ** 2)
    shape = shape.select("component", "area", (half + root).alias("major"), F.greatest(half - root, F.lit(0.0)).alias("minor"))
    long = (F.col("major") > 0) & ((F.sqrt(1 - F.col("minor") / F.col("major")) > 0.8) | (F.col("major") > 9 * F.col("minor")))
    return found.join(shape.where((F.col("area") >= least_area) & long).select("component"), "component").select("row", "col")


def classify(grid: DataFrame, nrows: int, ncols: int, cell_x: float = 1.0, cell_y: float = 1.0, bend: float = 0.01, steepest: float = 45.0, size: int = 3, sigma: float = 1.0) -> DataFrame:
    """``(row, col, v)``: -15 nodata, 2 cliff, -1 concave, 1 convex, 0 flat or too near to nodata to tell.

    Cliffs are the linear steep regions; if there is none, all steep cells.
    """
    forms = checkpointed(slope_curvature(grid, nrows, ncols, cell_x, cell_y, size, sigma))
    linear = checkpointed(linear_regions(forms, steepest)).withColumn("linear", F.lit(True))
    some = linear.limit(1).agg(F.count("*").alias("some"))
    cliff = F.when(F.col("some") > 0, F.col("linear").isNotNull()).otherwise(F.coalesce(F.col("slope") >= steepest, F.lit(False)))
    curved = F.when(F.col("curvature") > bend, CONCAVE).when(F.col("curvature") < -bend, CONVEX).otherwise(FLAT)
    out = grid.select("row", "col", "v").join(forms, ["row", "col"]).join(linear, ["row", "col"], "left").crossJoin(F.broadcast(some))
    return out.select("row", "col", F.when(F.col("v").isNull(), NODATA).when(cliff, CLIFF).otherwise(curved).alias("v"))
