"""Focal operators on ``(row, col, v)`` grids: one explode over a stencil and one aggregation.

A grid is first extended by the images that its edge rule gives to the border cells, then
every cell is scattered to the cells whose window holds it.  One shuffle with map-side
combining serves any stencil of up to a few hundred offsets.  NULL is nodata.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.operators.quantiles import quantiles
from gridloom.plans.scratch import checkpointed

Offsets = Iterable[tuple]


def _images(i: Column, n: int, pad: int, edge: str) -> Column:
    """Array of the places at which index ``i`` appears within ``pad`` of ``0..n-1``."""
    if edge == "none":
        return F.array(i)
    if edge == "symmetric":  # d c b a | a b c d
        more = [(-1 - i, i < pad), (2 * n - 1 - i, i >= n - pad)]
    elif edge == "wrap":
        more = [(i + n, i < pad), (i - n, i >= n - pad)]
    elif edge == "edge":
        more = [(F.lit(-p), i == 0) for p in range(1, pad + 1)] + [(F.lit(n - 1 + p), i == n - 1) for p in range(1, pad + 1)]
    else:
        raise ValueError(f"unknown edge rule {edge}")
    none = F.array().cast("array<int>")
    return F.concat(F.array(i), *[F.when(c, F.array(x.cast("int"))).otherwise(none) for x, c in more])


def windows(grid: DataFrame, offsets: Offsets, nrows: int, ncols: int, edge: str = "none") -> DataFrame:
    """``(row, col, v, dr, dc, w..)``: for each cell, the cells ``(row + dr, col + dc)`` of its window."""
    offs = [tuple(o) for o in offsets]
    pad = max([0, *(max(abs(o[0]), abs(o[1])) for o in offs)])
    ext = grid.select(F.explode(_images(F.col("row"), nrows, pad, edge)).alias("pr"), "col", "v")
    ext = ext.select("pr", F.explode(_images(F.col("col"), ncols, pad, edge)).alias("pc"), "v")
    names = ["dr", "dc", *[f"w{k}" if k else "w" for k in range(len(offs[0]) - 2)]]
    stencil = F.array(*[F.struct(*[F.lit(float(x) if k > 1 else int(x)).alias(n) for k, (n, x) in enumerate(zip(names, o))]) for o in offs])
    hit = ext.select("pr", "pc", "v", F.explode(stencil).alias("o")).select((F.col("pr") - F.col("o.dr")).alias("row"), (F.col("pc") - F.col("o.dc")).alias("col"), "v", "o.*")
    return hit.where(F.col("row").between(0, nrows - 1) & F.col("col").between(0, ncols - 1))


def square(n: int) -> list[tuple[int, int, float]]:
    h = n // 2
    return [(r, c, 1.0) for r in range(-h, h + 1) for c in range(-h, h + 1)]


def disk(size: int) -> list[tuple[int, int, float]]:
    h = size // 2
    return [(r, c, 1.0) for r, c, _ in square(size) if r * r + c * c <= h * h]


def gaussian(sigma: float) -> list[tuple[int, int, float]]:
    h = math.ceil(2 * sigma)
    raw = [(r, c, math.exp(-(r * r + c * c) / (2 * sigma**2))) for r in range(-h, h + 1) for c in range(-h, h + 1)]
    total = sum(w for _, _, w in raw)
    return [(r, c, w / total) for r, c, w in raw]


def bell(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    """``(offset, weight)`` of a Gaussian that ends after ``truncate`` deviations and sums to 1."""
    h = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-h, h + 1)]
    return [(o, w / sum(raw)) for o, w in zip(range(-h, h + 1), raw)]


def normalised_convolution(grid: DataFrame, offsets: Offsets, nrows: int, ncols: int) -> DataFrame:
    """Weighted mean of the valid cells of a window, symmetric edge; fills NULL cells that have a valid neighbour."""
    valid = F.when(F.col("v").isNotNull(), F.col("w"))
    out = windows(grid, offsets, nrows, ncols, "symmetric").groupBy("row", "col").agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.sum(valid).alias("n"))
    return out.select("row", "col", F.when(F.col("n") != 0, F.col("s") / F.col("n")).alias("v"))


def mean_filter(grid: DataFrame, n: int, nrows: int, ncols: int) -> DataFrame:
    return normalised_convolution(grid, square(n), nrows, ncols)


def gaussian_filter(grid: DataFrame, sigma: float, nrows: int, ncols: int) -> DataFrame:
    return normalised_convolution(grid, gaussian(sigma), nrows, ncols)


def median_filter(grid: DataFrame, n: int, nrows: int, ncols: int) -> DataFrame:
    """Median of the valid cells inside the grid."""
    return windows(grid, square(n), nrows, ncols).groupBy("row", "col").agg(F.percentile("v", 0.5).alias("v"))


# 3 x 3 compass kernels, rows from north to south.
COMPASS = {
    "N": [[-1, -1, -1], [0, 0, 0], [1, 1, 1]],
    "S": [[1, 1, 1], [0, 0, 0], [-1, -1, -1]],
    "E": [[-1, 0, 1], [-1, 0, 1], [-1, 0, 1]],
    "W": [[1, 0, -1], [1, 0, -1], [1, 0, -1]],
    "NE": [[0, -1, -1], [1, 0, -1], [1, 1, 0]],
    "NW": [[-1, -1, 0], [-1, 0, 1], [0, 1, 1]],
    "SE": [[0, 1, 1], [-1, 0, 1], [-1, -1, 0]],
    "SW": [[1, 1, 0], [1, 0, -1], [0, -1, -1]],
}


def kernel_offsets(kernel: list[list[float]], flip: bool = True) -> list[tuple[int, int, float]]:
    """Offsets of a true convolution (``flip``) or a correlation with a centred kernel; zeros stay, they carry nodata."""
    h = len(kernel) // 2
    s = -1 if flip else 1
    return [(s * (r - h), s * (c - h), float(w)) for r, line in enumerate(kernel) for c, w in enumerate(line)]


def convolve(grid: DataFrame, kernel: list[list[float]], nrows: int, ncols: int, edge: str = "symmetric", flip: bool = True) -> DataFrame:
    """Convolution in which a NULL anywhere in the window gives NULL."""
    hit = windows(grid, kernel_offsets(kernel, flip), nrows, ncols, edge).groupBy("row", "col")
    out = hit.agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.count("v").alias("n"), F.count("*").alias("m"))
    return out.select("row", "col", F.when(F.col("n") == F.col("m"), F.col("s")).alias("v"))


def directional(grid: DataFrame, direction: str, nrows: int, ncols: int) -> DataFrame:
    return convolve(grid, COMPASS[direction], nrows, ncols)


def windowed_stat(grid: DataFrame, stat: str | Callable[[Column], Column], size: int, nrows: int, ncols: int) -> DataFrame:
    """Statistic over a disk of odd diameter; NULL with fewer than three valid cells or where the cell itself is.

    ``stat`` is a name or a function from the column of the window's values to an aggregate.
    """
    if size % 2 == 0:
        raise ValueError("the window must be odd")
    how = stat(F.col("v")) if callable(stat) else {
        "min": F.min("v"), "max": F.max("v"), "mean": F.avg("v"), "median": F.percentile("v", 0.5), "variance": F.var_pop("v"),
        "std": F.stddev_pop("v"), "skewness": F.skewness("v"), "kurtosis": F.kurtosis("v"),
    }[stat]
    own = F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), F.col("v")))
    out = windows(grid, disk(size), nrows, ncols).groupBy("row", "col").agg(how.alias("s"), F.count("v").alias("n"), own.alias("own"))
    return out.select("row", "col", F.when((F.col("n") >= 3) & F.col("own").isNotNull(), F.nanvl("s", F.lit(None).cast("double"))).alias("v"))


def sun_simple(grid: DataFrame, nrows: int, ncols: int, altitude: float = 45.0, azimuth: float = 315.0, cell: float = 1.0) -> DataFrame:
    """Cosine between the surface normal, from central differences that wrap around, and the light."""
    a, z = math.radians(88.0 if altitude == 90 else altitude), math.radians(azimuth)
    light = (math.cos(a) * math.sin(z), math.cos(a) * math.cos(z), math.sin(a))
    offs = [(0, 1, 1.0, 0.0), (0, -1, -1.0, 0.0), (1, 0, 0.0, 1.0), (-1, 0, 0.0, -1.0)]
    d = windows(grid, offs, nrows, ncols, "wrap").groupBy("row", "col").agg(
        (F.sum(F.col("w") * F.col("v")) / (2 * cell)).alias("dx"), (F.sum(F.col("w1") * F.col("v")) / (2 * cell)).alias("dy"), F.count("v").alias("n"),
    )
    dot = -F.col("dx") * light[0] - F.col("dy") * light[1] + light[2]
    return d.select("row", "col", F.when(F.col("n") == 4, dot / F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + 1)).alias("v"))


# Difference kernels of the published relief formula, applied as true convolutions.
RELIEF_EAST = [[1, 0, -1], [2, 0, -2], [1, 0, -1]]
RELIEF_NORTH = [[1, 2, 1], [0, 0, 0], [-1, -2, -1]]


def relief(grid: DataFrame, nrows: int, ncols: int, altitude: float = 30.0, azimuth: float = 270.0, ns: float = 1.0, ew: float = 1.0, scale: float = 1.0, zscale: float = 1.0) -> DataFrame:
    """Shaded relief, 0..255, from slope and aspect by weighted 3 x 3 differences; NULL next to a NULL."""
    h, v = 4 * ew * scale / zscale, 4 * ns * scale / zscale
    east = dict(((r, c), w / h) for r, c, w in kernel_offsets(RELIEF_EAST))
    north = dict(((r, c), w / v) for r, c, w in kernel_offsets(RELIEF_NORTH))
    offs = [(r, c, east[r, c], north[r, c]) for r, c in east]
    d = windows(grid, offs, nrows, ncols, "edge").groupBy("row", "col").agg(F.sum(F.col("w") * F.col("v")).alias("dx"), F.sum(F.col("w1") * F.col("v")).alias("dy"), F.count("v").alias("n"))
    slope = F.lit(math.pi / 2) - F.atan(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2))
    aspect = F.when((F.col("dx") == 0) & (F.col("dy") == 0), math.pi / 180).otherwise(F.atan2("dy", "dx"))
    a = math.radians(altitude)
    shade = 255 * (math.sin(a) * F.sin(slope) + math.cos(a) * F.cos(slope) * F.cos(F.lit(math.radians(azimuth + 90)) - aspect))
    return d.select("row", "col", F.when(F.col("n") == 9, shade).alias("v"))


def anisotropy(grid: DataFrame, nrows: int, ncols: int, window: int = 7, shape: str = "gaussian") -> DataFrame:
    """``(row, col, magnitude, orientation)`` of the structure tensor, smoothed by a Gaussian of a sixth of ``window`` or a box.

    NULL cells count as zero and are restored; the magnitude is the eigenvalue difference over
    its 99th percentile, clipped to 0..1; the orientation is in degrees modulo 180.
    """
    if shape not in ("gaussian", "box"):
        raise ValueError(f"unknown window {shape}")
    filled = grid.select("row", "col", F.coalesce("v", F.lit(0.0)).alias("v"))
    gx = dict(((r, c), w) for r, c, w in kernel_offsets([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], False))
    gy = dict(((r, c), w) for r, c, w in kernel_offsets([[-1, -2, -1], [0, 0, 0], [1, 2, 1]], False))
    offs = [(r, c, gx[r, c], gy[r, c]) for r, c in gx]
    g = windows(filled, offs, nrows, ncols, "symmetric").groupBy("row", "col").agg(F.sum(F.col("w") * F.col("v")).alias("gx"), F.sum(F.col("w1") * F.col("v")).alias("gy"))
    packed = g.select("row", "col", F.struct((F.col("gx") * F.col("gx")).alias("xx"), (F.col("gy") * F.col("gy")).alias("yy"), (F.col("gx") * F.col("gy")).alias("xy")).alias("v"))
    if shape == "box":
        j = windows(packed, square(window), nrows, ncols, "symmetric").groupBy("row", "col").agg(*[F.avg(f"v.{k}").alias(k) for k in ("xx", "yy", "xy")])
    else:
        j = packed
        for offsets in ([(0, o, w) for o, w in bell(window / 6)], [(o, 0, w) for o, w in bell(window / 6)]):
            sums = windows(j, offsets, nrows, ncols, "symmetric").groupBy("row", "col").agg(*[F.sum(F.col("w") * F.col(f"v.{k}")).alias(k) for k in ("xx", "yy", "xy")])
            j = sums.select("row", "col", F.struct("xx", "yy", "xy").alias("v"))
        j = j.select("row", "col", "v.*")
    j = j.withColumn("s", F.sqrt((F.col("xx") - F.col("yy")) ** 2 + 4 * F.col("xy") ** 2))
    j = checkpointed(j)
    top = F.lit(quantiles(j, "s", [0.99])[0])
    theta = F.degrees(F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2)
    out = j.select("row", "col", F.least(F.lit(1.0), F.col("s") / (top + 1e-10)).alias("m"), F.pmod(theta, F.lit(180.0)).alias("o"))
    own = grid.select("row", "col", F.col("v").isNotNull().alias("ok"))
    return out.join(own, ["row", "col"]).select("row", "col", F.when(F.col("ok"), F.col("m")).alias("magnitude"), F.when(F.col("ok"), F.col("o")).alias("orientation"))


def _nearest_row(f: np.ndarray) -> np.ndarray:
    """For every place ``q`` the smallest ``p`` that minimises ``(q - p)^2 + f[p]``; ``f`` is -1 where nothing stands.

    The lower envelope of the parabolas over all ``p``, in one pass over whole numbers.
    """
    hull: list[int] = []
    until: list[int] = []  # the last q that the parabola before this one wins
    for p in np.flatnonzero(f >= 0).tolist():
        while hull:
            a = hull[-1]
            last = int((int(f[p]) + p * p - int(f[a]) - a * a) // (2 * (p - a)))
            if len(hull) > 1 and last <= until[-1]:
                hull.pop()
                until.pop()
            else:
                break
        until.append(last if hull else -1)
        hull.append(p)
    return np.array(hull)[np.searchsorted(np.array(until[1:]), np.arange(len(f)), side="left")]


def fill_nearest(grid: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """NULL cells take the nearest valid value (Euclidean in cells; ties: lowest row, then column).

    Two passes: along the rows every cell learns the nearest valid cell to its left or right;
    down each column, the row whose cell so found is nearest is the lowest of the parabolas over
    all rows.  Both passes hold one line of the grid, and no hole costs more than another.
    """
    before = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy("col").rowsBetween(0, Window.unboundedFollowing)
    own = F.when(F.col("v").isNotNull(), F.struct("col", "v"))
    sides = grid.select("row", "col", F.col("v").cast("double").alias("v")).select("row", "col", "v", F.last(own, True).over(before).alias("a"), F.first(own, True).over(after).alias("b"))
    left = F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("col") - F.col("a.col") <= F.col("b.col") - F.col("col")))
    near = F.when(left, F.col("a")).otherwise(F.col("b"))
    known = sides.select("row", "col", F.col("v").isNull().alias("hole"), near.alias("n")).select("row", "col", "hole", F.abs(F.col("n.col") - F.col("col")).alias("d"), F.col("n.v").alias("v"))

    def down(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        v = group["v"].to_numpy(float)
        if group["hole"].any() and not np.isnan(v).all():
            rows, d = group["row"].to_numpy(np.int64), group["d"].to_numpy(float)
            f = np.full(rows[-1] - rows[0] + 1, -1, np.int64)
            value = np.full(len(f), np.nan)
            valid = ~np.isnan(d)
            f[rows[valid] - rows[0]], value[rows[valid] - rows[0]] = d[valid].astype(np.int64) ** 2, v[valid]
            v = np.where(group["hole"], value[_nearest_row(f)][rows - rows[0]], v)
        return pd.DataFrame({"row": group["row"], "col": group["col"], "v": v})

    return known.groupBy("col").applyInPandas(down, "row int, col int, v double").select("row", "col", F.nanvl("v", F.lit(None).cast("double")).alias("v"))
