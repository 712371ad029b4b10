"""Euler deconvolution in sliding windows.

Every cell is scattered to the windows that hold it and adds its products to the 14 sums of
the normal equations, so that one shuffle with map-side combining serves all structural
indices.  Coordinates inside the sums are relative to the window, which keeps the systems
well conditioned; only the 4 x 4 solves run in numpy, a batch at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridloom.operators.spectral import Spectrum
from gridloom.plans.scratch import checkpointed

_SUMS = ("aa", "ab", "ac", "a", "bb", "bc", "b", "cc", "c", "fa", "fb", "fc", "f", "va", "vb", "vc", "v")


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("x", "y", "z", "base")]))
def _solve(s: pd.DataFrame, si: pd.Series, n: pd.Series) -> pd.DataFrame:
    k = si.to_numpy(float)
    m = {name: s[name].to_numpy(float) for name in _SUMS}
    rows = [[m["aa"], m["ab"], m["ac"], k * m["a"]], [m["ab"], m["bb"], m["bc"], k * m["b"]], [m["ac"], m["bc"], m["cc"], k * m["c"]], [k * m["a"], k * m["b"], k * m["c"], k * k * n.to_numpy(float)]]
    left = np.moveaxis(np.array(rows), 2, 0).reshape(-1, 4, 4)
    right = np.stack([m["fa"] + k * m["va"], m["fb"] + k * m["vb"], m["fc"] + k * m["vc"], k * (m["f"] + k * m["v"])], axis=1)
    out = np.full((len(k), 4), np.nan)
    fine = np.isfinite(left).all(axis=(1, 2)) & np.isfinite(right).all(axis=1)
    fine[fine] = np.linalg.matrix_rank(left[fine]) == 4
    out[fine] = np.linalg.solve(left[fine], right[fine][:, :, None])[:, :, 0]
    return pd.DataFrame(out, columns=["x", "y", "z", "base"])


def derivatives(grid: DataFrame, nrows: int, ncols: int, cell: float = 1.0) -> DataFrame:
    """``(row, col, v, dx, dy, dz)`` of a grid without taper, its edge values kept out to the next power of two of the longer side."""
    size = 1 << (max(nrows, ncols) - 1).bit_length()
    pad = lambda n: ((size - n) // 2, (size - n) // 2)
    s = Spectrum(grid, nrows, ncols, cell, cell, pads=(pad(nrows), pad(ncols)), edge="edge", window="none", level="none")
    ways = {"v": lambda kx, ky, k: np.ones_like(k), "dx": lambda kx, ky, k: 1j * kx, "dy": lambda kx, ky, k: -1j * ky, "dz": lambda kx, ky, k: k}
    return s.filtered(ways)


def deconvolve(field: DataFrame, indices: list[float], size: int, nrows: int, ncols: int, cell: float = 1.0, height: float = 0.0) -> DataFrame:
    """``(si, row, col, x, y, z, base, stdz)`` of each full window of ``field(row, col, v, dx, dy, dz)``.

    ``(row, col)`` is the window's first cell, ``x`` runs along columns and ``y`` along rows,
    ``stdz`` is the sample deviation of dz.  Windows that hold a NULL or whose system is
    singular give no row.
    """
    first = lambda i, n: F.sequence(F.greatest(F.lit(0), F.col(i) - size + 1), F.least(F.col(i), F.lit(n - size)))
    hit = field.where("v IS NOT NULL AND dx IS NOT NULL AND dy IS NOT NULL AND dz IS NOT NULL")
    hit = hit.select("*", F.explode(first("row", nrows)).alias("r0")).select("*", F.explode(first("col", ncols)).alias("c0"))
    x, y = (F.col("col") - F.col("c0")) * cell, (F.col("row") - F.col("r0")) * cell
    hit = hit.select("r0", "c0", "v", F.col("dx").alias("a"), F.col("dy").alias("b"), F.col("dz").alias("c"), (F.col("dx") * x + F.col("dy") * y + F.col("dz") * height).alias("f"))
    sums = [F.sum(F.col(s[0]) * F.col(s[1]) if len(s) == 2 else F.col(s)).alias(s) for s in _SUMS]
    w = hit.groupBy("r0", "c0").agg(*sums, F.count("*").alias("n"), F.stddev_samp("c").alias("stdz")).where(F.col("n") == size * size)
    w = w.select("r0", "c0", "n", "stdz", F.struct(*_SUMS).alias("s"), F.explode(F.array(*[F.lit(float(k)) for k in indices])).alias("si"))
    p = w.withColumn("p", _solve("s", "si", "n"))
    at = (F.col("p.x") + F.col("c0") * cell).alias("x"), (F.col("p.y") + F.col("r0") * cell).alias("y")
    out = p.select("si", F.col("r0").alias("row"), F.col("c0").alias("col"), *at, F.col("p.z").alias("z"), F.col("p.base").alias("base"), "stdz")
    return out.where(~F.isnan("x") & F.col("x").isNotNull())


def keep_most_varied(found: DataFrame, share: float) -> DataFrame:
    """Of each index the ``int(n * share)`` rows with the largest ``stdz`` (ties: smaller row, then column).

    Rows are ranked by a range-partitioned sort and the row counts of its partitions, so no
    task holds more than one range; only those counts reach the other tasks.
    """
    order = [F.desc("stdz"), F.asc("row"), F.asc("col")]
    ranged = checkpointed(found.repartitionByRange("si", *order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("si", "part").agg(F.count("*").alias("rows"))
    by_si = Window.partitionBy("si")
    before = F.coalesce(F.sum("rows").over(by_si.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("si", "part", before.alias("before"), F.sum("rows").over(by_si).alias("total"))
    rank = F.row_number().over(Window.partitionBy("si", "part").orderBy(*order)) + F.col("before")
    ranked = ranged.join(sizes, ["si", "part"]).withColumn("rank", rank)
    return ranked.where(F.col("rank") <= F.floor(F.col("total") * share)).drop("part", "before", "total", "rank")
