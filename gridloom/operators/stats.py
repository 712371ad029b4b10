"""Global and grouped statistics: trends, normalisation, source estimates, components of bands."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridloom.operators.quantiles import quantiles
from gridloom.plans.scratch import checkpointed


def plane(grid: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by.., a, b, c)`` of the least-squares plane a * col + b * row + c, from one aggregation."""
    g = grid.where("v IS NOT NULL").groupBy(*(by or []))
    m = g.agg(
        F.avg("col").alias("mc"), F.avg("row").alias("mr"), F.avg("v").alias("mv"), F.var_pop("col").alias("cc"), F.var_pop("row").alias("rr"),
        F.covar_pop("col", "row").alias("cr"), F.covar_pop("col", "v").alias("cv"), F.covar_pop("row", "v").alias("rv"),
    )
    det = F.col("cc") * F.col("rr") - F.col("cr") * F.col("cr")
    solve = lambda top: F.when(det != 0, top / det).otherwise(0.0)
    m = m.withColumn("a", solve(F.col("cv") * F.col("rr") - F.col("rv") * F.col("cr"))).withColumn("b", solve(F.col("rv") * F.col("cc") - F.col("cv") * F.col("cr")))
    return m.select(*(by or []), "a", "b", (F.col("mv") - F.col("a") * F.col("mc") - F.col("b") * F.col("mr")).alias("c"))


def detrend_plane(grid: DataFrame, by: list[str] | None = None) -> DataFrame:
    fit = plane(grid, by)
    both = grid.join(fit, by) if by else grid.crossJoin(F.broadcast(fit))  # one row when not grouped
    return both.select(*(by or []), "row", "col", (F.col("v") - F.col("a") * F.col("col") - F.col("b") * F.col("row") - F.col("c")).alias("v"))


_QUADRIC = ("cc", "rr", "cr", "c", "r", "one")


def quadric(grid: DataFrame, nrows: int, ncols: int, by: list[str] | None = None) -> DataFrame:
    """``(by.., w)``: weights of the least-squares quadric over centred and scaled places, from one aggregation.

    The sums of each group are one row, and only the 6 x 6 solves run in numpy, a batch at a time.
    """
    by = by or []
    terms = [F.expr(t) for t in ("c * c", "r * r", "c * r", "c", "r", "1.0D")]
    g = grid.where("v IS NOT NULL").select(*by, ((F.col("col") - ncols / 2) / ncols).alias("c"), ((F.col("row") - nrows / 2) / nrows).alias("r"), "v")
    pairs = [(i, j) for i in range(6) for j in range(i, 6)]
    sums = g.groupBy(*by).agg(F.array(*[F.sum(terms[i] * terms[j]) for i, j in pairs]).alias("s"), F.array(*[F.sum(t * F.col("v")) for t in terms]).alias("t"))

    @F.pandas_udf("array<double>")
    def solve(s: pd.Series, t: pd.Series) -> pd.Series:
        out = []
        for left, right in zip(s, t):
            if any(x is None or np.isnan(x) for x in left):
                out.append([0.0] * 6)
                continue
            a = np.zeros((6, 6))
            for (i, j), x in zip(pairs, left):
                a[i, j] = a[j, i] = x
            out.append(np.linalg.lstsq(a, np.array(right, float), rcond=None)[0].tolist())
        return pd.Series(out)

    return sums.select(*by, solve("s", "t").alias("w"))


def detrend_quadric(grid: DataFrame, nrows: int, ncols: int, by: list[str] | None = None) -> DataFrame:
    """Minus the least-squares quadric; of each group if ``by`` is given."""
    by = by or []
    fit = quadric(grid, nrows, ncols, by)
    both = grid.join(fit, by) if by else grid.crossJoin(F.broadcast(fit))  # one row when not grouped
    c, r = (F.col("col") - ncols / 2) / ncols, (F.col("row") - nrows / 2) / nrows
    trend = sum((t * F.col("w")[k] for k, t in enumerate([c * c, r * r, c * r, c, r, F.lit(1.0)])), F.lit(0.0))
    return both.select(*by, "row", "col", (F.col("v") - trend).alias("v"))


def normalise_grids(grids: DataFrame, order: int = 1, nrows: int = 0, ncols: int = 0) -> DataFrame:
    """Every grid detrended by a plane (order 1) or a quadric (2) and scaled to the standard deviation of the first usable one."""
    if order not in (1, 2):
        raise ValueError("order 1 takes off a plane, order 2 a quadric")
    flat = detrend_plane(grids, ["grid_id"]) if order == 1 else detrend_quadric(grids, nrows, ncols, ["grid_id"])
    s = flat.groupBy("grid_id").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).where("s > 0")
    ref = s.agg(F.min_by("s", "grid_id").alias("ref"))
    out = flat.join(s, "grid_id").crossJoin(F.broadcast(ref))
    return out.select("grid_id", "row", "col", (F.col("ref") * (F.col("v") - F.col("m")) / F.col("s")).alias("v"))


def summary(grid: DataFrame) -> DataFrame:
    """``(n, mean, std, least, most, median)`` of the valid cells."""
    median = F.lit(quantiles(grid, "v", [0.5])[0]).cast("double")
    return grid.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("most")).withColumn("median", median)


def window_stats(estimates: DataFrame, south: float, west: float, height: float, width: float) -> DataFrame:
    """Tumbling spatial windows over ``(si, y, x, z, base)``: counts, means and population deviations, depths in km."""
    at = [F.floor((F.col("y") - south) / height).cast("int").alias("window_row"), F.floor((F.col("x") - west) / width).cast("int").alias("window_col")]
    km = F.col("z") / 1000
    return estimates.groupBy("si", *at).agg(
        F.count("*").alias("n_estimates"), F.avg("y").alias("mean_y"), F.avg("x").alias("mean_x"), F.avg(km).alias("mean_depth_km"), F.avg("base").alias("mean_base_level"),
        F.stddev_pop("y").alias("std_y"), F.stddev_pop("x").alias("std_x"), F.stddev_pop(km).alias("std_depth_km"), F.min(km).alias("min_depth_km"), F.max(km).alias("max_depth_km"),
    )


def window_summary(stats: DataFrame, total_windows: int | None = None) -> DataFrame:
    """Second level per index: windows with data, of how many in all, estimates, mean and deviation of the windows' depths."""
    out = stats.groupBy("si").agg(
        F.count("*").alias("windows_with_data"), F.sum("n_estimates").alias("total_estimates"), F.avg("mean_depth_km").alias("mean_depth_km"), F.stddev_pop("mean_depth_km").alias("std_depth_km"),
    )
    return out if total_windows is None else out.withColumn("total_windows", F.lit(total_windows))


def within(estimates: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Estimates strictly inside a box."""
    return estimates.where((F.col("y") > south) & (F.col("y") < north) & (F.col("x") > west) & (F.col("x") < east))


def mean_places(estimates: DataFrame) -> DataFrame:
    """``(si, mean_x_km, mean_y_km, mean_z_km)``."""
    return estimates.groupBy("si").agg(*[(F.avg(c) / 1000).alias(f"mean_{c}_km") for c in "xyz"])


def extreme_to_null(grid: DataFrame, least: float = -1e38) -> DataFrame:
    """NULL for values below ``least``, by which some formats mean no data."""
    return grid.withColumn("v", F.when(F.col("v") >= least, F.col("v")))


def grid_frame(points: DataFrame, cell: float) -> DataFrame:
    """``(x0, y0, ncols, nrows, centre_x, centre_y)`` of the grid that covers ``points(x, y)`` with cells of that size."""
    box = points.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("low_", F.min), ("high_", F.max))])
    side = lambda c: F.floor((F.col(f"high_{c}") - F.col(f"low_{c}")) / cell).cast("long")
    return box.select(
        F.col("low_x").alias("x0"), F.col("low_y").alias("y0"), side("x").alias("ncols"), side("y").alias("nrows"),
        ((F.col("low_x") + F.col("high_x")) / 2).alias("centre_x"), ((F.col("low_y") + F.col("high_y")) / 2).alias("centre_y"),
    )


def band_correlation(rows: DataFrame, bands: list[str]) -> list[list[float]]:
    """Correlation matrix of the rows that are valid in every band."""
    ok = rows.dropna(subset=bands)
    pairs = [(i, j) for i in range(len(bands)) for j in range(i, len(bands))]
    r = ok.agg(*[F.corr(bands[i], bands[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return [[r[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(bands))] for i in range(len(bands))]


def principal_components(rows: DataFrame, bands: list[str], n: int | None = None) -> tuple[DataFrame, list[float], list[list[float]]]:
    """Scores ``pc1..`` of the standardised bands, explained ratios and loadings (largest one positive)."""
    values, vectors = np.linalg.eigh(np.array(band_correlation(rows, bands)))
    order = np.argsort(values)[::-1][: n or len(bands)]
    load = vectors[:, order].T
    load = load * np.sign(load[np.arange(len(load)), np.abs(load).argmax(axis=1)])[:, None]
    ok = rows.dropna(subset=bands)
    m = ok.agg(*[F.avg(b).alias(f"m_{b}") for b in bands], *[F.stddev_pop(b).alias(f"s_{b}") for b in bands]).first()
    z = [(F.col(b) - m[f"m_{b}"]) / (m[f"s_{b}"] or 1.0) for b in bands]
    scores = [sum((x * float(w) for x, w in zip(z[1:], l[1:])), z[0] * float(l[0])).alias(f"pc{k + 1}") for k, l in enumerate(load)]
    keep = [c for c in rows.columns if c not in bands]
    return ok.select(*keep, *scores), (values[order] / values.sum()).tolist(), load.tolist()


def independent_components(rows: DataFrame, bands: list[str], n: int | None = None, rounds: int = 200, tolerance: float = 1e-4, seed: int = 42, starts: int = 5) -> tuple[DataFrame, list[list[float]]]:
    """Scores ``ic1..`` and the unmixing matrix over standardised bands: fixed-point iteration with the tanh contrast, all components at once.

    Every round is one aggregation over the whitened rows (``n`` x ``n`` sums); only those reach
    the driver, which makes the directions orthogonal.  Where ``rounds`` do not settle, another of
    ``starts`` random directions is tried; if none settles, as for bands that are nearly Gaussian, a
    warning says so and the last one counts.  Components are in order of their largest weight's band,
    each with that weight positive.
    """
    ok = checkpointed(rows.dropna(subset=bands))
    m = ok.agg(*[F.avg(b).alias(f"m_{b}") for b in bands], *[F.stddev_pop(b).alias(f"s_{b}") for b in bands]).first()
    values, vectors = np.linalg.eigh(np.array(band_correlation(ok, bands)))
    top = np.argsort(values)[::-1][: n or len(bands)]
    whiten = vectors[:, top].T / np.sqrt(np.maximum(values[top], 1e-12))[:, None]
    z = [(F.col(b) - m[f"m_{b}"]) / (m[f"s_{b}"] or 1.0) for b in bands]
    mix = lambda weights, xs: sum((x * float(w) for w, x in zip(weights[1:], xs[1:])), xs[0] * float(weights[0]))
    white = checkpointed(ok.select(*[c for c in rows.columns if c not in bands], *[mix(w, z).alias(f"z{k}") for k, w in enumerate(whiten)]))
    size, zs = len(top), [F.col(f"z{k}") for k in range(len(top))]

    def orthogonal(w: np.ndarray) -> np.ndarray:
        u, _, v = np.linalg.svd(w)
        return u @ v

    random = np.random.default_rng(seed)
    for turn in range(rounds * starts):
        if turn % rounds == 0:
            w = orthogonal(random.normal(size=(size, size)))
        g = [F.tanh(mix(row, zs)) for row in w]
        means = white.agg(*[F.avg(g[i] * zs[j]).alias(f"a{i}_{j}") for i in range(size) for j in range(size)], *[F.avg(1 - g[i] * g[i]).alias(f"d{i}") for i in range(size)]).first()
        new = orthogonal(np.array([[means[f"a{i}_{j}"] - means[f"d{i}"] * w[i, j] for j in range(size)] for i in range(size)]))
        moved, w = np.abs(np.abs((new * w).sum(axis=1)) - 1).max(), new
        if moved < tolerance:
            break
    else:
        warnings.warn(f"the components did not settle in {starts} times {rounds} rounds", stacklevel=2)
    full = w @ whiten
    order = np.argsort(np.abs(full).argmax(axis=1), kind="stable")
    w, full = w[order], full[order]
    sign = np.sign(full[np.arange(size), np.abs(full).argmax(axis=1)])
    scores = [mix(row * s, zs).alias(f"ic{k + 1}") for k, (row, s) in enumerate(zip(w, sign))]
    return white.select(*[c for c in rows.columns if c not in bands], *scores), (full * sign[:, None]).tolist()
