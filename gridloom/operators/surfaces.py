"""Gridding of scattered points, colours to scalars, outlines of valid cells and polynomial trends of points."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.plans.scratch import checkpointed


def inverse_distance(points: DataFrame, nrows: int, ncols: int, radius: float, power: float = 2.0, x0: float = 0.0, y0: float = 0.0, cell: float = 1.0) -> DataFrame:
    """``(row, col, v, n)`` of the cells with a point of ``points(x, y, z)`` within ``radius`` of their centre.

    A point is sent to the cells that it reaches and sums are combined before the shuffle, so that
    neither dense places nor empty ones matter.  Points on a centre alone decide its value.
    """
    p = points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    centre = lambda i, at: F.lit(at) + (F.col(i) + 0.5) * cell

    def reach(x: str, at: float, n: int) -> Column:
        low = F.greatest(F.lit(0), F.ceil((F.col(x) - radius - at) / cell - 0.5).cast("int"))
        high = F.least(F.lit(n - 1), F.floor((F.col(x) + radius - at) / cell - 0.5).cast("int"))
        return F.when(low <= high, F.sequence(low, high))

    hit = p.select("x", "y", "z", F.explode(reach("y", y0, nrows)).alias("row"))
    hit = hit.select("x", "y", "z", "row", F.explode(reach("x", x0, ncols)).alias("col"))
    hit = hit.select("row", "col", "z", F.sqrt((F.col("x") - centre("col", x0)) ** 2 + (F.col("y") - centre("row", y0)) ** 2).alias("d")).where(F.col("d") <= radius)
    on, weight = F.col("d") == 0, F.when(F.col("d") > 0, F.pow("d", F.lit(-power)))
    sums = hit.groupBy("row", "col").agg(F.avg(F.when(on, F.col("z"))).alias("exact"), F.sum(weight * F.col("z")).alias("s"), F.sum(weight).alias("w"), F.count("*").alias("n"))
    return sums.select("row", "col", F.coalesce("exact", F.col("s") / F.col("w")).alias("v"), "n")


def colour_ramp(colours: list[tuple[int, int, int]], entries: int = 1024) -> list[tuple[int, int, int]]:
    """``entries`` colours at even steps between the given ones, whole numbers of 0..255."""
    at = np.linspace(0, len(colours) - 1, entries)
    bands = [np.interp(at, range(len(colours)), [c[k] for c in colours]) for k in range(3)]
    return [tuple(int(x) for x in entry) for entry in zip(*bands)]


def colour_to_scalar(pixels: DataFrame, table: list[tuple[int, int, int]], least: float = 0.0, most: float = 1.0) -> DataFrame:
    """``pixels(row, col, r, g, b)`` as ``(row, col, v)``: place of the nearest colour of ``table``, scaled.

    Pure white and black and incomplete pixels give NULL; equally near colours the first one.  Every
    different colour is compared once; the table is a parameter of at most a few thousand entries.
    """
    plain = (F.col("r") == F.col("g")) & (F.col("g") == F.col("b")) & F.col("r").isin(0, 255)
    known = pixels.where("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL").where(~plain).select("r", "g", "b").distinct()
    entries = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(int(x)).alias(n) for n, x in zip("rgb", c)]) for k, c in enumerate(table)])
    square = lambda e, n: (F.col(n) - e[n]) * (F.col(n) - e[n])
    near = F.array_min(F.transform(entries, lambda e: F.struct((square(e, "r") + square(e, "g") + square(e, "b")).alias("d"), e["k"].alias("k"))))
    found = known.select("r", "g", "b", (F.lit(least) + near["k"] * ((most - least) / max(1, len(table) - 1))).alias("v"))
    return pixels.join(found, ["r", "g", "b"], "left").select("row", "col", "v")


# Colour names of style sheets that a table of colours may use.
COLOURS = {
    "black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "lime": (0, 255, 0), "blue": (0, 0, 255), "yellow": (255, 255, 0), "cyan": (0, 255, 255), "aqua": (0, 255, 255),
    "magenta": (255, 0, 255), "fuchsia": (255, 0, 255), "silver": (192, 192, 192), "gray": (128, 128, 128), "grey": (128, 128, 128), "maroon": (128, 0, 0), "olive": (128, 128, 0),
    "green": (0, 128, 0), "purple": (128, 0, 128), "teal": (0, 128, 128), "navy": (0, 0, 128), "orange": (255, 165, 0), "brown": (165, 42, 42), "pink": (255, 192, 203),
}


def parse_colours(text: str, entries: int = 1024) -> list[tuple[int, int, int]]:
    """Colour table of ``(r,g,b),...``, plain numbers in threes or colour names, **last colour first**, as an even ramp.

    Numbers are shares of one if none is above 1, else of 255.
    """
    names = re.findall(r"[A-Za-z]+", text)
    if names:
        unknown = [n for n in names if n.lower() not in COLOURS]
        if unknown:
            raise ValueError(f"unknown colour {unknown[0]}")
        colours = [COLOURS[n.lower()] for n in names]
    else:
        numbers = [float(x) for x in re.findall(r"-?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?", text)]
        if not numbers or len(numbers) % 3:
            raise ValueError("colours are threes of numbers")
        scale = 1.0 if max(numbers) > 1 else 255.0
        colours = [tuple(int(x * scale) for x in numbers[k : k + 3]) for k in range(0, len(numbers), 3)]
    return colour_ramp(colours[::-1], entries)


def boundary_edges(grid: DataFrame) -> DataFrame:
    """``(row, col, axis)``: cell sides between a valid cell and a NULL cell or the outside.

    A side along the columns (axis 0) starts at the corner ``(row, col)`` and ends at ``col + 1``, one down
    the rows (axis 1) ends at ``row + 1``.  Sides of two valid cells are met twice and fall out.
    """
    side = lambda r, c, a: F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col"), F.lit(a).alias("axis"))
    sides = grid.where("v IS NOT NULL").select(F.explode(F.array(side(0, 0, 0), side(1, 0, 0), side(0, 0, 1), side(0, 1, 1))).alias("s"))
    return sides.groupBy("s").agg(F.count("*").alias("n")).where("n = 1").select("s.row", "s.col", "s.axis")


def point_trend(points: DataFrame, degree: int) -> tuple[DataFrame, list[tuple[int, int, float]]]:
    """``points(x, y, z)`` with ``trend`` and ``residual``, and ``(i, j, weight)`` of the terms ``x^i y^j``.

    One aggregation gathers the normal equations in coordinates scaled to -1..1, which the terms refer to.
    Points with a NULL take no part in the fit; without usable points the trend is NULL.
    """
    ok = points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    box = ok.agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))]).first()
    if box["low_x"] is None:
        return points.withColumn("trend", F.lit(None).cast("double")).withColumn("residual", F.lit(None).cast("double")), []
    scaled = {c: (F.col(c) - (box[f"low_{c}"] + box[f"high_{c}"]) / 2) / ((box[f"high_{c}"] - box[f"low_{c}"]) / 2 or 1.0) for c in "xy"}
    terms = [(i, j) for i in range(degree + 1) for j in range(degree + 1 - i)]
    power = lambda i, j: F.pow(scaled["x"], F.lit(float(i))) * F.pow(scaled["y"], F.lit(float(j)))
    moments = sorted({(a + c, b + d) for a, b in terms for c, d in terms})
    sums = ok.agg(*[F.sum(power(i, j)).alias(f"m{i}_{j}") for i, j in moments], *[F.sum(power(i, j) * F.col("z")).alias(f"z{i}_{j}") for i, j in terms]).first()
    left = [[sums[f"m{a + c}_{b + d}"] for c, d in terms] for a, b in terms]
    weights = np.linalg.lstsq(np.array(left), np.array([sums[f"z{i}_{j}"] for i, j in terms]), rcond=None)[0].tolist()
    trend = sum((power(i, j) * w for (i, j), w in zip(terms[1:], weights[1:])), power(0, 0) * weights[0])
    return points.withColumn("trend", trend).withColumn("residual", F.col("z") - F.col("trend")), [(i, j, w) for (i, j), w in zip(terms, weights)]


#: Control values of a lattice that is sent whole to every task; larger ones meet the places in a join.
DENSE_LATTICE = 1 << 16


def _cubic(x):
    """The four basis values of a uniform cubic B-spline at ``x`` within an interval, for columns and arrays."""
    return [(1 - x) ** 3 / 6, (3 * x**3 - 6 * x**2 + 4) / 6, (-3 * x**3 + 3 * x**2 + 3 * x + 1) / 6, x**3 / 6]


def _spread(places: DataFrame, n: int, keep: str) -> DataFrame:
    """``(<keep>, a, b, w, total)``: the 16 control places around each ``(s, t)`` on a lattice of ``n`` intervals, their weights and the sum of all squared ones."""
    base = lambda c: F.least(F.floor(F.col(c) * n), F.lit(n - 1))
    p = places.select(keep, base("s").alias("i"), base("t").alias("j"), (F.col("s") * n - base("s")).alias("u"), (F.col("t") * n - base("t")).alias("v"))
    p = p.select(keep, "i", "j", F.array(*_cubic(F.col("u"))).alias("x"), F.array(*_cubic(F.col("v"))).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    squares = lambda c: F.aggregate(c, F.lit(0.0), lambda s, w: s + w * w)
    a, b = F.floor(F.col("k") / 4).cast("int"), F.col("k") % 4
    return p.select(keep, (F.col("i") + a).alias("a"), (F.col("j") + b).alias("b"), (F.get("x", a) * F.get("y", b)).alias("w"), (squares("x") * squares("y")).alias("total"))


def _lattice(points: DataFrame, n: int) -> DataFrame:
    """``(a, b, phi)``: control values of ``points(s, t, z)`` within the lattice; sums are combined before they are shuffled."""
    near = _spread(points.where("s BETWEEN 0 AND 1 AND t BETWEEN 0 AND 1"), n, "z")
    return near.groupBy("a", "b").agg((F.sum(F.col("w") ** 3 * F.col("z") / F.col("total")) / F.sum(F.col("w") ** 2)).alias("phi"))


def _with_height(places: DataFrame, phi: DataFrame, n: int, dense: int) -> DataFrame:
    """``places(id, s, t, ..)`` with the height ``h`` of the surface over them; control places without a value count as 0."""
    if (n + 3) ** 2 > dense:
        h = _spread(places, n, "id").join(phi, ["a", "b"]).groupBy("id").agg(F.sum(F.col("w") * F.col("phi")).alias("h"))
        return places.join(h, "id", "left").withColumn("h", F.coalesce("h", F.lit(0.0)))
    lattice = np.zeros((n + 3, n + 3))  # at most ``dense`` values
    for r in phi.collect():
        if 0 <= r.a < n + 3 and 0 <= r.b < n + 3:
            lattice[r.a, r.b] = r.phi

    @F.pandas_udf("double")
    def height(s: pd.Series, t: pd.Series) -> pd.Series:
        s, t = s.to_numpy(float), t.to_numpy(float)
        i, j = (np.minimum(np.floor(x * n), n - 1).astype(int) for x in (s, t))
        out = np.zeros(len(s))
        inside = (i >= 0) & (j >= 0)
        i, j, u, w = i[inside], j[inside], (s * n - i)[inside], (t * n - j)[inside]
        out[inside] = sum(x * y * lattice[i + a, j + b] for a, x in enumerate(_cubic(u)) for b, y in enumerate(_cubic(w)))
        return pd.Series(out)

    return places.withColumn("h", height("s", "t"))


def b_spline(points: DataFrame, nrows: int, ncols: int, levels: int = 4, coarsest: int = 2, x0: float = 0.0, y0: float = 0.0, cell: float = 1.0, dense: int = DENSE_LATTICE) -> DataFrame:
    """``(row, col, v)`` of all cells: multilevel cubic B-spline approximation of ``points(x, y, z)``.

    Level k has ``coarsest * 2^k`` intervals on the longer side.  A point adds its residual to the
    4 x 4 control values around it, weighted by their squared basis; the surface so far is taken
    off before the next level.  Lattices of at most ``dense`` control values go to all tasks, so that
    the few control places of coarse levels are no keys of a join; finer ones are joined by place.
    """
    side = max(nrows, ncols) * cell
    rest = points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select(F.monotonically_increasing_id().alias("id"), ((F.col("x") - x0) / side).alias("s"), ((F.col("y") - y0) / side).alias("t"), F.col("z").cast("double").alias("z"))
    rest = checkpointed(rest)
    at = rest.sparkSession.range(nrows * ncols).select(F.col("id"), F.floor(F.col("id") / ncols).cast("int").alias("row"), (F.col("id") % ncols).cast("int").alias("col"))
    at = at.select("id", "row", "col", ((F.col("col") + 0.5) * cell / side).alias("s"), ((F.col("row") + 0.5) * cell / side).alias("t"), F.lit(0.0).alias("v"))
    for level in range(levels):
        n = coarsest << level
        phi = checkpointed(_lattice(rest, n))
        at = checkpointed(_with_height(at, phi, n, dense).select("id", "row", "col", "s", "t", (F.col("v") + F.col("h")).alias("v")))
        if level + 1 < levels:
            rest = checkpointed(_with_height(rest, phi, n, dense).select("id", "s", "t", (F.col("z") - F.col("h")).alias("z")))
    return at.select("row", "col", "v")


def _hull(xy: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, clockwise in a plane whose y grows upwards."""
    out: list[tuple[float, float]] = []
    for half in (sorted(set(xy)), sorted(set(xy), reverse=True)):
        side: list[tuple[float, float]] = []
        for p in half:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) - (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]) >= 0:
                side.pop()
            side.append(p)
        out += side[:-1]
    return out


def hull_mask(points: DataFrame, nrows: int, ncols: int, x0: float = 0.0, y0: float = 0.0, cell: float = 1.0) -> DataFrame:
    """``(row, col, inside)``: whether a cell's centre lies in the convex hull of ``points(x, y)``.

    Every partition keeps the corners of its own hull, and only those meet for the hull of all;
    its corners then go into a half-plane test that runs on the cells.
    """

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ring: list[tuple[float, float]] = []
        for b in batches:
            ring = _hull(ring + list(zip(b["x"].tolist(), b["y"].tolist())))
        yield pd.DataFrame(ring, columns=["x", "y"])

    p = points.where("x IS NOT NULL AND y IS NOT NULL").select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    parts = p.mapInPandas(corners, "x double, y double").coalesce(1).mapInPandas(corners, "x double, y double")
    ring = _hull([(r["x"], r["y"]) for r in parts.collect()])
    cells = points.sparkSession.range(nrows * ncols).select(F.floor(F.col("id") / ncols).cast("int").alias("row"), (F.col("id") % ncols).cast("int").alias("col"))
    x, y = F.lit(x0) + (F.col("col") + 0.5) * cell, F.lit(y0) + (F.col("row") + 0.5) * cell
    sides = F.array(*[F.struct(F.lit(ax).alias("ax"), F.lit(ay).alias("ay"), F.lit(bx - ax).alias("ux"), F.lit(by - ay).alias("uy")) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1])])
    inside = F.forall(sides, lambda s: (x - s["ax"]) * s["uy"] - (y - s["ay"]) * s["ux"] >= -1e-9) if len(ring) > 2 else F.lit(False)
    return cells.select("row", "col", inside.alias("inside"))
