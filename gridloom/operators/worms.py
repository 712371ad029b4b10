"""Multiscale edges: continuation to several heights, edge crossings, and lines through them."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.operators.graph import SMALL_EDGES, connected_components, forest_paths, minimum_spanning_forest
from gridloom.operators.spectral import Spectrum, upward
from gridloom.plans.scratch import checkpointed


def _pad(n: int) -> int:
    """A fifth of the side on each end, rounded up to an even number."""
    return math.ceil(int(0.2 * n) / 2) * 2


def continued(grid: DataFrame, nrows: int, ncols: int, heights: list[float], dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """``(z, row, col, v)``: the padded grid at each height, one transform for all; its first cell is the padding's."""
    py, px = _pad(nrows), _pad(ncols)
    s = Spectrum(grid, nrows, ncols, dx, dy, pads=((py, py), (px, px)), window="hann", level="mean", fill="level")
    wide = s.filtered({f"h{k}": upward(h) for k, h in enumerate(heights)}, crop=False, restore=False)
    each = F.array(*[F.struct(F.lit(float(h)).alias("z"), F.col(f"h{k}").alias("v")) for k, h in enumerate(heights)])
    cells = wide.select((F.col("row") + py).alias("row"), (F.col("col") + px).alias("col"), F.explode(each).alias("e"))
    return cells.select("e.z", "row", "col", "e.v")


def _around(value: str, across: str, along: str, step: int, keys: list[str]) -> Column:
    """The value one place on (or back) along a line that closes on itself."""
    w = Window.partitionBy(*keys, across).orderBy(along)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near, far = (F.lead, F.first) if step > 0 else (F.lag, F.last)
    return F.when(near(along).over(w).isNull(), far(value).over(whole)).otherwise(near(value).over(w))


def wrapped_gradient(cells: DataFrame, value: str, x: str, y: str, dx: float = 1.0, dy: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """``cells`` with the differences of both neighbours, over one spacing, along columns (``x``) and rows (``y``)."""
    keys = keys or []
    out = cells.withColumn(x, (_around(value, "row", "col", 1, keys) - _around(value, "row", "col", -1, keys)) / dx)
    return out.withColumn(y, (_around(value, "col", "row", 1, keys) - _around(value, "col", "row", -1, keys)) / dy)


def edges(levels: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """``(z, row, col, modulus, f)``: gradient modulus, and its slope along the gradient, which is 0 on an edge."""
    g = wrapped_gradient(levels, "v", "gx", "gy", dx, dy, ["z"])
    g = g.select("z", "row", "col", "gx", "gy", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2).alias("modulus"))
    m = wrapped_gradient(g, "modulus", "mx", "my", dx, dy, ["z"])
    flat = F.col("modulus") <= 1e-8
    slope = F.col("mx") * F.col("gx") / F.col("modulus") + F.col("my") * F.col("gy") / F.col("modulus")
    return m.select("z", "row", "col", "modulus", F.when(flat, 0.0).otherwise(slope).alias("f"))


def crossings(cells: DataFrame, nrows: int, ncols: int, keys: list[str] | None = None, value: str | None = None) -> DataFrame:
    """``(keys.., x, y, val)`` where ``f`` passes zero on the way to the next column or row, which wrap around.

    ``val`` is taken from the cell that the crossing starts from.
    """
    keys = keys or []
    ahead = cells.withColumn("fx", _around("f", "row", "col", 1, keys)).withColumn("fy", _around("f", "col", "row", 1, keys))
    place = lambda nxt: F.when(F.col("f") != F.col(nxt), F.col("f") / (F.col("f") - F.col(nxt)))
    sides = F.array(
        F.struct((F.col("col") + place("fx")).alias("x"), F.col("row").cast("double").alias("y"), place("fx").alias("s")),
        F.struct(F.col("col").cast("double").alias("x"), (F.col("row") + place("fy")).alias("y"), place("fy").alias("s")),
    )
    met = ahead.select(*keys, F.col(value).alias("val") if value else F.lit(None).cast("double").alias("val"), F.explode(sides).alias("p"))
    met = met.where(F.col("p.s").between(0, 1) & (F.col("p.x") < ncols) & (F.col("p.y") < nrows))
    return met.select(*keys, "p.x", "p.y", "val")


def sign_changes(cells: DataFrame) -> DataFrame:
    """``(row, col, edge)``: whether ``f`` has the other sign in one of the four neighbours, edges wrapped."""
    near = [_around("f", "row", "col", k, []) for k in (1, -1)] + [_around("f", "col", "row", k, []) for k in (1, -1)]
    wide = cells.select("row", "col", "f", *[c.alias(f"n{k}") for k, c in enumerate(near)])
    return wide.select("row", "col", F.greatest(*[F.col("f") * F.col(f"n{k}") < 0 for k in range(4)]).alias("edge"))


def fractional_changes(cells: DataFrame) -> DataFrame:
    """``(row, col, edge)``: whether ``f`` passes zero on the way right, down or along either diagonal to the right."""
    right = cells.withColumn("right", _around("f", "row", "col", 1, []))
    wide = right.select(
        "row", "col", "f", "right", _around("f", "col", "row", 1, []).alias("down"), _around("right", "col", "row", 1, []).alias("lower"), _around("right", "col", "row", -1, []).alias("upper"),
    )
    s = lambda n: F.coalesce((F.col("f") / F.nullif(F.col("f") - F.col(n), F.lit(0.0))).between(0, 1), F.lit(False))
    return wide.select("row", "col", F.greatest(*map(s, ("right", "down", "lower", "upper"))).alias("edge"))


def worms(grid: DataFrame, nrows: int, ncols: int, levels: int, base: float, step: float, dx: float = 1.0, dy: float = 1.0, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """``(z, x, y, val)``: edge points of every level within the grid, in map units from its first corner ``(x0, y0)``.

    Level k lies at ``base + k * step`` (0.01 where that is 0); ``y`` grows with the row.
    """
    heights = [base + k * step or 0.01 for k in range(levels)]
    py, px = _pad(nrows), _pad(ncols)
    found = crossings(edges(continued(grid, nrows, ncols, heights, dx, dy), dx, dy), nrows + 2 * py, ncols + 2 * px, ["z"], "modulus")
    at = found.select("z", (F.lit(x0) + (F.col("x") - px) * dx).alias("x"), (F.lit(y0) + (F.col("y") - py) * dy).alias("y"), "val")
    return at.where(F.col("x").between(x0, x0 + ncols * dx) & F.col("y").between(y0, y0 + nrows * dy))


def near_pairs(points: DataFrame, eps: float, keys: list[str]) -> DataFrame:
    """``(src, dst)`` ids of points of the same ``keys`` at most ``eps`` apart; each point looks into the squares around its own."""
    p = points.select(*keys, "id", "x", "y", F.floor(F.col("x") / eps).alias("bx"), F.floor(F.col("y") / eps).alias("by"))
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    a = p.select(*keys, F.col("id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by", F.explode(around).alias("o"))
    a = a.withColumn("bx", F.col("bx") + F.col("o.a")).withColumn("by", F.col("by") + F.col("o.b")).drop("o")
    b = p.select(*keys, F.col("id").alias("dst"), "x", "y", "bx", "by")
    met = a.join(b, [*keys, "bx", "by"])
    return met.where((F.col("src") < F.col("dst")) & ((F.col("ax") - F.col("x")) ** 2 + (F.col("ay") - F.col("y")) ** 2 <= eps * eps)).select("src", "dst")


#: Cells on a side of the squares in which close points are joined.
_FINE = 8


def near_links(points: DataFrame, eps: float, keys: list[str]) -> DataFrame:
    """``(src, dst)`` links that connect the same points of the same ``keys`` as steps of at most ``eps`` do.

    The points of a square whose diagonal is ``eps`` are all linked to its smallest id.  Two squares
    need one step between them, which the boxes around the points of their cells decide: one pair of
    boxes that lies wholly within ``eps`` links them, and only where there is none but some pair
    might, the points of those cells are compared.  Crowded squares are never expanded into pairs.
    """
    side = eps / 1.4143
    at = lambda c, n: F.floor(F.col(c) / (side / n)).alias(f"{c}{n}")
    p = points.select(*keys, "id", "x", "y", at("x", 1), at("y", 1), at("x", _FINE), at("y", _FINE))
    square, cell = [*keys, "x1", "y1"], [f"x{_FINE}", f"y{_FINE}"]
    heads = p.groupBy(*square).agg(F.min("id").alias("head"))
    stars = p.join(heads, square).select(F.col("head").alias("src"), F.col("id").alias("dst"))
    boxes = p.groupBy(*square, *cell).agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("low_", F.min), ("high_", F.max))])
    boxes = checkpointed(boxes.join(heads, square))
    half = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)])
    a = boxes.withColumn("o", F.explode(half)).select(*keys, (F.col("x1") + F.col("o.i")).alias("x1"), (F.col("y1") + F.col("o.j")).alias("y1"), *[F.col(c).alias(f"a_{c}") for c in boxes.columns if c not in square])
    met = a.join(boxes, square)
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"low_{c}") - F.col(f"a_high_{c}"), F.col(f"a_low_{c}") - F.col(f"high_{c}"))
    span = lambda c: F.greatest(F.abs(F.col(f"high_{c}") - F.col(f"a_low_{c}")), F.abs(F.col(f"a_high_{c}") - F.col(f"low_{c}")))
    limit, a_cell = eps * eps, [f"a_{c}" for c in cell]
    met = met.select(*keys, "a_head", "head", *a_cell, *cell, (span("x") ** 2 + span("y") ** 2 <= limit).alias("sure"), (gap("x") ** 2 + gap("y") ** 2 <= limit).alias("may")).where("may")
    met = checkpointed(met)
    linked = met.where("sure").select(F.col("a_head").alias("src"), F.col("head").alias("dst")).distinct()
    open_ = met.join(linked, (F.col("a_head") == F.col("src")) & (F.col("head") == F.col("dst")), "left_anti")
    where = p.select(*keys, *cell, "x", "y")
    first = open_.join(where.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cell], F.col("x").alias("ax"), F.col("y").alias("ay")), [*keys, *a_cell])
    both = first.join(where, [*keys, *cell]).where((F.col("ax") - F.col("x")) ** 2 + (F.col("ay") - F.col("y")) ** 2 <= limit)
    return stars.union(linked).union(both.select("a_head", "head").distinct())


def clusters(points: DataFrame, eps: float, least_z: float = 1.0) -> DataFrame:
    """``points(z, id, x, y)`` with ``cluster``: the smallest id reachable over steps of at most ``eps`` within a level.

    Levels below ``least_z`` and single points take no part.
    """
    use = points.where(F.col("z") >= least_z)
    found = connected_components(near_links(use, eps, ["z"]), SMALL_EDGES).withColumnRenamed("node", "id").withColumnRenamed("component", "cluster")
    sizes = found.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1")
    return use.join(found, "id").join(sizes, "cluster").select("z", "id", "x", "y", "cluster")


def neighbour_links(cells: DataFrame, keys: list[str] | None = None, most: int = 2) -> DataFrame:
    """``(src, dst, weight)``: ids of each of ``cells(keys.., id, row, col)`` and of its ``most`` nearest cells among the eight around it.

    Of equally near ones the lower row, then the lower column counts.
    """
    keys = keys or []
    around = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)])
    a = cells.select(*keys, F.col("id").alias("src"), "row", "col", F.explode(around).alias("o"))
    a = a.select(*keys, "src", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), (F.col("o.dr") ** 2 + F.col("o.dc") ** 2).alias("d2"))
    met = a.join(cells.select(*keys, F.col("id").alias("dst"), "row", "col"), [*keys, "row", "col"])
    near = met.groupBy("src").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "row", "col", "dst"))), 1, most).alias("n"))  # at most eight
    return near.select("src", F.explode("n").alias("n")).select("src", "n.dst", F.sqrt("n.d2").alias("weight"))


def edge_segments(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(segment, seq, id)``: unbranched stretches of the least tree over ``neighbour_links`` of edge cells, from end to end.

    Levels are told apart by ``keys``, but no level is a group of its own; ids are unique over all
    levels.  Each link of the tree is in one segment, a cell where it branches in several; a cell
    without neighbours is in none.  A segment is named by its first and last id.
    """
    tree = minimum_spanning_forest(neighbour_links(cells, keys))
    path = forest_paths(tree)
    name = F.concat_ws("-", "start", "stop").alias("segment")
    first = path.where("seq = 0").select(name, F.lit(0).cast("long").alias("seq"), F.col("src").alias("id"))
    return first.unionByName(path.select(name, (F.col("seq") + 1).alias("seq"), F.col("dst").alias("id")))


_NEAREST = 10


class _Squares:
    """Points in squares that hold about two of them each, for the nearest ones of a place."""

    def __init__(self, xy: np.ndarray, eps: float):
        box = np.maximum(np.ptp(xy, axis=0), eps)
        self.side = max(min(eps, math.sqrt(2 * box[0] * box[1] / len(xy))), eps / 32)
        self.rings = math.ceil(eps / self.side)
        self.eps, self.xy = eps, [tuple(p) for p in xy.tolist()]
        self.at = list(map(tuple, np.floor(xy / self.side).astype(np.int64).tolist()))
        self.all: dict[tuple[int, int], list[int]] = {}
        for k, s in enumerate(self.at):
            self.all.setdefault(s, []).append(k)
        self.open = {s: set(ks) for s, ks in self.all.items()}

    def close(self, k: int) -> None:
        left = self.open[self.at[k]]
        left.discard(k)
        if not left:
            del self.open[self.at[k]]

    def _ring(self, s: tuple[int, int], n: int):
        a, b = s
        if n == 0:
            yield s
            return
        for j in range(-n, n + 1):
            yield a - n, b + j
            yield a + n, b + j
        for i in range(-n + 1, n):
            yield a + i, b - n
            yield a + i, b + n

    def nearest(self, k: int, most: int, index: dict) -> list[tuple[float, int]]:
        """The ``most`` nearest points of ``index`` by distance, then number, complete within ``eps``."""
        x, y = self.xy[k]
        found: list[tuple[float, int]] = []
        for n in range(self.rings + 1):
            few = n > 2 and len(index) < 8 * n  # so few squares are left that going through them is shorter
            for s in list(index) if few else self._ring(self.at[k], n):
                for j in index.get(s, ()):
                    found.append((math.hypot(self.xy[j][0] - x, self.xy[j][1] - y), j))
            if few:
                return sorted(set(found))[:most]
            if len(found) >= most:
                found.sort()
                if found[most - 1][0] < n * self.side:  # nothing nearer lies further out
                    return found[:most]
        found.sort()
        return found[:most]


def _path(xy: np.ndarray, eps: float) -> list[int]:
    """Order in which points are visited: the nearest open one among the ten nearest if within ``eps``, else the open one nearest to any visited.

    Points are those of one cluster, so some visited point always has an open one within ``eps``.
    Where the walk ends dead, visited points wait in a heap under the distance to their nearest open
    point when last looked at, which can only grow; the first whose point is still open wins.
    """
    squares = _Squares(xy, eps)
    order, is_open = [0], [True] * len(xy)
    is_open[0] = False
    squares.close(0)
    waiting: list[tuple[float, int, int]] = [(0.0, -1, 0)]
    while len(order) < len(xy):
        here = order[-1]
        nxt = next((k for d, k in squares.nearest(here, _NEAREST, squares.all) if is_open[k] and d <= eps), -1)
        while nxt < 0:
            d, k, of = heapq.heappop(waiting)
            if k >= 0 and is_open[k]:
                nxt = k
                heapq.heappush(waiting, (d, k, of))
            else:
                again = squares.nearest(of, 1, squares.open)
                if again and again[0][0] <= 2 * eps:
                    heapq.heappush(waiting, (*again[0], of))
        is_open[nxt] = False
        squares.close(nxt)
        order.append(nxt)
        heapq.heappush(waiting, (0.0, -1, nxt))
    return order


def polylines(points: DataFrame, eps: float) -> DataFrame:
    """``(z, cluster, line, seq, x, y)``: points of each cluster in the order of a greedy walk, cut at steps longer than ``eps``.

    The walk is sequential, so a cluster is one group; clusters are as long as one connected edge, and
    time grows with their points but for a logarithm.
    It begins at the point with the smallest id; a line of one point is dropped, as is a first
    part of a single step before a cut.
    """

    def walk(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        xy = group[["x", "y"]].to_numpy(float)
        order = _path(xy, eps)
        lines, part = [], [order[0]]
        for before, k in zip(order, order[1:]):
            if math.dist(xy[before], xy[k]) > eps:
                if len(part) > 1:
                    lines.append(part)
                part = []
            part.append(k)
        if len(part) > 1:
            lines.append(part)
        rows = [(key[0], key[1], i, j, *xy[k].tolist()) for i, line in enumerate(lines) for j, k in enumerate(line)]
        return pd.DataFrame(rows, columns=["z", "cluster", "line", "seq", "x", "y"])

    return clusters(points, eps).groupBy("z", "cluster").applyInPandas(walk, "z double, cluster long, line int, seq int, x double, y double")


def as_wkt(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys.., wkt)``: one LINESTRING for the rows ``(seq, x, y)`` of each key."""
    pair = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), pair), ", ")
    return lines.groupBy(*keys).agg(F.concat(F.lit("LINESTRING ("), text, F.lit(")")).alias("wkt"))
