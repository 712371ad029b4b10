"""Closed outlines of valid cells: rings, holes and the polygons they make.

Outlines are traced tile by tile; a tile yields closed rings and chains that enter and leave it.
Chains are strung together by looking twice as far back in each round, so that no task holds
more than a tile however long an outline is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.operators.graph import SMALL_EDGES, connected_components
from gridloom.plans.scratch import checkpointed, materialise

#: Corners on a side of the tiles in which outlines are traced.
TILE = 256
#: Corners in one piece of an outline's text.
PIECE = 5_000


def directed_sides(grid: DataFrame) -> DataFrame:
    """``(r0, c0, r1, c1)``: outline sides from corner to corner, the valid cell on the right of the way."""
    side = lambda r0, c0, r1, c1: F.struct((F.col("row") + r0).alias("r0"), (F.col("col") + c0).alias("c0"), (F.col("row") + r1).alias("r1"), (F.col("col") + c1).alias("c1"))
    around = F.array(side(0, 0, 0, 1), side(0, 1, 1, 1), side(1, 1, 1, 0), side(1, 0, 0, 0))
    sides = grid.where("v IS NOT NULL").select(F.explode(around).alias("s")).select("s.*")
    # A side between two valid cells is there twice, once each way.
    end = lambda k: F.struct(F.col(f"r{k}").alias("r"), F.col(f"c{k}").alias("c"))
    name = [F.least(end(0), end(1)).alias("a"), F.greatest(end(0), end(1)).alias("b")]
    once = sides.groupBy(*name).agg(F.count("*").alias("n"), F.first("r0").alias("r0"), F.first("c0").alias("c0"), F.first("r1").alias("r1"), F.first("c1").alias("c1"))
    return once.where("n = 1").select("r0", "c0", "r1", "c1")


def _chains(own: np.ndarray, r: np.ndarray, c: np.ndarray, way: np.ndarray) -> list[tuple[int | None, list[int], bool]]:
    """``(entering side, sides in order, leaves)``: chains and closed rings over the sides that start in a tile.

    ``own`` marks those, the others end in it.  Ways are east, south, west and north as 0 to 3.
    Where two outlines touch in a corner the walk turns right, round the same cell.
    """
    step = np.array([(0, 1), (1, 0), (0, -1), (-1, 0)])
    place = {(a, b, w): k for k, (a, b, w, o) in enumerate(zip(r.tolist(), c.tolist(), way.tolist(), own.tolist())) if o}
    ends = zip((r + step[way, 0]).tolist(), (c + step[way, 1]).tolist(), way.tolist())
    after = [next((k for turn in (1, 0, 3) if (k := place.get((a, b, (w + turn) % 4))) is not None), -1) for a, b, w in ends]
    seen, out = ~own, []
    entries = np.flatnonzero(~own).tolist()
    for entry in [*entries, *np.flatnonzero(own).tolist()]:
        k = after[entry] if entry < len(own) and not own[entry] else entry
        if k < 0 or seen[k]:
            continue
        chain = []
        while k >= 0 and not seen[k]:
            seen[k] = True
            chain.append(k)
            k = after[k]
        out.append((entry if not own[entry] else None, chain, k < 0))
    return out


def _side(r, c, way):
    """A number for the side that starts at a corner and goes one way: first by row, then by column."""
    return r * (1 << 33) + c * 4 + way


def _traced(sides: DataFrame, tile: int) -> DataFrame:
    """``(chain, k, side, row, col, enter, leave, cross)``: sides in order along each chain of each tile.

    ``enter`` and ``leave`` are the sides by which a chain comes from another tile and goes to one, NULL
    for rings within a tile; ``cross`` sums up to twice the area.
    """
    way = F.when(F.col("c1") > F.col("c0"), 0).when(F.col("r1") > F.col("r0"), 1).when(F.col("c1") < F.col("c0"), 2).otherwise(3)
    home = lambda k: F.struct(F.floor(F.col(f"r{k}") / tile).alias("tr"), F.floor(F.col(f"c{k}") / tile).alias("tc"))
    tiles = F.array_distinct(F.array(home(0), home(1)))
    dealt = sides.select(F.col("r0").alias("row"), F.col("c0").alias("col"), way.alias("way"), F.explode(tiles).alias("t"), home(0).alias("h"))
    dealt = dealt.select("t.tr", "t.tc", "row", "col", "way", (F.col("t") == F.col("h")).alias("own"))

    def trace(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["row", "col", "way"])
        own, r, c, w = (group[x].to_numpy() for x in ("own", "row", "col", "way"))
        r, c = r.astype(np.int64), c.astype(np.int64)
        side = _side(r, c, w.astype(np.int64))
        dr, dc = np.array([0, 1, 0, -1])[w], np.array([1, 0, -1, 0])[w]
        cross = c * (r + dr) - (c + dc) * r
        parts = []
        for enter, chain, leaves in _chains(own.astype(bool), r, c, w):
            at = np.array(chain)
            last = np.arange(len(at)) == len(at) - 1
            parts.append(pd.DataFrame({
                "chain": side[at[0]], "k": np.arange(len(at)), "side": side[at], "row": r[at], "col": c[at],
                "enter": pd.array(np.where(np.arange(len(at)) == 0, side[enter], -1) if enter is not None else np.full(len(at), -1)),
                "leave": pd.array(np.where(last, side[at], -1) if leaves else np.full(len(at), -1)), "cross": cross[at],
            }))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["chain", "k", "side", "row", "col", "enter", "leave", "cross"])

    found = dealt.groupBy("tr", "tc").applyInPandas(trace, "chain long, k long, side long, row int, col int, enter long, leave long, cross long")
    return found.withColumns({c: F.nullif(F.col(c), F.lit(-1).cast("long")) for c in ("enter", "leave")})


def _strung(chains: DataFrame) -> DataFrame:
    """``(chain, leader, before)`` of open ``chains(chain, enter, leave, n)``: the smallest chain of the ring and how many sides lie between."""
    link = chains.select("chain", "enter").join(chains.select(F.col("leave").alias("enter"), F.col("chain").alias("prev"), "n"), "enter").select("chain", "prev", "n")
    link = checkpointed(link)
    state = link.select("chain", "prev", F.col("chain").alias("leader"))
    while True:  # the smallest of the last 1, 2, 4, .. chains, until that changes for none
        far = state.select(F.col("chain").alias("prev"), F.col("prev").alias("further"), F.col("leader").alias("other"))
        new = checkpointed(state.join(far, "prev").select("chain", F.col("further").alias("prev"), F.least("leader", "other").alias("leader"), (F.col("other") < F.col("leader")).alias("moved")))
        moved = new.where("moved").isEmpty()
        state = new.drop("moved")
        if moved:
            break
    named = link.join(state.select("chain", "leader"), "chain")
    first = F.col("chain") == F.col("leader")
    dist = checkpointed(named.select("chain", "leader", F.when(~first, F.col("prev")).alias("prev"), F.when(first, 0).otherwise(F.col("n")).alias("before")))
    while not dist.where("prev IS NOT NULL").isEmpty():
        far = dist.select(F.col("chain").alias("prev"), F.col("prev").alias("further"), F.col("before").alias("more"))
        on = dist.where("prev IS NOT NULL").join(far, "prev").select("chain", "leader", F.col("further").alias("prev"), (F.col("before") + F.col("more")).alias("before"))
        dist = checkpointed(dist.where("prev IS NULL").unionByName(on))
    return dist.select("chain", "leader", F.col("before").cast("long").alias("before"))


def rings(grid: DataFrame, tile: int = TILE) -> DataFrame:
    """``(ring, seq, row, col, area)``: corners of every closed outline in order from its smallest one, that one again at the end.

    ``ring`` is a number of that corner; ``area`` counts cells and is negative for a hole.
    """
    parts = materialise(_traced(directed_sides(grid), tile), "outline-chains")
    chains = parts.groupBy("chain").agg(F.count("*").alias("n"), F.max("enter").alias("enter"), F.max("leave").alias("leave"), F.sum("cross").alias("cross"), F.min(F.struct("side", "k")).alias("least"))
    chains = checkpointed(chains)
    whole, cut = chains.where("enter IS NULL"), chains.where("enter IS NOT NULL")
    place = whole.select("chain", F.col("chain").alias("leader"), F.lit(0).cast("long").alias("before"))
    if not cut.isEmpty():
        place = place.unionByName(_strung(cut))
    placed = checkpointed(chains.join(place, "chain"))
    about = placed.groupBy("leader").agg(F.sum("n").alias("sides"), (F.sum("cross") / 2).alias("area"), F.min(F.struct(F.col("least.side").alias("ring"), (F.col("before") + F.col("least.k")).alias("at"))).alias("first"))
    of = placed.select("chain", "leader", "before").join(about, "leader").select("chain", "before", "sides", "area", F.col("first.ring").alias("ring"), F.col("first.at").alias("at"))
    seq = F.pmod(F.col("before") + F.col("k") - F.col("at"), F.col("sides"))
    found = parts.join(of, "chain").select("ring", seq.alias("seq"), "row", "col", "area", "sides")
    both = F.when(F.col("seq") == 0, F.array(F.lit(0).cast("long"), F.col("sides"))).otherwise(F.array("seq"))
    return found.select("ring", F.explode(both).alias("seq"), "row", "col", "area")


def with_parents(found: DataFrame) -> DataFrame:
    """``(ring, area, parent)``: for each hole the outline of the cells around it, NULL for outlines.

    Along each row of cells the upright sides come in pairs, left and right of a run of valid cells;
    the rings of a pair bound the same region, and so do all rings that pairs connect.
    """
    totals = checkpointed(found.groupBy("ring").agg(F.first("area").alias("area")))
    nxt = found.select("ring", (F.col("seq") - 1).alias("seq"), F.col("row").alias("r1"), F.col("col").alias("c1"))
    upright = found.join(nxt, ["ring", "seq"]).where("col = c1").select("ring", F.least("row", "r1").alias("row"), "col", (F.col("r1") < F.col("row")).alias("left"))
    pairs = upright.select("ring", "left", F.lead("ring").over(Window.partitionBy("row").orderBy("col")).alias("other"))
    links = pairs.where("left AND ring <> other").select(F.col("ring").alias("src"), F.col("other").alias("dst")).distinct()
    region = connected_components(links, SMALL_EDGES).withColumnRenamed("node", "ring")
    outer = region.join(totals.where("area > 0"), "ring").select("component", F.col("ring").alias("parent"))
    parent = region.join(totals.where("area < 0").select("ring"), "ring").join(outer, "component").select("ring", "parent")
    return totals.join(parent, "ring", "left").select("ring", "area", "parent")


def polygon_pieces(grid: DataFrame, x0: float = 0.0, y0: float = 0.0, dx: float = 1.0, dy: float = 1.0, tile: int = TILE, piece: int = PIECE) -> DataFrame:
    """``(id, type, area, holes, hole, ring, piece, text)``: one polygon for each outline, its holes as inner rings.

    Polygons are numbered from 1 by place.  The texts of a polygon in the order of ``hole``, ``ring``
    and ``piece`` are its WKT: the outline, then the holes by place; no text has more than ``piece``
    corners.
    """
    found = materialise(rings(grid, tile), "outline-rings")
    about = with_parents(found).withColumn("outer", F.coalesce("parent", "ring"))
    hole = F.col("area") < 0
    polygon = about.groupBy("outer").agg(F.sum("area").alias("area"), (F.count("*") - 1).alias("holes"), F.max(F.when(hole, F.col("ring"))).alias("last_hole"))
    # Ring numbers grow with their first corner's row: a sum over rows, and over blocks of rows before them.
    row = F.shiftrightunsigned("outer", 33)
    per = polygon.groupBy(row.alias("row")).agg(F.count("*").alias("n")).withColumn("block", F.shiftright("row", 12))
    up = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = per.groupBy("block").agg(F.sum("n").alias("n")).select("block", up(Window.orderBy("block")).alias("blocks_before"))  # a row for each 4096 of the grid
    per = per.select("row", "block", up(Window.partitionBy("block").orderBy("row")).alias("rows_before")).join(blocks, "block")
    inside = F.row_number().over(Window.partitionBy("row").orderBy("outer"))
    polygon = polygon.withColumn("row", row).withColumn("k", inside).join(per, "row").select("outer", "area", "holes", "last_hole", (F.col("blocks_before") + F.col("rows_before") + F.col("k")).alias("id"))
    order = about.select("ring", "outer", hole.alias("hole")).join(polygon, "outer")
    pair = lambda p: F.concat_ws(" ", (F.lit(float(x0)) + p["col"] * float(dx)).cast("string"), (F.lit(float(y0)) + p["row"] * float(dy)).cast("string"))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "row", "col"))), pair), ", ")
    text = found.groupBy("ring", F.floor(F.col("seq") / piece).alias("piece")).agg(path.alias("text"), F.max("seq").alias("last"))
    ends = found.groupBy("ring").agg(F.max("seq").alias("sides"))
    joined = text.join(ends, "ring").join(order, "ring")
    opening = F.when(F.col("piece") > 0, ", ").when(F.col("hole"), ", (").otherwise("POLYGON ((")
    final = F.when(F.col("holes") == 0, True).otherwise(F.col("ring") == F.col("last_hole"))
    closing = F.when(F.col("last") < F.col("sides"), "").when(final, "))").otherwise(")")
    return joined.select("id", F.lit("Multipolygon boundary").alias("type"), "area", "holes", "hole", "ring", "piece", F.concat(opening, "text", closing).alias("text"))


def polygons(grid: DataFrame, x0: float = 0.0, y0: float = 0.0, dx: float = 1.0, dy: float = 1.0, tile: int = TILE) -> DataFrame:
    """``(id, type, area, holes, wkt)``: the pieces of each polygon as one text, which must fit in memory."""
    pieces = polygon_pieces(grid, x0, y0, dx, dy, tile)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hole", "ring", "piece", "text"))), lambda p: p["text"]), "")
    return pieces.groupBy("id", "type", "area", "holes").agg(text.alias("wkt"))
