"""Connected components of edge tables and of grid cells."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.plans.scratch import checkpointed


#: Links that one task solves; more are contracted in rounds first.
SMALL_EDGES = 200_000


def connected_components(edges: DataFrame, small: int = 0) -> DataFrame:
    """``edges(src, dst)`` -> ``(node, component)``; component is the smallest node reachable.

    Every round points each node at its smallest neighbour, follows two pointers, renames the
    edges to the nodes pointed at and drops those that have become loops.  Nodes are ordered by
    their hash meanwhile: runs of falling hashes are short in any graph, so that the edge table
    shrinks by a factor each round, whereas a path numbered from end to end would lose a few
    nodes at a time.  Self loops are kept as one-node components; an empty edge table gives an
    empty result.  Nodes may be of any ordered type; rows with nulls are ignored.  Once at most
    ``small`` different edges are left, which are counted, one task solves those instead.
    """
    hashed = lambda c: F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("id")).alias(c)
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(hashed("src"), hashed("dst"))
    e = checkpointed(e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    found = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("component", F.col("node"))
    e = e.where("src <> dst")
    left = e.count()
    if left > small:
        found = checkpointed(found)
    while left > small:
        up = e.groupBy(F.col("dst").alias("n")).agg(F.min("src").alias("p"))
        up = checkpointed(up)  # every non-minimal node -> its smallest neighbour
        hop = lambda links: links.select(F.col("n").alias("p"), F.col("p").alias("q"))
        up2 = up.join(hop(up), "p", "left").select("n", F.coalesce("q", "p").alias("p"))
        up4 = checkpointed(up2.join(hop(up2), "p", "left").select("n", F.coalesce("q", "p").alias("p")))
        to = up4.select(F.col("n").alias("component"), F.col("p"))
        found = checkpointed(found.join(to, "component", "left").select("node", F.coalesce("p", "component").alias("component")))
        a = up4.select(F.col("n").alias("src"), F.col("p").alias("ps"))
        b = up4.select(F.col("n").alias("dst"), F.col("p").alias("pd"))
        e = e.join(a, "src", "left").join(b, "dst", "left")
        e = e.select(F.coalesce("ps", "src").alias("x"), F.coalesce("pd", "dst").alias("y")).where("x <> y")
        e = checkpointed(e.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).distinct())
        left = e.count()
    if left:
        up = _roots(e).select(F.col("n").alias("component"), "p")
        found = checkpointed(found.join(up, "component", "left").select("node", F.coalesce("p", "component").alias("component")))
    least = found.groupBy("component").agg(F.min("node.id").alias("least"))
    return found.join(least, "component").select(F.col("node.id").alias("node"), F.col("least").alias("component"))


def _roots(edges: DataFrame) -> DataFrame:
    """``(n, p)``: every node of a small table and the smallest node it reaches, by one task's union-find."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches):
        number: dict = {}
        parent: list[int] = []

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        names: list = []
        for b in batches:
            for ends in zip(b["src"].tolist(), b["dst"].tolist()):
                at = []
                for x in ends:
                    key = (x["hash"], x["id"])
                    if key not in number:
                        number[key] = len(parent)
                        parent.append(len(parent))
                        names.append(key)
                    at.append(root(number[key]))
                low, high = (at[0], at[1]) if names[at[0]] <= names[at[1]] else (at[1], at[0])
                parent[high] = low
        shape = lambda i: {"hash": names[i][0], "id": names[i][1]}
        for at in range(0, len(parent), 10_000):
            some = range(at, min(at + 10_000, len(parent)))
            yield pd.DataFrame({"n": [shape(i) for i in some], "p": [shape(root(i)) for i in some]}, columns=["n", "p"])

    return edges.coalesce(1).mapInPandas(run, f"n {kind}, p {kind}")


def minimum_spanning_forest(edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """``edges(src, dst, weight)`` -> the ``(src, dst, weight)``, ``src < dst``, of the forest of least weight.

    Every round each part of the forest takes its lightest edge to another part and the parts so
    joined become one, which leaves at most half as many.  Equal weights are told apart by their
    nodes, so that the forest is the only one of least weight in that order.  Loops, rows with nulls
    and heavier copies of an edge are left out; an empty table gives an empty forest.  Parts are
    joined by ``connected_components``, which solves at most ``small`` edges in one task.
    """
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL AND weight IS NOT NULL AND src <> dst")
    e = e.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("weight").alias("weight"))
    e = checkpointed(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("weight", "src", "dst").alias("edge")))
    forest = e.select("edge.src", "edge.dst", "edge.weight").limit(0)
    while not e.isEmpty():
        ends = e.select("a", "b", "edge").union(e.select(F.col("b"), F.col("a"), F.col("edge")))
        taken = ends.groupBy("a").agg(F.min(F.struct("edge", "b")).alias("t"))
        taken = checkpointed(taken.select("a", F.col("t.b").alias("b"), F.col("t.edge").alias("edge")))
        forest = checkpointed(forest.union(taken.select("edge.src", "edge.dst", "edge.weight").distinct()))
        part = checkpointed(connected_components(taken.select(F.col("a").alias("src"), F.col("b").alias("dst")), small))
        for end in "ab":
            e = e.join(part.select(F.col("node").alias(end), F.col("component").alias(f"p{end}")), end, "left")
        e = e.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"), "edge").where("a <> b")
        # Of all edges between the same two parts only the lightest can be taken.
        e = checkpointed(e.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("edge").alias("edge")))
    return forest


def forest_paths(forest: DataFrame) -> DataFrame:
    """``forest(src, dst)`` -> ``(start, stop, seq, src, dst)``: its edges along paths between ends and branches.

    A path's inner nodes have two edges, its ends have one or several; ``start < stop`` name it, as no
    two paths of a forest share both.  ``seq`` counts its edges from 0, each pointing from ``src`` to
    ``dst`` towards ``stop``.  Each way of an edge looks twice as far along the path in every round.
    The edges must not hold a cycle; for such the rounds would not end, so they stop with an error.
    """
    ways = forest.select("src", "dst").union(forest.select(F.col("dst"), F.col("src")))
    nodes = ways.groupBy("src").agg(F.count("*").alias("degree")).withColumnRenamed("src", "node")
    onward = ways.select(F.col("src").alias("dst"), F.col("dst").alias("then"))
    inner = nodes.where("degree = 2").select(F.col("node").alias("dst"))
    ahead = ways.join(inner, "dst").join(onward, "dst").where("then <> src").select("src", "dst", F.struct(F.col("dst").alias("s"), F.col("then").alias("d")).alias("next"))
    way = F.struct(F.col("src").alias("s"), F.col("dst").alias("d")).alias("way")
    last = F.coalesce("next", F.struct(F.col("src").alias("s"), F.col("dst").alias("d"))).alias("last")
    state = ways.join(ahead, ["src", "dst"], "left").select(way, last, F.col("next").isNotNull().cast("long").alias("hops"), F.col("next").isNull().alias("done"))
    state = checkpointed(state)
    most, rounds = state.count(), 0
    while not state.where("NOT done").isEmpty():
        if 1 << rounds > most:
            raise ValueError("the edges hold a cycle")
        rounds += 1
        far = state.select(F.col("way").alias("last"), F.col("last").alias("beyond"), F.col("hops").alias("more"), F.col("done").alias("ended"))
        open_ = state.where("NOT done").join(far, "last").select("way", F.col("beyond").alias("last"), (F.col("hops") + F.col("more")).alias("hops"), F.col("ended").alias("done"))
        state = checkpointed(state.where("done").unionByName(open_))
    back = state.select(F.struct(F.col("way.d").alias("s"), F.col("way.s").alias("d")).alias("way"), F.col("last.d").alias("start"), F.col("hops").alias("seq"))
    both = state.select("way", F.col("last.d").alias("stop")).join(back, "way").where("start < stop")
    return both.select("start", "stop", "seq", F.col("way.s").alias("src"), F.col("way.d").alias("dst"))


def grid_components(active: DataFrame, offsets: list[tuple[int, int]], link: Column | None = None) -> DataFrame:
    """``active(row, col, ..)`` with ``component`` (smallest member as row * 2^31 + col) and ``size``.

    Two cells are linked if one of ``offsets`` leads from one to the other and ``link``, a
    condition over the columns of ``a`` and ``b``, holds.
    """
    node = lambda r, c: F.col(r).cast("long") * (1 << 31) + F.col(c)
    half = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in offsets if (r, c) > (0, 0)])
    a = active.select("*", F.explode(half).alias("o")).withColumn("br", F.col("row") + F.col("o.dr")).withColumn("bc", F.col("col") + F.col("o.dc")).alias("a")
    b = active.alias("b")
    met = a.join(b, (F.col("a.br") == F.col("b.row")) & (F.col("a.bc") == F.col("b.col")))
    met = met if link is None else met.where(link)
    edges = met.select(node("a.row", "a.col").alias("src"), node("b.row", "b.col").alias("dst"))
    loops = active.select(node("row", "col").alias("src"), node("row", "col").alias("dst"))
    found = connected_components(edges.union(loops), SMALL_EDGES)
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    named = active.withColumn("node", node("row", "col")).join(found, "node").join(sizes, "component")
    return named.select(*active.columns, "component", "size")


def disk_offsets(radius: int) -> list[tuple[int, int]]:
    r = range(-radius, radius + 1)
    return [(a, b) for a in r for b in r if 0 < a * a + b * b <= radius * radius]
