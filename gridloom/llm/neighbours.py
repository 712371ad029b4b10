"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a vector to the cell of ``FUNCTIONS`` Gaussian projections of
width ``WIDTH`` (times the data's scale, fitted on a bounded sample).  A query visits its own
cell and the perturbed cells of each table in the order in which they are most likely to hold
neighbours: by the summed squared distance to the cell walls that have to be crossed.  All
rows are indexed; the candidates of all visited cells are ranked by exact distance.

Cells are split into blocks of bounded size and so are the queries that visit one cell, so a
hot cell never meets in one task; each block returns the best few of its candidates for each
query, not its pairs.  Equal vectors are one entry that carries their ``k + 1`` smallest ids,
which is all that any answer can hold of them, so a large group of copies costs one entry.
A query that finds fewer than ``k`` candidates is compared with all rows, in blocks.

Take no part: rows with a null id or a vector that is null, empty, zero, holds a null or a
non-finite component, or differs in dimension from the most common one (the smaller of
equals).  Repeated rows count once.  Ties in distance go to the smaller id.  An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.plans.scratch import materialise, shuffled

TABLES, FUNCTIONS, WIDTH, PROBES = 2, 6, 2.0, 220
SAMPLE_ROWS = 2_000
BLOCK_ROWS, BLOCK_QUERIES = 2_048, 1_024
#: Most cells, visited ones that hold rows, whose blocks are sent to every task.
BROADCAST_CELLS = 100_000
SEED = 20_240_101


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Distinct ``(id, vec array<double>)`` that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    v = v.where("id IS NOT NULL AND vec IS NOT NULL").where(fine)
    sizes = v.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return v.where(F.size("vec") == (sizes[0]["d"] if sizes else 0))


def entries(rows: DataFrame, k: int) -> DataFrame:
    """``(key, vec, ids)``: one row for each distinct vector, with its ``k + 1`` smallest ids."""
    first = Window.partitionBy("vec").orderBy("id")
    few = rows.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= k + 1).groupBy("vec", "id").agg(F.min("r").alias("r"))
    one = few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return one.select(F.concat_ws(":", F.element_at("ids", 1).cast("string"), F.hex(F.xxhash64("vec"))).alias("key"), "vec", "ids")


class Hashes:
    """The projections of all tables, drawn from a fixed seed."""

    def __init__(self, dim: int, scale: float, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH):
        rnd = np.random.default_rng(SEED)
        self.a = rnd.standard_normal((tables, functions, dim))
        self.b = rnd.uniform(0, 1, (tables, functions))
        self.width = width * scale

    def places(self, x: np.ndarray, table: int) -> np.ndarray:
        """Positions in units of cells."""
        return x @ self.a[table].T / self.width + self.b[table]


def cell_key(cell: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(np.ascontiguousarray(cell, dtype=np.int64).tobytes()) - (1 << 63)


def perturbations(inside: np.ndarray, probes: int) -> Iterator[list[tuple[int, int]]]:
    """Sets of (function, step) in order of the squared distance to the walls they cross, the empty set first."""
    walls = sorted([(float(x) ** 2, i, -1) for i, x in enumerate(inside)] + [(float(1 - x) ** 2, i, 1) for i, x in enumerate(inside)])
    yield []
    heap, given = [(walls[0][0], (0,))], 1
    while heap and given < probes:
        cost, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if len({walls[c][1] for c in chosen}) == len(chosen):
            yield [walls[c][1:] for c in chosen]
            given += 1
        if last + 1 < len(walls):
            heapq.heappush(heap, (cost - walls[last][0] + walls[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + walls[last + 1][0], (*chosen, last + 1)))


def _least(rows: DataFrame, n: int) -> DataFrame:
    """The ``SAMPLE_ROWS`` vectors of least hash; ``n``, if given, is the number of ``rows``.

    Every task sends as many rows as it may hold of these.  Hashes are uniform, so those looked for lie
    in the lowest share of them, but for one sample in 10^6, and all tasks together send few more.
    """
    h, share = F.xxhash64("vec"), 1.25 * SAMPLE_ROWS / max(1, n)
    low = rows.where(h < F.lit(int(share * 2.0**64) - (1 << 63))) if n and share < 1 else rows
    return low.select("vec").orderBy(h).limit(SAMPLE_ROWS)


def _scale(rows: DataFrame) -> tuple[int, float]:
    """Dimension, and the usual distance of two vectors over the square root of two, from a bounded sample."""
    n = rows.count()
    got = _least(rows, n).collect()
    if len(got) < min(n, SAMPLE_ROWS):
        got = _least(rows, 0).collect()
    x = np.array([r["vec"] for r in got], dtype=float)
    if len(x) < 2:
        return (x.shape[1] if len(x) else 0), 1.0
    d = np.sqrt(((x[1:] - x[:-1]) ** 2).sum(axis=1))
    return x.shape[1], float(np.median(d[d > 0]) / np.sqrt(2)) if (d > 0).any() else 1.0


def _index(rows: DataFrame, hashes: Hashes) -> DataFrame:
    tables = len(hashes.a)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            v = np.stack(x["vec"].to_numpy())
            packed = [r.tobytes() for r in v]
            for t in range(tables):
                cells = np.floor(hashes.places(v, t)).astype(np.int64)
                yield pd.DataFrame({"table": t, "cell": [cell_key(c) for c in cells], "ids": x["ids"], "packed": packed})

    return rows.select("vec", "ids").mapInPandas(place, "table int, cell long, ids array<long>, packed binary")


def _visits(queries: DataFrame, hashes: Hashes, probes: int) -> DataFrame:
    tables = len(hashes.a)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for key, v in zip(x["key"], x["vec"]):
                out, v = [], np.asarray(v)
                for t in range(tables):
                    at = hashes.places(v[None], t)[0]
                    base = np.floor(at).astype(np.int64)
                    for moves in perturbations(at - base, probes):
                        cell = base.copy()
                        for i, step in moves:
                            cell[i] += step
                        out.append((key, t, cell_key(cell)))
                frame = pd.DataFrame(out, columns=["key", "table", "cell"])
                yield frame.assign(packed=v.tobytes())

    return queries.select("key", "vec").mapInPandas(visit, "key string, table int, cell long, packed binary")


def _packed(column: str) -> Column:
    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda x: np.asarray(x, dtype=np.float64).tobytes())

    return run(F.col(column))


def _best(index: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """``(key, id, score)``: the ``k + 1`` best candidates of each query over all cells it visits."""
    n = index.groupBy("table", "cell").agg(F.count("*").alias("n"))
    m = visits.groupBy("table", "cell").agg(F.count("*").alias("m"))
    parts = shuffled(n).join(shuffled(m), ["table", "cell"]).select("table", "cell", F.ceil(F.col("n") / BLOCK_ROWS).alias("nb"), F.ceil(F.col("m") / BLOCK_QUERIES).alias("qb"))
    parts = materialise(parts, "ann-cells")
    few = parts.count() <= BROADCAST_CELLS
    # Spark sizes visits as the queries they come from, so that it would broadcast them if it had the choice.
    split = lambda df: df.join(F.broadcast(parts), ["table", "cell"]) if few else shuffled(df).join(shuffled(parts), ["table", "cell"])
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c).cast("int") - 1))
    left = split(index).withColumn("block", F.pmod(F.xxhash64("ids"), "nb").cast("int")).withColumn("qblock", spread("qb"))
    right = split(visits).withColumn("qblock", F.pmod(F.xxhash64("key"), "qb").cast("int")).withColumn("block", spread("nb"))
    # Named by another value than the cell, so that rows dealt by cell are dealt anew by block.
    left, right = (x.withColumn("place", F.bitwise_not("cell")) for x in (left, right))
    by = ["table", "place", "block", "qblock"]

    def rank(cand: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(cand) and len(asked):
            x = np.frombuffer(b"".join(cand["packed"]), dtype=np.float64).reshape(len(cand), -1)
            owner = np.repeat(np.arange(len(cand)), cand["ids"].map(len))
            ids = np.concatenate(cand["ids"].to_numpy())
            for key, packed in zip(asked["key"], asked["packed"]):
                diff = x - np.frombuffer(packed, dtype=np.float64)
                d = np.sqrt((diff * diff).sum(axis=1))[owner]
                if len(d) > k + 1:  # all that tie with the last place stay in
                    near = np.nonzero(d <= np.partition(d, k)[k])[0]
                    near = near[np.lexsort((ids[near], d[near]))][: k + 1]
                else:
                    near = np.arange(len(d))
                out += zip([key] * len(near), ids[near].tolist(), d[near].tolist())
        return pd.DataFrame(out, columns=["key", "id", "score"])

    slim = lambda df, *c: df.select(*by, *c)
    pairs = slim(left, "ids", "packed").groupBy(*by).cogroup(slim(right, "key", "packed").groupBy(*by))
    found = pairs.applyInPandas(rank, "key string, id long, score double").groupBy("key", "id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("key").orderBy("score", "id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, every: int = 100, probes: int = PROBES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for rows whose id is divisible by ``every``, the ``k`` nearest found."""
    rows = materialise(usable(vectors, id_col, vec_col), "ann-rows")
    one = materialise(entries(rows, k), "ann-entries")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).distinct().join(one.select("key", "vec"), "vec")
    asked = materialise(asked.select("id", "key", "vec"), "ann-queries")
    queries = asked.select("key", "vec").dropDuplicates(["key"])
    dim, scale = _scale(one)
    hashes = Hashes(max(1, dim), scale)
    index = materialise(_index(one, hashes), "ann-index")
    best = materialise(_best(index, _visits(queries, hashes, probes), k), "ann-best")
    short = queries.join(best.groupBy("key").agg(F.count("*").alias("n")), "key", "left").where(F.coalesce("n", F.lit(0)) < k + 1)
    short = materialise(short.select("key", "vec"), "ann-short")
    if one.select("key").limit(2).count() and not short.isEmpty():
        # Too few candidates in the visited cells: these queries see every entry, in blocks of one common cell.
        everything = one.select(F.lit(-1).alias("table"), F.lit(0).cast("long").alias("cell"), "ids", _packed("vec").alias("packed"))
        rest = short.select("key", F.lit(-1).alias("table"), F.lit(0).cast("long").alias("cell"), _packed("vec").alias("packed"))
        best = best.join(short.select("key"), "key", "left_anti").unionByName(_best(everything, rest, k))
    answers = asked.select(F.col("id").alias("query_id"), "key").join(best, "key").where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = answers.groupBy("query_id", "id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
