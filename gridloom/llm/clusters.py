"""Centroid clustering with bounds from the norm of a sum of moves.

Every vector keeps, for each centroid, the squared distance at which it last measured it and the
round of that measurement.  All centroids of all rounds are kept (``k`` times rounds vectors), so
that a later round bounds a distance by the old one and the length of the centroid's *total*
displacement since then, which is never more than the summed lengths of its single moves.  A
vector whose own centroid stays strictly nearer than the lower bounds of all others is not measured
at all; otherwise its own distance is measured, and then only the centroids whose lower bound does
not exceed it.  Measurements are exact in integers; the bounds allow for rounding, so that ties and
near ties are always measured.

The state of a round is a table of one row per vector, changed in place of no key: no shuffle.
Between rounds only ``k`` sums per partition travel.  Bounded by parameters: centroids (``k`` times
``dims`` numbers a round) pass the driver and go to every task.

Vectors that are null, of another length or hold null or non-finite components take no part.
Components become ``floor(scale * x)``, held within ``LIMIT`` either way so that squared distances
fit a long.  Ties go to the smaller number.  Rows are clustered one by one: repeated rows and ids each
have their result; a null id has one too, and comes last among starting vectors.  Repeated ids tie as starting
vectors, the smaller components first.  Fewer vectors than ``k``: as many centroids.  An empty table
gives an empty result.  Sums of distances beyond a long are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.plans.scratch import discard, materialise

#: Integer components are held within this, so that 64 squared differences fit a long.
LIMIT = 2**27
#: Below this, products of 64 components are exact in double precision.
_EXACT = 2**21
_SLACK = 1e-9


def _components(vec_col: str, dims: int, scale: int) -> tuple[Column, Column]:
    """(whether the vector takes part, its integers)."""
    good = (F.size(vec_col) == dims) & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    value = lambda x: F.least(F.greatest(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int")
    return F.coalesce(good, F.lit(False)), F.transform(vec_col, value)


def integer_vectors(vectors: DataFrame, dims: int = 64, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, x array<int>)`` of the vectors that take part."""
    good, x = _components(vec_col, dims, scale)
    return vectors.where(good).select(F.col(id_col).alias("id"), x.alias("x"))


def starts(vectors: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of ``<seed>:<id>``, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(h.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return np.array([r.x for r in rows], dtype=np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all rows of ``c``."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < _EXACT:
        f, g = x.astype(np.float64), c.astype(np.float64)
        return ((f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def moves(history: np.ndarray) -> np.ndarray:
    """``[j, t]``: length of centroid j's displacement from round t until the last one."""
    diff = (history[-1][None] - history).astype(np.float64)
    return np.sqrt((diff * diff).sum(2)).T


def reassign(x: np.ndarray, cluster: np.ndarray, dist: np.ndarray, when: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroids of the last round and how many distances each row measured; ``dist`` and ``when`` are updated."""
    now, n, k = len(history) - 1, *dist.shape
    rows, moved = np.arange(n), moves(history)
    root, off = np.sqrt(dist.astype(np.float64)), moved[np.arange(k)[None, :], when]
    low = root - off
    others = np.arange(k)[None, :] != cluster[:, None]
    upper = root[rows, cluster] + off[rows, cluster]
    slack = _SLACK * (1.0 + upper + off.max(axis=1, initial=0.0))
    failed = np.flatnonzero(((low <= (upper + slack)[:, None]) & others).any(axis=1))
    measured = np.zeros(n, dtype=np.int32)
    if not len(failed):
        return cluster, measured
    last = history[-1]
    own = cluster[failed]
    d = ((x[failed] - last[own]) ** 2).sum(1)
    dist[failed, own], when[failed, own] = d, now
    near = (low[failed] <= (np.sqrt(d.astype(np.float64)) + slack[failed])[:, None]) & others[failed]
    r, j = np.nonzero(near)
    at = failed[r]
    dist[at, j], when[at, j] = ((x[at] - last[j]) ** 2).sum(1), now
    measured[failed] = 1 + near.sum(axis=1)
    near[np.arange(len(failed)), own] = True
    cluster = cluster.copy()
    cluster[failed] = np.where(near, dist[failed], np.iinfo(np.int64).max).argmin(axis=1)  # the first of equals
    return cluster, measured


_STATE = "x array<int>, cluster int, dist array<long>, seen array<tinyint>, measured int"


def _matrix(column: pd.Series, kind) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(kind)


def _assign(rows: DataFrame, history: np.ndarray) -> DataFrame:
    """The state after assigning every vector to the last centroids of ``history``."""
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {_STATE}"
    first = len(history) == 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b["x"], np.int64)
            if first:
                dist = squared(x, history[-1])
                cluster, when, measured = dist.argmin(axis=1), np.zeros(dist.shape, np.int64), np.full(len(b), dist.shape[1])
            else:
                dist, when = _matrix(b["dist"], np.int64), _matrix(b["seen"], np.int64)
                cluster, measured = reassign(x, b["cluster"].to_numpy().astype(np.int64), dist, when, history)
            yield pd.DataFrame({"id": b["id"], "x": b["x"], "cluster": cluster.astype(np.int32), "dist": list(dist), "seen": list(when.astype(np.int8)), "measured": measured.astype(np.int32)})

    return rows.mapInPandas(run, schema)


def _means(state: DataFrame, last: np.ndarray) -> np.ndarray:
    """Componentwise floor of the means of the clusters; empty ones stay."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[i].cast("long")) for i in range(last.shape[1])]).alias("s")).collect()
    out = last.copy()
    for r in sums:
        out[r.cluster] = [s // r.n for s in r.s]
    return out


def kmeans(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(state of the ``(id, x)`` rows after ``rounds`` rounds and one more assignment, centroids of every round).

    At most 127 rounds.
    """
    history = starts(vectors, k, seed)[None]
    state = vectors
    for r in range(rounds + 1):
        new = materialise(_assign(state, history), f"clusters-{r}")
        if r:
            discard(state)
        state = new
        if r < rounds:
            history = np.concatenate([history, _means(state, history[-1])[None]])
    return state, history


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(<id_col>, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every vector that takes part."""
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, dims, scale, id_col, vec_col)
    result = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if rows.isEmpty():
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256")).limit(0)
    state, history = kmeans(rows, k, rounds, seed)
    last = [list(map(int, c)) for c in history[-1]]
    distance = F.aggregate(F.zip_with("x", "c", lambda a, b: (a.cast("long") - b) * (a.cast("long") - b)), F.lit(0).cast("long"), lambda s, d: s + d)
    table = spark.createDataFrame([(j, c) for j, c in enumerate(last)], "cluster int, c array<long>")
    done = state.select("id", "cluster", "x").join(F.broadcast(table), "cluster").select("id", "cluster", distance.alias("distance"))
    sums = {r.cluster: r.s for r in done.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    whole = None if None in sums.values() or sum(sums.values()) >= 2**63 else sum(sums.values())
    facts = [(j, sums.get(j, 0), whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(last)]
    return done.join(F.broadcast(spark.createDataFrame(facts, result)), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 16, rounds: int = 3) -> str:
    sql = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(CAST(e AS DOUBLE)))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, x
  FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h LIMIT {k})),"""
    for r in range(rounds + 1):
        sql += f"""
a{r} AS MATERIALIZED (SELECT vec_id, x, best.c AS cluster, best.d AS distance FROM (
  SELECT v.vec_id, any_value(v.x) AS x, min({{'d': CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'c': c.cluster}}) AS best
  FROM v, c{r} c GROUP BY v.vec_id)),"""
        if r < rounds:
            sql += f"""
m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
  SELECT cluster, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.cluster),"""
    return sql.rstrip(",") + f"""
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""


ORACLE_SQL = _oracle()
