"""SimHash near-duplicate groups by a grid join over segment popcounts.

A 64-bit fingerprint is embedded as the popcounts of its two-bit segments.  One differing
bit moves one popcount by one, so the Manhattan distance of two embeddings is a lower bound
of the fingerprints' Hamming distance.  With at most three differing bits, one of the two
32-bit halves has a Manhattan distance of at most one: every fingerprint stands in one grid
cell per half (its 16 popcounts there) and looks into that cell and those one step away.
Pairs that meet are verified on the exact bits.

Cells that hold many fingerprints (thousands of variants of one text) are first contracted:
two fingerprints that share a one-bit neighbour differ in at most two bits, so each such hub
links its fingerprints to the smallest of them, and the grid join only has to report pairs
that still lie in different classes.  No link between classes is lost, and no dense group is
expanded into all its pairs.

Nulls: a null text counts as empty, an empty text has fingerprint zero and is linked like
any other.  Rows with a null id get a fingerprint and a component, but never name one
(a component of null ids only is null).  Repeated rows and equal texts share a component.
Texts of any length are
read whole; ties between rows go to the smaller id.  An empty table gives an empty result; other
columns of the input, whatever their names, are not looked at, and :func:`keep_one` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.columns import free
from gridloom.operators.graph import connected_components
from gridloom.plans.scratch import materialise, shuffled

SHINGLE_WORDS = 3
MAX_BITS = 3
#: A cell with more fingerprints than this is contracted before the join.
DENSE_CELL = 64
#: Fingerprints of more than one in this many rows are looked up by broadcast, so fewer than this many.
HOT_SHARE = 10_000
_BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned SimHash of the word shingles, repeats included; 0 for a text without words."""
    if not text:
        return 0
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII blanks only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        h = [digest(joined[a:b], 42) for a, b in zip(starts[at : min(n, at + _BLOCK)].tolist(), last[at : at + _BLOCK].tolist())]
        bits = np.unpackbits(np.array(h, dtype=">u8").view(np.uint8)).reshape(-1, 64)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def of_hashes(h: np.ndarray) -> int:
    """Unsigned SimHash of shingle hashes; 0 for none."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), _BLOCK):
        votes += np.unpackbits(h[at : at + _BLOCK].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(h)).tobytes(), "big")


def simhash_of(text_col: str, words: int = SHINGLE_WORDS) -> Column:
    """Column expression: the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return simhash(F.col(text_col))


def _halves(fps: DataFrame) -> DataFrame:
    """One row per half, with the packed popcounts (two bits each) of its 16 segments."""
    hi, lo = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    pop = lambda x: x - F.shiftright(x, 1).bitwiseAND(F.lit(0x55555555))
    side = F.explode(F.array(F.struct(F.lit(0).alias("half"), pop(hi).alias("cell")), F.struct(F.lit(1).alias("half"), pop(lo).alias("cell"))))
    return fps.select("*", side.alias("s")).select(*fps.columns, "s.half", "s.cell")


def _around(cells: DataFrame) -> DataFrame:
    """The cell itself and all cells at Manhattan distance one."""
    step = lambda i: F.shiftright(F.col("cell"), 2 * i).bitwiseAND(F.lit(3))
    near = [F.array("cell")]
    for i in range(16):
        near.append(F.when(step(i) < 2, F.array(F.col("cell") + F.lit(1 << 2 * i))).otherwise(F.array().cast("array<bigint>")))
        near.append(F.when(step(i) > 0, F.array(F.col("cell") - F.lit(1 << 2 * i))).otherwise(F.array().cast("array<bigint>")))
    rest = [c for c in cells.columns if c != "cell"]
    return cells.select(*rest, F.explode(F.concat(*near)).alias("cell"))


def _hub_links(fps: DataFrame) -> DataFrame:
    """Links that join all fingerprints at distance two or less, by way of their one-bit neighbours."""
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)]
    hubs = fps.select("fp", F.explode(F.array(*flips)).alias("hub"))
    least = hubs.groupBy("hub").agg(F.min("fp").alias("dst"), F.max("fp").alias("top")).where("dst <> top").select("hub", "dst")
    return shuffled(hubs).join(shuffled(least), "hub").where("fp <> dst").select(F.col("fp").alias("src"), "dst").distinct()


def link_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS, dense: int = DENSE_CELL, small: int = 0) -> DataFrame:
    """``fps(fp)`` distinct -> ``(src, dst)`` links whose components are those of 'at most ``max_bits`` bits differ'; ``small`` as for ``connected_components``."""
    if not 2 <= max_bits <= 3:
        raise ValueError("the two-half grid covers 2 or 3 differing bits")
    cells = _halves(fps.select("fp"))
    crowded = cells.groupBy("half", "cell").agg(F.count("*").alias("n")).where(F.col("n") > dense)
    hubs = materialise(_hub_links(cells.join(crowded, ["half", "cell"], "left_semi").select("fp").distinct()), "hub-links")
    classes = connected_components(hubs, small).select(F.col("node").alias("fp"), F.col("component").alias("cls"))
    known = _halves(fps.join(classes, "fp", "left").select("fp", F.coalesce("cls", "fp").alias("cls")))
    a = known.select("half", "cell", F.col("fp").alias("src"), F.col("cls").alias("ca"))
    b = _around(known).select("half", "cell", F.col("fp").alias("dst"), F.col("cls").alias("cb"))
    met = (F.col("src") < F.col("dst")) & (F.col("ca") != F.col("cb")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_bits)
    return shuffled(a).join(shuffled(b), ["half", "cell"]).where(met).select("src", "dst").union(hubs)


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple:
    """Non-null values that rows share only if their ids and texts are equal."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, max_bits: int) -> DataFrame:
    """``(id, k, th, fp, component_id)`` for each row."""
    k, th = _row_key(docs, id_col, text_col)
    keyed = docs.select(F.col(id_col).alias("id"), k.alias("k"), th.alias("th"), F.col(text_col).alias("text"))
    marked = materialise(keyed.select("id", "k", "th", simhash_of("text", words).alias("fp")), "fingerprints")
    fps = materialise(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows")), "fingerprint-counts")
    groups = connected_components(link_fingerprints(fps, max_bits)).withColumnRenamed("node", "fp")
    named = fps.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    lookup = materialise(named.join(least, "component").select("fp", "component", "component_id", "rows"), "fingerprint-groups")
    # Fingerprints of a large share of the rows meet them by broadcast, fewer than HOT_SHARE whatever the data.
    total = lookup.agg(F.sum("rows")).first()[0] or 0
    is_hot = F.col("rows") * HOT_SHARE > total
    hot, rest = F.broadcast(lookup.where(is_hot).drop("rows")), lookup.where(~is_hot).drop("rows")
    return marked.join(hot, "fp").unionByName(marked.join(hot, "fp", "left_anti").join(rest, "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``(<id_col>, fingerprint, component_id)``: 16 hex digits, and the smallest id reachable over links."""
    rows = _grouped(docs, id_col, text_col, words, max_bits)
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def take_rows(docs: DataFrame, best: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``best(k, th)`` names, each once."""
    names = free(docs, "_k", "_th")
    k, th = _row_key(docs, id_col, text_col)
    # The join leaves rows dealt by key and hash, so dropping repeats needs no further shuffle.
    kept = docs.withColumns(dict(zip(names, (k, th)))).join(best.toDF(*names), names)
    return kept.dropDuplicates(names).select(*docs.columns)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row left of every near-duplicate group: that with the smallest id.

    A null id counts as larger than any other; rows that tie are settled by their text's
    hash, and of repeated rows (same id and text) one stays.
    """
    rows = _grouped(docs, id_col, text_col, words, max_bits)
    first = F.struct(F.col("id").isNull().alias("none"), "id", "th", "k")
    best = rows.groupBy("component").agg(F.min(first).alias("b")).select(F.col("b.k").alias("k"), F.col("b.th").alias("th"))
    return take_rows(docs, best, id_col, text_col)
