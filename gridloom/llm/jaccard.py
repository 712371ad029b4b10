"""Near-duplicate groups by five-word Jaccard similarity, confirmed on the exact shingle sets.

Texts are sets of hashed word shingles; equal sets are one node.  Nodes whose SimHash fingerprints
differ in at most three bits meet first, by the grid join over segment popcounts of
:mod:`gridloom.llm.simhash`, and are linked if their exact sets agree.  Pairs at 0.8 may differ in
more bits, so what is left meets by minimum hashes: ``BANDS`` bands of ``ROWS``
minimum hashes each name the keys under which nodes meet: two sets of similarity 0.8 share none
of them with a probability of (1 - 0.8^5)^32 = 3e-6.  Pairs that meet are dropped by their sizes
or by 128 one-bit minima that differ in more than ``MOST_BITS`` (0.8 gives 12.8 on average,
standard deviation 3.4), and all others are decided on their exact sets.

Keys that many nodes share are not expanded into all pairs.  In ``STAR_ROUNDS`` rounds every node
is compared with one leading node of its keys, of another class than its own, in the first round
the one that shares keys with most others; that joins groups of copies however large they are.  What is left in keys of several classes goes through a prefix
join on the exact sets: only nodes that share one of their rarest shingles meet, and only where
enough shingles follow it in both, which loses no pair of similarity 0.8.  Shingles held by the same
nodes count as one there, so that a pair of long texts does not meet once for each of them.

Nulls: a null text counts as empty; texts without words are one group.  A text shorter than a
shingle is one shingle.  An empty table gives an empty result; other columns pass through,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.llm import simhash
from gridloom.operators.graph import SMALL_EDGES, connected_components
from gridloom.plans.scratch import materialise, shuffled

SHINGLE_WORDS = 5
BANDS, ROWS = 32, 5
#: Most differing bits of two sketches whose pair is still decided on the exact sets.
MOST_BITS = 34
#: Rounds in which nodes are tried against leading nodes of their bands, before all pairs that may still be missing are.
STAR_ROUNDS = 3
#: Ratio of the sizes between which nodes are told apart before they meet.
SIZE_STEP = 1.02
#: Earlier lists of a node that are looked at to tell whether a pair has met before; where more come first, it may be reported again.
EARLIER_LISTS = 16
#: Most texts whose keys are sent to every task when their sets are needed.
BROADCAST_TEXTS = 100_000
_BLOCK = 1 << 9
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(8).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.array([], dtype=np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), last.tolist())), np.uint64, len(last)))


def sketch(h: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(a key for each band, two words of one-bit minima) of a shingle set."""
    if not len(h):
        return np.array([], dtype=np.int64), 0, 0
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), _BLOCK):
        np.minimum(least, (_FACTORS[:, None] * h[None, at : at + _BLOCK]).min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ (key >> np.uint64(29))) * _MIX + row
    key = (key ^ (key >> np.uint64(32))) * _MIX
    s = np.packbits((least[:128] >> np.uint64(17) & np.uint64(1)).astype(np.uint8)).view(np.int64)
    return key.view(np.int64), int(s[0]), int(s[1])


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(node, n, fp, bands, s0, s1, first)`` of the distinct shingle sets; ``first`` names the row to keep."""

    @F.pandas_udf("node long, n int, fp long, bands array<long>, s0 long, s1 long")
    def mark(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for h in map(shingles, texts):
                rows.append((int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 7)).view(np.int64)), len(h), int(np.uint64(simhash.of_hashes(h)).view(np.int64)), *sketch(h)))
            yield pd.DataFrame(rows, columns=["node", "n", "fp", "bands", "s0", "s1"])

    k, th = simhash._row_key(docs, id_col, text_col)
    first = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), th.alias("th"), k.alias("k")).alias("first")
    marked = docs.select(first, mark(F.col(text_col)).alias("m")).select("first", "m.*")
    same = [F.first(c).alias(c) for c in ("n", "fp", "bands", "s0", "s1")]
    return materialise(marked.groupBy("node").agg(*same, F.min("first").alias("first")), "shingle-sets")


def _can_be_near(a: str, b: str):
    """Sizes and sketches of two nodes leave room for a similarity of 0.8."""
    c = lambda x: F.col(x).cast("long")
    bits = sum(F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in ("s0", "s1"))
    return (c(f"{a}n") * 5 >= c(f"{b}n") * 4) & (c(f"{b}n") * 5 >= c(f"{a}n") * 4) & (bits <= MOST_BITS)


def _sets(asked: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written table ``(node, n, s0, s1, set)`` of the exact shingle sets of ``asked(node)``, read from one text of each."""

    @F.pandas_udf("array<long>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t).view(np.int64) for t in texts], dtype=object)

    wanted = materialise(nodes.join(asked, "node").select("node", "n", "s0", "s1", F.col("first.k").alias("_k"), F.col("first.th").alias("_th")), "asked-texts")
    k, th = simhash._row_key(docs, id_col, text_col)
    texts = docs.select(k.alias("_k"), th.alias("_th"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted, ["_k", "_th"])
    return materialise(texts.dropDuplicates(["node"]).select("node", "n", "s0", "s1", hashes("text").alias("set")), "asked-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those rows of ``pairs(src, dst, ..)`` whose exact similarity is at least 0.8."""
    a, b = (sets.select(F.col("node").alias(c), F.col("set").alias(s)) for c, s in (("src", "a"), ("dst", "b")))
    # i / (na + nb - i) >= 4 / 5 in whole numbers
    near = F.size(F.array_intersect("a", "b")) * 9 >= (F.size("a") + F.size("b")) * 4
    return pairs.join(a, "src").join(b, "dst").where(near).select(*pairs.columns)


def _mixed(known: DataFrame) -> DataFrame:
    """The rows ``(key, node, cls)`` of the bands that hold more than one class."""
    some = known.groupBy("key").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("key")
    return shuffled(known).join(shuffled(some), "key")


def _hub_pairs(known: DataFrame, order: Column) -> DataFrame:
    """``(src, dst, dst_cls)``: every node with one node of another class that leads one of its bands, the least by ``order``."""
    rank = F.struct(order.alias("h"), "node", "cls")
    hubs = known.groupBy("key").agg(F.min(rank).alias("hub"), F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("key", "hub")
    ends = shuffled(known).join(shuffled(hubs), "key").where("cls <> hub.cls").groupBy("node").agg(F.min("hub").alias("hub"))
    return ends.select(F.col("node").alias("src"), F.col("hub.node").alias("dst"), F.col("hub.cls").alias("dst_cls"))


def _lists(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """``(p0, p1, node, cls, n, s0, s1, rest, before)``: the lists of nodes under the shingles of each node.

    A list is all nodes of ``mixed`` that hold a shingle, named by ``p0, p1``; shingles with the
    same list count as one, lists of one class are left out.  Rare ones first, ``rest`` is how
    many shingles of the node lie in this list or a later one, ``before`` names the first of its
    earlier lists.
    """
    nodes = mixed.groupBy("node").agg(F.first("cls").alias("cls"))
    about = sets.join(nodes, "node")
    tokens = about.select("node", "cls", F.explode("set").alias("t"))
    named = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"p{i}") for i in (0, 1)]
    held = tokens.groupBy("t").agg(F.count("*").alias("df"), *named, F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b")
    lists = tokens.join(held.select("t", "df", "p0", "p1"), "t").groupBy("node", "df", "p0", "p1").agg(F.count("*").alias("k"))
    at = Window.partitionBy("node").orderBy("df", "p0", "p1")
    lists = lists.withColumn("at", F.row_number().over(at))
    lists = lists.withColumn("rest", F.sum("k").over(at.rowsBetween(0, Window.unboundedFollowing)))
    first = F.collect_list(F.when(F.col("at") <= EARLIER_LISTS, F.col("p0"))).over(at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lists = lists.select("node", "p0", "p1", "rest", F.slice(first, 1, F.col("at") - 1).alias("before"))
    about = about.select("node", "cls", F.col("n").cast("long").alias("n"), "s0", "s1")
    # Any partner has at least 4 / 5 of the node's shingles, and at most ``rest`` of them can be shared.
    return lists.join(about, "node").where("rest * 9 >= n * 4 + (n * 4 + 4) div 5 * 4")


def _prefix_meetings(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """``(src, dst)``, some of them repeated, of different classes that may reach 0.8: they share a shingle early in both.

    Two sets of ``a`` and ``b`` shingles and similarity 0.8 share at least 4 / 9 of ``a + b``.  Under
    any common order as many of each lie at or after the first that they share, which also is the
    first of its list; so they meet there if ``rest`` of both is that large.  Shingles of one class
    take up the first places without making a pair, so that variants of one text do not meet by
    what all of them hold unless few enough of their own shingles precede it.  The larger set looks
    only into steps of size that its ``rest`` leaves room for.  Where they share an early list that comes before,
    they have met there.
    """
    lists = materialise(_lists(mixed, sets), "rare-lists")
    step = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(SIZE_STEP)))
    of = lambda x, rows: rows.select("p0", "p1", "step", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "cls", "n", "s0", "s1", "rest", "before")])
    small = of("a", lists.where("rest * 9 >= n * 8").withColumn("step", step(F.col("n"))))
    least, most = F.expr("(n * 4 + 4) div 5"), F.least("n", F.expr("(rest * 9 - n * 4) div 4"))
    large = of("b", lists.withColumn("step", F.explode(F.sequence(step(least), step(most)))))
    met = shuffled(small).join(shuffled(large), ["p0", "p1", "step"])
    met = met.where("a_cls <> b_cls AND (a_n < b_n OR a_n = b_n AND a_node < b_node) AND least(a_rest, b_rest) * 9 >= (a_n + b_n) * 4 AND NOT arrays_overlap(a_before, b_before)")
    return met.where(_can_be_near("a_", "b_")).select(F.col("a_node").alias("src"), F.col("b_node").alias("dst"))


def _prefix_pairs(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """The different pairs of ``_prefix_meetings``; all of similarity 0.8 and different classes are among them but for the sketches."""
    return _prefix_meetings(mixed, sets).distinct()


def grid_pairs(nodes: DataFrame) -> DataFrame:
    """``(src, dst)`` of ``nodes(node, fp)`` whose components are those of 'at most three bits of the fingerprints differ'."""
    fps = materialise(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "set-fingerprints")
    end = lambda c: shuffled(fps.select(F.col("fp").alias(c), F.col("rep").alias(f"{c}_rep")))
    near = simhash.link_fingerprints(fps.select("fp"), small=SMALL_EDGES).join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_rep").alias("src"), F.col("dst_rep").alias("dst"))
    return near.union(nodes.join(shuffled(fps), "fp").where("node <> rep").select(F.col("node").alias("src"), F.col("rep").alias("dst")))


def _classes(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(node, cls)`` of the nodes that have links: the components of 'similarity at least 0.8'."""
    grouped = lambda links: connected_components(links, SMALL_EDGES).withColumnRenamed("component", "cls")
    rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    met = materialise(shuffled(rows).join(shuffled(shared.select("key", "size")), "key"), "shared-bands")
    named = lambda classes: met.join(classes, "node", "left").withColumn("cls", F.coalesce("cls", "node"))
    grid = materialise(grid_pairs(nodes.select("node", "fp")), "grid-pairs")
    asked = met.select("node").union(grid.select("src")).union(grid.select("dst")).distinct()
    sets = _sets(asked, nodes, docs, id_col, text_col)
    size = lambda at: sets.select(F.col("node").alias(at), *[F.col(c).alias(f"{at}_{c}") for c in ("n", "s0", "s1")])
    # In the rounds a node takes on the class of the leading node it is linked with; nodes of one class are always linked, if not the other way round.
    links = materialise(_confirmed(shuffled(grid), sets), "near-in-grid")
    # Whoever shares bands with most others lies in the middle of its variants and leads in the first round.
    known = named(grouped(links)).withColumn("reach", F.sum("size").over(Window.partitionBy("node")))
    known = materialise(known.select("key", "node", "cls", "reach"), "band-classes")
    for salt in range(STAR_ROUNDS):
        leading = _hub_pairs(known, F.xxhash64("node", F.lit(salt)) if salt else -F.col("reach"))
        pairs = leading.join(size("src"), "src").join(size("dst"), "dst")
        tried = materialise(pairs.where(_can_be_near("src_", "dst_")).select("src", "dst", "dst_cls"), "tried-pairs")
        found = materialise(_confirmed(tried, sets), "near-hubs")
        links = links.union(found.select("src", "dst"))
        if salt < STAR_ROUNDS - 1:
            moved = found.select(F.col("src").alias("node"), "dst_cls")
            known = materialise(known.join(moved, "node", "left").select("key", "node", F.coalesce("dst_cls", "cls").alias("cls")), "band-classes")
    classes = grouped(links)
    known = materialise(named(classes).select("key", "node", "cls"), "band-classes")
    rest = materialise(_prefix_pairs(materialise(_mixed(known), "mixed-bands"), sets), "other-pairs")
    return classes if rest.isEmpty() else grouped(links.union(_confirmed(shuffled(rest), sets)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row left of every group of near duplicates, chosen as ``simhash.keep_one`` does."""
    nodes = _nodes(docs, id_col, text_col)
    classes = _classes(nodes, docs, id_col, text_col)
    named = nodes.select("node", "first").join(classes, "node", "left").withColumn("cls", F.coalesce("cls", "node"))
    best = named.groupBy("cls").agg(F.min("first").alias("b"))
    return simhash.take_rows(docs, best.select(F.col("b.k").alias("k"), F.col("b.th").alias("th")), id_col, text_col)
