"""Chat formatting after cumulative-snapshot collapse, in DataFrame expressions only.

Logs often hold one conversation several times, each time with a few more turns.  Every turn
is hashed together with its place; the running sums of those hashes (four 32-bit parts, so
128 bits) identify every prefix of every conversation.  A conversation whose full hash is a
proper prefix of another one is dropped by an anti-join, of equal ones the smallest id stays,
and the rest are rendered.

Running sums are built in two levels: rows are dealt by ranges of (conversation, turn, role,
text), which no conversation and no turn number can crowd, and sums run over the ranges of a
conversation and within each.  Long conversations are rendered in parts of ``BLOCK`` turns.  So
no task ever holds one conversation of unbounded length.

Nulls: a null role counts as ``user``, a null text as empty, a null turn as 0; rows with a
null conversation id are left out.  Repeated rows count once; turns that share a number are
ordered by role, then text.  A text of any length is one
line.  An empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gridloom.plans.scratch import materialise

BLOCK = 256
START, END = "<|im_start|>", "<|im_end|>"
_PARTS = ("a", "b", "c", "d")


def numbered(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, role, text, length, a..d)``: place from 1 and the sums of hashes up to it."""
    t = turns.where("conv_id IS NOT NULL").select(
        "conv_id", F.coalesce(F.col("turn"), F.lit(0)).cast("long").alias("turn"),
        F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    t = materialise(t.repartitionByRange("conv_id", "turn", "role", "text").withColumn("block", F.spark_partition_id()), "chat-turns")
    sizes = t.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    by_block = Window.partitionBy("conv_id").orderBy("block")
    sizes = sizes.select("conv_id", "block", (F.sum("n").over(by_block) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("conv_id")).alias("length"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    placed = t.withColumn("k", F.row_number().over(inside)).join(sizes, ["conv_id", "block"])
    placed = placed.select("conv_id", "block", (F.col("before") + F.col("k")).alias("pos"), "length", "role", "text")
    h1, h2 = F.xxhash64("pos", "role", "text"), F.xxhash64(F.lit("again"), "text", "role", "pos")
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    parts = [low(h1), F.shiftrightunsigned(h1, 32), low(h2), F.shiftrightunsigned(h2, 32)]
    hashed = placed.select("*", *[p.alias(x) for p, x in zip(parts, _PARTS)])
    totals = hashed.groupBy("conv_id", "block").agg(*[F.sum(x).alias(f"t{x}") for x in _PARTS])
    totals = totals.select("conv_id", "block", *[(F.sum(f"t{x}").over(by_block) - F.col(f"t{x}")).alias(f"t{x}") for x in _PARTS])
    running = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = hashed.select("conv_id", "block", "pos", "length", "role", "text", *[F.sum(x).over(running).alias(x) for x in _PARTS])
    summed = summed.join(totals, ["conv_id", "block"])
    return summed.select("conv_id", "pos", "length", "role", "text", *[(F.col(x) + F.col(f"t{x}")).alias(x) for x in _PARTS])


def maximal(placed: DataFrame) -> DataFrame:
    """``(conv_id, length, n_copies)`` of the conversations that are no proper prefix of another, one of each."""
    key = ["pos", *_PARTS]
    whole = placed.where("pos = length").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    shorter = placed.where("pos < length").select(*key).distinct()
    return whole.join(shorter, key, "left_anti").select("conv_id", F.col("pos").alias("length"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """``(conv_id, part, n_turns, n_copies, rendered)``: maximal conversations in chat markup, parts from 0."""
    placed = materialise(numbered(turns), "chat-prefixes")
    part = lambda n: F.floor((F.col(n) - 1) / BLOCK).cast("int")
    # A row for each part of a conversation: the join, too, meets at most BLOCK turns under one key.
    whole = maximal(placed).select("conv_id", "n_copies", F.explode(F.sequence(F.lit(0), part("length"))).alias("part"))
    kept = placed.withColumn("part", part("pos")).join(whole, ["conv_id", "part"])
    line = F.concat(F.lit(START), F.col("role"), F.lit("\n"), F.col("text"), F.lit(END + "\n"))
    parts = kept.groupBy("conv_id", "part").agg(
        F.count("*").alias("n_turns"), F.max("n_copies").alias("n_copies"),
        F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"),
    )
    return parts.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))


#: The same over DuckDB: prefixes are compared turn by turn instead of by hash.
ORACLE_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, coalesce(turn, 0) AS turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM t
), c AS (
  SELECT conv_id, count(*) AS length, list(role || chr(10) || text ORDER BY pos) AS turns FROM p GROUP BY conv_id
), w AS (
  SELECT min(conv_id) AS conv_id, count(*) AS n_copies, length, turns FROM c GROUP BY length, turns
), heads AS (
  SELECT DISTINCT l.turns[1:k.k] AS turns FROM w l, (SELECT DISTINCT length AS k FROM w) k WHERE k.k < l.length
), kept AS (
  SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.turns = w.turns)
)
SELECT kept.conv_id, CAST((pos - 1) // 256 AS INTEGER) AS part, count(*) AS n_turns, max(n_copies) AS n_copies,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM kept JOIN p ON p.conv_id = kept.conv_id GROUP BY 1, 2
"""
