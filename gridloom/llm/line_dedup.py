"""Line deduplication: lines that many documents share stay in one of them only.

Texts are split at ``\\n``; a line's key is the line without blanks at its ends, A-Z in lower case.
Keys are hashed to 128 bits and their documents counted; a line whose key is long enough and
stands in enough documents is dropped, except from the document with the smallest id that holds
it.  The positions of dropped lines are gathered per document, and its text is put together from
the stretches between them.  Everything is a DataFrame expression; only hashes and positions are
shuffled by line, texts once by document.

A key that holds more than one in ``HOT_SHARE`` of all lines is marked by a broadcast join: there
are fewer than ``HOT_SHARE`` such keys whatever the size of the data.  All others meet in a
shuffled join whose crowded partitions Spark can split.

Nulls: a null text counts as empty, an empty text is one empty line.  Null ids come after all
others and count as one document: they lose what any other document holds and keep what only they
share.  Rows with the same id are one document, so that each keeps its lines where that id is the
smallest; rows with the same id and text have the same result, each a row of its own.  A very long
text becomes rows of lines; one text and the positions of its dropped lines must fit in memory.
An empty table gives an empty result.  Columns named like a result column are replaced, all
others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.columns import free
from gridloom.plans.scratch import materialise

#: The characters stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
#: Keys of more than one in this many lines are broadcast, so at most this many.
HOT_SHARE = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case, other letters as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _two(*cols: Column) -> tuple[Column, Column]:
    """128 bits of the values, as two longs."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def keyed_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, d1, d2, pos, h1, h2)`` of every line that is long enough: its document, place and hashed key."""
    d1, d2 = _two(F.col(id_col), _text(text_col))
    rows = docs.select(F.col(id_col).alias("doc"), d1.alias("d1"), d2.alias("d2"), F.posexplode(F.split(_text(text_col), "\n", -1)).alias("pos", "line"))
    rows = rows.select("doc", "d1", "d2", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    h1, h2 = _two(F.col("key"))
    return rows.select("doc", "d1", "d2", "pos", h1.alias("h1"), h2.alias("h2"))


def shared_keys(lines: DataFrame, min_docs: int = 2) -> DataFrame:
    """``(h1, h2, first_doc, n)`` of the keys in at least ``min_docs`` documents; ``n`` lines hold them."""
    if min_docs <= 2:  # two different documents: no need to see each of them
        held = lines.groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), F.count("doc").alias("named"), F.count("*").alias("n"))
        return held.where("first_doc < last_doc OR (first_doc IS NOT NULL AND named < n)").select("h1", "h2", "first_doc", "n")
    each = lines.groupBy("h1", "h2", "doc").agg(F.count("*").alias("n"))
    held = each.groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"), F.count("*").alias("docs"), F.sum("n").alias("n"))
    return held.where((F.col("docs") >= min_docs) & F.col("first_doc").isNotNull()).select("h1", "h2", "first_doc", "n")


def dropped_positions(lines: DataFrame, min_docs: int = 2) -> DataFrame:
    """``(d1, d2, dropped)`` of the documents that lose lines: their positions from 0, ascending."""
    keys = materialise(shared_keys(lines, min_docs), "shared-lines")
    n = keys.agg(F.sum("n")).first()[0] or 0  # lines with a shared key; a share of them is a share of all
    hot, rest = (keys.where(c).select("h1", "h2", "first_doc") for c in (F.col("n") * HOT_SHARE > n, F.col("n") * HOT_SHARE <= n))
    loses = F.col("doc").isNull() | (F.col("doc") > F.col("first_doc"))
    crowded = lines.join(F.broadcast(hot), ["h1", "h2"]).where(loses)
    others = lines.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti").join(rest, ["h1", "h2"]).where(loses)
    lost = crowded.select("d1", "d2", "pos").unionByName(others.select("d1", "d2", "pos"))
    return lost.groupBy("d1", "d2").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def _without(text: Column, dropped: Column) -> Column:
    """``text`` without the lines at the sorted positions ``dropped``: the stretches between them, each copied once."""
    # The array of one struct binds the split lines, so that they are not split again for each stretch.
    parts = F.array(F.struct(F.split(text, "\n", -1).alias("all"), F.concat(F.array(F.lit(-1)), dropped).alias("cut")))

    def kept(p: Column) -> Column:
        ends = F.concat(F.slice(p["cut"], 2, F.size(p["cut"])), F.array(F.size(p["all"])))
        return F.flatten(F.zip_with(p["cut"], ends, lambda a, b: F.slice(p["all"], a + 2, b - a - 1)))

    return F.array_join(F.transform(parts, kept)[0], "\n")


def dedup(docs: DataFrame, min_docs: int = 2, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its texts without shared lines, and ``n_lines long`` (before), ``n_dropped long``."""
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    k1, k2, gone = free(docs, "_d1", "_d2", "_dropped")
    # Read three times; splitting the texts costs more than writing hashes and positions once.
    lines = materialise(keyed_lines(docs, min_chars, id_col, text_col), "lines")
    lost = materialise(dropped_positions(lines, min_docs), "lines-lost")
    d1, d2 = _two(F.col(id_col), _text(text_col))
    rows = docs.withColumns({k1: d1, k2: d2}).join(lost.toDF(k1, k2, gone), [k1, k2], "left")
    text = _text(text_col)
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    new = F.when(F.col(gone).isNull(), text).otherwise(_without(text, F.col(gone)))
    return rows.select(
        *[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in keep], n_lines.cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, n_lines, n_dropped, kept_sha256)`` of every document."""
    return dedup(docs.select(id_col, text_col), id_col=id_col, text_col=text_col).select(id_col, "n_lines", "n_dropped", F.sha2(text_col, 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id > s.first_doc AS gone FROM k LEFT JOIN s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
