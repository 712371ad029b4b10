"""Bounded, deterministic samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.plans.scratch import materialise


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls on the fold kept for testing; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, folds: int, fold: int) -> DataFrame:
    """``(id, y)`` of the rows open to training, without their texts; ids labelled 0 and 1 alike are left out."""
    y = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    y = y.agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("top")).where("y = top").drop("top")
    return docs.where(~held_out(id_col, folds, fold)).select(F.col(id_col).alias("id")).join(y, "id")


#: Characters that the sample of a class holds at most, besides its first text.
SAMPLE_CHARS = 50_000_000


def with_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, n: int, salt: int) -> DataFrame:
    """``(id, y, text)`` of at most ``n`` different rows and ``SAMPLE_CHARS`` characters of each class among ``ids(id, y)``.

    The rows are chosen without their texts, first by id, then by id, hash and length of the text, so
    that only the at most ``2 n`` chosen rows meet their texts, as a broadcast.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.length(text).alias("size"))
    found = materialise(rows.join(F.broadcast(per_class(ids, n, salt).distinct()), "id").distinct(), "sampled-ids")
    few = per_class(found, n, salt, "id", "th")
    # At most 2 n rows without texts: their sizes are summed in the order in which they were chosen.
    order = Window.partitionBy("y").orderBy(F.xxhash64(F.lit(salt), "id"), "id", "th")
    few = few.withColumn("before", F.sum("size").over(order) - F.col("size")).where(F.col("before") <= SAMPLE_CHARS).select("id", "th", "y")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(few), ["id", "th"]).dropDuplicates(["id", "th", "y"]).select("id", "y", "text")


def per_class(rows: DataFrame, n: int, salt: int, *keys: str) -> DataFrame:
    """At most ``n`` rows of each class, those with the smallest hash of the first key, then by the keys: the same ones on every run."""
    keys = keys or ("id",)
    parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(salt), F.col(keys[0])), *keys).limit(n) for y in (0, 1)]
    return parts[0].unionByName(parts[1])
