"""Byte ranges of large files for tasks: read at an offset, and written at one.

Paths are those of Spark's own readers.  ``file:`` paths and plain ones are opened as files, which on
a cluster must lie in a folder that all machines share; other stores go through Arrow's file
systems, which take offsets for reading only, so that there one task writes the pieces in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridloom.plans.scratch import checkpointed, materialise

#: Bytes that one task reads at least, where a file is cut into blocks.
TASK_BYTES = 8 << 20


def local(path: str) -> str | None:
    """The place of a ``file:`` path, None for other stores."""
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def opened(path: str):
    """A seekable file to read from."""
    place = local(path)
    if place is not None:
        return open(place, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def ranged(file) -> Callable[[int, int], bytes]:
    """``read(offset, length)`` over an open file."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return read


def listed(spark: SparkSession, path: str) -> DataFrame:
    """``(file, length)`` of the files that ``path`` names; no content is read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").repartition("file")


def dealt(blocks: DataFrame, size: str = "size") -> DataFrame:
    """``blocks`` dealt over tasks that each read about ``TASK_BYTES``, in one partition at least."""
    blocks = checkpointed(blocks)
    total = blocks.agg(F.sum(size), F.count("*")).first()
    lanes = blocks.sparkSession.sparkContext.defaultParallelism
    n = min(total[1], max(lanes, -(-(total[0] or 0) // TASK_BYTES)))
    return blocks.repartition(max(1, int(n)))


def write_pieces(pieces: DataFrame, path: str, head: Callable[[list[int]], tuple[bytes, int]], count: int) -> None:
    """Write one file from ``pieces(k, body)``, k from 0 to ``count`` - 1 without gaps, behind ``head(lengths) -> (its bytes, where pieces begin)``.

    Pieces are stored once; only their lengths come to the driver, which writes the head, and tasks
    put each piece in its place.  A task that runs again writes the same bytes.
    """
    spark = pieces.sparkSession
    pieces = materialise(pieces.select(F.col("k").cast("long").alias("k"), "body"), "file-pieces")
    lengths = [0] * count
    for r in pieces.select("k", F.length("body").alias("n")).toLocalIterator():
        lengths[r.k] = r.n
    first, start = head(lengths)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    path = str(system.makeQualified(target).toString())
    system.mkdirs(target.getParent())
    place = local(path)
    if place is None:
        _stream(pieces, path, first)
        return
    with open(place, "wb") as f:
        f.write(first)
        f.truncate(start + sum(lengths))
    # Places by a sum over blocks of pieces and one within each.
    up = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = checkpointed(pieces.select("k", F.length("body").cast("long").alias("n"), F.shiftright("k", 12).alias("g")))
    groups = sizes.groupBy("g").agg(F.sum("n").alias("n")).select("g", up(Window.orderBy("g")).alias("before"))  # a row for each 4096 pieces
    at = sizes.join(groups, "g").select("k", (up(Window.partitionBy("g").orderBy("k")) + F.col("before") + start).alias("at"))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(place, "r+b") as f:
            for b in batches:
                for where, body in zip(b["at"], b["body"]):
                    f.seek(where)
                    f.write(body)
        yield pd.DataFrame({"done": [1]})

    pieces.join(at, "k").select("at", "body").mapInPandas(put, "done int").agg(F.sum("done")).collect()


def _stream(pieces: DataFrame, path: str, first: bytes) -> None:
    """One task writes the head and the pieces in order, a batch at a time."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        with system.open_output_stream(inner) as f:
            f.write(first)
            for b in batches:
                for body in b["body"]:
                    f.write(body)
        yield pd.DataFrame({"done": [1]})

    pieces.coalesce(1).sortWithinPartitions("k").select("body").mapInPandas(put, "done int").collect()
