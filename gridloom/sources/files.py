"""Readers of survey files: line XYZ, modelled ASCII grids, binary GRD grids, harmonic coefficients.

Each reader takes a path or glob and gives one row per point or cell, with the file's name as
``file``.  Text files are read in Spark's splits, line files are taken up split by split and binary
grids block by block, each by many tasks; many files are read in parallel.  Values that mean "no data" become NULL.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridloom.sources import blocks, raster


def _splits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(file, split, k, line)``: trimmed lines with their number from 1 in the split that they begin in, and ``(file, split, n)``: the lines of each."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    # A split is read in order by one task, so that these ids rise along it.
    text = text.withColumn("id", F.monotonically_increasing_id())
    p = text.withColumn("k", F.row_number().over(Window.partitionBy("file", "split").orderBy("id")))
    p = p.select("file", "split", "k", F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line"))
    return p, text.groupBy("file", "split").agg(F.count("*").alias("n"))


def _first_line(splits: DataFrame) -> Column:
    """The number, from 0, of the first line of each of ``splits(file, split, n)``."""
    return F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, at, line)``: trimmed lines with their number from 0."""
    p, splits = _splits(spark, path)
    first = splits.select("file", "split", _first_line(splits).alias("first"))
    return p.join(F.broadcast(first), ["file", "split"]).select("file", (F.col("first") + F.col("k") - 1).cast("int").alias("at"), "line")


def xyz(spark: SparkSession, path: str, ties: bool = True) -> DataFrame:
    """``(file, line_id, seq, x, y, data)``: stations below ``LINE:n`` and, if wanted, ``TIE:n`` markers.

    Rows that are not all numbers, have fewer than two, or come before any marker are left out.  A
    split's stations before its first marker belong to the last one of the splits before it.
    """
    number = F.regexp_extract("line", r"^(?:LINE|TIE):\D*(\d+)", 1).cast("int")
    mark = F.when(F.col("line").startswith("LINE:"), number).when(F.col("line").startswith("TIE:"), number if ties else F.lit(-1))
    p, splits = _splits(spark, path)
    p = p.withColumn("mark", mark)
    w = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    marks = p.where("mark IS NOT NULL").groupBy("file", "split").agg(F.max_by("mark", "k").alias("last"))
    heads = splits.join(marks, ["file", "split"], "left").select("file", "split", _first_line(splits).alias("first"), F.last("last", True).over(w).alias("open"))
    p = p.withColumn("own", F.last("mark", True).over(Window.partitionBy("file", "split").orderBy("k")))
    p = p.join(F.broadcast(heads), ["file", "split"]).withColumn("line_id", F.coalesce("own", "open")).withColumn("at", (F.col("first") + F.col("k") - 1).cast("int"))
    p = p.where("mark IS NULL AND line_id >= 0").withColumn("d", F.transform(F.split("line", " "), lambda t: t.try_cast("double")))
    p = p.where((F.size("d") >= 2) & ~F.exists("d", lambda v: v.isNull()))
    return p.select("file", "line_id", F.col("at").alias("seq"), F.col("d")[0].alias("x"), F.col("d")[1].alias("y"), F.slice("d", 3, F.size("d")).alias("data"))


def coefficients(spark: SparkSession, path: str) -> DataFrame:
    """``(file, n, m, year, coef)`` of a spherical-harmonic file: ``#`` lines, parameters, epochs, then ``n m c..``."""
    p = _lines(spark, path).where("line <> '' AND NOT line LIKE '#%'")
    p = p.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("at"))).withColumn("d", F.split("line", " ").cast("array<double>"))
    years = p.where("k = 2").select("file", F.posexplode("d").alias("i", "year"))
    rows = p.where("k > 2").select("file", F.col("d")[0].cast("int").alias("n"), F.col("d")[1].cast("int").alias("m"), F.posexplode(F.slice("d", 3, F.size("d"))).alias("i", "coef"))
    return rows.join(years, ["file", "i"]).select("file", "n", "m", "year", "coef")


def modelled_grid(spark: SparkSession, path: str) -> DataFrame:
    """``(file, kind, row, col, x, y, v)`` of ASCII grids: a code (333: mag, else grv), five header lines, then rows from the north.

    Lines of ``#`` and empty ones do not count; ``x`` and ``y`` are cell centres.
    """
    p = _lines(spark, path).where("line <> '' AND NOT line LIKE '#%'")
    p = p.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("at"))).withColumn("d", F.split("line", " "))
    line = lambda k, i: F.max(F.when(F.col("k") == k, F.col("d")[i].try_cast("double")))
    # The sixth line holds cell size and survey height; the grid starts at the seventh.
    head = p.groupBy("file").agg(
        F.when(line(1, 0) == 333, "mag").otherwise("grv").alias("kind"), line(4, 0).alias("west"), line(4, 1).alias("south"), line(5, 0).alias("east"), line(5, 1).alias("north"),
        (F.max("k") - 6).alias("nrows"),
    )
    cells = p.where("k > 6").select("file", (F.col("k") - 7).cast("int").alias("row"), F.size("d").alias("ncols"), F.posexplode(F.col("d").cast("array<double>")).alias("col", "v")).join(head, "file")
    x = F.col("west") + (F.col("col") + 0.5) * (F.col("east") - F.col("west")) / F.col("ncols")
    y = F.col("north") - (F.col("row") + 0.5) * (F.col("north") - F.col("south")) / F.col("nrows")
    return cells.select("file", "kind", "row", "col", x.alias("x"), y.alias("y"), F.when(~F.isnan("v"), F.col("v")).alias("v"))


# Fixed values of the GRD format: element types by (size, sign flag), and what stands for no data.
_TYPES = {(1, 0): "u1", (1, 1): "i1", (2, 0): "u2", (2, 1): "i2", (4, 0): "u4", (4, 1): "i4", (4, 2): "f4", (8, 2): "f8"}
_DUMMY = {"i1": -127, "u1": 255, "i2": -32767, "u2": 65535, "i4": -2147483647, "u4": 4294967295, "f4": -1e32, "f8": -1e32}
_HEADER = 512


#: Bytes of an uncompressed grid that one block holds.
_PLAIN_BYTES = 1 << 22
_HEAD = "file string, length int, vectors int, turned boolean, de double, dv double, x0 double, y0 double, rotation double, base double, factor double, kind string, packed boolean, "
_GRD_BLOCK = _HEAD + "first int, n int, at long, size long"


def _grd_blocks(read: Callable[[int, int], bytes]) -> tuple[tuple, list[tuple[int, int, int, int]]]:
    """What all blocks share, and (first vector, vectors, offset, size) of each; only the head is read."""
    raw = read(0, _HEADER + 16)
    size, sign, length, vectors, order = struct.unpack_from("<5i", raw, 0)
    de, dv, x0, y0, rotation, base, factor = struct.unpack_from("<7d", raw, 20)
    packed = size > 1024
    width = size - 1024 if packed else size
    if order not in (-1, 1):
        raise ValueError(f"unknown ordering {order}")
    if (width, sign) not in _TYPES:
        raise ValueError(f"unknown element type: size {width}, sign flag {sign}")
    if packed:
        count, per = struct.unpack_from("<2i", raw, _HEADER + 8)
        table = read(_HEADER + 16, 12 * count)
        places = zip(struct.unpack_from(f"<{count}q", table), struct.unpack_from(f"<{count}i", table, 8 * count))
        cut = [(k * per, min(per, vectors - k * per), a + 16, n - 16) for k, (a, n) in enumerate(places)]
    else:
        line = length * width
        per = max(1, _PLAIN_BYTES // max(1, line))
        cut = [(k, min(per, vectors - k), _HEADER + k * line, min(per, vectors - k) * line) for k in range(0, vectors, per)]
    return (length, vectors, order == -1, de, dv, x0, y0, rotation, base, factor, _TYPES[width, sign], packed), cut


def _grd_cells(raw: bytes, block) -> pd.DataFrame:
    """``row, col, x, y, v`` of one block; y grows with the row before rotation, and vectors are columns if ``turned``."""
    a = np.frombuffer(zlib.decompress(raw) if block.packed else raw, "<" + block.kind, count=block.length * block.n)
    v = a.astype(float) / block.factor + block.base
    v[a <= _DUMMY[block.kind] if block.kind[0] == "f" else a == _DUMMY[block.kind]] = np.nan
    vector, place = (i.ravel() for i in np.indices((block.n, block.length)))
    vector = vector + block.first
    row, col, de, dv = (place, vector, block.dv, block.de) if block.turned else (vector, place, block.de, block.dv)
    t, east, north = np.deg2rad(block.rotation), col * de, row * dv
    return pd.DataFrame({"file": block.file, "row": row.astype(np.int32), "col": col.astype(np.int32), "x": block.x0 + east * np.cos(t) - north * np.sin(t), "y": block.y0 + east * np.sin(t) + north * np.cos(t), "v": v})


def grd_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``(file, .., first, n, at, size)``: which vectors lie where in which binary GRD grid; a compressed one is as its writer cut it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file in b["file"]:
                with blocks.opened(file) as f:
                    head, cut = _grd_blocks(blocks.ranged(f))
                yield pd.DataFrame([(file, *head, *x) for x in cut], columns=[c.split()[0] for c in _GRD_BLOCK.split(", ")])

    return blocks.listed(spark, path).mapInPandas(run, _GRD_BLOCK)


def grd(spark: SparkSession, path: str) -> DataFrame:
    """``(file, row, col, x, y, v)`` of binary GRD grids, plain or compressed, each block read and inflated by the task it is dealt to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, group in b.sort_values(["file", "at"]).groupby("file", sort=False):
                with blocks.opened(file) as f:
                    read = blocks.ranged(f)
                    for x in group.itertuples():
                        yield _grd_cells(read(x.at, x.size), x)

    found = blocks.dealt(grd_blocks(spark, path)).mapInPandas(run, "file string, row int, col int, x double, y double, v double")
    return found.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def grd_to_tiff(spark: SparkSession, path: str, out: str, epsg: int | None = None, nodata: float | None = None, deflate: bool = True) -> None:
    """Write one GRD grid as a TIFF with its row 0 in the north; a rotated grid keeps its rotation in the placement.

    Raises unless ``path`` names exactly one grid.
    """
    heads = grd_blocks(spark, path).drop("first", "n", "at", "size").distinct().take(2)
    if len(heads) != 1:
        raise ValueError(f"one grid is needed at {path}")
    h = heads[0]
    nrows, ncols, dx, dy = (h.length, h.vectors, h.dv, h.de) if h.turned else (h.vectors, h.length, h.de, h.dv)
    t = math.radians(h.rotation)
    # Cell centres of row r from the south: x0 + col dx cos - r dy sin, y0 + col dx sin + r dy cos.
    east, north = (dx * math.cos(t), dx * math.sin(t)), (-dy * math.sin(t), dy * math.cos(t))
    x0 = h.x0 + (nrows - 0.5) * north[0] - 0.5 * east[0]
    y0 = h.y0 + (nrows - 0.5) * north[1] - 0.5 * east[1]
    cells = grd(spark, path).select(F.lit(1).alias("band"), "row", "col", "v")
    raster.write(cells, out, nrows, ncols, 1, (x0, east[0], -north[0], y0, east[1], -north[1]), epsg, nodata, flip=True, deflate=deflate)
