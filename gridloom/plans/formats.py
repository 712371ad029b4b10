"""Queries that write a format and read it back, so that the reader and the writer meet the tables."""

from __future__ import annotations

import struct
import uuid
import zlib
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.plans.registry import GRID_SQL, N, add, grid
from gridloom.plans.scratch import shared_dir
from gridloom.sources import blocks, files, fixtures, raster, tables


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def _text(rows: DataFrame, name: str, order: list[str]) -> str:
    """Lines of ``rows(line, ..)`` as one text file in the given order."""
    path = _folder(rows.sparkSession, name)
    rows.orderBy(*order).select("line").coalesce(1).write.text(path)
    return path


def _line(*parts: Column) -> Column:
    return F.concat_ws(" ", *[p.cast("string") for p in parts])


# --- TIFF -----------------------------------------------------------------------------------


def _saved(s: SparkSession, cells: DataFrame, bands: list[str], **how) -> str:
    tall = cells.select("row", "col", F.posexplode(F.array(*[F.col(b).cast("double") for b in bands])).alias("band", "v"))
    folder = _folder(s, "tiff")
    raster.write(tall.select((F.col("band") + 1).alias("band"), "row", "col", "v"), folder + "/grid.tif", N, N, len(bands), **how)
    return folder


def _tiff(s: SparkSession, d: str) -> DataFrame:
    folder = _saved(s, grid(s, d), ["v"], transform=(1000.0, 25.0, 0.0, 9000.0, 0.0, -25.0), epsg=32750, nodata=-9999.0, deflate=True)
    return raster.read(s, folder + "/*.tif").select("row", "col", "x", "y", F.round("v", 2).alias("v"))


add(
    "tiff_round_trip", _tiff,
    f"WITH {GRID_SQL} SELECT row, col, 1000 + (col + 0.5) * 25 AS x, 9000 - (row + 0.5) * 25 AS y, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 2) AS v FROM g",
)


def _bands(s: SparkSession, d: str) -> DataFrame:
    q = fixtures.table(s, d, "lineitem").groupBy((F.col("l_partkey") % N).cast("int").alias("row"), (F.col("l_orderkey") % N).cast("int").alias("col"))
    b = q.agg(F.avg("l_quantity").alias("p"), F.avg("l_discount").alias("q"))
    folder = _saved(s, b, ["p", "q"], transform=raster.boxed_transform(N, N, 10.0, 0.0, 20.0, 30.0), flip=True, tags={"inclination": "-60", "declination": "5", "intensity": "55000"}, names=["quantity", "discount"])
    cells = raster.bands_wide(raster.read(s, folder + "/*.tif"), [1, 2]).where("b1 IS NOT NULL")
    p = raster.magnetic_parameters(raster.describe(s, folder + "/*.tif")).drop("file")
    return cells.crossJoin(F.broadcast(p)).select("row", "col", F.round("b1", 3).alias("b1"), F.round("b2", 5).alias("b2"), "inclination", "declination", "intensity")


add(
    "tiff_bands", _bands,
    f"""SELECT {N - 1} - CAST(l_partkey % {N} AS INTEGER) AS row, CAST(l_orderkey % {N} AS INTEGER) AS col, round(CAST(CAST(avg(l_quantity) AS FLOAT) AS DOUBLE), 3) AS b1, round(CAST(CAST(avg(l_discount) AS FLOAT) AS DOUBLE), 5) AS b2,
-60.0 AS inclination, 5.0 AS declination, 55000.0 AS intensity FROM lineitem GROUP BY 1, 2""",
)



def _pieces_of_a_mosaic(s: SparkSession, d: str) -> DataFrame:
    """Four files that overlap by four columns and rows, the later ones by name 1000 higher each; cells within a box."""
    folder, g = _folder(s, "mosaic"), grid(s, d).select(F.lit(1).alias("band"), "row", "col", "v").cache()
    half = N // 2
    for k, (r, c) in enumerate(((0, 0), (0, half - 4), (half - 4, 0), (half - 4, half - 4))):
        part = g.where(F.col("row").between(r, r + half + 3) & F.col("col").between(c, c + half + 3)).select("band", (F.col("row") - r).alias("row"), (F.col("col") - c).alias("col"), (F.col("v") + 1000 * k).alias("v"))
        raster.write(part, f"{folder}/part{k}.tif", half + 4, half + 4, transform=(100.0 + 10 * c, 10.0, 0.0, 900.0 - 10 * r, 0.0, -10.0))
    cells = raster.mosaic(raster.block_table(s, folder + "/*.tif"), box=(150.0, 500.0, 520.0, 850.0))
    return cells.select("row", "col", "x", "y", F.round("v", 2).alias("v"))


_HALF = N // 2
_INSIDE = [f"(row BETWEEN {r} AND {r + _HALF + 3} AND col BETWEEN {c} AND {c + _HALF + 3})" for r, c in ((0, 0), (0, _HALF - 4), (_HALF - 4, 0), (_HALF - 4, _HALF - 4))]
add(
    "tiff_mosaic", _pieces_of_a_mosaic,
    f"""WITH {GRID_SQL} SELECT row, col, 105 + 10.0 * col AS x, 895 - 10.0 * row AS y, round(CAST(CAST(v + CASE {' '.join(f'WHEN {_INSIDE[k]} THEN {1000 * k}' for k in (3, 2, 1, 0))} END AS FLOAT) AS DOUBLE), 2) AS v
FROM g WHERE 105 + 10 * col BETWEEN 150 AND 520 AND 895 - 10 * row BETWEEN 500 AND 850""",
)


def _rows_of_bands(s: SparkSession, d: str) -> DataFrame:
    """Ten rows of the second of three bands; the file is stored from the south up and in strips of seven rows."""
    q = fixtures.table(s, d, "lineitem").groupBy((F.col("l_partkey") % N).cast("int").alias("row"), (F.col("l_orderkey") % N).cast("int").alias("col"))
    b = q.agg(F.avg("l_quantity").alias("p"), F.max("l_discount").alias("q"), F.count("*").alias("n"))
    folder = _saved(s, b, ["p", "q", "n"], transform=(0.0, 1.0, 0.0, 0.0, 0.0, 2.0), tags={"made by": "a < b & c"})
    cells = raster.read(s, folder + "/*.tif", rows=(20, 30), bands=[2]).where("v IS NOT NULL")
    tags = raster.describe(s, folder + "/*.tif").select(F.col("tags")["made by"].alias("note"))
    return cells.crossJoin(F.broadcast(tags)).select("band", "row", "col", "x", "y", F.round("v", 4).alias("v"), "note")


add(
    "tiff_rows", _rows_of_bands,
    f"""WITH q AS (SELECT CAST(l_partkey % {N} AS INTEGER) AS r, CAST(l_orderkey % {N} AS INTEGER) AS col, max(l_discount) AS v FROM lineitem GROUP BY 1, 2)
SELECT 2 AS band, {N - 1} - r AS row, col, col + 0.5 AS x, (r + 0.5) * 2 AS y, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 4) AS v, 'a < b & c' AS note FROM q WHERE {N - 1} - r BETWEEN 20 AND 29""",
)


def _grd(s: SparkSession, d: str) -> str:
    """The price grid as a compressed GRD file in blocks of five vectors, values in quarters above 30000."""
    path, per = _folder(s, "grd") + "/grid.grd", 5
    g = grid(s, d).select(F.floor(F.col("row") / per).alias("k"), "row", "col", F.coalesce(F.round((F.col("v") - 30000) * 4), F.lit(-1e32)).alias("v"))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        body = group.sort_values(["row", "col"])["v"].to_numpy("<f4").tobytes()
        return pd.DataFrame({"k": [key[0]], "body": [bytes(16) + zlib.compress(body)]})

    def head(lengths: list[int]) -> tuple[bytes, int]:
        first = struct.pack("<5i7d", 4 + 1024, 2, N, N, 1, 25.0, 50.0, 1000.0, 2000.0, 0.0, 30000.0, 4.0).ljust(512, b"\0")
        start = 512 + 16 + 12 * len(lengths)
        offsets = [start + n for n in accumulate(lengths[:-1], initial=0)]
        return first + struct.pack("<4i", 0, 0, len(lengths), per) + struct.pack(f"<{len(lengths)}q", *offsets) + struct.pack(f"<{len(lengths)}i", *lengths), start

    blocks.write_pieces(g.groupBy("k").applyInPandas(run, "k long, body binary"), path, head, -(-N // per))
    return path


def _converted(s: SparkSession, d: str) -> DataFrame:
    path = _grd(s, d)
    files.grd_to_tiff(s, path, path + ".tif", epsg=32750)
    return raster.read(s, path + ".tif").select("row", "col", "x", "y", "v")


add(
    "grd_cells", lambda s, d: files.grd(s, _grd(s, d)).select("row", "col", "x", "y", "v"),
    f"WITH {GRID_SQL} SELECT row, col, 1000 + 25.0 * col AS x, 2000 + 50.0 * row AS y, round((v - 30000) * 4) / 4 + 30000 AS v FROM g",
)
add(
    "grd_to_tiff", _converted,
    f"WITH {GRID_SQL} SELECT {N - 1} - row AS row, col, 1000 + 25.0 * col AS x, 2000 + 50.0 * row AS y, round((v - 30000) * 4) / 4 + 30000 AS v FROM g",
)

# --- text -----------------------------------------------------------------------------------


def _csv(s: SparkSession, d: str) -> DataFrame:
    """Parts as a table whose coordinate columns are to be guessed; every seventh has none."""
    p = fixtures.table(s, d, "part")
    path = _folder(s, "csv")
    east = F.when(F.col("p_partkey") % 7 != 0, (F.col("p_partkey") * 1.5).cast("string")).otherwise("n/a")
    p.select("p_partkey", east.alias("Easting"), F.col("p_size").alias("Northing"), "p_brand", "p_retailprice").write.csv(path, header=True)
    return tables.points(s, path).select("x", "y", F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand", "p_retailprice")


_LEGACY = """DEFN   ST=RECD,RT=COMM;RT:A4;COMMENTS:A76
DEFN 3 ST=RECD,RT=;NET:F12.2:UNIT=nT,NAME=Net price
DEFN 1 ST=RECD,RT=;ORDER:I10
DEFN 2 ST=RECD,RT=;LINE:I4
DEFN 4 ST=RECD,RT=;FLAG:A1;END DEFN
PROJ GDA94 / MGA Zone 51"""


def _legacy(s: SparkSession, d: str) -> DataFrame:
    """Line items in the older form; every eleventh row lacks its last fields, every seventh price is a word."""
    q = fixtures.table(s, d, "lineitem")
    price = F.when(F.col("l_partkey") % 7 == 0, "none").otherwise(F.col("l_extendedprice").cast("string"))
    line = F.when(F.col("l_orderkey") % 11 == 0, _line(F.col("l_orderkey"), F.col("l_linenumber"))).otherwise(F.concat(F.lit("DATA"), _line(F.lit(" "), F.col("l_orderkey"), F.col("l_linenumber"), price, F.col("l_returnflag"))))
    path = _folder(s, "legacy")
    q.select(line.alias("line")).write.text(path)
    fields, epsg, typed = tables.legacy_definitions(_LEGACY)
    return tables.legacy_data(s, fields, path, typed).withColumn("epsg", F.lit(epsg))


add(
    "legacy_fields", _legacy,
    """SELECT l_orderkey AS "ORDER", CAST(l_linenumber AS BIGINT) AS "LINE", CASE WHEN l_partkey % 7 <> 0 THEN l_extendedprice END AS "Net price", l_returnflag AS "FLAG", 28351 AS epsg FROM lineitem WHERE l_orderkey % 11 <> 0""",
)
add("csv_points", _csv, "SELECT p_partkey * 1.5 AS x, CAST(p_size AS DOUBLE) AS y, p_partkey, p_brand, p_retailprice FROM part WHERE p_partkey % 7 <> 0")


def _xyz(s: SparkSession, d: str) -> DataFrame:
    """Events as stations under the marker of their user; users divisible by four are ties."""
    e = fixtures.table(s, d, "events")
    station = e.select(F.col("user_id").alias("l"), F.lit(1).alias("k"), F.col("event_id").alias("e"), _line(F.col("event_id") % 1000, F.col("event_id") % 77, F.col("value")).alias("line"))
    mark = e.select("user_id").distinct().select(F.col("user_id").alias("l"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("e"), F.concat(F.when(F.col("user_id") % 4 == 0, "TIE:").otherwise("LINE:"), F.col("user_id").cast("string")).alias("line"))
    # Files of whole lines: all rows of a user are in one range, behind their marker.
    path = _folder(s, "xyz")
    station.union(mark).repartitionByRange("l").sortWithinPartitions("l", "k", "e").select("line").write.text(path)
    found = files.xyz(s, path, ties=False)
    return found.select(F.col("line_id").cast("long").alias("line_id"), "x", "y", F.round(F.col("data")[0], 6).alias("v"))


add("xyz_lines", _xyz, "SELECT user_id AS line_id, CAST(event_id % 1000 AS DOUBLE) AS x, CAST(event_id % 77 AS DOUBLE) AS y, round(value, 6) AS v FROM events WHERE user_id % 4 <> 0")


def _definitions(s: SparkSession, d: str) -> DataFrame:
    """Line items by a field definition with arrays, null values and comments."""
    text = """DEFN   ST=RECD,RT=COMM;RT:A4;COMMENTS:A76
DEFN 1 ST=RECD,RT=; ORDER: I10: NAME=order
DEFN 2 ST=RECD,RT=; NUMBER: I4
DEFN 3 ST=RECD,RT=; PRICE: F12.2: UNIT=aud, NULL=-9999
DEFN 4 ST=RECD,RT=; PAIR: 2F8.3
DEFN 5 ST=RECD,RT=; FLAG: A1
DEFN 6 ST=RECD,RT=; DATUM: A9: NAME=GDA94 MGA ZONE 50; END DEFN"""
    fields, _ = tables.definitions(text)
    q = fixtures.table(s, d, "lineitem")
    price = F.when(F.col("l_partkey") % 9 == 0, "-9999.00").otherwise(F.col("l_extendedprice").cast("string"))
    note = F.when(F.col("l_linenumber") == 1, F.lit("*first")).otherwise(F.lit(""))
    rows = q.select(_line(F.col("l_orderkey"), F.col("l_linenumber"), price, F.col("l_discount"), F.col("l_tax"), F.col("l_returnflag"), note).alias("line"))
    path = _folder(s, "defined")
    rows.write.text(path)
    return tables.defined_data(s, fields, path).withColumnRenamed("COMMENTS", "note")


add(
    "defined_fields", _definitions,
    """SELECT l_orderkey AS "ORDER", CAST(l_linenumber AS BIGINT) AS "NUMBER", CASE WHEN l_partkey % 9 <> 0 THEN l_extendedprice END AS "PRICE", concat_ws(';', CAST(l_discount AS VARCHAR), CAST(l_tax AS VARCHAR)) AS "PAIR", l_returnflag AS "FLAG",
CASE WHEN l_linenumber = 1 THEN '*first' ELSE '' END AS note FROM lineitem""",
)


def _model(s: SparkSession, d: str) -> DataFrame:
    """The price grid as a modelled ASCII grid."""
    g = grid(s, d, False).where(f"row < {N}").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", F.coalesce("v", F.lit(0.0)).alias("v")))).alias("c"))
    body = g.select((F.col("row") + 10).alias("k"), F.array_join(F.transform("c", lambda x: (F.floor(x["v"] * 4 + 0.0137) / 4).cast("string")), " ").alias("line"))
    head = s.createDataFrame([(0, "# model"), (1, "333 1"), (2, f"4 {N} {N} 1"), (3, "-60 5 55000"), (4, "0 0 0"), (5, f"{N * 10} {N * 5} 0"), (6, "10 100")], "k int, line string")
    return files.modelled_grid(s, _text(body.union(head), "model", ["k"])).select("kind", "row", "col", "x", "y", "v")


add(
    "modelled_grid", _model,
    f"WITH {GRID_SQL} SELECT 'mag' AS kind, row, col, (col + 0.5) * 10 AS x, {N * 5} - (row + 0.5) * 5 AS y, floor(coalesce(v, 0) * 4 + 0.0137) / 4 AS v FROM full_",
)


def _harmonic_file(s: SparkSession, d: str) -> DataFrame:
    """Prices of the first parts as a coefficient file of two epochs."""
    p = fixtures.table(s, d, "part").where("p_partkey BETWEEN 1 AND 8")
    body = p.select((F.col("p_partkey") + 10).alias("k"), _line((F.col("p_partkey") / 3).cast("int") + 1, (F.col("p_partkey") % 3 - 1).cast("int"), F.col("p_retailprice"), F.col("p_retailprice") + F.col("p_size")).alias("line"))
    head = s.createDataFrame([(0, "# coefficients"), (1, "1 3 2 2 1 2000.0 2005.0"), (2, "2000.0 2005.0")], "k long, line string")
    found = files.coefficients(s, _text(body.union(head), "shc", ["k"]))
    return found.select("n", "m", "year", F.round("coef", 4).alias("coef"))


add(
    "harmonic_file", _harmonic_file,
    """SELECT CAST(p_partkey // 3 + 1 AS INTEGER) AS n, CAST(p_partkey % 3 - 1 AS INTEGER) AS m, e.year AS year, round(p_retailprice + CASE WHEN e.year = 2005 THEN p_size ELSE 0 END, 4) AS coef
FROM part, (SELECT unnest([2000.0, 2005.0])::DOUBLE AS year) e WHERE p_partkey BETWEEN 1 AND 8""",
)


def _sorted_names(s: SparkSession, d: str) -> DataFrame:
    """Brands by short names, updated and deleted rows, in one pass over a point table."""
    p = fixtures.table(s, d, "part").select(F.col("p_partkey").alias("part_identifier"), F.col("p_size").alias("part_identifier_size"), F.col("p_retailprice").alias("z"), (F.col("p_partkey") % 50).cast("double").alias("x"), F.col("p_size").cast("double").alias("y"))
    changes = p.where("part_identifier % 5 = 0").withColumn("z", F.lit(0.0))
    kept = tables.deleted(tables.updated(p, changes, "part_identifier"), "part_identifier % 3 = 0")
    return tables.point_table(kept)


add(
    "point_table", _sorted_names,
    """SELECT p_partkey AS part_ident, p_size AS part_iden1, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_retailprice END AS z, CAST(p_partkey % 50 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y,
'POINT (' || p_partkey % 50 || '.0 ' || p_size || '.0)' AS wkt FROM part WHERE p_partkey % 3 <> 0""",
)


def _sinks(s: SparkSession, d: str) -> DataFrame:
    """A grid as Parquet and estimates as text, a folder for each index, read again."""
    path = _folder(s, "sinks")
    tables.write_grid(grid(s, d), path + "/grid")
    q = fixtures.table(s, d, "lineitem").where("l_linenumber <= 3")
    tables.write_estimates(q.select(F.col("l_linenumber").alias("si"), F.col("l_quantity").alias("y"), F.col("l_tax").alias("x"), F.col("l_extendedprice").alias("z"), F.col("l_discount").alias("base")), path + "/estimates")
    g = s.read.parquet(path + "/grid").agg(F.count("v").alias("cells"), F.round(F.sum("v"), 2).alias("total"))
    e = s.read.csv(path + "/estimates", header=True, inferSchema=True).groupBy("si").agg(F.count("*").alias("n"), F.round(F.sum("z_source"), 2).alias("depth"), F.round(F.sum("base_level"), 4).alias("base"))
    return e.crossJoin(F.broadcast(g))


add(
    "sinks", _sinks,
    f"""WITH {GRID_SQL}, c AS (SELECT count(v) AS cells, round(sum(v), 2) AS total FROM g)
SELECT CAST(l_linenumber AS INTEGER) AS si, count(*) AS n, round(sum(l_extendedprice), 2) AS depth, round(sum(l_discount), 4) AS base, any_value(cells) AS cells, any_value(total) AS total FROM lineitem, c WHERE l_linenumber <= 3 GROUP BY 1""",
)
