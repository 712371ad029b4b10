"""Grids, lines and points derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, nrows: int, ncols: int) -> DataFrame:
    """All ``(row, col)`` of a grid."""
    at = spark.range(nrows * ncols)
    return at.select(F.floor(F.col("id") / ncols).cast("int").alias("row"), (F.col("id") % ncols).cast("int").alias("col"))


def rasterise(rows: DataFrame, row: Column, col: Column, value: Column, nrows: int, ncols: int) -> DataFrame:
    """Mean of ``value`` per cell as a dense ``(row, col, v)``; NULL where no row falls."""
    means = rows.groupBy(row.cast("int").alias("row"), col.cast("int").alias("col")).agg(F.avg(value).alias("v"))
    return cells(rows.sparkSession, nrows, ncols).join(means, ["row", "col"], "left")


def price_grid(spark: SparkSession, sf_dir: str, n: int = 48, holes: bool = False) -> DataFrame:
    """Mean extended price over part and order keys modulo ``n``; ``holes`` blanks a regular pattern of cells."""
    g = rasterise(table(spark, sf_dir, "lineitem"), F.col("l_partkey") % n, F.col("l_orderkey") % n, F.col("l_extendedprice"), n, n)
    if holes:
        g = g.withColumn("v", F.when((F.col("row") * 7 + F.col("col") * 3) % 11 == 0, None).otherwise(F.col("v")))
    return g


def grid_set(spark: SparkSession, sf_dir: str, n: int = 48) -> DataFrame:
    """``(grid_id, row, col, v)``: one grid for each line number, occupied cells only."""
    rows = table(spark, sf_dir, "lineitem")
    key = [F.col("l_linenumber").alias("grid_id"), (F.col("l_partkey") % n).cast("int").alias("row"), (F.col("l_orderkey") % n).cast("int").alias("col")]
    return rows.groupBy(*key).agg(F.avg("l_extendedprice").alias("v"))


def survey_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(line_id, x, y, v)``: events as stations along a user's line, x in seconds."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("line_id"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("x"), F.col("user_id").cast("double").alias("y"), F.col("value").alias("v"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(x, y, z)``: mean retail price at part key modulo 50 and size."""
    p = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 50).cast("double").alias("x"), F.col("p_size").cast("double").alias("y"))
    return p.agg(F.avg("p_retailprice").alias("z"))
