"""Thresholds, zero crossings between neighbouring cells, and sampling a grid at points."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def blank(grid: DataFrame, condition: str, above: float | None = None, below: float | None = None) -> DataFrame:
    """``grid`` with NULL where ``v`` is ``above`` the one limit, ``below`` the other, or strictly ``between`` the two."""
    tests = {"above": lambda v: v > above, "below": lambda v: v < below, "between": lambda v: (v > below) & (v < above)}
    if condition not in tests:
        raise ValueError(f"unknown condition {condition}")
    return grid.withColumn("v", F.when(tests[condition](F.col("v")), None).otherwise(F.col("v")))


def zero_crossings(grid: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """``(x, y, row, col, axis)``: where ``v`` passes zero on the way to the next column (0) or row (1).

    The position is linear between the cells; the last cell's neighbour is the first one.
    Each cell is sent to itself and to the two cells that look at it: one shuffle.
    """
    back = lambda i, n: F.pmod(F.col(i) - 1, F.lit(n)).cast("int")
    own = F.struct(F.col("row"), F.col("col"), F.lit(-1).alias("axis"))
    left = F.struct(F.col("row"), back("col", ncols).alias("col"), F.lit(0).alias("axis"))
    up = F.struct(back("row", nrows).alias("row"), F.col("col"), F.lit(1).alias("axis"))
    sent = grid.where("v IS NOT NULL").select(F.explode(F.array(own, left, up)).alias("to"), "v")
    pick = lambda k: F.max(F.when(F.col("to.axis") == k, F.col("v")))
    met = sent.groupBy(F.col("to.row").alias("row"), F.col("to.col").alias("col")).agg(pick(-1).alias("f"), pick(0).alias("f0"), pick(1).alias("f1"))
    met = met.select("row", "col", "f", F.explode(F.array(F.struct(F.lit(0).alias("axis"), F.col("f0").alias("g")), F.struct(F.lit(1).alias("axis"), F.col("f1").alias("g")))).alias("e"))
    s = F.col("f") / F.nullif(F.col("f") - F.col("e.g"), F.lit(0.0))
    out = met.select("row", "col", "e.axis", s.alias("s")).where("s BETWEEN 0 AND 1")
    at = lambda i, k: F.col(i) + F.when(F.col("axis") == k, F.col("s")).otherwise(F.lit(0.0))
    return out.select(at("col", 0).alias("x"), at("row", 1).alias("y"), "row", "col", "axis").where((F.col("x") < ncols) & (F.col("y") < nrows))


def sample(grid: DataFrame, points: DataFrame, x0: float = 0.0, y0: float = 0.0, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """``points(x, y, ..)`` with the ``v`` of the cell that holds them; NULL outside the grid."""
    row, col = F.floor((F.col("y") - y0) / dy).cast("int"), F.floor((F.col("x") - x0) / dx).cast("int")
    at = points.withColumn("row", row).withColumn("col", col)
    return at.join(grid.select("row", "col", "v"), ["row", "col"], "left").drop("row", "col")
