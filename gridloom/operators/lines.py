"""Survey lines: ordering, distance, regular resampling and local maxima."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def along(points: DataFrame) -> DataFrame:
    """``points`` with ``pos`` (from 1, along the axis with the larger range) and ``dist`` (cumulative length)."""
    span = points.groupBy("line_id").agg((F.max("x") - F.min("x") >= F.max("y") - F.min("y")).alias("by_x"))
    p = points.join(span, "line_id").withColumn("at", F.when(F.col("by_x"), F.col("x")).otherwise(F.col("y"))).drop("by_x")
    w = Window.partitionBy("line_id").orderBy("at", "seq")
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
    p = p.withColumn("pos", F.row_number().over(w)).withColumn("step", F.coalesce(step, F.lit(0.0)))
    return p.withColumn("dist", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("at")


def regularise(points: DataFrame, spacing: float | None = None) -> DataFrame:
    """``(line_id, k, d, v)``: values at evenly spaced distances, ends included, by linear interpolation.

    Without a spacing each line takes its median step.  Segments emit the targets that fall
    on them, so no join by range is needed.
    """
    p = along(points).where("v IS NOT NULL")
    n = p.groupBy("line_id").agg(F.max("dist").alias("length"), F.percentile(F.when(F.col("pos") > 1, F.col("step")), 0.5).alias("median"))
    n = n.withColumn("n", F.floor(F.col("length") / (F.lit(float(spacing)) if spacing else F.col("median"))).cast("int") + 1)
    n = n.where("n > 1 AND length > 0").withColumn("gap", F.col("length") / (F.col("n") - 1))
    w = Window.partitionBy("line_id").orderBy("pos")
    seg = p.select("line_id", "pos", "dist", "v", F.lead("dist").over(w).alias("d1"), F.lead("v").over(w).alias("v1")).where("d1 > dist")
    seg = seg.join(n, "line_id")
    first = F.ceil(F.col("dist") / F.col("gap") - 1e-9).cast("int")
    last = F.least(F.ceil(F.col("d1") / F.col("gap") - 1e-9).cast("int") - 1, F.col("n") - 1)
    last = F.when(F.col("d1") >= F.col("length"), F.col("n") - 1).otherwise(last)
    ks = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    out = seg.select("*", F.explode(ks).alias("k")).withColumn("d", F.col("k") * F.col("gap"))
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("d") - F.col("dist")) / (F.col("d1") - F.col("dist"))))
    return out.select("line_id", "k", "d", (F.col("v") + (F.col("v1") - F.col("v")) * at).alias("v"))


def local_maxima(points: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Points strictly above both neighbours and above ``threshold`` times the line's maximum."""
    w = Window.partitionBy("line_id").orderBy("pos")
    top = F.max("v").over(Window.partitionBy("line_id"))
    p = along(points).withColumn("a", F.lag("v").over(w)).withColumn("b", F.lead("v").over(w)).withColumn("top", top)
    return p.where((F.col("v") > F.col("a")) & (F.col("v") > F.col("b")) & (F.col("v") > threshold * F.col("top"))).select("line_id", "pos", "v")


def along_path(corners: DataFrame, spacing: float) -> DataFrame:
    """``(line_id, k, d, x, y)``: places every ``spacing`` along the path through ``corners(line_id, seq, x, y)``, from its start.

    Each segment emits the places that fall on it; a path shorter than the spacing has its start only,
    one of equal corners as well.
    """
    w = Window.partitionBy("line_id").orderBy("seq")
    seg = corners.select("line_id", "seq", "x", "y", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    seg = seg.withColumn("step", F.coalesce(F.sqrt((F.col("x1") - F.col("x")) ** 2 + (F.col("y1") - F.col("y")) ** 2), F.lit(0.0)))
    seg = seg.withColumn("d0", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("step"))
    first, end = F.ceil(F.col("d0") / spacing - 1e-12).cast("int"), (F.col("d0") + F.col("step")) / spacing
    after = F.coalesce(F.sum("step").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    seg = seg.withColumn("ends", after == 0).withColumn("lone", F.col("ends") & (F.col("step") == 0) & F.lag("seq").over(w).isNull())
    until = F.when(F.col("ends"), F.floor(end + 1e-12)).otherwise(F.ceil(end - 1e-12) - 1).cast("int")
    ks = F.when(F.col("lone"), F.array(F.lit(0))).when((F.col("step") > 0) & (first <= until), F.sequence(first, until))
    out = seg.select("*", F.explode(ks).alias("k")).withColumn("t", F.when(F.col("step") > 0, (F.col("k") * spacing - F.col("d0")) / F.col("step")).otherwise(0.0))
    move = lambda a, b: F.col(a) + F.coalesce((F.col(b) - F.col(a)) * F.col("t"), F.lit(0.0))
    return out.select("line_id", "k", (F.col("k") * F.lit(float(spacing))).alias("d"), move("x", "x1").alias("x"), move("y", "y1").alias("y"))
