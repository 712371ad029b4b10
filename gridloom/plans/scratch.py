"""Tables and checkpoints in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only where that is unset and all tasks run in one process (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = spark.conf.get("gridloom.scratch.dir", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
            spark.conf.set("gridloom.scratch.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def materialise(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that ``materialise`` has written and nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    base = path(shared_dir(spark)).toUri().getPath()
    for folder in {str(path(f).getParent().toString()) for f in df.inputFiles()}:
        where = path(folder)
        if where.toUri().getPath().startswith(f"{base.rstrip('/')}/"):
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for small tables of an iteration; freed when no longer referenced."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is never broadcast: Spark sizes what an explode has lengthened as if it had not."""
    return df.hint("merge")


def bounded_batches(spark: SparkSession, rows: int = 1_000, mb: int = 16) -> None:
    """Hand rows of long text to Python in small Arrow batches, so that a worker's memory stays bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")
