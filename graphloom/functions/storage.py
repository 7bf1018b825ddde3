"""Materialised intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def stash(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` as a table and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/graphloom/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`stash` that nothing reads any more."""
    spark = df.sparkSession
    for p in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
