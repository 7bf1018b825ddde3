"""Shared helpers of the training-data operators: table reads, shared folder, materialised tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system; Spark keeps workers for later stages."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc only
        trim(0)


def lean() -> None:
    """Give large arrays of a Python worker back to the system as soon as they are dropped, Arrow's included: workers
    that hold many of them in turn otherwise keep the gaps."""
    import ctypes

    import pyarrow

    pyarrow.set_memory_pool(pyarrow.system_memory_pool())
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:  # glibc only
        mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: arrays above it are mapped on their own


def tidy(f):
    """A batch function for mapInPandas that releases its memory at the end of a task."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{what}-{uuid.uuid4().hex}"


def stash(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its source has fewer partitions (a small file with one row group): Python is the cost."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def drop_path(spark: SparkSession, df_or_path) -> None:
    """Delete a table made by :func:`stash` that nothing reads any more."""
    paths = [df_or_path] if isinstance(df_or_path, str) else {p.rsplit("/", 1)[0] for p in df_or_path.inputFiles()}
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def utf8_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_id() -> Column:
    """A hash of a row's id and text; rows with both equal share it, null ids and texts included."""
    return F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")), F.col("text").isNull(), utf8_text())


def held_out(id_column: str = "doc_id") -> Column:
    """True for rows kept from training: crc32 of the id as text leaves 2 modulo 4 (null ids are held out)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))
