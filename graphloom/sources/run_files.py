"""Benchmark logs: dirty run-summary TSVs, scaling TSVs, dataset catalogues, phase logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import to_number
from graphloom.functions.storage import stash

#: Implementations in their canonical order, and older lower-case names for them.
IMPLEMENTATIONS = ["Sequential", "OpenMP", "GPU", "GPU_Managed", "GPU_ReadMostly", "GPU_Opt"]
OLD_NAMES = ["sequential", "omp", "gpu", "gpu_managed", "gpu_readmostly", "gpu_opt"]
NUMERIC = ("time_sec", "gteps", "batchsize", "bfs_sec", "back_sec", "size_gb", "time_ms", "bandwidth_gbs", "theoretical_gbs", "ratio_pct")
LINES = "file string, file_ord int, line_no long, value string"


def text_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """file, file_ord (from 1, by path), line_no (from 0), value of all files that match; no rows if there is no such file.

    Spark splits the files, so a large one is read by many tasks. The lines of each split are counted first; a line's number
    is its place in its split, after the lines of the splits before it.
    """
    from pyspark.errors import AnalysisException

    try:
        texts = spark.read.text(pattern)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LINES)
    block = F.col("_metadata.file_block_start").alias("block")
    rows = stash(texts.select("value", F.col("_metadata.file_path").alias("file"), block, F.monotonically_increasing_id().alias("id")), "log-lines")
    splits = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    files = splits.select("file").distinct().withColumn("file_ord", F.row_number().over(Window.orderBy("file")))  # a row a file
    placed = rows.join(splits.join(files, "file"), ["file", "block"])
    return placed.select("file", "file_ord", (F.col("before") + F.col("id") - F.col("first")).alias("line_no"), "value")


def parse_tsv(lines: DataFrame, columns: list[str], first: str) -> DataFrame:
    """Rows of dirty TSV lines: everything before a file's first header (a line whose first field is ``first``) goes, and
    repeated headers, rows with fewer fields than ``columns`` and, for run summaries, unknown implementations; longer rows
    are cut. Numbers that cannot be read become null; rows of nulls only go. Keeps file_ord and line_no."""
    fields = F.split("value", "\t")
    head = F.trim(fields[0]) == first
    headers = lines.filter(head).groupBy("file_ord").agg(F.min("line_no").alias("header"))  # reaches all splits of the file
    rows = lines.join(headers, "file_ord").filter(F.col("line_no") > F.col("header")).filter(~head & (F.size(fields) >= len(columns)))
    if first == "Implementation":
        rows = rows.filter(F.trim(fields[0]).isin(*IMPLEMENTATIONS, *OLD_NAMES))
    out = []
    for i, c in enumerate(columns):
        x = F.trim(fields[i])
        out.append((to_number(x) if c.lower() in NUMERIC else x).alias(c.lower()))
    return rows.select("file_ord", "line_no", *out).na.drop("all", subset=[c.lower() for c in columns])


def read_runs(spark: SparkSession, *patterns: str) -> DataFrame:
    """implementation, graph, time_sec, gteps of all run summaries, in the order of the patterns."""
    out = None
    for k, pattern in enumerate(patterns):
        part = parse_tsv(text_lines(spark, pattern), ["Implementation", "Graph", "Time_sec", "GTEPS"], "Implementation").withColumn("pattern_ord", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; aggregated before the shuffle, unlike a window."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("f"))
    return first.select(*[c if c in keys else F.col("f")[c].alias(c) for c in rows.columns])


def first_runs(runs: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each (implementation, graph)."""
    return first_of(runs, ["implementation", "graph"], order)


def parse_scaling(lines: DataFrame) -> DataFrame:
    """impl, graph, ranks, sharp, time_sec, gteps of scaling lines: # starts a comment, the first other line is the
    header; a file in which one sharp value is not a number is rejected whole; rows without ranks or time go."""
    text = F.trim(F.split("value", "#")[0])
    kept = lines.withColumn("t", text).filter("t <> ''")
    headers = kept.groupBy("file_ord").agg(F.min("line_no").alias("header"))
    fields = F.split("t", "\t")
    rows = kept.join(headers, "file_ord").filter("line_no > header").select(
        "file_ord", "line_no", F.trim(fields[0]).alias("impl"), F.trim(F.get(fields, F.lit(1))).alias("graph"), to_number(F.get(fields, F.lit(2))).cast("int").alias("ranks"), to_number(F.get(fields, F.lit(3))).alias("sharp"), to_number(F.get(fields, F.lit(4))).alias("time_sec"), to_number(F.get(fields, F.lit(5))).alias("gteps")
    )
    bad = rows.filter("sharp IS NULL").select("file_ord").distinct()
    return rows.join(bad, "file_ord", "left_anti").withColumn("sharp", F.col("sharp").cast("int")).na.drop(subset=["ranks", "time_sec"])


def parse_catalogue(lines: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """category, name, url, directed, descr from pipe-separated lines; null or ["all"] takes every category."""
    f = F.split("value", r"\|")
    rows = lines.filter(F.size(f) >= 5).select(*[F.trim(f[i]).alias(c) for i, c in enumerate(["category", "name", "url", "directed", "descr"])])
    return rows if categories is None or "all" in categories else rows.filter(F.col("category").isin(*categories))


def parse_phases(lines: DataFrame) -> DataFrame:
    """bfs_sec, back_sec of each file: the first ``BFS: x`` and ``Backward: y``; null if there is none."""
    def first(pattern):
        found = F.regexp_extract("value", pattern, 1)
        return F.min(F.when(found != "", F.struct("line_no", found.alias("x"))))["x"].try_cast("double")

    return lines.groupBy("file_ord").agg(first(r"BFS: ([0-9.]+)").alias("bfs_sec"), first(r"Backward: ([0-9.]+)").alias("back_sec"))
