"""Report tables and figure series over benchmark runs; every report is a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import base_name, efficiency, format_nodes, ideal_time, on_off, ratio, ratio_percent
from graphloom.sources.run_files import IMPLEMENTATIONS, OLD_NAMES

#: Theoretical peaks in GB/s and labels of transfer types.
TRANSFERS = [
    ("HBM3_DtoD", 4020, "HBM3 D->D"),
    ("Pinned_HtoD", 900, "Pinned H->D"),
    ("Pinned_DtoH", 900, "Pinned D->H"),
    ("NVLink_C2C_Prefetch", 900, "NVLink-C2C"),
]
ABLATION = IMPLEMENTATIONS[2:]


def transfers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSFERS, "transfer_type string, peak_gbs int, label string")


def with_metadata(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds graph_base and nodes (0 where unknown); ``sizes`` has a row a known graph."""
    based = runs.withColumn("graph_base", base_name(F.col("graph")))
    return based.join(sizes.select("graph_base", "nodes"), "graph_base", "left").withColumn("nodes", F.coalesce("nodes", F.lit(0)))


def canonical(runs: DataFrame) -> DataFrame:
    """Older names of implementations become the canonical ones."""
    names = F.create_map(*[F.lit(x) for pair in zip(OLD_NAMES, IMPLEMENTATIONS, strict=True) for x in pair])
    return runs.withColumn("implementation", F.coalesce(names[F.col("implementation")], F.col("implementation")))


def in_order(rows: DataFrame, *order) -> DataFrame:
    """Adds ``place`` (from 1) in the given order. Reports have a row a graph or less, so one task numbers them."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def by_size(rows: DataFrame, graph: str = "graph_base") -> DataFrame:
    """Report rows in order of nodes, then name."""
    return in_order(rows, "nodes", graph)


def by_label(table: DataFrame, kinds: DataFrame) -> DataFrame:
    """Rows of a table by transfer in the order of the known transfers; unknown ones last, by name."""
    known = kinds.select(F.col("label").alias("transfer"), (-F.col("peak_gbs")).alias("rank"))
    return in_order(table.join(known, "transfer", "left"), F.col("rank").asc_nulls_last(), "transfer").drop("rank")


def implementations(runs: DataFrame) -> DataFrame:
    """implementation, place of those in ``runs``: canonical names in their order; older names only where no canonical one
    occurs, else among the unknown ones, which come last by name."""
    present = runs.select("implementation").distinct()
    anchor = Window.partitionBy(F.lit(1))
    new = F.array_position(F.array(*[F.lit(x) for x in IMPLEMENTATIONS]), F.col("implementation"))
    old = F.array_position(F.array(*[F.lit(x) for x in OLD_NAMES]), F.col("implementation"))
    rows = present.withColumn("new", new).withColumn("any_new", F.max(new).over(anchor) > 0)
    rank = F.when(F.col("new") > 0, F.col("new")).when(~F.col("any_new") & (old > 0), old).otherwise(len(IMPLEMENTATIONS) + 1)
    return in_order(rows.withColumn("rank", rank), "rank", "implementation").select("implementation", "place")


def peak_by_type(bandwidth: DataFrame, wanted: list[str]) -> DataFrame:
    """One row with the largest GB/s of each wanted transfer type, 0 where there is none."""
    return bandwidth.agg(*[F.coalesce(F.max(F.when(F.col("transfer_type") == t, F.col("bandwidth_gbs"))), F.lit(0.0)).alias(t) for t in wanted])


def nth_sample(rows: DataFrame, n: int, *order) -> DataFrame:
    """The n-th row in the given order, from 1; none if there are fewer."""
    return rows.orderBy(*order).offset(n - 1).limit(1)


def converted(catalogue: DataFrame, headers: DataFrame) -> DataFrame:
    """category, graph, n, m, bytes of the catalogue's graphs that have been converted; ``headers``: graph, n, m, bytes."""
    return catalogue.select("category", F.col("name").alias("graph")).join(headers, "graph").select("category", "graph", "n", "m", "bytes")


def pivot_mean(rows: DataFrame, by: list[str], kind: str, kinds: list[str], value: str) -> DataFrame:
    """A row for each ``by``, a column of the mean value for each of ``kinds``."""
    return rows.groupBy(*by).pivot(kind, kinds).agg(F.avg(value))


def _pivot(rows: DataFrame, value: str) -> DataFrame:
    out = pivot_mean(rows, ["graph_base", "nodes"], "implementation", IMPLEMENTATIONS, value)
    return out.select(F.col("graph_base").alias("graph"), format_nodes(F.col("nodes")).alias("size"), *IMPLEMENTATIONS)


def exec_time_table(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Mean seconds: a row a graph, a column an implementation."""
    return _pivot(with_metadata(runs, sizes), "time_sec")


def gteps_table(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    return _pivot(with_metadata(runs, sizes), "gteps")


def beside_baseline(rows: DataFrame, key: str, kind: str, baseline: str, value: str, out: str) -> DataFrame:
    """Each row with the value ``out`` of the baseline's rows of the same key, once for each of them."""
    base = rows.filter(F.col(kind) == baseline).select(key, F.col(value).alias(out))
    return rows.join(base, key)


def against(runs: DataFrame, sizes: DataFrame, baseline: str) -> DataFrame:
    """Runs with the baseline's seconds on the same graph and the speedup."""
    rows = beside_baseline(with_metadata(runs, sizes), "graph_base", "implementation", baseline, "time_sec", "base_time")
    return rows.withColumn("speedup", ratio(F.col("base_time"), F.col("time_sec")))


def speedup_table(runs: DataFrame, sizes: DataFrame, baseline: str) -> DataFrame:
    return _pivot(against(runs, sizes, baseline), "speedup")


def ablation_table(runs: DataFrame, sizes: DataFrame, order: list[str], relative: bool = False) -> DataFrame:
    """The first GTEPS of each graph and implementation; ``relative`` divides them by the GPU column."""
    rows = canonical(with_metadata(runs, sizes)).filter(F.col("implementation").isin(*ABLATION) & F.col("gteps").isNotNull())
    place = F.row_number().over(Window.partitionBy("graph_base", "implementation").orderBy(*order))
    table = rows.withColumn("place", place).filter("place = 1").groupBy("graph_base", "nodes").pivot("implementation", ABLATION).agg(F.first("gteps"))
    cols = [ratio(F.col(c), F.col("GPU")).alias(c) if relative else F.col(c) for c in ABLATION]
    return table.select(F.col("graph_base").alias("graph"), "nodes", *cols)


def bandwidth_table(bandwidth: DataFrame, kinds: DataFrame, size_list: list[float]) -> DataFrame:
    """Mean GB/s: a row a transfer type, a column a buffer size."""
    names = [f"gb_{s:g}".replace(".", "_") for s in size_list]
    table = bandwidth.groupBy("transfer_type").pivot("size_gb", size_list).agg(F.avg("bandwidth_gbs")).toDF("transfer_type", *names)
    return table.join(kinds, "transfer_type", "left").select(F.coalesce("label", "transfer_type").alias("transfer"), *names)


def at_largest(rows: DataFrame, column: str) -> DataFrame:
    """The rows that hold the largest value of ``column``."""
    return rows.join(F.broadcast(rows.agg(F.max(column).alias(column))), column)


def utilisation(bandwidth: DataFrame, kinds: DataFrame) -> DataFrame:
    """Measured against peak GB/s at the largest buffer."""
    return at_largest(bandwidth, "size_gb").join(kinds, "transfer_type").select(F.col("label").alias("transfer"), "bandwidth_gbs", "peak_gbs", ratio_percent(F.col("bandwidth_gbs"), F.col("peak_gbs")).alias("percent"))


def _first_time_alone(scaling: DataFrame) -> DataFrame:
    alone = F.when(F.col("ranks") == 1, F.col("time_sec"))
    return scaling.withColumn("t1", F.max(alone).over(Window.partitionBy("impl", "sharp")))


def scaling_table(scaling: DataFrame) -> DataFrame:
    """Speedup and parallel efficiency against one rank of the same implementation and switch; groups without it go."""
    rows = _first_time_alone(scaling).filter("t1 is not null")
    return rows.select("impl", "sharp", "ranks", "time_sec", ratio(F.col("t1"), F.col("time_sec")).alias("speedup"), efficiency(F.col("t1"), F.col("ranks"), F.col("time_sec")).alias("efficiency"), "gteps")


def adequacy(runs: DataFrame, phase2: DataFrame, bandwidth: DataFrame, sizes: DataFrame) -> DataFrame:
    """score, verdict: one row that rates how far a set of runs goes."""
    rows = with_metadata(runs, sizes)
    volume = runs.agg(F.countDistinct("graph").alias("n_graphs"), F.count("*").alias("n_runs"))
    seq = rows.filter(F.lower("implementation") == "sequential").select("graph_base", F.col("time_sec").alias("a"))
    opt = rows.filter(F.lower("implementation") == "gpu_opt").select("graph_base", F.col("time_sec").alias("b"))
    speed = seq.join(opt, "graph_base").agg(F.max(ratio(F.col("a"), F.col("b"))).alias("speedup"))
    known = rows.filter("nodes > 0").agg(F.countDistinct("nodes").alias("n_sizes"), F.max("nodes").alias("hi"), F.min("nodes").alias("lo"))
    facts = volume.crossJoin(speed).crossJoin(known).crossJoin(phase2.agg(F.count("*").alias("n_phase2"))).crossJoin(bandwidth.agg(F.count("*").alias("n_bandwidth")))  # one row each
    # fixed values: the limits of the rating, the points that they give, and the points of its words
    score = (
        F.when(F.col("n_graphs") >= 5, 2).when(F.col("n_graphs") >= 3, 1).otherwise(0)
        + F.when(F.col("speedup") > 100, 3).when(F.col("speedup") > 10, 2).when(F.col("speedup").isNotNull(), 1).otherwise(0)
        + F.when(F.col("n_phase2") > 0, 1).otherwise(0)
        + F.when(F.col("n_bandwidth") > 0, 1).otherwise(0)
        + F.when(F.col("n_sizes") < 4, 0).when(F.col("hi") / F.col("lo") > 100, 2).otherwise(1)
    )
    scored = facts.select(score.cast("int").alias("score"))
    return scored.select("score", F.when(F.col("score") >= 8, "Excellent").when(F.col("score") >= 5, "Good").otherwise("Insufficient").alias("verdict"))


def time_series(runs: DataFrame, sizes: DataFrame, value: str = "time_sec") -> DataFrame:
    """series, graph, nodes, y: execution time or GTEPS by graph, keyed by graph."""
    return with_metadata(runs, sizes).select(F.col("implementation").alias("series"), F.col("graph_base").alias("graph"), "nodes", F.col(value).alias("y"))


def speedup_series(runs: DataFrame, sizes: DataFrame, baseline: str) -> DataFrame:
    rows = against(runs, sizes, baseline).filter(F.col("implementation") != baseline)
    return rows.select(F.col("implementation").alias("series"), F.col("graph_base").alias("graph"), "nodes", F.col("speedup").alias("y"))


def dense_series(runs: DataFrame, sizes: DataFrame, implementations: list[str], value: str) -> DataFrame:
    """A bar for every graph and implementation, 0 where there is no run."""
    rows = canonical(with_metadata(runs, sizes)).filter(F.col("implementation").isin(*implementations))
    names = runs.sparkSession.createDataFrame([(x,) for x in implementations], "implementation string")
    means = rows.groupBy("graph_base", "nodes", "implementation").agg(F.avg(value).alias("y"))
    cells = dense(rows.select("graph_base", "nodes").distinct(), names, means, "y", 0.0)
    return cells.select(F.col("implementation").alias("series"), F.col("graph_base").alias("graph"), "nodes", "y")


def dense(left: DataFrame, right: DataFrame, cells: DataFrame, value: str, fill) -> DataFrame:
    """All combinations of the rows of two report axes, with ``value`` of the cells that exist and ``fill`` elsewhere; the
    result has as many rows as it must have. ``right`` (a few names) is an array in each row of ``left``."""
    names = right.agg(F.collect_list(F.struct(*right.columns)).alias("axis")).withColumn("k", F.lit(1))
    every = left.withColumn("k", F.lit(1)).join(names, "k").select(*left.columns, F.explode("axis").alias("x"))
    every = every.select(*left.columns, *[F.col("x")[c].alias(c) for c in right.columns])
    return every.join(cells, [*left.columns, *right.columns], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def ablation_series(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """GTEPS of each graph and implementation and its ratio to GPU; 0 if one is missing or the reference is not positive."""
    dense = dense_series(runs, sizes, ABLATION, "gteps")
    reference = F.max(F.when(F.col("series") == "GPU", F.col("y"))).over(Window.partitionBy("graph"))
    return dense.withColumn("ratio", F.when(reference > 0, F.col("y") / reference).otherwise(0.0))


def bandwidth_series(bandwidth: DataFrame, kinds: DataFrame) -> DataFrame:
    return bandwidth.join(kinds, "transfer_type").select(F.col("label").alias("series"), F.col("size_gb").alias("x"), F.col("bandwidth_gbs").alias("y"), "peak_gbs")


def batch_series(*sweeps: DataFrame) -> DataFrame:
    """Time and GTEPS by batch size and graph over all sweeps."""
    out = sweeps[0]
    for s in sweeps[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.select(base_name(F.col("graph")).alias("series"), F.col("batchsize").cast("int").alias("x"), "time_sec", "gteps")


def best_batch(sweep: DataFrame) -> DataFrame:
    """The fastest batch size of each graph, the smaller one among ties."""
    best = F.min(F.struct("time_sec", "x", "gteps")).alias("b")
    return batch_series(sweep).filter("time_sec is not null").groupBy("series").agg(best).select(F.col("series").alias("graph"), F.col("b.x").alias("batch"), F.col("b.time_sec").alias("time_sec"), F.col("b.gteps").alias("gteps"))


def scaling_series(scaling: DataFrame, weak: bool = False) -> DataFrame:
    """Time by ranks for each implementation and switch, and the ideal line from the mean time on one rank."""
    measured = scaling.select(F.concat("impl", F.lit(" ("), on_off(F.col("sharp")), F.lit(")")).alias("series"), F.col("ranks").alias("x"), F.col("time_sec").alias("y"))
    alone = scaling.agg(F.avg(F.when(F.col("ranks") == 1, F.col("time_sec"))).alias("t1")).filter("t1 is not null")
    y = F.col("t1") if weak else ideal_time(F.col("t1"), F.col("ranks"))
    line = scaling.select("ranks").distinct().crossJoin(F.broadcast(alone)).select(F.lit("ideal").alias("series"), F.col("ranks").alias("x"), y.alias("y"))
    return measured.unionByName(line)


def switch_series(scaling: DataFrame) -> DataFrame:
    """Mean time with the switch on and off by ranks; no rows unless both occur."""
    both = scaling.agg(F.countDistinct("sharp").alias("n")).filter("n > 1").drop("n")
    means = scaling.groupBy("sharp", "ranks").agg(F.avg("time_sec").alias("y"))
    return means.crossJoin(F.broadcast(both.select(F.lit(1).alias("one")))).select(on_off(F.col("sharp")).alias("series"), F.col("ranks").alias("x"), "y")


def phase_totals(phases: DataFrame) -> DataFrame:
    """Seconds by phase over all logs."""
    return phases.agg(F.sum("bfs_sec").alias("forward"), F.sum("back_sec").alias("backward")).select(F.explode(F.create_map(F.lit("forward"), F.col("forward"), F.lit("backward"), F.col("backward"))).alias("phase", "seconds"))


def measured_bandwidth(timings: DataFrame) -> DataFrame:
    """GB/s from bytes, milliseconds of all repetitions, repetitions and crossings (2 for a round trip)."""
    return timings.withColumn("bandwidth_gbs", ratio(F.col("bytes") / 1e9 * F.col("crossings"), F.col("ms") / 1000 / F.col("reps")))
