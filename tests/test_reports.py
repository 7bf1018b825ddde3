"""Dirty logs, report tables and writers."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars
from graphloom.plans import catalogue, reports
from graphloom.sources import run_files, sinks
import small_inputs

DIRTY = """noise before header
Implementation\tGraph\tTime_sec\tGTEPS
Sequential\tbenchmark_7000_41459\t4.2091\t0.0689
OpenMP\t/some/dir/benchmark_7000_41459\t0.0857\t3.3868
Implementation\tGraph\tTime_sec\tGTEPS
unknown_impl\tg\t1\t1
GPU\tbenchmark_7000_41459\tnot_a_number\t0.9210
GPU\tshort_row
GPU_Opt\tbenchmark_7000_41459\t0.2142\t1.3551\textra
"""


def test_dirty_file(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(DIRTY)
    (tmp_path / "b.tsv").write_text(DIRTY)
    rows = run_files.read_runs(spark, str(tmp_path / "*.tsv"))
    assert rows.count() == 8
    first = run_files.first_runs(rows, ["pattern_ord", "file_ord", "line_no"])
    got = {r.implementation: (r.time_sec, r.gteps, r.file_ord) for r in first.collect()}
    assert got == {"Sequential": (4.2091, 0.0689, 1), "OpenMP": (0.0857, 3.3868, 1), "GPU": (None, 0.921, 1), "GPU_Opt": (0.2142, 1.3551, 1)}


def test_missing_file(spark, tmp_path):
    assert run_files.read_runs(spark, str(tmp_path / "none.tsv")).count() == 0


def test_scaling_file(spark):
    head = (1, 0, "Impl\tGraph\tRanks\tSHARP\tTime_sec\tGTEPS")
    good = [(1, 1, "# note"), (1, 2, "a\tg\t1\t0\t8.0\t1"), (1, 3, "a\tg\t2\t1\t5.0\tx"), (1, 4, "a\tg\tz\t1\t5.0\t1")]
    bad = [(2, 0, head[2]), (2, 1, "a\tg\t1\t0\t8.0\t1"), (2, 2, "a\tg\t2\tx\t5.0\t1")]
    got = run_files.parse_scaling(small_inputs.lines(spark, [head, *good, *bad]))
    assert sorted((r.ranks, r.sharp, r.time_sec, r.gteps) for r in got.collect()) == [(1, 0, 8.0, 1.0), (2, 1, 5.0, None)]


def test_catalogue_and_phases(spark):
    rows = small_inputs.lines(spark, [(1, 0, "medium|a|http://x|directed|text"), (1, 1, "large|b|http://y|undirected|t"), (1, 2, "bad")])
    assert [r.name for r in run_files.parse_catalogue(rows, ["large"]).collect()] == ["b"]
    assert run_files.parse_catalogue(rows, ["all"]).count() == 2
    log = small_inputs.lines(spark, [(1, 0, "start"), (1, 1, "BFS: 1.5 s Backward: 2"), (1, 2, "BFS: 9"), (2, 0, "none")])
    assert {(r.file_ord, r.bfs_sec, r.back_sec) for r in run_files.parse_phases(log).collect()} == {(1, 1.5, 2.0), (2, None, None)}


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.format_nodes(F.lit(1_971_281)).alias("a"), scalars.format_nodes(F.lit(56_438)).alias("b"), scalars.format_nodes(F.lit(7)).alias("c"), scalars.ratio(F.lit(1.0), F.lit(0.0)).alias("d"), scalars.cell(F.lit(None).cast("double"), 2).alias("e"), scalars.cell(F.lit(1.239), 2, "x").alias("f"), scalars.batch_size(F.lit(100.0), F.lit(1000.0)).alias("g"), scalars.batch_size(F.lit(1e9), F.lit(1.0)).alias("h"), scalars.batch_size(F.lit(1e9), F.lit(1.0), override=64).alias("i"), scalars.gteps(F.lit(7000), F.lit(41459), F.lit(4.2091)).alias("j")
    ).first()
    assert tuple(row)[:9] == ("1.97M", "56K", "7", None, "--", "1.24x", 1, 1024, 64)
    assert row.j == pytest.approx(0.0689, abs=1e-4)


def test_tables_and_writers(spark, tmp_path):
    runs = spark.createDataFrame([("Sequential", "d/a", 4.0, 0.5), ("GPU", "a", 0.3, 1.0), ("GPU", "b", 2.0, 3.0)], "implementation string, graph string, time_sec double, gteps double")
    sizes = spark.createDataFrame([("a", 7000, 41459)], "graph_base string, nodes long, edges long")
    table = reports.speedup_table(runs, sizes, "Sequential").orderBy("graph")
    text = sinks.latex(table, "Speedup", "tab:s", 2, r"$\times$")
    assert r"13.33$\times$" in text and "--" in text
    sinks.write_table(table, f"{tmp_path}/t", 2)
    assert "13.33" in "".join(r.value for r in spark.read.text(f"{tmp_path}/t").collect())
    sinks.append_runs(runs, f"{tmp_path}/r")
    sinks.append_runs(runs, f"{tmp_path}/r")
    assert spark.read.text(f"{tmp_path}/r").count() == 2 * runs.count()


def test_bandwidth_from_timings(spark):
    raw = spark.createDataFrame([(10**9, 2, 100.0, 5)], "bytes long, crossings int, ms double, reps int")
    assert reports.measured_bandwidth(raw).first().bandwidth_gbs == pytest.approx(100.0)


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES) <= set(entry.queries())


def test_orders_of_reports(spark):
    runs = spark.createDataFrame([("gpu",), ("GPU_Opt",), ("zeta",), ("OpenMP",), ("alpha",)], "implementation string")
    assert [r.implementation for r in reports.implementations(runs).orderBy("place").collect()] == ["OpenMP", "GPU_Opt", "alpha", "gpu", "zeta"]
    old = spark.createDataFrame([("gpu_opt",), ("gpu",), ("zeta",)], "implementation string")
    assert [r.implementation for r in reports.implementations(old).orderBy("place").collect()] == ["gpu", "gpu_opt", "zeta"]
    sizes = spark.createDataFrame([("b", 5), ("a", 5), ("c", 1)], "graph_base string, nodes long")
    assert [r.graph_base for r in reports.by_size(sizes).orderBy("place").collect()] == ["c", "a", "b"]
    assert reports.nth_sample(sizes, 4, "nodes").count() == 0


def test_overrides_only_lower_a_batch(spark):
    sizes = [scalars.batch_size(F.lit(1000.0), F.lit(10), override=o).alias(f"b{i}") for i, o in enumerate((None, 0, -3, 7, 5000))]
    assert tuple(spark.range(1).select(*sizes).first()) == (85, 85, 85, 7, 85)


def test_outputs_are_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    assert sinks.write_once(spark.range(3), path, dry_run=True) == "would write"
    assert sinks.write_once(spark.range(3), path) == "written"
    assert sinks.write_once(spark.range(9), path) == "skipped" and sinks.write_once(spark.range(9), path, dry_run=True) == "would skip"
    assert spark.read.parquet(path).count() == 3
    assert sinks.write_once(spark.range(9), path, force=True) == "written" and spark.read.parquet(path).count() == 9


def test_converted_graphs(spark, tmp_path):
    from graphloom.sources import graph_files

    (tmp_path / "g1").write_text("4 3\n0 1 3 5 6\n1 0 2 1 3 2\n")
    listed = spark.createDataFrame([("c|g1|u|d|x",), ("c|g2|u|d|x",)], "value string")
    catalogue_rows = run_files.parse_catalogue(listed)
    headers = graph_files.csr_headers(spark, f"file://{tmp_path}", ["g1", "g2"])
    assert [tuple(r) for r in reports.converted(catalogue_rows, headers).collect()] == [("c", "g1", 4, 3, 26)]


def test_dispatch_by_name(spark):
    from graphloom.operators import centrality, generators

    got = centrality.by_strategy(generators.grid(spark, 3)).groupBy("strategy").count().collect()
    assert {r.strategy for r in got} == set(centrality.STRATEGIES) and len({r["count"] for r in got}) == 1
    with pytest.raises(ValueError):
        centrality.by_strategy(generators.grid(spark, 3), "none")


NEW = ["graphs_by_size", "lowered_batches", "transfers_in_order", "peak_bandwidth", "third_sample", "runs_by_tier", "comparison_summary", "first_failures", "pass_counts"]


@pytest.mark.parametrize("name", NEW)
def test_queries_equal_their_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "customer", "nation", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, sf), con.execute(catalogue.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_registry_without_optional_modules(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "graphloom.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(catalogue.QUERIES) and set(entry.oracle_sql()) == set(catalogue.ORACLE)


def test_no_runs_beyond_the_last_size_class(spark, tmp_path):
    """As in the query's SQL, whose last class ends at 9e9 nodes."""
    from graphloom.plans import catalogue

    keys = {0: [9_000_000_000], 1: [9_000_000_000, 1], 2: [5]}
    spark.createDataFrame([(k, n) for n, ks in keys.items() for k in ks], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(n, f"N{n}") for n in keys], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    assert sorted(r.graph for r in catalogue.QUERIES["runs_by_tier"](spark, str(tmp_path)).collect()) == ["N0", "N2"]
