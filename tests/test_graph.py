"""Closed forms, strategies against each other and invariants of centrality; clean edge lists and file round trips."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import compare, etl, generators, graph, paths
from graphloom.operators.centrality import betweenness, most_central
from graphloom.sources import graph_files, sinks
import small_inputs

GOLDEN = {
    "path4": ([(0, 1), (1, 2), (2, 3)], 4, {0: 0, 1: 2, 2: 2, 3: 0}),
    "star5": ([(0, i) for i in range(1, 6)], 6, {0: 10, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0}),
    "cycle4": ([(0, 1), (1, 2), (2, 3), (3, 0)], 4, {i: 0.5 for i in range(4)}),
    "cycle5": ([(i, (i + 1) % 5) for i in range(5)], 5, {i: 1 for i in range(5)}),
    "complete4": ([(i, j) for i in range(4) for j in range(i)], 4, {i: 0 for i in range(4)}),
    "two_parts": ([(0, 1), (1, 2), (3, 4), (4, 5)], 6, {0: 0, 1: 1, 2: 0, 3: 0, 4: 1, 5: 0}),
    "isolated": ([(0, 1), (1, 2), (2, 3)], 5, {0: 0, 1: 2, 2: 2, 3: 0, 4: 0}),
    "parallel": ([(0, 1), (0, 1), (1, 3), (0, 2), (2, 3)], 4, {0: 2 / 3, 1: 2 / 3, 2: 1 / 3, 3: 1 / 3}),
}


def build(spark, pairs, n):
    arcs = [*pairs, *[(b, a) for a, b in pairs]]
    return graph.Graph(spark.range(n), spark.createDataFrame(arcs, "src long, dst long"))


def result(bc):
    return {r.v: r.bc for r in bc.collect()}


@pytest.mark.parametrize("strategy", ["kernel", "relational"])
@pytest.mark.parametrize("name", ["star5", "cycle5", "two_parts", "isolated", "parallel"])
def test_golden(spark, strategy, name):
    pairs, n, want = GOLDEN[name]
    assert result(betweenness(build(spark, pairs, n), strategy)) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("name", ["path4", "cycle4", "complete4"])
def test_golden_kernel(spark, name):
    pairs, n, want = GOLDEN[name]
    assert result(betweenness(build(spark, pairs, n))) == pytest.approx(want, abs=1e-9)


def test_empty_graph(spark):
    g = build(spark, [], 0)
    assert result(betweenness(g, "kernel")) == {}
    assert tuple(most_central(betweenness(g, "kernel")).first()) == (-1, -1.0)


def test_ties_take_the_smallest_vertex(spark):
    bc = spark.createDataFrame([(5, 2.0), (3, 2.0), (9, 1.0)], "v long, bc double")
    assert tuple(most_central(bc).first()) == (3, 2.0)


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        betweenness(build(spark, [], 1), "guess")


def test_sum_of_centrality_and_renaming(spark):
    """The sum over vertices is the sum of d - 1 over pairs, and names do not matter."""
    rng = random.Random(2)
    pairs = sorted({tuple(sorted(rng.sample(range(24), 2))) for _ in range(40)})
    g = build(spark, pairs, 24)
    bc = result(betweenness(g, "kernel"))
    far = paths.bfs(g, g.vertices).filter("s < v").agg(F.sum(F.col("d") - 1)).first()[0]
    assert sum(bc.values()) == pytest.approx(far)
    named = {v: 1000 - 7 * v for v in range(24)}
    other = graph.Graph(spark.createDataFrame([(x,) for x in named.values()], "id long"), spark.createDataFrame([(named[a], named[b]) for p in pairs for a, b in (p, p[::-1])], "src long, dst long"))
    assert result(betweenness(other, "kernel")) == pytest.approx({named[v]: x for v, x in bc.items()})
    assert result(betweenness(g, "relational", batch=5)) == pytest.approx(bc)


def test_lattice_paths(spark):
    g = generators.grid(spark, 25)
    found = paths.shortest_path_counts(g, spark.createDataFrame([(0,)], "id long"), direction="auto").filter("v = 24").first()
    assert (found.d, found.sigma) == (8, math.comb(8, 4))


def test_directed(spark):
    g = graph.Graph(spark.range(3), spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"), directed=True)
    assert result(betweenness(g, "kernel")) == {0: 0, 1: 1, 2: 0}
    assert result(betweenness(g, "relational")) == {0: 0, 1: 1, 2: 0}


def test_comparator(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 0.0), (3, 5.0)], "v long, bc double")
    b = spark.createDataFrame([(0, 1.0), (1, 2.1), (2, float("nan")), (4, 5.0)], "v long, bc double")
    assert compare.summary(a, a).first()["pass"]
    r = compare.summary(a, b).first()
    assert (r.n, r.n_fail, r.n_nan, r["pass"]) == (5, 4, 1, False)
    assert r.max_rel == pytest.approx(0.05) and r.abs_at_max_rel == pytest.approx(0.1)
    assert [x.v for x in compare.first_failures(a, b, k=2).collect()] == [1, 2]


def test_cleaning(spark):
    done = etl.clean(small_inputs.edge_lines(spark).limit(11))
    assert sorted(map(tuple, done.graph.edges.collect())) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert sorted(map(tuple, done.mapping.collect())) == [(10, 0), (20, 1), (30, 2)]
    assert tuple(done.lines.first()) == (11, 1, 3, 2)


def test_csr_round_trip(spark, tmp_path):
    g = build(spark, GOLDEN["path4"][0], 5)
    sinks.write_csr(g, f"{tmp_path}/csr")
    text = " ".join(r.value for r in spark.read.text(f"{tmp_path}/csr").collect())
    assert text.split() == "5 3 0 1 3 5 6 6 1 0 2 1 3 2".split()
    back = graph_files.read_csr(spark, f"{tmp_path}/csr")
    assert sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, g.edges.collect()))
    assert back.vertices.count() == 5 and not back.directed
    assert tuple(graph_files.csr_header(spark, f"{tmp_path}/csr").first()) == (5, 3)


def test_broken_csr(spark, tmp_path):
    (tmp_path / "bad").write_text("2 1\n0 1 3\n1 0\n")
    with pytest.raises(Exception, match="disagree"):
        graph_files.read_csr(spark, str(tmp_path / "bad")).edges.collect()


def test_dump_round_trip(spark, tmp_path):
    bc = spark.createDataFrame([(0, 0.1), (1, 1 / 3)], "v long, bc double")
    sinks.write_dump(bc, f"{tmp_path}/dump", "kernel", "tiny")
    got = graph_files.read_dump(spark, f"{tmp_path}/dump").collect()
    assert sorted((r.impl, r.graph, r.v, r.bc) for r in got) == [("kernel", "tiny", 0, 0.1), ("kernel", "tiny", 1, pytest.approx(1 / 3))]


def test_random_graphs(spark):
    g = generators.erdos_renyi(spark, 400, 0.02, seed=1)
    s = graph.degree_stats(g).first()
    assert abs(s.m - 0.02 * 400 * 399 / 2) < 160
    assert sorted(map(tuple, generators.erdos_renyi(spark, 400, 0.02, seed=1).edges.collect())) == sorted(map(tuple, g.edges.collect()))
    assert graph.degree_stats(generators.erdos_renyi(spark, 9, 1.0)).first().m == 36
    assert graph.degree_stats(generators.erdos_renyi(spark, 9, 0.0)).first().isolated == 9
    ba = generators.barabasi_albert(spark, 2000, 3)
    degree = {r.id: r.degree for r in graph.degrees(ba).collect()}
    assert min(degree.values()) >= 3 and sum(degree.values()) == 2 * (6 + 1996 * 3) and max(degree.values()) > 60
    spread_out = generators.barabasi_albert(spark.newSession(), 2000, 3)
    assert {tuple(r) for r in ba.edges.collect()} == {tuple(r) for r in spread_out.edges.repartition(7).collect()}
    assert {tuple(r) for r in generators.barabasi_albert(spark, 4, 3).edges.collect()} == {(i, j) for i in range(4) for j in range(4) if i != j}


def test_numbers_over_many_buckets(spark):
    ids = spark.range(1000).select((F.col("id") * 13 + 5).alias("x"))
    got = {r.orig_id: r.id for r in graph.numbered(ids, buckets=16).collect()}
    assert got == {13 * i + 5: i for i in range(1000)}


def test_consecutive_rows_cross_days(spark):
    rows = spark.createDataFrame([(1, 10, 1), (2, 20, 1), (3, 30, 5), (4, 40, 9), (5, 50, 9)], "t long, u long, day int")
    assert sorted(map(tuple, graph.consecutive(rows, "u", ["t"], "day").collect())) == [(10, 20), (20, 30), (30, 40), (40, 50)]
