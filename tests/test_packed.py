"""Searches inside tasks against joins, and what they leave in the shared folder."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import storage
from graphloom.operators import folding, graph, multi_source, packed, paths
from graphloom.operators.centrality import betweenness, dependencies


def random_graph(spark, n, k, seed, directed):
    """Ids with gaps, some parallel edges, some vertices alone."""
    rng = random.Random(seed)
    pairs = [(7 * a, 7 * b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(k)) if a != b]
    pairs = pairs + pairs[:5]
    both = pairs if directed else pairs + [(b, a) for a, b in pairs]
    return graph.Graph(spark.createDataFrame([(7 * i,) for i in range(n + 3)], "id long"), spark.createDataFrame(both, "src long, dst long"), directed)


def rows(df):
    return sorted(map(tuple, df.collect()))


def tables(spark):
    folder = f"{storage.shared_dir(spark)}/graphloom"
    return {x for x in os.listdir(folder) if x.startswith(("level-", "bit-", "path-arcs", "delta"))} if os.path.isdir(folder) else set()


@pytest.mark.parametrize("directed", [False, True])
def test_pairs_leave_no_tables(spark, directed):
    g = random_graph(spark, 60, 110, 4, directed)
    sources = g.vertices.filter("id % 2 = 0").union(spark.range(1, 2))  # one is no vertex
    before = tables(spark)
    counts, pairs, deep = rows(paths.shortest_path_counts(g, sources)), rows(paths.bfs(g, sources)), rows(multi_source.eccentricities(g, sources))
    sizes, shares = rows(multi_source.level_sizes(g, sources)), {(r.s, r.v): r.delta for r in dependencies(g, g.vertices).collect()}
    assert tables(spark) == before
    assert counts == rows(paths.shortest_path_counts(g, sources, most=2_000_000)) and (1, 1, 0, 1.0) in counts
    assert pairs == sorted((s, v, d) for s, v, d, _ in counts)
    assert deep == sorted((s, max(d for t, _, d in pairs if t == s)) for s in {s for s, _, _ in pairs})
    assert sizes == rows(multi_source.level_sizes(g, sources, most=2_000_000))
    assert shares == pytest.approx({(r.s, r.v): r.delta for r in dependencies(g, g.vertices, most=2_000_000).collect()})


@pytest.mark.parametrize("directed", [False, True])
def test_many_arcs_are_packed(spark, monkeypatch, directed):
    """Arcs are not counted against a broadcast: mapped from files, pulled or expanded, kept or not, all agree."""
    g = random_graph(spark, 40, 260, 5, directed)
    want = {r.v: r.bc for r in betweenness(g, "relational", batch=16).collect()}
    got = {r.v: r.bc for r in betweenness(g, "kernel").collect()}
    assert got == pytest.approx(want) and len(got) == 43
    lists = packed.Lists.__new__(packed.Lists)
    found = packed.pack(g)
    lists.n, n = len(found.ids), len(found.ids)
    lists.into, lists.out_of = (packed._lists(p, n, packed.HELD_ARCS + 1) for p in (found.into, found.out_of))
    assert isinstance(lists.into[1], np.memmap) and len(lists.into[1]) == g.edges.count()
    half = 1 if directed else 2
    for kept in (0, 10**6):
        monkeypatch.setattr(packed, "KEPT_ARCS", kept)
        total = packed.Batch(lists, np.arange(n)).dependencies().reshape(n, n).sum(axis=1) / half
        assert dict(zip(found.ids.tolist(), total.tolist(), strict=True)) == pytest.approx(want)


def test_pulls_of_hubs():
    rng = np.random.default_rng(3)
    n = 900
    degree = rng.integers(0, 40, n)
    degree[[5, 700]] = 5000, 3000
    adj = rng.integers(0, n, degree.sum()).astype(np.int32)
    lists = np.concatenate([[0], np.cumsum(degree)]), adj
    state, own = rng.random((n, 6)), np.sort(rng.choice(n, 400, replace=False))
    want = np.array([state[adj[lists[0][v] : lists[0][v + 1]]].sum(axis=0) for v in own])
    assert packed.pulled(lists, state, own, np.add) == pytest.approx(want)


def test_empty(spark):
    empty = graph.Graph(spark.range(0), spark.createDataFrame([], "src long, dst long"))
    assert rows(paths.shortest_path_counts(empty, empty.vertices)) == [] and rows(multi_source.eccentricities(empty, empty.vertices)) == []
    assert rows(betweenness(graph.Graph(spark.range(3), empty.edges), "kernel")) == [(0, 0.0), (1, 0.0), (2, 0.0)]
    assert rows(paths.bfs(graph.Graph(spark.range(3), empty.edges), spark.range(3)).select(F.col("v"))) == [(0,), (1,), (2,)]


def test_leaves_are_taken_off(spark):
    """A tree on a cycle, a path, a pair, a star and a lone vertex, with all sources and with some: as without folding; trees
    fold to a vertex each."""
    rng = random.Random(5)
    pairs = [(0, 1), (1, 2), (2, 3), (3, 0)] + [(rng.randrange(i), i) for i in range(4, 40)]
    pairs += [(50, 51), (51, 52), (52, 53), (60, 61), *[(70, i) for i in range(71, 80)]]
    ids = sorted({x for p in pairs for x in p} | {90})
    g = graph.Graph(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src long, dst long"))
    for sources in (g.vertices, g.vertices.filter("id % 3 = 0")):
        want = {r.v: r.bc for r in betweenness(g, "kernel", sources).collect()}
        less = folding.folded(g, sources)
        assert less is not None and less.core.vertices.count() < 30
        assert {r.v: r.bc for r in betweenness(g, "auto", sources).collect()} == pytest.approx(want) and len(want) == len(ids)
