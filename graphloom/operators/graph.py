"""Graphs as two DataFrames: vertices(id) and edges(src, dst), an undirected edge being two arcs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.storage import stash


@dataclass
class Graph:
    vertices: DataFrame
    edges: DataFrame
    directed: bool = False
    stored: bool = False  # edges are a written table, cheap to read again

    @staticmethod
    def from_edges(edges: DataFrame, directed: bool = False, stored: bool = False) -> Graph:
        """Vertices are the distinct ends. Parallel edges stay; use :func:`symmetrised` for a simple graph."""
        return Graph(endpoints(edges), edges.select("src", "dst"), directed, stored)


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def symmetrised(edges: DataFrame) -> DataFrame:
    """Both arcs of every edge, once, without self-loops."""
    ok = edges.filter("src <> dst").select("src", "dst")
    return ok.union(ok.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(graph: Graph) -> DataFrame:
    """id, degree (out-degree; isolated vertices have 0)."""
    out = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return graph.vertices.join(out, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_stats(graph: Graph) -> DataFrame:
    """n, m, avg_degree, max_degree, isolated (m counts an undirected edge once)."""
    m = F.sum("degree") if graph.directed else (F.sum("degree") / 2).cast("long")
    return degrees(graph).agg(F.count("*").alias("n"), m.alias("m"), F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"), F.count_if(F.col("degree") == 0).alias("isolated"))


def adjacency(graph: Graph) -> DataFrame:
    """id, nbrs (sorted)."""
    lists = graph.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))
    return graph.vertices.join(lists, "id", "left").select("id", F.coalesce("nbrs", F.array().cast("array<long>")).alias("nbrs"))


def bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """Adds ``bucket``: ranges of ``by`` that ascend with it and hold about equally many rows, so that running sums and
    numbers can be taken bucket by bucket instead of in one task."""
    cuts = sorted(set(df.approxQuantile(by, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))))
    number = F.lit(0)
    if cuts:
        number = F.size(F.filter(F.lit([int(c) for c in cuts]), lambda c: c < F.col(by)))
    return df.withColumn("bucket", number)


def running_sum(df: DataFrame, by: str, value: str, out: str, buckets: int = 64) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows with a smaller ``by`` (unique numbers)."""
    parts = bucketed(df, by, buckets)
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over one row a bucket
    offsets = parts.groupBy("bucket").agg(F.sum(value).alias("s")).select("bucket", F.coalesce(F.sum("s").over(order), F.lit(0)).alias("before"))
    within = Window.partitionBy("bucket").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(F.broadcast(offsets), "bucket").withColumn(out, F.col("before") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("bucket", "before")


def numbered(ids: DataFrame, buckets: int | None = None) -> DataFrame:
    """orig_id, id: distinct ids re-numbered from 0 in ascending order. Rows are sorted by ranges; a row's number is its
    place in its partition, after the rows of the partitions before."""
    rows = ids.select(F.col(ids.columns[0]).alias("orig_id")).distinct()
    ranged = rows.repartitionByRange("orig_id") if buckets is None else rows.repartitionByRange(buckets, "orig_id")
    rows = ranged.sortWithinPartitions("orig_id")
    placed = stash(rows.select("orig_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "numbered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    parts = placed.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    parts = parts.select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(parts), "part").select("orig_id", (F.col("at") + F.col("shift")).alias("id"))  # a row a partition


def row_pointers(graph: Graph, buckets: int = 64) -> DataFrame:
    """id, degree, ptr (arcs before this vertex in ascending order of ids)."""
    return running_sum(degrees(graph), "id", "degree", "ptr", buckets).select("id", "degree", "ptr")


def consecutive(rows: DataFrame, value: str, order: list[str], day: str) -> DataFrame:
    """src, dst: ``value`` of every row and of the next one in ``order``.

    ``day`` is a coarse, ascending part of the order: the next row is found within it, and the last row of a part is
    joined to the first of the next part that has rows, so no task sorts the whole table.
    """
    within = Window.partitionBy(day).orderBy(*order)
    pairs = rows.withColumn("next", F.lead(value).over(within)).withColumn("place", F.row_number().over(within))
    ends = rows.groupBy(day).agg(F.count("*").alias("n"))
    marked = pairs.join(ends, day)
    firsts = marked.filter("place = 1").select(F.col(day).alias("part"), F.col(value).alias("first"))
    follow = firsts.withColumn("part_before", F.lag("part").over(Window.orderBy("part")))  # one row a day
    bridge = follow.filter("part_before is not null").select(F.col("part_before").alias(day), "first")
    last = marked.filter("place = n").join(F.broadcast(bridge), day).select(F.col(value).alias("src"), F.col("first").alias("dst"))
    return marked.filter("place < n").select(F.col(value).alias("src"), F.col("next").alias("dst")).union(last)
