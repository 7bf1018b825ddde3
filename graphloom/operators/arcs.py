"""Arcs laid out for searches that join a frontier to them once a level.

Few arcs are broadcast (behind a count). More are written once as a table bucketed by their tail, so that a level moves only
its frontier: the scan side of the join has no exchange. The arcs of a vertex with more than ``cut`` of them are split over
parts, and a frontier row of such a hub is copied to each part, so that no task holds all arcs of a hub.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.storage import shared_dir, stash
from graphloom.operators.graph import Graph

BROADCAST_ARCS = 2_000_000  # of two longs: about 32 MB


@dataclass
class Arcs:
    table: DataFrame  # src, part, dst
    hubs: DataFrame | None  # hub, parts
    few: bool

    def out_of(self, rows: DataFrame, at: str = "v") -> DataFrame:
        """``rows`` with dst: a row for each arc that leaves the vertex ``at``."""
        if self.few:
            return rows.join(F.broadcast(self.table), F.col(at) == F.col("src")).drop("src", "part")
        if self.hubs is None:
            return rows.join(self.table, F.col(at) == F.col("src")).drop("src", "part")
        marked = rows.join(self.hubs, F.col(at) == F.col("hub"), "left").drop("hub")
        rows = marked.withColumn("of_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        return rows.join(self.table, (F.col(at) == F.col("src")) & (F.col("of_part") == F.col("part"))).drop("src", "part", "of_part")


def is_small(edges: DataFrame, most: int = BROADCAST_ARCS) -> bool:
    return edges.limit(most + 1).count() <= most


def laid_out(graph: Graph, most: int = BROADCAST_ARCS, cut: int = 20_000, buckets: int | None = None) -> Arcs:
    """``most``: arcs that may be broadcast; ``cut``: arcs of a vertex that stay together; ``buckets``: by default as many
    as the session's shuffle partitions."""
    spark = graph.edges.sparkSession
    edges = graph.edges.select("src", "dst")
    if is_small(edges, most):
        stored = edges if graph.stored else stash(edges, "arcs")
        return Arcs(stored.withColumn("part", F.lit(0)), None, True)
    hubs = stash(edges.groupBy(F.col("src").alias("hub")).agg(F.ceil(F.count("*") / cut).cast("int").alias("parts")).filter("parts > 1"), "hubs")
    some = not hubs.isEmpty()
    if some:
        part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("dst"), F.col("parts"))).cast("int")
        edges = edges.join(hubs, F.col("src") == F.col("hub"), "left").select("src", part.alias("part"), "dst")
    else:
        edges = edges.select("src", F.lit(0).alias("part"), "dst")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"arcs_{uuid.uuid4().hex}"
    by = ["src", "part"] if some else ["src"]
    edges.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).option("path", f"{shared_dir(spark)}/graphloom/{name}").saveAsTable(name)
    return Arcs(spark.table(name), hubs if some else None, False)
