"""Graphs that are derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.storage import stash
from graphloom.operators.graph import Graph, consecutive, symmetrised

SUPPLIER_AT = 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchase_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: who bought next after whom."""
    bought = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", "ts", "event_id", F.to_date("ts").alias("day"))
    return consecutive(bought, "user_id", ["ts", "event_id"], "day").filter("src <> dst").distinct()


def purchase_graph(spark: SparkSession, sf_dir: str, directed: bool = False) -> Graph:
    arcs = purchase_arcs(spark, sf_dir)
    return Graph.from_edges(stash(arcs if directed else symmetrised(arcs), "purchases"), directed, stored=True)  # read many times


def part_supplier_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts and suppliers (+ SUPPLIER_AT) that meet in a line item."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + SUPPLIER_AT).alias("dst"))
    return Graph.from_edges(stash(symmetrised(pairs), "part-suppliers"), stored=True)  # read many times


def suppliers(g: Graph) -> DataFrame:
    """id: the suppliers of a part-supplier graph."""
    return g.vertices.filter(F.col("id") >= SUPPLIER_AT)


def geography_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A forest: region, nation (+ 100), supplier (+ 1,000,000) and customer (+ 2,000,000)."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + F.lit(100)).cast("long").alias("dst"))
    supplier = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + F.lit(100)).cast("long").alias("src"), (F.col("s_suppkey") + F.lit(1_000_000)).alias("dst"))
    customer = table(spark, sf_dir, "customer").select((F.col("c_nationkey") + F.lit(100)).cast("long").alias("src"), (F.col("c_custkey") + F.lit(2_000_000)).alias("dst"))
    return Graph.from_edges(symmetrised(nation.union(supplier).union(customer)))
