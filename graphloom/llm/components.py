"""Connected components of links between documents, computed by joins; links and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import drop_path, stash


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: a, b. Returns node, component (the smallest node reachable) for every node of a link.

    Each round every node takes the smallest of its neighbours and itself, and follows such choices twice; links then
    join the chosen nodes, and links within one node go, so that later rounds only see what is not joined yet. Rounds are
    written to the shared folder. Null ends and links of a node to itself are ignored.
    """
    spark = links.sparkSession
    ok = links.filter("a is not null and b is not null and a <> b")
    edges = stash(ok.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        chosen = stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "chosen")
        for _ in range(2):
            step = chosen.select(F.col("node").alias("label"), F.col("label").alias("next"))
            chosen = chosen.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        chosen = stash(chosen, "chosen")
        if found is None:
            found = chosen
        else:
            step = chosen.select(F.col("node").alias("label"), F.col("label").alias("next"))
            found = stash(found.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        at = edges.join(chosen.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(chosen.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        after = stash(at.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        drop_path(spark, edges)
        edges = after
        if edges.isEmpty():
            return found.select("node", F.col("label").alias("component"))
