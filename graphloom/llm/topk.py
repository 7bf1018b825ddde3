"""Exact top-k inner-product search by a Voronoi join.

Data and queries are grouped by their nearest pivot. For every data group the summary keeps its radius and the
distances of its members nearest to the pivot. Since q.x = q.p + q.(x - p), a member at distance d from pivot p scores
between q.p - |q| d and q.p + |q| d.

1. A query is solved in the groups whose pivots suit it best, enough of them for k rows. Its k-th score there, or the
   k-th best lower bound over all groups if that is higher, is a threshold that its result must reach.
2. It is then sent to those other groups whose upper bound reaches the threshold, and to no others.

Queries travel in blocks of like ones (those whose pivots share a nearest coarse pivot), and groups of data in bundles of
like ones. A query goes to a bundle once, with the groups that it asks for; the rows of a group are copied to the blocks
that ask for it only. A part of a bundle and a block meet in one task, which keeps k rows a query, none below the query's
threshold. Scores are integers, so bounds (kept with a margin for rounding) never lose a row. What a task holds is bounded
by ``CELLS`` at a time, whatever the number of groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import stash, tidy

EXACT = float(2**52)  # float64 sums of integers up to here are exact
CELLS = 1_000_000  # numbers in a task's largest array: queries times bounds, or queries times data


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v, the integers floor(scale * component); vectors that are null or hold a null or non-finite component go."""
    x = F.col("embedding")
    valid = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.filter(valid).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column: Iterable, width: int) -> np.ndarray:
    """Vectors as rows of int64; shorter ones are padded with zeros."""
    rows = list(column)
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of rows of a and b, as doubles where these hold them."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < EXACT:
        return a.astype(np.float64) @ b.T.astype(np.float64)
    return a @ b.T


def _largest(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of every query, ties to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))[: len(query)]
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[place < k], ids[place < k], scores[place < k]


def best_of(q: pd.DataFrame, x: pd.DataFrame, width: int, k: int) -> pd.DataFrame:
    """query_id, vec_id, score: the k best rows of ``x`` (cell, vec_id, v) for every row of ``q`` (query_id, v, cells, least),
    among the cells that it asks for; scores below ``least`` (null: none) may be left out."""
    if not len(q) or not len(x):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    names, asking = q.query_id.to_numpy(dtype=np.int64), _matrix(q.v, width)
    floor = np.array([np.iinfo(np.int64).min if pd.isna(s) else int(s) for s in q.least], dtype=np.int64)
    which = np.concatenate([np.asarray(c, dtype=np.int64) for c in q.cells])
    order = np.argsort(which, kind="stable")
    which, who = which[order], np.repeat(np.arange(len(q)), [len(c) for c in q.cells])[order]
    x = x.sort_values("cell", kind="stable")
    ids, data, cell = x.vec_id.to_numpy(dtype=np.int64), _matrix(x.v, width), x.cell.to_numpy()
    begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    kept, waiting = [(np.zeros(0, dtype=np.int64),) * 3], 0
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(cell)], strict=True):
        askers = who[np.searchsorted(which, cell[a]) : np.searchsorted(which, cell[a], side="right")]
        step = max(1, CELLS // (b - a))
        for s in range(0, len(askers), step):
            own = askers[s : s + step]
            scores = _products(asking[own], data[a:b])
            hits = scores >= floor[own][:, None]
            if b - a > k + 1 and np.count_nonzero(hits) > 4 * k * len(own):  # the query's own row may be among the k + 1
                hits &= scores >= np.partition(scores, b - a - k - 1, axis=1)[:, b - a - k - 1][:, None]
            row, col = np.nonzero(hits & (names[own][:, None] != ids[a:b][None, :]))
            kept.append((own[row], ids[a:b][col], scores[row, col].astype(np.int64)))
            waiting += len(row)
            if waiting > CELLS:
                kept, waiting = [_largest(*map(np.concatenate, zip(*kept, strict=True)), k)], 0
                at, n = np.unique(kept[0][0], return_counts=True)
                last = np.cumsum(n) - 1
                floor[at[n == k]] = np.maximum(floor[at[n == k]], kept[0][2][last[n == k]])
    query, ids, scores = _largest(*map(np.concatenate, zip(*kept, strict=True)), k)
    return pd.DataFrame({"query_id": names[query], "vec_id": ids, "score": scores})


def _norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a.astype(np.float64) ** 2).sum(axis=1))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def top_products(vectors: DataFrame, is_query, k: int = 20, max_pivots: int = 2048, part_rows: int = 16_384, query_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of every query row with every other row.

    ``vectors``: vec_id, v (array of longs). Ties go to the smaller vec_id; a query never meets its own vec_id; rows that
    repeat a vec_id count once (the smallest vector); with fewer than k candidates all are returned; empty vectors
    score 0; an empty table gives no rows. There are as many pivots as the root of the number of rows; ``max_pivots`` bounds
    them and so the summary on the driver. ``part_rows``: data rows, and ``query_block``: queries that meet in a task, about.
    """
    spark = vectors.sparkSession
    rows = stash(vectors.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    width = max(1, width)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(max_pivots, math.isqrt(n)))).toPandas()
    pivots = _matrix(picked.v, width).astype(np.float64)
    step = max(1, CELLS // max(len(pivots), width))

    def assign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), step):
                own = batch.iloc[s : s + step]
                x = _matrix(own.v, width).astype(np.float64)
                cell = nearest(x, pivots)
                yield own.assign(cell=cell.astype(np.int32), far=_norms(x - pivots[cell]))

    grouped = stash(rows.mapInPandas(tidy(assign), "vec_id long, v array<long>, cell int, far double"), "cells")
    # per group: rows, radius, and the k + 1 smallest distances (one of them may be the query itself)
    by_far = Window.partitionBy("cell", "bucket").orderBy("far")
    close = grouped.withColumn("bucket", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("place", F.row_number().over(by_far)).filter(F.col("place") <= k + 1)
    close = close.groupBy("cell").agg(F.slice(F.array_sort(F.collect_list("far")), 1, k + 1).alias("near"))  # at most 64 * (k + 1) values
    summary = grouped.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).join(close, "cell").orderBy("cell").collect()
    cells = np.array([s.cell for s in summary])
    sizes = np.array([s.n for s in summary])
    radius = np.array([s.radius for s in summary])
    near = np.concatenate([s.near for s in summary])
    near_cell = np.repeat(np.arange(len(summary)), [len(s.near) for s in summary])
    queries = grouped.filter(is_query)
    asking = {r.cell: r["count"] for r in queries.groupBy("cell").count().collect()}
    n_blocks = max(1, -(-sum(asking.values()) // query_block))
    coarse = nearest(pivots, pivots[:n_blocks])  # of each pivot
    # blocks and bundles of like groups; a block of too many queries is cut by a hash
    in_block = np.bincount(coarse, weights=[asking.get(c, 0) for c in range(len(pivots))], minlength=n_blocks)
    cuts = np.maximum(1, -(-in_block.astype(np.int64) // (2 * query_block)))
    first_block = np.cumsum(cuts) - cuts
    like = np.lexsort((cells, coarse[cells]))
    bundle = np.empty(len(cells), dtype=np.int64)
    bundle[like] = (np.cumsum(sizes[like]) - sizes[like]) // part_rows
    parts = np.maximum(1, -(-np.bincount(bundle, weights=sizes).astype(np.int64) // part_rows))

    def route(batches: Iterable[pd.DataFrame], first: bool) -> Iterator[pd.DataFrame]:
        centre = pivots[cells]
        for batch in batches:
            step = max(1, CELLS // max(len(near_cell), width))
            for s in range(0, len(batch), step):
                own = batch.iloc[s : s + step]
                q = _matrix(own.v, width).astype(np.float64)
                length, at = _norms(q), q @ centre.T
                order = np.argsort(-at, axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                best = np.zeros(at.shape, dtype=bool)  # the groups with the best pivots, until they hold k others
                np.put_along_axis(best, order, before < k + 1, axis=1)
                if first:
                    who, which = np.nonzero(best)
                else:
                    low = at[:, near_cell] - length[:, None] * near[None, :]
                    floor = own.least.to_numpy(dtype=np.float64, na_value=-math.inf)
                    if low.shape[1] > k:
                        # the (k+1)-th best: the query's own row may be above
                        floor = np.maximum(floor, -np.partition(-low, k, axis=1)[:, k])
                    reaches = at + length[:, None] * radius[None, :] >= floor[:, None] - 1e-6 * (1 + np.abs(floor[:, None]))
                    who, which = np.nonzero(reaches & ~best)
                of = coarse[own.cell.to_numpy()]
                block = first_block[of] + own["deal"].to_numpy() % cuts[of]
                yield pd.DataFrame({"cell": cells[which], "bundle": bundle[which], "block": block[who], "query_id": own.vec_id.to_numpy()[who]})

    counts = spark.createDataFrame([(int(c), int(b), int(parts[b])) for c, b in zip(cells, bundle, strict=True)], "cell int, bundle int, parts int")
    counts = stash(counts, "cell-parts")
    dealt = grouped.join(F.broadcast(counts), "cell").select("cell", "bundle", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "v")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def solved(asking: DataFrame, first: bool) -> DataFrame:
        """``asking``: vec_id, v, cell, least."""
        asking = asking.withColumn("deal", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(1 << 30)))
        asked = asking.mapInPandas(tidy(lambda batches: route(batches, first)), "cell int, bundle int, block int, query_id long")
        asked = stash(asked, "asked")
        wanted = asked.select("cell", F.col("block").alias("to_block")).distinct()
        sent = asked.groupBy("bundle", "block", "query_id").agg(F.collect_list("cell").alias("cells"))
        sent = sent.join(asking.select(F.col("vec_id").alias("query_id"), "v", "least"), "query_id")
        left = sent.join(F.broadcast(counts.select("bundle", "parts").distinct()), "bundle").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = dealt.select(F.col("cell").alias("c"), F.col("bundle").alias("b"), F.col("part").alias("p"), "vec_id", F.col("v").alias("x")).join(wanted, F.col("c") == F.col("cell")).drop("cell")
        met = left.select("bundle", "part", "block", "query_id", "v", "cells", "least").groupBy("bundle", "part", "block").cogroup(right.groupBy("b", "p", "to_block"))
        best = met.applyInPandas(lambda q, x: best_of(q, x.rename(columns={"c": "cell", "x": "v"}), width, k), "query_id long, vec_id long, score long")
        return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    found = stash(solved(queries.withColumn("least", F.lit(None).cast("long")), True), "best-groups")
    least = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
    later = queries.join(least.select(F.col("query_id").alias("vec_id"), "least"), "vec_id", "left")
    both = found.drop("rank").unionByName(solved(later, False).drop("rank"))
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
