"""Similarity join of word n-gram sets through a token-group matrix.

1. Every row becomes the sorted set of its hashed n-grams; equal sets form one class, so copies cost one row from here on.
   A table of fixed size counts all n-grams by hash; it orders them from rare to frequent.
2. Classes are partitioned into groups of similar sets: of a like size and with a smallest hash in common, at most about
   ``members`` each. A group's row of the matrix is the union of its members' n-grams.
3. Links within a group are found through its own matrix, and make the first components.
4. Two linked sets share ``least_shared`` of their rarest n-grams (as many as a link may miss, and that many more). These
   are few enough to be counted exactly; by that count the most frequent ``least_shared`` - 1 of those that a set shares
   with any other are left out, and two linked sets still share one. Only groups that hold one of a set's n-grams that
   are left, of fitting sizes and of another component, are candidates. Components that are joined already
   are not joined again: first one member of each component in a group asks, then, with the components that this gives,
   all that are left. No set asks a group twice, and n-grams of one component or group are not looked at again.
5. The overlap of a set with a candidate's union bounds its overlap with each member. Only groups whose bound reaches
   the threshold are opened; their members are compared on full sets.
6. Components of all links, spread to the copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import drop_path, row_id, spread, stash, tidy
from graphloom.llm.components import connected_components
from graphloom.llm.near_dedup import _name, _root, full_sets, texts_of, with_components
from graphloom.llm.shingles import mix, shingle_sets, signed

TABLE_BITS = 18  # of the table of counts: 1 MB
SLICE = 4096
ASKERS = 256  # sets that meet one copy of a group
SORTED = 16_384  # classes of a group that one task sorts


def _cells(s: np.ndarray) -> np.ndarray:
    return (mix(s) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def least_shared(n, percent: int):
    """How many of their rarest n-grams two linked sets share, by the smaller's size: half as many as it may miss, and one.
    The rarest are one's ``n`` less the overlap that a link needs, plus this number: so many of the overlap lie among them."""
    return n * (100 - percent) // 200 + 1


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """rid, doc_id, n_shingles, node, lows (the three smallest hashes) of every row; besides, with no rid, slices of each
    task's counts: task, part, counts."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << TABLE_BITS, dtype=np.int64)
        for batch in batches:
            out, held, size = [], [], 0
            for s in shingle_sets(batch.text, width):
                held.append(s)
                size += len(s)
                if size >= 1 << 20:
                    table += np.bincount(_cells(np.concatenate(held)), minlength=len(table))
                    held, size = [], 0
                out.append((len(s), _name(s), signed(s[:3])))
            if held:
                table += np.bincount(_cells(np.concatenate(held)), minlength=len(table))
            yield pd.DataFrame({"rid": batch.rid, "doc_id": batch.doc_id, "n_shingles": [x[0] for x in out], "node": [x[1] for x in out], "lows": [x[2] for x in out], "task": None, "part": None, "counts": None})
        parts = [(TaskContext.get().partitionId(), i, table[i * SLICE : (i + 1) * SLICE]) for i in range(len(table) // SLICE)]
        none = [None] * len(parts)
        yield pd.DataFrame({"rid": none, "doc_id": none, "n_shingles": none, "node": none, "lows": none, "task": [p[0] for p in parts], "part": [p[1] for p in parts], "counts": [p[2] for p in parts]})

    rows = docs.select(row_id().alias("rid"), F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInPandas(tidy(run), "rid long, doc_id string, n_shingles long, node long, lows array<long>, task int, part int, counts array<long>")


def frequencies(drawn: DataFrame) -> np.ndarray:
    """The table of counts over all tasks, added up in two levels."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(rows.part.iloc[0], rows.lot.iloc[0], np.sum(np.stack(rows.counts.tolist()), axis=0))], columns=["part", "lot", "counts"])

    slices = drawn.filter("part IS NOT NULL").select("part", F.pmod("task", F.lit(64)).alias("lot"), "counts")
    kind = "part int, lot int, counts array<long>"
    sums = slices.groupBy("part", "lot").applyInPandas(add, kind)
    sums = sums.withColumn("lot", F.lit(0)).groupBy("part").applyInPandas(add, kind)
    table = np.zeros(1 << TABLE_BITS, dtype=np.int64)
    for row in sums.select("part", "counts").collect():  # 2 ** TABLE_BITS numbers
        table[row["part"] * SLICE : (row["part"] + 1) * SLICE] = row["counts"]
    return table


def rarest(docs: DataFrame, width: int, percent: int, table: np.ndarray) -> DataFrame:
    """node, rare: of each class that can have a link to another, the rarest n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for batch in batches:
            out = []
            for s in shingle_sets(batch.text, width):
                if len(s) * (100 - percent) >= percent:
                    most = len(s) - -(-percent * len(s) // 100) + least_shared(len(s), percent)
                    order = np.argsort(table[_cells(s)], kind="stable")[:most]  # equal counts by ascending hash
                    out.append((_name(s), signed(s[order])))
            yield pd.DataFrame(out, columns=["node", "rare"])

    return spread(docs.select(F.col("text").cast("string").alias("text"))).mapInPandas(tidy(run), "node long, rare array<long>").dropDuplicates(["node"])


def grouped(reps: DataFrame, percent: int, members: int) -> DataFrame:
    """node, rid, n, group: classes of like size that share the one of their three smallest hashes that most classes have,
    so that a set with a few n-grams of its own stays with its like. Larger groups are cut in order of all three hashes;
    groups too large to be sorted by one task, by all three hashes and then by the class's own hash."""
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / percent))
    rows = reps.select("node", F.col("best.rid").alias("rid"), F.col("n_shingles").alias("n"), "lows", band.alias("band"))
    keys = rows.select("node", F.posexplode("lows").alias("at", "low"), "band").select("node", "at", F.xxhash64("band", "low").alias("g"))
    popular = keys.groupBy("g").agg(F.count("*").alias("c"))
    own = keys.join(popular, "g").groupBy("node").agg(F.max(F.struct("c", (-F.col("at")).alias("first"), "g")).alias("k")).select("node", "k.g")
    rows = stash(rows.join(own, "node").withColumn("all", F.xxhash64("g", "lows")), "signatures")
    large = stash(rows.groupBy("g").agg(F.count("*").alias("c1")).filter(F.col("c1") > members), "large-groups")
    rest = rows.join(large.select("g"), "g", "left_anti").select("node", "rid", "n", F.col("g").alias("group"))
    within = Window.partitionBy("g").orderBy("lows", "node")
    sortable = rows.join(large.filter(F.col("c1") <= SORTED), "g").withColumn("chunk", F.floor((F.row_number().over(within) - 1) / members))
    vast = rows.join(large.filter(F.col("c1") > SORTED), "g")
    larger = vast.groupBy("all").agg(F.count("*").alias("c2")).filter(F.col("c2") > members)
    dealt = F.xxhash64("all", F.when(F.col("c2").isNotNull(), F.pmod(F.xxhash64("node"), F.ceil(2 * F.col("c2") / members))))
    vast = vast.join(larger, "all", "left").select("node", "rid", "n", dealt.alias("group"))
    return rest.union(sortable.select("node", "rid", "n", F.xxhash64("g", "chunk").alias("group"))).union(vast)


class Matrix:
    """The token-group matrix of one group: its union of n-grams, and which members hold each."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        self.owner, values = np.repeat(np.arange(len(sets)), self.sizes)[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        self.union, self.at = values[first], np.append(first, len(values))

    def held(self, own: np.ndarray) -> np.ndarray:
        """Places in the union of those of ``own`` that it holds: their number bounds the overlap with any member."""
        at = np.minimum(np.searchsorted(self.union, own), len(self.union) - 1)
        return at[self.union[at] == own]

    def opened(self, held: np.ndarray) -> np.ndarray:
        """The overlap with each member."""
        low, n = self.at[held], self.at[held + 1] - self.at[held]
        place = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.owner[place], minlength=len(self.sizes))


def links_to(matrix: Matrix, nodes: list[int], comps: list[int], asking: Iterable[tuple[int, int, np.ndarray]], percent: int) -> Iterator[tuple[int, int]]:
    """Links of the ``asking`` sets (node, component, n-grams) to members of other components, enough to join all that have one."""
    parent: dict[int, int] = {}
    for node, comp, own in asking:
        held = matrix.held(own)
        if 100 * len(held) < percent * len(own):
            continue
        shared = matrix.opened(held)
        for j in np.flatnonzero(100 * shared >= percent * (len(own) + matrix.sizes - shared)).tolist():
            a, b = _root(parent, comp), _root(parent, comps[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield node, nodes[j]


def links_within(groups: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: links within ``groups`` (rid, node, group), enough to join what they join. Texts move to their group, which
    are smaller than their sets."""

    def solve(nodes: list[int], held: list[np.ndarray]) -> list[tuple[int, int]]:
        return list(links_to(Matrix(held), nodes, nodes, zip(nodes, nodes, held, strict=True), percent)) if len(nodes) > 1 else []

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, nodes, held = None, [], []
        for batch in batches:
            out = []
            for g, node, own in zip(batch.group, batch.node, shingle_sets(batch.text, width), strict=True):
                if g != group:
                    out += solve(nodes, held)
                    group, nodes, held = g, [], []
                nodes.append(node)
                held.append(own)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(solve(nodes, held), columns=["a", "b"], dtype="int64")

    rows = texts_of(docs, groups).select("group", "node", "text")
    return rows.repartition("group").sortWithinPartitions("group", "node").mapInPandas(tidy(run), "a long, b long")


def candidates(asking: DataFrame, rows: DataFrame, sizes: DataFrame, percent: int, star: bool) -> DataFrame:
    """node, group: sets of ``asking`` and groups that share one of their rarest n-grams, may fit in size and hold a larger
    component (of two, the set of the smaller one asks). Both tables: token, node, n, group, comp, weight. ``star``: of an
    n-gram's groups, one with the largest component alone is asked."""
    others = rows.groupBy("token", "group").agg(F.max(F.struct("weight", "comp")).alias("most"))
    if star:
        others = others.groupBy("token").agg(F.max(F.struct("most", "group")).alias("o")).select("token", "o.most", "o.group")
    others = others.join(sizes, "group")
    others = others.select(F.col("token").alias("t"), F.col("group").alias("other"), "most", "low", "high")
    fits = (100 * F.col("n") >= percent * F.col("low")) & (100 * F.col("high") >= percent * F.col("n"))
    larger = F.col("most") > F.struct("weight", "comp")
    met = asking.join(others, (F.col("token") == F.col("t")) & (F.col("group") != F.col("other")) & larger & fits)
    return met.select("node", F.col("other").alias("group")).distinct()


def links_across(pairs: DataFrame, groups: DataFrame, comps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: links of candidate ``pairs`` (node, group), enough to join what they join."""
    parts = stash(pairs.groupBy("group").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("parts")), "asked-groups")
    inside = stash(groups.join(parts, "group").select("node", "rid", "group", "parts"), "asked-members")
    wanted = groups.join(pairs.select("node").distinct(), "node").select("rid", "node").union(inside.select("rid", "node")).distinct()
    sets = stash(full_sets(docs, stash(wanted, "wanted"), width).join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "shingles"), "sets")
    deal = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("parts")).cast("int").alias("deal")
    left = pairs.join(parts, "group").select("node", "group", deal).join(sets, "node")
    right = inside.select("node", "group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("deal")).join(sets.select("node", F.col("comp").alias("own"), F.col("shingles").alias("held")), "node")

    def run(asking: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        if len(asking) and len(members):
            asking, members = asking.sort_values("node"), members.sort_values("node")
            matrix = Matrix([np.asarray(s) for s in members.held])
            rows = zip(asking.node.tolist(), asking.comp.tolist(), map(np.asarray, asking.shingles), strict=True)
            out = list(links_to(matrix, members.node.tolist(), members.own.tolist(), rows, percent))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    found = stash(left.groupBy("group", "deal").cogroup(right.groupBy("group", "deal")).applyInPandas(run, "a long, b long"), "links-across")
    drop_path(docs.sparkSession, sets)
    return found


def similar_sets(docs: DataFrame, percent: int = 90, width: int = 3, members: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id of any atomic type, text; other columns are ignored).

    Documents are linked if 100 * intersection >= percent * union of their sets of ``width`` words lower-cased in A-Z; a
    text with fewer words has its whole sequence as one n-gram, a null text or one without words has an empty set and no
    links. ``component_id`` is the smallest id reachable. Rows with a null id take part, and have a null component only
    where no row of theirs has an id; rows that repeat an id are documents of their own. An empty table gives no rows.
    ``percent``: 50 to 99.
    """
    if not 50 <= percent <= 99:
        raise ValueError("percent must be between 50 and 99")
    mixed = stash(profiles(docs, width), "profiles")
    drawn = mixed.filter("part IS NULL").select("rid", F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_shingles", "node", "lows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "rid")).alias("best")
    reps = stash(drawn.filter("n_shingles > 0").groupBy("node").agg(best, F.count("*").alias("n_rows"), F.first("n_shingles").alias("n_shingles"), F.first("lows").alias("lows")), "classes")
    groups = stash(grouped(reps.filter(F.col("n_shingles") * (100 - percent) >= percent), percent, members), "groups")
    sizes = stash(groups.groupBy("group").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("c")), "group-sizes")
    several = stash(groups.join(sizes.filter("c > 1"), "group", "left_semi"), "grouped")
    links = stash(links_within(several.select("rid", "node", "group"), docs, width, percent), "links-within")
    found = connected_components(links)

    tokens = rarest(docs, width, percent, frequencies(mixed)).select("node", F.explode("rare").alias("token"))
    # most n-grams are one set's alone: they are counted where they meet, and go no further
    held = tokens.withColumn("c", F.count("*").over(Window.partitionBy("token"))).filter("c > 1")
    # the smallest by (c, token) of what two sets share is in both sets' rows after each has dropped its last ones
    own = Window.partitionBy("node")
    ranked = held.withColumn("shared", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("c", "token")))
    ranked = ranked.join(groups.select("node", "n", "group"), "node")
    half = F.floor(F.col("n") * (100 - percent) / 200)  # least_shared less one
    held = stash(ranked.filter(F.col("place") <= F.col("shared") - half).select("token", "node", "n", "group"), "token-groups")
    asked = None
    for members_ask, star in ((False, True), (False, False), (True, False)):
        comps = found.withColumnRenamed("component", "comp")
        weights = comps.groupBy("comp").agg(F.count("*").alias("weight"))
        rows = held.join(comps.join(weights, "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node")).withColumn("weight", F.coalesce("weight", F.lit(1)))
        split = rows.groupBy("token").agg(F.min("group").alias("g1"), F.max("group").alias("g2"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("g1 <> g2 AND c1 <> c2").select("token")
        rows = stash(rows.join(split, "token", "left_semi"), "open-tokens")
        held = rows.select("token", "node", "n", "group")  # an n-gram of one group or component stays one's
        asking = rows
        if not members_ask:
            asking = rows.join(rows.groupBy("group", "comp").agg(F.min("node").alias("node")).select("node"), "node", "left_semi")
        pairs = candidates(asking, rows, sizes.drop("c"), percent, star)
        pairs = stash(pairs if asked is None else pairs.join(asked, ["node", "group"], "left_anti"), "candidates")
        asked = pairs if asked is None else asked.union(pairs)
        more = None if pairs.isEmpty() else links_across(pairs, groups, comps, docs, width, percent)
        if more is not None and not more.isEmpty():
            links = links.union(more)
            found = connected_components(links)
    rows = with_components(drawn.drop("lows"), reps, found)
    return rows.select("doc_id", "n_shingles", "component_id")
