"""Near-duplicate components by bottom-k sketches from one hash function.

1. Every row becomes the sorted set of its hashed shingles; equal sets form one class, named by the hash of the set, so
   copies cost one row from here on.
2. A class keeps its ``k`` smallest hashes (its sketch). Inverted lists are kept for runs of three neighbouring retained
   values: two sets that agree on most of their union share many such runs, while a passage that thousands of unrelated
   documents hold rarely fills three neighbouring places. A list pairs its classes with its smallest one and with their
   neighbours in nested hash buckets. Both depend on the class alone, so the many lists of one family draw the same few
   pairs, and a family of n classes gives O(n) of them. Sets too short for three shared neighbours have lists for the set
   and for the set without each of its values.
3. The bottom-k sketch of the union estimates the similarity of a pair; pairs far below the threshold go.
4. The remaining pairs are confirmed on the full sets. They also join classes into clusters; a cluster that the
   confirmed links do not make one component is searched exhaustively, so that no link depends on which pairs were drawn
   in step 2: classes whose sets hold too little that occurs in other components of the cluster can have no link across
   them and go; the rest meet block by block, those outside the cluster's largest component against all, through the
   rarest shingles of each (a link must share one of them).
5. Components of all links, spread to the copies.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import drop_path, row_id, spread, stash, tidy
from graphloom.llm.components import connected_components
from graphloom.llm.shingles import shingle_sets, signed

BROADCAST_ROWS = 1_000_000  # of two longs: about 16 MB
HOT_SHARE = 20_000  # a key with more than one in so many rows is hot: there are at most so many of them
FAN = 500  # pairs of a class that meet one copy of its set


def _name(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """rid, doc_id, n_shingles, node (the hash of the set), sketch (the k smallest hashes, ascending)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # a set is dropped as soon as its sketch is taken
            out = [(len(s), _name(s), signed(s[:k])) for s in shingle_sets(batch.text, width)]
            yield pd.DataFrame({"rid": batch.rid, "doc_id": batch.doc_id, "n_shingles": [x[0] for x in out], "node": [x[1] for x in out], "sketch": [x[2] for x in out]})

    rows = docs.select(row_id().alias("rid"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    drawn = spread(rows).mapInPandas(tidy(run), "rid long, doc_id string, n_shingles long, node long, sketch array<long>")
    return drawn.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def candidate_pairs(reps: DataFrame, short: int) -> DataFrame:
    """Pairs a < b of classes that share a run of retained values, or, with at most ``short`` shingles, all but one."""
    runs = F.transform(F.sequence(F.lit(1), F.size("sketch") - 2), lambda i: F.xxhash64(F.element_at("sketch", i), F.element_at("sketch", i + 1), F.element_at("sketch", i + 2)))
    rows = reps.filter(F.size("sketch") >= 3).select("node", F.explode(runs).alias("run"))
    lists = stash(rows.groupBy("run").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1"), "lists")
    limit = (reps.agg(F.sum(F.size("sketch"))).first()[0] or 0) // HOT_SHARE
    hot = F.broadcast(lists.filter(F.col("n") > limit))  # at most HOT_SHARE rows

    def drawn(rows: DataFrame) -> DataFrame:
        # nested buckets of two to four classes by leading bits of the class's own hash
        bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / 4))).cast("int")
        part = F.floor(F.expr("shiftrightunsigned(xxhash64(node), 32)") / F.pow(F.lit(2.0), 32 - bits))
        few = rows.withColumn("part", part).groupBy("run", "part").agg(F.array_sort(F.collect_set("node")).alias("few"), F.max("pivot").alias("pivot"), F.max("n").alias("n"))
        star = F.transform(F.filter("few", lambda x: x != F.col("pivot")), lambda x: F.struct(F.col("pivot").alias("a"), x.alias("b")))
        # all pairs of a list of at most four classes, chains of neighbours within buckets of longer ones
        later = F.transform("few", lambda x, i: F.transform(F.slice("few", i + 2, F.size("few")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
        chain = F.transform(F.slice("few", 2, F.size("few")), lambda y, i: F.struct(F.element_at("few", i + 1).alias("a"), y.alias("b")))
        pairs = F.when(F.col("n") <= 4, F.flatten(later)).otherwise(F.concat(star, chain))
        return few.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()

    listed = drawn(rows.join(hot, "run")).unionByName(drawn(rows.join(lists.filter(F.col("n") <= limit), "run")))
    # the sketch of a short set is the set; all members of a list hold its core, so pairs with the smallest suffice
    rests = F.transform("sketch", lambda x: F.xxhash64(F.filter("sketch", lambda y: y != x)))
    cores = reps.filter(F.col("n_shingles") <= short).select("node", F.explode(F.concat(F.array(F.xxhash64("sketch")), rests)).alias("core"))
    pivots = cores.groupBy("core").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    close = cores.join(pivots, "core").filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    return listed.union(close).distinct()


def fanned(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs with a salt of their first class, and the number of salts of classes that have more than one."""
    fan = stash(pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("salts")).filter("salts > 1"), "fan")
    return pairs.join(fan, "a", "left").select("a", "b", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("salts"))).cast("int").alias("salt")), fan


def with_both(pairs: DataFrame, fan: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """a, b, salt, x, y: the pairs with both classes' ``column``."""
    right = values.select(F.col("node").alias("b"), F.col(column).alias("y"))
    left = values.select(F.col("node").alias("a"), F.col(column).alias("x")).join(fan, "a", "left")
    left = left.select("a", "x", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return pairs.join(right, "b").join(left, ["a", "salt"])


def estimated(pairs: DataFrame, fan: DataFrame, reps: DataFrame, k: int, least: float) -> DataFrame:
    """Pairs whose similarity, estimated by the bottom-k sketch of their union, reaches ``least``."""
    union = F.slice(F.array_sort(F.array_union("x", "y")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect("x", "y"), "u"))
    return with_both(pairs, fan, reps, "sketch").withColumn("u", union).filter(shared >= F.lit(least) * F.size("u")).select("a", "b", "salt")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (rid and other columns, one row a rid) with the text of each."""
    few = wanted.count() <= BROADCAST_ROWS
    return docs.select(row_id().alias("rid"), "text").join(F.broadcast(wanted) if few else wanted, "rid").dropDuplicates(["rid"])


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, shingles of the classes in ``wanted`` (rid, node)."""
    texts = texts_of(docs, wanted).select("node", "text")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch.node, "shingles": [signed(s) for s in shingle_sets(batch.text, width)]})

    return texts.mapInPandas(tidy(run), "node long, shingles array<long>")


def confirmed(near: DataFrame, fan: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links on their full sets."""
    shared = F.size(F.array_intersect("x", "y"))
    return with_both(near, fan, sets, "shingles").filter(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def linkable(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Members (node, cluster, comp), n and alone, whose sets may have a link to another component of their cluster.

    A shingle that no other component of the cluster holds is in the union of any such pair, but not in the
    intersection. ``alone`` counts those of at most two classes.
    """
    own = sets.join(members, "node").select("node", "cluster", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("g"))
    of = own.groupBy("cluster", "g").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("c"), F.min("node").alias("a"), F.max("node").alias("b"))
    alone = of.filter("x = y AND c <= 2").select(F.explode(F.array_distinct(F.array("a", "b"))).alias("node")).groupBy("node").count()
    rows = members.join(sets.select("node", F.size("shingles").alias("n")), "node").join(alone, "node", "left")
    rows = rows.withColumn("alone", F.coalesce("count", F.lit(0)))
    rest = stash(rows.filter(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n")).select("node", "cluster", "comp", "n", "alone"), "linkable")
    split = rest.groupBy("cluster").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("cluster")
    return rest.join(split, "cluster", "left_semi")


def _root(parent: dict, x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def cross_links(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> Iterator[tuple[int, int]]:
    """Links (nodes) between rows of different components; a component that is joined already is not searched again."""
    found = [np.asarray(s) for s in right.shingles]
    sizes = np.array([len(s) for s in found])
    values, nodes, comps, alone = np.concatenate(found), right.node.to_numpy(), right.comp.to_numpy(), right.alone.to_numpy()
    order = np.argsort(values, kind="stable")
    owner, values = np.repeat(np.arange(len(found)), sizes)[order], values[order]
    parent: dict[int, int] = {}
    for node, comp, lonely, own in zip(left.node, left.comp, left.alone, left.shingles, strict=True):
        own = np.asarray(own)
        lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        # a link shares percent of the own set at least, so it shares one of its rarest shingles
        rarest = np.argsort(hi - lo, kind="stable")[: len(own) - -(-percent * len(own) // 100) + 1]
        n = (hi - lo)[rarest]
        at = np.repeat(lo[rarest] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        those = np.unique(owner[at])
        # what is alone on either side is in the union only
        most = np.minimum(sizes[those] - alone[those], len(own) - lonely)
        those = those[(comps[those] != comp) & (100 * most >= percent * (most + alone[those] + lonely))]
        if len(those) > 32:  # count all at once
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(found))[those]
        else:
            shared = np.array([len(np.intersect1d(own, found[j], assume_unique=True)) for j in those], dtype=np.int64)
        for j in those[100 * shared >= percent * (len(own) + sizes[those] - shared)].tolist():
            a, b = _root(parent, int(comp)), _root(parent, int(comps[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield int(node), int(nodes[j])


def searched(sets: DataFrame, members: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Links (a, b) between components of a cluster: enough of them to join all components that have one.

    ``members``: node, cluster, comp, n, alone. Classes outside the largest component of a cluster meet all of the cluster, in
    blocks of ``block_bytes`` of sets a side; clusters that fit into one block are dealt many to a task.
    """
    weight = F.sum(8 * F.col("n"))
    by_comp = members.groupBy("cluster", "comp").agg(weight.alias("bytes"))
    sizes = by_comp.groupBy("cluster").agg(F.max(F.struct("bytes", "comp")).alias("most"), F.sum("bytes").alias("all"))
    blocks = lambda size: F.ceil(size / block_bytes).cast("int")
    sizes = stash(sizes.select("cluster", F.col("most.comp").alias("largest"), blocks(F.col("all") - F.col("most.bytes")).alias("lefts"), blocks(F.col("all")).alias("rights"), "all"), "cluster-sizes")
    total = sizes.agg(F.sum("all")).first()[0]
    if not total:
        return members.sparkSession.createDataFrame([], "a long, b long")
    group = F.when((F.col("lefts") == 1) & (F.col("rights") == 1), F.pmod(F.xxhash64("cluster"), F.lit(int(-(-4 * total // block_bytes))))).otherwise(F.col("cluster"))
    rows = sets.join(members.select("node", "cluster", "comp", "alone"), "node").join(sizes.drop("all"), "cluster").withColumn("deal", group)
    part = lambda n: F.pmod(F.xxhash64(F.lit(3), "node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["deal", "cluster", "i", "j", "asks", "node", "comp", "alone", "shingles"]
    right = rows.withColumn("j", part("rights")).withColumn("i", every("lefts")).withColumn("asks", F.lit(False)).select(columns)
    left = rows.filter("comp <> largest").withColumn("i", part("lefts")).withColumn("j", every("rights")).withColumn("asks", F.lit(True)).select(columns)

    def check(block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in block.sort_values("node").groupby("cluster"):
            asks = own[own.asks]
            rest = own[~own.asks]
            if len(asks) and len(rest):
                out += cross_links(asks, rest, percent)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return right.unionByName(left).groupBy("deal", "i", "j").applyInPandas(check, "a long, b long")


def with_components(drawn: DataFrame, reps: DataFrame, found: DataFrame) -> DataFrame:
    """rid, doc_id, n_shingles, component_id, one of every row of ``drawn`` (rid, doc_id, n_shingles, node), from its classes
    ``reps`` (node, best, n_rows) and the components ``found`` (node, component) of those that are linked."""
    # the smallest id of a component, for classes that have copies or links
    firsts = found.join(reps.select("node", "best"), "node").groupBy("component").agg(F.min("best").alias("one"))
    joined = found.join(firsts, "component").select("node", "one")
    mates = reps.join(joined, "node", "left").filter("one IS NOT NULL OR n_rows > 1").select("node", F.coalesce("one", "best").alias("one"), "n_rows")
    mates = stash(mates, "mates")
    rows = drawn.select("rid", "doc_id", "n_shingles", "node")
    limit = drawn.count() // HOT_SHARE + 1
    hot = F.broadcast(mates.filter(F.col("n_rows") > limit).drop("n_rows"))  # at most HOT_SHARE rows
    some = rows.filter("n_shingles > 0")
    many = some.join(hot, "node")
    rest = some.join(hot.select("node"), "node", "left_anti").join(mates.filter(F.col("n_rows") <= limit).drop("n_rows"), "node", "left")
    none = rows.filter("n_shingles = 0").withColumn("one", F.lit(None).cast(mates.schema["one"].dataType))
    both = many.unionByName(rest).unionByName(none)
    return both.select("rid", "doc_id", "n_shingles", F.when(F.col("one").isNull(), F.col("doc_id")).otherwise(F.col("one.doc_id")).alias("component_id"), F.coalesce("one.rid", "rid").alias("one"))


def components(docs: DataFrame, percent: int, width: int, k: int, slack: float, block_bytes: int) -> DataFrame:
    """rid, doc_id, n_shingles, component_id and one (the rid of a row that stands for the component) of every row."""
    if percent < 76:
        raise ValueError("percent must be 76 or more")
    drawn = stash(sketches(docs, width, k), "sketches")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "rid")).alias("best")
    reps = stash(drawn.filter("n_shingles > 0").groupBy("node").agg(best, F.count("*").alias("n_rows"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    # a smaller set is similar enough only to an equal one
    mated = reps.filter(F.col("n_shingles") * (100 - percent) >= percent)
    # s shared shingles with b others in between hold a run of three if s > 2 (b + 1), so in unions above this size
    pairs = stash(candidate_pairs(mated, 200 // (3 * percent - 200)), "pairs")
    salted, fan = fanned(pairs)
    near = stash(estimated(salted, fan, reps, k, percent / 100 - slack), "near-pairs")
    nodes = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    sets = stash(full_sets(docs, stash(reps.join(nodes, "node").select("best.rid", "node"), "wanted"), width), "sets")
    links = stash(confirmed(near, fan, sets, percent), "confirmed")
    found = connected_components(links)
    clusters = connected_components(near).withColumnRenamed("component", "cluster")
    members = stash(clusters.join(found, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("comp")), "members")
    split = members.groupBy("cluster").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("cluster")
    members = stash(linkable(sets, members.join(split, "cluster", "left_semi"), percent), "open-members")
    more = stash(searched(sets, members, percent, block_bytes), "searched")
    if not more.isEmpty():
        found = connected_components(links.union(more))
    for used in (pairs, near, sets):
        drop_path(docs.sparkSession, used)
    return with_components(drawn, reps, found)


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, k: int = 64, slack: float = 0.23, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id of any atomic type, text; other columns are
    ignored).

    Documents are linked if 100 * intersection >= percent * union of their shingle sets. A null or empty text has an
    empty set and no links. ``component_id`` is the smallest id of the component; rows with a null id are documents like
    any other, are never kept, and have a null component only where no row of theirs has an id. Rows that repeat an id are
    documents of their own. An empty table gives no rows. ``slack``: how far below the threshold an estimate may lie (five
    standard errors at k = 64). ``percent`` is 76 or more: below that, short sets may differ by two shingles and share
    neither a run of three nor all but one.
    """
    rows = components(docs, percent, width, k, slack, block_bytes)
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, k: int = 64, slack: float = 0.23, block_bytes: int = 4 << 20) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest id (null ids last; among equal ids, of the text with
    the smallest hash). Texts without words are linked with nothing and stay. Of rows with equal id and text one stays,
    whatever their other columns hold. Columns are kept as they are.
    """
    rows = stash(components(docs, percent, width, k, slack, block_bytes).filter("n_shingles > 0").groupBy("rid").agg(F.max(F.col("rid") != F.col("one")).alias("goes"), F.count("*").alias("n")).filter("goes OR n > 1"), "dropped")
    named = docs.select(F.struct(*docs.columns).alias("row"), row_id().alias("rid"))
    few = rows.count() <= BROADCAST_ROWS
    marks = F.broadcast(rows) if few else rows
    once = named.join(marks, "rid", "left_anti").select("row.*")
    if rows.filter("NOT goes").isEmpty():
        return once
    return once.unionByName(named.join(rows.filter("NOT goes"), "rid").dropDuplicates(["rid"]).select("row.*"))
