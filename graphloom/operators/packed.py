"""Searches inside tasks, for graphs whose vertices (not arcs) fit into a process.

Vertices are numbered by their place among the sorted ids, which are broadcast. Tasks write the arcs, sorted by ranges, as
files of 4 bytes an arc in the shared folder; a worker that searches maps them (many arcs stay in its page cache, not in its
memory), so neither the driver nor a broadcast holds arcs. Every task takes whole batches of sources:

* With path counts, a batch's state is a matrix of vertices by sources. A level whose frontier has few arcs is expanded arc
  by arc (top-down); one with many is pulled: the rows that some source has not reached add up the frontier rows of their
  neighbours, which moves a row of all sources for each arc (bottom-up). The way back chooses in the same way.
* Without path counts a row holds 64 sources a word.

Results leave a batch as rows; nothing of a (source, vertex) pair is written or moved in between.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.storage import shared_dir
from graphloom.operators.graph import Graph

MOST_VERTICES = 4_000_000  # 8 bytes each in a broadcast
HELD_ARCS = 16_000_000  # in a worker's memory; more are mapped
STATE_CELLS = 3_000_000  # vertices times sources of a batch with path counts: 28 bytes each
STATE_WORDS = 8_000_000  # vertices times words of a batch of bits: 24 bytes each
KEPT_ARCS = 4_000_000  # of a batch, kept from the way out for the way back
PIECE = 131_072  # numbers that a pull works on at once
OUT_ROWS = 1_000_000  # pairs in a frame

_loaded: dict = {}  # of this worker: the last packed graph


@dataclass
class Packed:
    ids: np.ndarray
    shared: object  # broadcast of ids
    into: list  # files of the arcs by head, in order
    out_of: list  # by tail; the same files for undirected graphs
    arcs: int


def fits(graph: Graph, most: int = MOST_VERTICES) -> bool:
    return graph.vertices.limit(most + 1).count() <= most


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _written(pairs: DataFrame, folder: str) -> tuple[list, int]:
    """(cols, rows) files of the pairs (row, col), in order of rows, and how many pairs there are."""

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, first, total, heads = f"{folder}/{uuid.uuid4().hex}", -1, 0, []
        system, local = _system(path)
        system.create_dir(local.rsplit("/", 1)[0])
        with system.open_output_stream(f"{local}.cols") as out:
            for batch in batches:
                if len(batch):
                    row = batch.row.to_numpy()
                    at = np.flatnonzero(np.diff(row, prepend=-1))
                    heads.append(np.stack([row[at], np.diff(np.append(at, len(row)))]).astype(np.int32).T)
                    first, total = int(row[0]) if first < 0 else first, total + len(row)
                    out.write(batch.col.to_numpy(dtype=np.int32).tobytes())
        if total:
            with system.open_output_stream(f"{local}.rows") as out:
                out.write(np.concatenate(heads).tobytes())
            yield pd.DataFrame({"first": [first], "path": [path], "n": [total]})

    done = pairs.repartitionByRange("row").sortWithinPartitions("row", "col").mapInPandas(write, "first long, path string, n long").collect()
    return [r.path for r in sorted(done)], sum(r.n for r in done)


def pack(graph: Graph, sources: DataFrame | None = None) -> Packed:
    """``sources`` (id) may hold ids that are no vertices; these have no arcs."""
    spark = graph.edges.sparkSession
    every = graph.vertices.select(F.col("id").cast("long").alias("id"))
    if sources is not None:
        every = every.union(sources.select(F.col("id").cast("long").alias("id"))).distinct()
    ids = np.sort(every.toPandas().id.to_numpy(dtype=np.int64))
    shared = spark.sparkContext.broadcast(ids)

    def number(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            row, col = (np.searchsorted(shared.value, batch[c].to_numpy(dtype=np.int64)).astype(np.int32) for c in ("row", "col"))
            yield pd.DataFrame({"row": row, "col": col})

    folder = f"{shared_dir(spark)}/graphloom/packed-{uuid.uuid4().hex}"
    by_head = graph.edges.select(F.col("dst").alias("row"), F.col("src").alias("col")).mapInPandas(number, "row int, col int")
    into, arcs = _written(by_head, folder)
    out_of = into
    if graph.directed:
        out_of, _ = _written(by_head.select(F.col("col").alias("row"), F.col("row").alias("col")), folder)
    return Packed(ids, shared, into, out_of, arcs)


def _lists(paths: list, n: int, arcs: int) -> tuple[np.ndarray, np.ndarray]:
    """ptr, adj: the neighbours of row v are adj[ptr[v] : ptr[v + 1]]."""
    degree, pieces = np.zeros(n, dtype=np.int64), []
    file = tempfile.TemporaryFile() if arcs > HELD_ARCS else None
    for path in paths:
        system, local = _system(path)
        with system.open_input_file(f"{local}.rows") as rows:
            heads = np.frombuffer(rows.read(), dtype=np.int32).reshape(-1, 2)
            np.add.at(degree, heads[:, 0], heads[:, 1])
        with system.open_input_file(f"{local}.cols") as cols:
            if file is None:
                pieces.append(np.frombuffer(cols.read(), dtype=np.int32))
            else:
                while piece := cols.read(8 << 20):
                    file.write(piece)
    ptr = np.concatenate([[0], np.cumsum(degree)])
    if file is not None:
        file.flush()
        return ptr, np.memmap(file, dtype=np.int32, mode="r")
    return ptr, np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.int32)


class Lists:
    """The neighbours of every vertex, in this worker."""

    def __init__(self, into: list, out_of: list, n: int, arcs: int):
        self.n = n
        self.into = _lists(into, n, arcs)
        self.out_of = self.into if out_of is into or out_of == into else _lists(out_of, n, arcs)


def _of_worker(into: list, out_of: list, n: int, arcs: int) -> Lists:
    key = tuple(into), n
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Lists(into, out_of, n, arcs)
    return _loaded[key]


def pulled(lists: tuple[np.ndarray, np.ndarray], state: np.ndarray, rows: np.ndarray, op) -> np.ndarray:
    """``op`` (add or bitwise_or) over the rows of ``state`` that are neighbours of each of ``rows``. The j-th neighbours of
    a piece of rows are taken together; what is left of a few rows with many neighbours is taken row by row."""
    ptr, adj = lists
    width = state.shape[1]
    out = np.zeros((len(rows), width), dtype=state.dtype)
    step = max(64, PIECE // width)
    taken = np.empty((step, width), dtype=state.dtype)
    for a in range(0, len(rows), step):
        own = rows[a : a + step]
        begin, k = ptr[own], ptr[own + 1] - ptr[own]
        order = np.argsort(-k, kind="stable")
        begin, k = begin[order], k[order]
        most = int(k[0])
        more = len(own) - np.searchsorted(k[::-1], np.arange(most), side="right")  # rows with over j neighbours
        both = int(np.searchsorted(-more, -16, side="right"))  # of these, how many j are shared by 16 rows or more
        got = np.zeros((len(own), width), dtype=state.dtype)
        for j in range(both):
            c = more[j]
            np.take(state, adj[begin[:c] + j], axis=0, out=taken[:c], mode="clip")
            op(got[:c], taken[:c], out=got[:c])
        for i in range(more[both] if both < most else 0):
            for low in range(int(begin[i]) + both, int(begin[i] + k[i]), step):
                piece = state[adj[low : min(low + step, int(begin[i] + k[i]))]]
                op(got[i], op.reduce(piece, axis=0), out=got[i])
        out[a : a + step][order] = got
    return out


class Batch:
    """Shortest paths from a batch of sources: cell v * b + i is vertex v in the search from source i."""

    def __init__(self, lists: Lists, sources: np.ndarray):
        self.lists, self.n, self.b = lists, lists.n, len(sources)
        n, b = self.n, self.b
        self.sigma, self.depth, self.mark = np.zeros(n * b), np.full(n * b, -1, dtype=np.int32), np.empty(n * b, dtype=np.int32)
        self.levels, self.kept, held = [sources * b + np.arange(b)], [], 0
        self.degree = np.diff(lists.out_of[0])
        self.dense = 15 + 1.5 * b  # ns an arc of a pull, against 50 for one that is expanded
        cells = self.levels[0]
        self.sigma[cells], self.depth[cells] = 1.0, 0
        while True:
            level = len(self.levels)
            few = 50 * self.degree[cells // b].sum()
            rows = None
            if few > 50 * lists.into[0][-1] / 8:  # else a pull would hardly pay
                rows = np.flatnonzero((self.depth.reshape(n, b) < 0).any(axis=1))
                ptr = lists.into[0]
                if self.dense * (ptr[rows + 1] - ptr[rows]).sum() > few:
                    rows = None
            if rows is None:
                tail, head = self.expanded(cells, lists.out_of)
                fresh = self.depth[head] < 0
                tail, head = tail[fresh], head[fresh]
                np.add.at(self.sigma, head, self.sigma[tail])
                self.depth[head] = level
                self.mark[head] = np.arange(len(head), dtype=np.int32)
                cells = head[self.mark[head] == np.arange(len(head), dtype=np.int32)]
                held += len(head)
                self.kept.append((tail, head) if held <= KEPT_ARCS else None)
            else:
                front = np.zeros((n, b))
                front.ravel()[cells] = self.sigma[cells]
                found = []
                step = max(64, 2 * PIECE // b)
                for a in range(0, len(rows), step):
                    own = rows[a : a + step]
                    got = pulled(lists.into, front, own, np.add)
                    got[self.depth.reshape(n, b)[own] >= 0] = 0
                    at, which = np.nonzero(got)
                    at = own[at] * b + which
                    self.sigma[at] = got[got != 0]
                    found.append(at)
                cells = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
                self.depth[cells] = level
                self.kept.append(None)
            if not len(cells):
                self.kept.pop()
                break
            self.levels.append(cells)

    def expanded(self, cells: np.ndarray, lists) -> tuple[np.ndarray, np.ndarray]:
        """The arcs out of ``cells``, as cells."""
        ptr, adj = lists
        v = cells // self.b
        k = ptr[v + 1] - ptr[v]
        tail = np.repeat(cells, k)
        arc = np.arange(len(tail)) + np.repeat(ptr[v] - (np.cumsum(k) - k), k)
        return tail.astype(np.int32), adj[arc] * np.int32(self.b) + np.repeat(cells - v * self.b, k).astype(np.int32)

    def dependencies(self, counted: np.ndarray | None = None) -> np.ndarray:
        """delta of every cell; ``counted``: how many vertices a target stands for."""
        n, b, lists = self.n, self.b, self.lists
        delta, share = np.zeros(n * b), np.zeros(n * b)
        for d in range(len(self.levels) - 1, 1, -1):
            low, high, kept = self.levels[d], self.levels[d - 1], self.kept[d - 1]
            share[low] = ((1.0 if counted is None else counted[low // b]) + delta[low]) / self.sigma[low]
            if kept is None:
                rows = np.flatnonzero(np.bincount(high // b, minlength=n))
                ptr = lists.into[0]
                down, up = self.degree[high // b].sum(), (ptr[low // b + 1] - ptr[low // b]).sum()
                if self.dense * self.degree[rows].sum() > 50 * min(down, up):
                    if down <= up:
                        tail, head = self.expanded(high, lists.out_of)
                        on_path = self.depth[head] == d
                    else:
                        head, tail = self.expanded(low, lists.into)
                        on_path = self.depth[tail] == d - 1
                    kept = tail[on_path], head[on_path]
            if kept is not None:
                np.add.at(delta, kept[0], self.sigma[kept[0]] * share[kept[1]])
            else:
                step = max(64, 2 * PIECE // b)
                for a in range(0, len(rows), step):
                    own = rows[a : a + step]
                    got = pulled(lists.out_of, share.reshape(n, b), own, np.add)
                    at, which = np.nonzero((self.depth.reshape(n, b)[own] == d - 1) & (got != 0))
                    cell = own[at] * b + which
                    delta[cell] = self.sigma[cell] * got[at, which]
            share[low] = 0
        return delta


def _batches(packed: Packed, sources: DataFrame, width: int, schema: str, work: Callable, least: int = 8) -> DataFrame:
    """``work`` (lists, ids, batches of source numbers) -> frames of ``schema``, over tasks of whole batches of up to
    ``width`` sources; ``least`` or more, where smaller ones would keep more cores busy."""
    spark = sources.sparkSession
    if not len(packed.ids):
        return spark.createDataFrame([], schema)
    own = sources.select(F.col("id").cast("long").alias("id")).distinct()
    cores, n_sources = spark.sparkContext.defaultParallelism, own.count()
    width = min(width, max(least, -(-n_sources // (2 * cores))))
    into, out_of, n, arcs, shared = packed.into, packed.out_of, len(packed.ids), packed.arcs, packed.shared

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = shared.value

        def batches() -> Iterator[np.ndarray]:
            left = np.zeros(0, dtype=np.int64)
            for frame in frames:
                own = frame.id.to_numpy(dtype=np.int64)
                at = np.minimum(np.searchsorted(ids, own), n - 1)
                left = np.concatenate([left, at[ids[at] == own]])
                while len(left) >= width:
                    yield left[:width]
                    left = left[width:]
            if len(left):
                yield left

        yield from work(_of_worker(into, out_of, n, arcs), ids, batches())

    tasks = max(1, min(-(-n_sources // width), 16 * cores))
    return own.repartition(tasks, "id").mapInPandas(run, schema)


def _width(packed: Packed, cells: int) -> int:
    """Sources of a batch: many where pulls pay (a row of a vertex's sources moves at once), else as many as fit a cache."""
    return max(1, min(cells // max(1, len(packed.ids)), 64 if packed.arcs > 8 * len(packed.ids) else 16))


def centrality_sums(packed: Packed, sources: DataFrame, width: int | None = None) -> DataFrame:
    """v, total: dependencies summed over the sources (vertices without any may be left out)."""
    def work(lists: Lists, ids: np.ndarray, batches: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(ids))
        for own in batches:
            total += Batch(lists, own).dependencies().reshape(len(ids), len(own)).sum(axis=1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"v": ids[at], "total": total[at]})

    sums = _batches(packed, sources, min(width or 64, _width(packed, STATE_CELLS)), "v long, total double", work)
    return sums.groupBy("v").agg(F.sum("total").alias("total"))


def weighted_sums(packed: Packed, weights: DataFrame) -> DataFrame:
    """v, total, in_a, in_c: ``weights`` (id, a, c) has how many sources and vertices each vertex stands for; in_a and in_c are
    their sums over its component, as far as that has sources."""
    spark = weights.sparkSession
    frame = weights.select("id", "a", "c").toPandas().sort_values("id")
    shared = spark.sparkContext.broadcast((frame.a.to_numpy(dtype=np.float64), frame.c.to_numpy(dtype=np.float64)))

    def work(lists: Lists, ids: np.ndarray, batches: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
        a, c = shared.value
        total, in_a, in_c = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids))
        for own in batches:
            found = Batch(lists, own)
            total += found.dependencies(c).reshape(len(ids), len(own)) @ a[own]
            reached = found.depth.reshape(len(ids), len(own)) >= 0
            for sums, w in ((in_a, a), (in_c, c)):
                np.maximum(sums, (reached * (w @ reached)).max(axis=1), out=sums)
        at = np.flatnonzero(in_a)
        yield pd.DataFrame({"v": ids[at], "total": total[at], "in_a": in_a[at], "in_c": in_c[at]})

    sums = _batches(packed, weights.filter("a > 0"), _width(packed, STATE_CELLS), "v long, total double, in_a double, in_c double", work)
    return sums.groupBy("v").agg(F.sum("total").alias("total"), F.max("in_a").alias("in_a"), F.max("in_c").alias("in_c"))


def path_counts(packed: Packed, sources: DataFrame) -> DataFrame:
    """s, v, d, sigma of every reachable pair."""

    def work(lists: Lists, ids: np.ndarray, batches: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
        for own in batches:
            found, b = Batch(lists, own), len(own)
            for d, cells in enumerate(found.levels):
                for a in range(0, len(cells), OUT_ROWS):
                    at = cells[a : a + OUT_ROWS]
                    yield pd.DataFrame({"s": ids[own[at % b]], "v": ids[at // b], "d": np.full(len(at), d, dtype=np.int32), "sigma": found.sigma[at]})

    return _batches(packed, sources, _width(packed, STATE_CELLS), "s long, v long, d int, sigma double", work)


def dependencies(packed: Packed, sources: DataFrame) -> DataFrame:
    """s, v, delta above 0."""

    def work(lists: Lists, ids: np.ndarray, batches: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
        for own in batches:
            delta, b = Batch(lists, own).dependencies(), len(own)
            cells = np.flatnonzero(delta > 0)
            for a in range(0, len(cells), OUT_ROWS):
                at = cells[a : a + OUT_ROWS]
                yield pd.DataFrame({"s": ids[own[at % b]], "v": ids[at // b], "delta": delta[at]})

    return _batches(packed, sources, _width(packed, STATE_CELLS), "s long, v long, delta double", work)


def bit_levels(lists: Lists, sources: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each level (rows, bits): the vertices in it and, bit i % 64 of word i // 64, the sources that have them there."""
    n, words = lists.n, -(-len(sources) // 64)
    seen, front = np.zeros((n, words), dtype=np.uint64), np.zeros((n, words), dtype=np.uint64)
    i = np.arange(len(sources))
    np.bitwise_or.at(front, (sources, i // 64), np.left_shift(np.uint64(1), (i % 64).astype(np.uint64)))
    every = np.bitwise_or.reduce(front, axis=0)
    rows = np.unique(sources)
    bits = front[rows]
    while len(rows):
        seen[rows] |= bits
        yield rows, bits
        ptr, adj = lists.out_of
        k = ptr[rows + 1] - ptr[rows]
        if k.sum() * 8 < ptr[-1]:
            arc = np.arange(k.sum()) + np.repeat(ptr[rows] - (np.cumsum(k) - k), k)
            near = np.flatnonzero(np.bincount(adj[arc], minlength=n)) if len(arc) else np.zeros(0, dtype=np.int64)
        else:
            near = np.arange(n)
        open_ = np.zeros(len(near), dtype=bool)
        for w in range(words):
            open_ |= seen[near, w] != every[w]
        near = near[open_]
        found, got = [], []
        step = max(64, 2 * PIECE // words)
        for a in range(0, len(near), step):
            own = near[a : a + step]
            new = pulled(lists.into, front, own, np.bitwise_or) & ~seen[own]
            some = new.any(axis=1)
            found.append(own[some])
            got.append(new[some])
        front[rows] = 0
        rows = np.concatenate(found) if found else near
        bits = np.concatenate(got) if got else np.zeros((0, words), dtype=np.uint64)
        front[rows] = bits


def _bits_width(packed: Packed) -> int:
    return 64 * max(1, min(STATE_WORDS // max(1, len(packed.ids)), 8))


def _unpacked(bits: np.ndarray, b: int) -> np.ndarray:
    return np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1, bitorder="little", count=b)


def eccentricities(packed: Packed, sources: DataFrame) -> DataFrame:
    """s, depth."""

    def work(lists: Lists, ids: np.ndarray, batches: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
        for own in batches:
            depth = np.zeros(len(own), dtype=np.int32)
            for d, (_, bits) in enumerate(bit_levels(lists, own)):
                depth[_unpacked(np.bitwise_or.reduce(bits, axis=0)[None, :], len(own))[0] > 0] = d
            yield pd.DataFrame({"s": ids[own], "depth": depth})

    return _batches(packed, sources, _bits_width(packed), "s long, depth int", work, 64)


def level_sizes(packed: Packed, sources: DataFrame) -> DataFrame:
    """s, d, size, first."""

    def work(lists: Lists, ids: np.ndarray, batches: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
        for own in batches:
            first = np.zeros(len(own), dtype=np.int64)
            for d, (rows, bits) in enumerate(bit_levels(lists, own)):
                size = np.zeros(len(own), dtype=np.int64)
                for a in range(0, len(rows), 4096):
                    size += _unpacked(bits[a : a + 4096], len(own)).sum(axis=0, dtype=np.int64)
                at = np.flatnonzero(size)
                yield pd.DataFrame({"s": ids[own[at]], "d": np.full(len(at), d, dtype=np.int32), "size": size[at], "first": first[at]})
                first += size

    return _batches(packed, sources, _bits_width(packed), "s long, d int, size long, first long", work, 64)


def reached_pairs(packed: Packed, sources: DataFrame) -> DataFrame:
    """s, v, d of every reachable pair."""

    def work(lists: Lists, ids: np.ndarray, batches: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
        for own in batches:
            step = max(1, OUT_ROWS // len(own))
            for d, (rows, bits) in enumerate(bit_levels(lists, own)):
                for a in range(0, len(rows), step):
                    at, which = np.nonzero(_unpacked(bits[a : a + step], len(own)))
                    yield pd.DataFrame({"s": ids[own[which]], "v": ids[rows[a : a + step][at]], "d": np.full(len(at), d, dtype=np.int32)})

    return _batches(packed, sources, _bits_width(packed), "s long, v long, d int", work, 64)
