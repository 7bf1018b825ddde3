"""Runs (maximal periodic stretches) of words by partition refinement, for many texts at once.

Positions are classed by the factor of ``l`` words that begins there, first for l = 1 within each text. To pass from l to
l + 1, a class is split by the class of the following position, and only the smaller parts of classes split in the last
step act as splitters, so a position is moved O(log n) times in all. The members of a class form a list in order of
position; two neighbours of a class at a distance of exactly l begin a square of period l, and only squares with a
primitive root show up that way (a root that is a power has another member in between). Squares at consecutive positions
are one run.

A pair of neighbours is kept with the level at which it arose, so a square is noticed when its pair ends: the pair held at
level l = distance, or it did not. All texts of a batch go through the levels together; a text takes no part beyond half
its words, as no run can have a longer period.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import spread, tidy

WALK = 200  # steps along lists before the whole batch is scanned instead


def _edges(*keys: np.ndarray) -> np.ndarray:
    """True where a sorted sequence of keys begins a new value."""
    out = np.ones(len(keys[0]), dtype=bool)
    if len(out):
        out[1:] = False
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


class _Lists:
    """Classes of positions with their members as doubly linked lists, and the squares that ended pairs reveal."""

    def __init__(self, classes: np.ndarray, n_classes: int):
        n = len(classes)
        self.cls, self.n_classes = classes, n_classes
        self.size = np.zeros(n + 1, dtype=np.int32)
        self.size[:n_classes] = np.bincount(classes, minlength=n_classes)
        order = np.argsort(classes, kind="stable")
        same = classes[order[1:]] == classes[order[:-1]]
        self.next = np.full(n, -1, dtype=np.int32)
        self.prev = np.full(n, -1, dtype=np.int32)
        self.next[order[:-1][same]] = order[1:][same]
        self.prev[order[1:][same]] = order[:-1][same]
        self.born = np.ones(n, dtype=np.int32)
        self.marked = np.zeros(n, dtype=bool)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def end_pairs(self, at: np.ndarray, level: int) -> None:
        """The pairs (at, next) do not hold beyond ``level``."""
        distance = self.next[at] - at
        square = (self.next[at] >= 0) & (self.born[at] <= distance) & (distance <= level)
        if square.any():
            self.found.append((distance[square], at[square]))

    def rest_of(self, moved: np.ndarray, first: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Members, outside ``moved``, of the classes ``owners``; ``moved`` is sorted by class and position, ``first``
        marks each class's first. The unmoved members lie in stretches of the lists after moved ones, or before the first."""
        self.marked[moved] = True
        out = []
        for links, at in ((self.next, moved), (self.prev, moved[first])):
            at, steps = links[at], 0
            at = at[at >= 0]
            at = at[~self.marked[at]]
            while len(at) and steps < WALK:
                out.append(at)
                at, steps = links[at], steps + 1
                at = at[at >= 0]
                at = at[~self.marked[at]]
            if len(at):
                asked = np.zeros(self.n_classes, dtype=bool)
                asked[owners] = True
                out = [np.flatnonzero(asked[self.cls] & ~self.marked)]
                break
        self.marked[moved] = False
        return np.concatenate(out).astype(np.int32) if out else np.zeros(0, dtype=np.int32)

    def move(self, who: np.ndarray, to: np.ndarray, level: int) -> None:
        """Take positions out of their classes into new ones (``to``); pairs that change held up to ``level``."""
        old = self.cls[who]
        order = np.lexsort((who, old))
        who, to, old = who[order], to[order], old[order]
        joined = np.zeros(len(who), dtype=bool)
        joined[1:] = self.next[who[:-1]] == who[1:]
        heads, tails = who[~joined], who[~np.append(joined[1:], False)]
        before, after = self.prev[heads], self.next[tails]
        left = before >= 0
        self.end_pairs(before[left], level)
        order = np.lexsort((who, to))
        own, label = who[order], to[order]
        same = label[1:] == label[:-1]
        following = np.full(len(own), -1, dtype=np.int32)
        following[:-1][same] = own[1:][same]
        changed = self.next[own] != following
        self.end_pairs(own[changed], level)
        self.next[before[left]] = after[left]
        self.born[before[left]] = level + 1
        right = after >= 0
        self.prev[after[right]] = before[right]
        self.next[own] = following
        self.born[own[changed]] = level + 1
        self.prev[own] = -1
        self.prev[own[1:][same]] = own[:-1][same]
        np.subtract.at(self.size, old, 1)
        self.cls[own] = label
        np.add.at(self.size, label, 1)


def squares(classes: np.ndarray, n_classes: int, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(period, position) of all squares with a primitive root.

    ``classes``: a number for every position, equal for equal words of a text; every text ends in a position of a class of
    its own. ``longest``: for every position the longest period that its text can have.
    """
    state = _Lists(classes.astype(np.int32), n_classes)
    splitters, level = np.arange(1, len(classes), dtype=np.int32), 1
    while len(splitters):
        at = splitters - 1
        at = at[(state.size[state.cls[at]] > 1) & (longest[at] > level)]
        if not len(at):
            break
        key = state.cls[at].astype(np.int64) * (state.n_classes + 1) + state.cls[at + 1]
        order = np.lexsort((at, key))
        at, key = at[order], key[order]
        owner = state.cls[at]
        starts = np.flatnonzero(_edges(key))
        sizes = np.diff(starts, append=len(at))
        group_owner = owner[starts]
        firsts = np.flatnonzero(_edges(group_owner))  # the first group of each class
        moved = np.add.reduceat(sizes, firsts)
        largest = np.maximum.reduceat(sizes, firsts)
        rest = state.size[group_owner[firsts]] - moved
        n_groups = np.diff(firsts, append=len(starts))
        splits = (n_groups > 1) | (rest > 0)
        stays = rest >= largest  # the rest keeps the class, else the largest group does
        per_class = np.repeat(np.arange(len(firsts)), n_groups)
        is_largest = sizes == largest[per_class]
        rank = np.cumsum(is_largest)
        chosen = is_largest & (rank - (rank[firsts] - is_largest[firsts])[per_class] == 1)  # the first of the largest
        goes = splits[per_class] & (stays[per_class] | ~chosen)
        label = np.full(len(starts), -1, dtype=np.int64)
        label[goes] = state.n_classes + np.arange(int(goes.sum()))
        state.n_classes += int(goes.sum())
        each = np.repeat(np.arange(len(starts)), sizes)
        take = goes[each]
        who, to = at[take], label[each[take]]
        few = splits & ~stays & (rest > 0)
        if few.any():
            inside = few[per_class[each]]
            moved_at, moved_owner = at[inside], owner[inside]
            order = np.lexsort((moved_at, moved_owner))
            moved_at, moved_owner = moved_at[order], moved_owner[order]
            owners = group_owner[firsts[few]]
            others = state.rest_of(moved_at, _edges(moved_owner), owners)
            number = state.n_classes + np.searchsorted(owners, state.cls[others])
            state.n_classes += len(owners)
            who, to = np.concatenate([who, others]), np.concatenate([to, number])
        if len(who):
            state.move(who, to, level)
        splitters = who[who > 0].astype(np.int32)
        level += 1
    linked = np.flatnonzero(state.next >= 0).astype(np.int32)
    distance = state.next[linked] - linked
    valid = (state.born[linked] <= distance) & (distance <= longest[linked])
    state.found.append((distance[valid], linked[valid]))
    return np.concatenate([x[0] for x in state.found]), np.concatenate([x[1] for x in state.found])


def runs_of(texts: list[list], least: int = 12) -> list[np.ndarray]:
    """For each sequence of words its runs of at least ``least`` words: rows (start, length, period), by start and period."""
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(counts + 1) - 1
    n = int(ends[-1]) + 1 if len(texts) else 0
    classes = np.empty(n, dtype=np.int32)
    at = known = 0
    for words in texts:
        codes: dict = {}
        classes[at : at + len(words)] = [codes.setdefault(w, len(codes)) for w in words]
        classes[at : at + len(words)] += known
        at += len(words)
        known += len(codes)
        classes[at] = known
        at += 1
        known += 1
    if not n:
        return []
    period, start = squares(classes, known, np.repeat((counts // 2).astype(np.int32), counts + 1))
    order = np.lexsort((start, period))
    period, start = period[order].astype(np.int64), start[order].astype(np.int64)
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (period[1:] != period[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start))[: len(first)] - 1
    q, begin = period[first], start[first]
    length = start[last] - begin + 2 * q
    long = length >= least
    q, begin, length = q[long], begin[long], length[long]
    order = np.lexsort((q, begin))
    rows = np.stack([begin, length, q], axis=1)[order] if len(order) else np.zeros((0, 3), dtype=np.int64)
    cuts = np.searchsorted(rows[:, 0], ends)
    out, low = [], 0
    for high, base in zip(cuts.tolist(), (ends - counts).tolist(), strict=True):
        own = rows[low:high].copy()
        own[:, 0] -= base
        out.append(own)
        low = high
    return out


def collapsed(words: list, runs: np.ndarray) -> list:
    """The words that no run contains after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, least: int = 12, group_bytes: int = 8 << 20) -> DataFrame:
    """For every row of ``docs`` (doc_id of any atomic type, text; other columns are ignored): doc_id, n_runs, start, length,
    period, exponent_milli of the longest run (ties: smallest start, then period), runs_sha256, collapsed_sha256, runs
    (array of start, length, period) and collapsed (the kept words, joined by one space).

    Words are runs of bytes other than space and \\x09-\\x0D, compared byte by byte. A null, empty or short text has no
    runs: four nulls, the hash of nothing, and its own words. Rows with equal or null ids are documents of their own; an
    empty table gives no rows. A text is one task's work, in memory proportional to its words.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch.doc_id.tolist(), batch.text.tolist()
            low = 0
            while low < len(texts):
                high, held = low, 0
                while high < len(texts) and (high == low or held + len(texts[high] or "") <= group_bytes):
                    held += len(texts[high] or "")
                    high += 1
                words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts[low:high]]
                out = []
                for doc_id, own, found in zip(ids[low:high], words, runs_of(words, least), strict=True):
                    kept = b" ".join(collapsed(own, found))
                    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist())
                    best = (None,) * 4
                    if len(found):
                        s, n, q = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist()
                        best = (s, n, q, 1000 * n // q)
                    out.append((doc_id, len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), [{"start": s, "length": n, "period": q} for s, n, q in found.tolist()], kept.decode("utf-8", "surrogatepass")))
                frame = pd.DataFrame(out, columns=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"])
                for c in ("start", "length", "period", "exponent_milli"):
                    frame[c] = frame[c].astype("Int64")
                yield frame
                low = high

    rows = spread(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = rows.mapInPandas(tidy(run), "doc_id string, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def with_planted_runs(text: Column, doc_id: Column) -> Column:
    """The text of ``doc_id``, in every tenth document (by crc32 of the decimal id) with a periodic tail of words.

    With h = crc32(id), g = h div 10 and n words, from word a = g mod n on word i becomes word a + (i - a) mod p, where
    p = 1 + (n - a) div (3 + g mod 8). Null ids and texts without words stay as they are.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rewritten(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int"))), " ")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    planted = F.get(F.transform(F.filter(F.array(words), lambda w: F.size(w) > 0), rewritten), 0)  # a lambda's argument is computed once
    return F.when((h % 10 == 0) & text.isNotNull(), F.coalesce(planted, text)).otherwise(text)
