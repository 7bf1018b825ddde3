"""Removal of byte strings that occur more than once, found by suffix arrays over matching segments.

Whether a ``length``-byte window occurs again only depends on windows with the same content, so the corpus is dealt by
a function of the content: the smallest hash among a window's k-grams. Neighbouring windows mostly agree on it, so a
document becomes about one segment for every ``(length - k) / 2`` bytes.

1. Count the keys (smallest hashes) of all segments; windows under a key that occurs once, as the hash of one k-gram,
   are unique.
2. Segments under repeated keys are grouped by (key, content), the content named by a 128-bit hash of its bytes, before
   anything is sorted; one of each goes to the task of its key, with a mark if it has copies. Rows that are equal in id
   and text are cut once and counted as often as they occur.
3. A task sorts the suffixes of its segments by two-stage sorting, block by block, and compares neighbours in the
   suffix array: a window is repeated exactly if a neighbour shares ``length`` bytes.
4. A key with more than ``crowd`` different segments would not fit into a block; its windows are dealt one by one, by
   key and 128-bit hash, and counted there.
5. Repeated windows return to their documents, where the bytes that they cover go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import stash, tidy, utf8_text
from graphloom.llm.shingles import mix
from graphloom.llm.suffixes import repeated_starts, words8

GRAM = 24
LONGEST = 2048  # windows in a segment
SEPARATOR = np.array([255], dtype=np.uint8)  # never part of UTF-8
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def gram_hashes(text: np.ndarray) -> np.ndarray:
    w = np.concatenate([words8(text), np.zeros(GRAM, dtype=np.uint64)])
    n = len(text)
    return mix(w[:n] * _ODD[0] ^ mix(w[8 : n + 8] * _ODD[1]) ^ w[16 : n + 16] * _ODD[2])


def window_keys(grams: np.ndarray, span: int) -> np.ndarray:
    """For each window its key, the smallest of ``span`` neighbouring hashes (undefined where that runs over the end)."""
    low, have, n = grams, 1, len(grams)
    while have * 2 <= span:
        low = np.minimum(low, np.concatenate([low[have:], np.full(min(have, n), 2**64 - 1, dtype=np.uint64)]))
        have *= 2
    rest = span - have
    return np.minimum(low, np.concatenate([low[rest:], np.full(min(rest, n), 2**64 - 1, dtype=np.uint64)]))


def _holds_key_twice(grams: np.ndarray, begin: np.ndarray, n: np.ndarray, key: np.ndarray, span: int) -> np.ndarray:
    """Whether a segment's key is the hash of two of its k-grams: only then can it repeat a window of its own."""
    out = np.ones(len(begin), dtype=bool)
    for at in range(0, len(begin), 2048):
        part = slice(at, at + 2048)
        inside = np.arange(span)
        first = grams[begin[part, None] + inside] == key[part, None]
        last = grams[(begin[part] + n[part] - 1)[:, None] + inside] == key[part, None]
        out[part] = begin[part] + first.argmax(axis=1) != begin[part] + n[part] - 1 + span - 1 - last[:, ::-1].argmax(axis=1)
    return out


def segments(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, number of windows, key, hash of the bytes, may repeat itself) of all segments."""
    raw = b"".join(texts)
    data = np.frombuffer(raw, dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    room = np.maximum(0, sizes - length + 1)
    if not room.sum():
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    starts = np.repeat(ends - sizes - (np.cumsum(room) - room), room) + np.arange(room.sum())
    grams, span = gram_hashes(data), length - GRAM + 1
    key = window_keys(grams, span)[starts]
    first = np.ones(len(starts), dtype=bool)
    first[1:] = (key[1:] != key[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(first)
    n = np.diff(at, append=len(starts))
    long = np.flatnonzero(n > LONGEST)
    if len(long):
        more = [np.arange(at[i] + LONGEST, at[i] + n[i], LONGEST) for i in long]
        at = np.sort(np.concatenate([at, *more]))
        n = np.diff(at, append=len(starts))
    begin, key = starts[at], key[at]
    own = _holds_key_twice(grams, begin, n, key, span)
    content = np.array([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begin.tolist(), (begin + n + length - 1).tolist(), strict=True)], dtype=object)
    which = np.searchsorted(ends, begin, side="right")
    return which, begin - (ends - sizes)[which], n, key.view(np.int64), content, own


def _groups(texts: list[bytes], size: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) <= size):
            held += len(texts[to])
            to += 1
        yield at, texts[at:to]
        at = to


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last places of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2].tolist(), (edge[1::2] - 1).tolist()


def repeated_spans(docs: DataFrame, length: int = 200, crowd: int = 4096, block_bytes: int = 1 << 20) -> DataFrame:
    """``docs`` (with their columns and rid, a hash of id and text) and spans: windows that are repeated, as an array
    of (first window, last window) in bytes of the UTF-8 text; null where there are none.

    A null text is empty; texts under ``length`` bytes have no windows; rows that repeat an id and its text are documents
    of their own and so repeat each other; an empty table gives no rows.
    """
    if length < GRAM + 8 or length % 8:
        raise ValueError("length must be a multiple of 8 and at least 32")
    named = docs.withColumn("rid", F.xxhash64(F.col("doc_id"), utf8_text()))
    texts = named.select("rid", utf8_text().cast("binary").alias("raw")).filter(F.octet_length("raw") >= length)
    # rows that share a rid are taken once, with their number
    equal = stash(named.groupBy("rid").agg(F.count("*").alias("times")).filter("times > 1"), "equal-rows")
    if equal.isEmpty():
        texts = texts.withColumn("times", F.lit(1).cast("long"))
    else:
        once = texts.join(equal, "rid", "left_anti").withColumn("times", F.lit(1).cast("long"))
        texts = once.unionByName(texts.join(equal, "rid").dropDuplicates(["rid"]))

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rids, times = batch.rid.to_numpy(), batch.times.to_numpy()
            for at, part in _groups(batch.raw.tolist()):
                which, start, n, key, content, own = segments(part, length)
                yield pd.DataFrame({"rid": rids[at + which], "start": start.astype(np.int32), "n": n.astype(np.int32), "key": key, "content": content, "own": own.astype(bool), "times": times[at + which]})

    found = texts.mapInPandas(tidy(cut), "rid long, start int, n int, key long, content binary, own boolean, times long")
    repeated = found.groupBy("key").agg(F.sum("times").alias("n_segments"), F.max("own").alias("own")).filter("n_segments > 1 or own").select("key")
    matching = stash(found.drop("own").join(repeated, "key"), "segments")
    distinct = matching.groupBy("key", "content").agg(F.sum("times").alias("copies"), F.min(F.struct("rid", "start", "n")).alias("one"))
    distinct = stash(distinct.select("key", "content", (F.col("copies") > 1).alias("again"), "one.rid", "one.start", "one.n"), "segment-classes")
    crowded = distinct.groupBy("key").count().filter(F.col("count") > crowd).select("key")
    crowded = stash(crowded, "crowded-keys")
    wanted = distinct.groupBy("rid").agg(F.collect_list(F.struct("key", "content", "again", "start", "n")).alias("w")).select("rid", "w.key", "w.content", "w.again", "w.start", "w.n")

    def fetch(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "content", "again", "start", "n"]
        for batch in batches:
            out, held = [], 0
            for row in zip(batch.raw, *[batch[c] for c in names], strict=True):
                raw, part = row[0], pd.DataFrame(dict(zip(names, row[1:], strict=True)))
                part["bytes"] = [raw[s : s + n + length - 1] for s, n in zip(part.start, part.n, strict=True)]
                out.append(part.drop(columns="start"))
                held += len(part)
                if held >= 4096:
                    yield pd.concat(out)
                    out, held = [], 0
            if out:
                yield pd.concat(out)

    fetched = stash(texts.join(wanted, "rid").mapInPandas(tidy(fetch), "key long, content binary, again boolean, n int, bytes binary"), "segment-texts")

    def solve(held: list[tuple]) -> pd.DataFrame:
        parts, at = [], 0
        places, counts = [], np.array([row[3] for row in held])
        for row in held:
            places.append(at)
            parts += [np.frombuffer(row[4], dtype=np.uint8), SEPARATOR]
            at += len(row[4]) + 1
        asked = np.zeros(at, dtype=bool)
        asked[np.repeat(np.array(places) - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())] = True
        flags = repeated_starts(np.concatenate(parts), length, asked)
        rows = []
        for (key, content, again, n, _), place in zip(held, places, strict=True):
            # a segment with an equal one repeats in full; one copy stands for all in the suffix array
            first, last = ([0], [n - 1]) if again else _runs(flags[place : place + n])
            if first:
                rows.append((key, content, first, last))
        return pd.DataFrame(rows, columns=["key", "content", "first", "last"])

    def sort_suffixes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for row in zip(batch.key, batch.content, batch.again, batch.n, batch.bytes, strict=True):
                if size > block_bytes and row[0] != held[-1][0]:  # a key's segments stay together
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    marks = "key long, content binary, first array<int>, last array<int>"
    none_crowded = crowded.isEmpty()
    dealt = fetched if none_crowded else fetched.join(crowded, "key", "left_anti")
    spans = dealt.repartition("key").sortWithinPartitions("key").mapInPandas(tidy(sort_suffixes), marks)
    if not none_crowded:

        def windows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            columns = ["key", "content", "at", "mark", "copies"]
            for batch in batches:
                out = []
                for key, content, again, n, raw in zip(batch.key, batch.content, batch.again, batch.n, batch.bytes, strict=True):
                    for i in range(n):
                        out.append((key, content, i, hashlib.blake2b(raw[i : i + length], digest_size=16).digest(), 2 if again else 1))
                    if len(out) >= 50_000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                yield pd.DataFrame(out, columns=columns)

        single = stash(fetched.join(crowded, "key").mapInPandas(tidy(windows), "key long, content binary, at int, mark binary, copies long"), "windows")
        twice = single.groupBy("key", "mark").agg(F.sum("copies").alias("total")).filter("total > 1").select("key", "mark")
        places = single.join(twice, ["key", "mark"]).groupBy("key", "content").agg(F.array_sort(F.collect_set("at")).alias("first"))
        spans = spans.unionByName(places.withColumn("last", F.col("first")))
    spans = stash(spans, "repeated-windows")
    moved = F.transform(F.arrays_zip("first", "last"), lambda s: F.struct((s["first"] + F.col("start")).alias("first"), (s["last"] + F.col("start")).alias("last")))
    by_doc = matching.drop("times").join(spans, ["key", "content"]).select("rid", moved.alias("spans")).groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    return named.join(by_doc, "rid", "left")


def merge_spans(spans, length: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes as (from, to)."""
    out: list[tuple[int, int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans) if spans is not None else ():
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last + length))
        else:
            out.append((first, last + length))
    return out


def keep_rest(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return b"".join(parts)


def removal_report(docs: DataFrame, length: int = 200, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) for every row of ``docs``."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for raw, spans in zip(batch.raw, batch.spans, strict=True):
                runs = merge_spans(spans, length)
                kept = keep_rest(raw, runs)
                out.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            yield pd.concat([batch[["doc_id"]], pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], index=batch.index)], axis=1)

    rows = repeated_spans(docs.select("doc_id", "text"), length, **options).select(F.col("doc_id").cast("string"), utf8_text().cast("binary").alias("raw"), "spans")
    out = rows.mapInPandas(tidy(run), "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def without_repeats(docs: DataFrame, length: int = 200, **options) -> DataFrame:
    """``docs`` with repeated strings cut out of their texts, and n_chars counted anew where there is such a column.

    A cut that falls within a character takes the whole character. Texts that become empty stay as empty texts; null
    texts stay null.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else keep_rest(t.encode(), merge_spans(s, length)).decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)], dtype=object)

    # the other columns travel as one, so that its names cannot clash with the operator's own
    rows = repeated_spans(docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("whole")), length, **options)
    text = F.when(F.col("spans").isNotNull(), cut("text", "spans")).otherwise(F.col("text"))
    new = {"text": text} | ({"n_chars": F.char_length(text).cast("long")} if "n_chars" in docs.columns else {})
    return rows.select(*[new[c].alias(c) if c in new else F.col("whole")[c].alias(c) for c in docs.columns])
