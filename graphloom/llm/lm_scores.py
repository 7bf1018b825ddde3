"""Stupid-backoff language-model scores of documents under the corpus's own n-gram counts.

Units are the ids of a public tokenizer (16 bits each), so an n-gram of up to three of them is one exact number.

1. A document's token ids are written once, a row for each batch of documents.
2. Batches are exploded to their distinct n-grams, each with its number of occurrences in the batch: the aggregation
   before the shuffle. A frequent n-gram therefore has one row a batch, however many documents hold it. N-grams of one
   context (all tokens but the last) travel as one row with arrays; contexts of frequent tokens are split into slots.
3. The rows are dealt by the hash of context and slot. Their sums are the count table, of which each batch takes the
   entries of its own n-grams, in the same partitions; those below the least count, which back off, are left out.
4. The entries return to their batches and meet the token ids; every token is scored, the sums of a document are its score.

Single tokens are counted first; that table is bounded by the vocabulary and is broadcast. No step holds more than one
batch in a task, whatever the size of the corpus or the frequency of an n-gram.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import lean, release, stash, tidy, utf8_text
from graphloom.llm.packing import Tokens
from graphloom.llm.shingles import mix

BATCHES = "batch long, doc_ids array<string>, sizes array<int>, ids binary"
CHUNK = 50_000  # rows that a task hands over at a time
SLOT = 4_000_000  # occurrences of a context, at most, that one slot holds
TOTAL_BITS = 40  # of a packed entry; the word is above them
SLICE = 125_000  # tokens that are scored at a time
SUMMED = 1_000_000  # n-grams that are summed at a time, whole keys


def token_batches(docs: DataFrame, tokenizer_path: str, batch_tokens: int) -> DataFrame:
    """Token ids of documents, a row for about ``batch_tokens`` of them (a document is not cut): ``ids`` holds the 16-bit
    ids of all, compressed, ``sizes`` their number in each document."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, packer = Tokens(tokenizer_path), pa.Codec("zstd", compression_level=7)
        names, held, size = [], [], 0

        def batch() -> pd.DataFrame:
            raw = packer.compress(b"".join(x.tobytes() for x in held), asbytes=True)
            row = (uuid.uuid4().int >> 65, names, [len(x) for x in held], raw)
            return pd.DataFrame([row], columns=["batch", "doc_ids", "sizes", "ids"])

        for frame in batches:
            for name, ids in zip(frame.doc_id, tokens.many(frame.text.tolist()), strict=True):
                names.append(name)
                held.append(ids.astype("<u2"))
                size += len(ids)
                if size >= batch_tokens:
                    yield batch()
                    names, held, size = [], [], 0
        if names:
            yield batch()

    return docs.select(F.col("doc_id").cast("string"), utf8_text().alias("text")).mapInPandas(tidy(run), BATCHES)


def tokens_of(raw: bytes, sizes: np.ndarray) -> np.ndarray:
    n = int(sizes.sum())
    return np.frombuffer(pa.decompress(raw, decompressed_size=2 * n, codec="zstd", asbytes=True), dtype="<u2") if n else np.zeros(0, dtype="<u2")


def grams(ids: np.ndarray, sizes: np.ndarray, m: int, start_id: int, slots: np.ndarray) -> np.ndarray:
    """The number of the n-gram of ``m`` tokens that ends at each token; documents begin with ``start_id``s.

    It is the order m, 16 bits for each token of the context, the slot (10 bits, a hash of the last token below the
    smallest ``slots`` of a context token) and 16 bits for the last token.
    """
    out = ids.astype(np.int64) | (m << 58)
    begins, fewest = np.cumsum(sizes) - sizes, None
    for back in range(1, m):
        token = np.full(len(ids), start_id, dtype=np.uint16)
        token[back:] = ids[: max(0, len(ids) - back)]
        for i in range(back):
            token[begins[sizes > i] + i] = start_id
        out |= token.astype(np.int64) << (10 + 16 * back)
        fewest = slots[token] if fewest is None else np.minimum(fewest, slots[token])
    if fewest is not None and fewest.max(initial=1) > 1:
        out |= (mix(ids.astype(np.uint64)) % fewest).astype(np.int64) << 16
    return out


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first document, end, first token, end) of runs of documents with about SLICE tokens."""
    ends = np.cumsum(sizes)
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, SLICE), side="right"))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sizes)], strict=True):
        yield a, b, int(ends[a] - sizes[a]), int(ends[b - 1])


def distinct_grams(ids: np.ndarray, sizes: np.ndarray, m: int, start_id: int, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams in order, and how often they occur; a quarter of them is held with its repeats at a time."""
    found, counts = [], []
    for quarter in range(4):
        parts = []
        for a, b, x, y in slices(sizes):
            own = grams(ids[x:y], sizes[a:b], m, start_id, slots)
            parts.append(own[(own & 3) == quarter])
        own = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        del parts
        own.sort()
        fresh = np.ones(len(own), dtype=bool)
        np.not_equal(own[1:], own[:-1], out=fresh[1:])
        at = np.flatnonzero(fresh)
        found.append(own[at])
        counts.append(np.diff(at, append=len(own)).astype(np.int32))
    names, k = np.concatenate(found), np.concatenate(counts)
    by = np.argsort(names, kind="stable")
    return names[by], k[by]


def entries(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a batch's ``rows`` (key, packed words and totals), in order, and the packed entries with the totals."""
    rows = rows.select(["key", "packed"]).sort_by("key").combine_chunks()
    if not rows.num_rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    values = rows["packed"].chunk(0).flatten().to_numpy()
    names = values >> TOTAL_BITS
    names |= np.repeat(rows["key"].to_numpy() << 16, rows["packed"].chunk(0).value_lengths().to_numpy())
    return names, values


def totals(sought: np.ndarray, names: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """The total of each of ``sought`` by the entries, 0 where there is none. They are looked up in order: the search then
    walks through memory once."""
    found = np.zeros(len(sought), dtype=np.int64)
    if len(names):
        by = np.argsort(sought)
        sought = sought[by]
        at = np.searchsorted(names, sought)
        at[at == len(names)] = 0
        found[by] = np.where(names[at] == sought, packed[at] & ((1 << TOTAL_BITS) - 1), 0)
    return found


def token_counts(batches: DataFrame, vocabulary: int) -> np.ndarray:
    """Occurrences of every id."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for frame in frames:
            for sizes, raw in zip(frame.sizes, frame.ids, strict=True):
                total += np.bincount(tokens_of(raw, np.asarray(sizes, dtype=np.int64)), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "k": total[at]})

    found = batches.select("sizes", "ids").mapInPandas(tidy(run), "id int, k long").groupBy("id").agg(F.sum("k").alias("k")).toPandas()
    out = np.zeros(vocabulary, dtype=np.int64)
    out[found.id] = found.k
    return out


def exploded(batches: DataFrame, order: int, start_id: int, slots) -> DataFrame:
    """batch, key (order, context and slot), words and ks: the distinct n-grams of two or more tokens of every batch, and
    how often they occur in it."""
    schema = pa.schema([("batch", pa.int64()), ("key", pa.int64()), ("words", pa.list_(pa.int32())), ("ks", pa.list_(pa.int32()))])

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for frame in frames:
            for row in frame.to_pylist():
                sizes = np.asarray(row["sizes"], dtype=np.int64)
                ids = tokens_of(row["ids"], sizes)
                for m in range(2, order + 1):
                    own, k = distinct_grams(ids, sizes, m, start_id, slots.value)
                    first = np.flatnonzero(np.diff(own >> 16, prepend=-1))
                    ends = np.append(first[1:], len(own))
                    for i in range(0, len(first), CHUNK):
                        a, b = first[i], ends[min(i + CHUNK, len(first)) - 1]
                        offsets = pa.array(np.append(first[i : i + CHUNK], b) - a, type=pa.int32())
                        words, ks = pa.array((own[a:b] & 0xFFFF).astype(np.int32)), pa.array(k[a:b].astype(np.int32))
                        key = own[first[i : i + CHUNK]] >> 16
                        yield pa.record_batch([pa.array(np.full(len(key), row["batch"])), pa.array(key), pa.ListArray.from_arrays(offsets, words), pa.ListArray.from_arrays(offsets, ks)], schema=schema)
                    del own, k
        release()

    return batches.select("batch", "sizes", "ids").mapInArrow(run, "batch long, key long, words array<int>, ks array<int>")


def summed(dealt: DataFrame, min_count: int) -> DataFrame:
    """batch, key, packed: for every row of ``dealt`` (in order of the key, a key in one partition) its words in order, each
    with its total over all batches; words below ``min_count`` are left out, and so are rows without others."""
    schema = pa.schema([("batch", pa.int64()), ("key", pa.int64()), ("packed", pa.list_(pa.int64()))])

    def answer(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        words, ks = rows["words"].chunk(0), rows["ks"].chunk(0).flatten().to_numpy()
        length, key = words.value_lengths().to_numpy(), rows["key"].to_numpy()
        # of rows of one key the words are sorted together; keys are numbered from 0
        number = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        name = np.repeat(number << 16, length) | words.flatten().to_numpy()
        by = np.argsort(name)
        ordered = name[by]
        first = np.flatnonzero(np.diff(ordered, prepend=-1))
        total = np.empty(len(name), dtype=np.int64)
        total[by] = np.repeat(np.add.reduceat(ks[by].astype(np.int64), first), np.diff(first, append=len(name)))
        del by, ordered
        kept = total >= min_count
        left = np.add.reduceat(kept, np.cumsum(length) - length, dtype=np.int64)  # no row is without words
        packed = ((name & 0xFFFF) << TOTAL_BITS | total)[kept]
        some = left > 0
        batch, key, left = rows["batch"].to_numpy()[some], key[some], left[some]
        ends = np.cumsum(left)
        for i in range(0, len(key), CHUNK):
            a, b = ends[i] - left[i], ends[min(i + CHUNK, len(key)) - 1]
            offsets = pa.array(np.append(ends[i : i + CHUNK] - left[i : i + CHUNK], b) - a, type=pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(packed[a:b]))
            yield pa.record_batch([pa.array(batch[i : i + CHUNK]), pa.array(key[i : i + CHUNK]), lists], schema=schema)

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held, size = [], 0
        for frame in frames:
            if size >= SUMMED and frame.num_rows:  # cut before the last key, which may go on
                rows = pa.Table.from_batches(held)
                key = rows["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield from answer(rows.slice(0, cut))
                    held = rows.slice(cut).combine_chunks().to_batches()
                    size = sum(len(x["words"].flatten()) for x in held)
                del rows
            held.append(frame)
            size += len(frame["words"].flatten())
        if size:
            yield from answer(pa.Table.from_batches(held))
        release()

    return dealt.select("batch", "key", "words", "ks").mapInArrow(run, "batch long, key long, packed array<long>")


def lm_scores(docs: DataFrame, tokenizer_path: str, vocabulary: int, start_id: int, order: int = 3, min_count: int = 2, backoff: float = 0.4, batch_tokens: int = 8_000_000, slot: int = SLOT) -> DataFrame:
    """doc_id, n_tokens, log10_score (sum over tokens), mean_log10 for every row of ``docs``.

    S(w | u v) = count(u v w) / count(u v) if count(u v w) >= ``min_count``, else ``backoff`` * S(w | v), and so on down
    to count(w) / N; a document begins with ``start_id``s, whose count is the number of documents with tokens. ``order``
    is 1 to 3. The default of ``min_count`` is 2 because the corpus scores itself: an n-gram seen once was seen in the
    scored text alone. Counts are over all rows (repeated rows count again). A null or empty text has no tokens, sum 0 and
    a null mean; an empty table gives no rows. Ids must fit into 16 bits. ``slot`` bounds the occurrences of one context
    that are dealt to one place.
    """
    if vocabulary > 1 << 16 or not 1 <= order <= 3:
        raise ValueError("ids must fit into 16 bits, and order must be 1, 2 or 3")
    spark = docs.sparkSession
    batches = stash(token_batches(docs, tokenizer_path, batch_tokens), "token-batches")
    n_docs = batches.agg(F.sum(F.size(F.filter("sizes", lambda s: s > 0)))).first()[0] or 0
    single = token_counts(batches, vocabulary)
    n_tokens = max(1, int(single.sum()))
    spread = single.copy()
    spread[start_id] += n_docs
    slots = spark.sparkContext.broadcast(np.minimum(1 + spread // slot, 1024).astype(np.uint16))
    unigrams = spark.sparkContext.broadcast(single)
    dealt = exploded(batches, order, start_id, slots).repartition("key")
    # a context and slot is in one partition, so neither the sums nor the way back to the batch's rows needs a shuffle
    answers = summed(dealt.sortWithinPartitions("key"), min_count)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.string()), "n_tokens": pa.array([], pa.int64()), "log10_score": pa.array([], pa.float64())})
        sizes = left["sizes"].combine_chunks().flatten().to_numpy().astype(np.int64)
        every = tokens_of(left["ids"][0].as_py(), sizes)
        names, packed = entries(right)
        sums = np.zeros(len(sizes))
        for a, b, x, y in slices(sizes):
            own, ids = sizes[a:b], every[x:y]
            begins = (np.cumsum(own) - own)[own > 0]
            before = unigrams.value[ids]
            value = np.log10(before / n_tokens)
            for m in range(2, order + 1):
                found = totals(grams(ids, own, m, start_id, slots.value), names, packed)
                # the context of a token is the n-gram that ended one token earlier; starts were seen once a document
                context = np.roll(before, 1)
                context[begins] = n_docs
                value = np.where(found > 0, np.log10(np.maximum(found, 1) / np.maximum(context, 1)), np.log10(backoff) + value)
                before = found
            sums[a:b] = np.bincount(np.repeat(np.arange(b - a), own), weights=value, minlength=b - a)
        del names, packed, every
        release()
        return pa.table({"doc_id": left["doc_ids"].combine_chunks().flatten(), "n_tokens": sizes, "log10_score": sums})

    scored = batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, "doc_id string, n_tokens long, log10_score double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log10_score") / F.col("n_tokens")).alias("mean_log10")
    return scored.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_tokens", "log10_score", mean)
