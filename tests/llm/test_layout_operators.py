"""Packing, sharding, WARC, top-k search, and the pipeline."""

import io
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import packing, sharding, topk, warc

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 6))
def test_best_fit(lengths, open_bins):
    placed = packing.best_fit(lengths, 64, open_bins)
    bins = defaultdict(list)
    for (b, offset), size in zip(placed, lengths, strict=True):
        bins[b].append((offset, size))
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 64


def test_best_fit_prefers_the_fullest_bin():
    assert packing.best_fit([40, 50, 10, 14], 64, 8) == [(0, 0), (1, 0), (1, 50), (0, 40)]
    # with one open bin the fullest closes first
    assert packing.best_fit([40, 50, 20], 64, 1) == [(0, 0), (1, 0), (2, 0)]


def test_packing(spark):
    texts = ["", None, "Hello, World's 42 things!", "a\tb\nc d e\x1cf", "word " * 5000, "it's <|endoftext|> here", "ÉTÉ été İstanbul", "Sİ. Bİ! e\u0301. x\u0327; tail"]
    rows = [*enumerate(texts), (2, texts[2]), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    got = packing.pack(docs, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist() and sum(n for _, n in parts) <= 2048
    assert len(by) == -(-sum(r.length for r in got) // 2048)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def brute_capacity(sizes, shards):
    def fits(c):
        used, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            if at + s > c:
                used, at = used + 1, 0
            at += s
        return used <= shards

    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("seed", [1, 2])
def test_smallest_capacity(spark, seed):
    rng = np.random.default_rng(seed)
    keys = np.sort(rng.choice(2**60, 300, replace=False)) if seed == 1 else np.arange(300) * 7  # spread out, and in one range
    sizes = [int(x) for x in rng.integers(1, 60, 300)]
    sizes[17] = 900
    atoms = spark.createDataFrame([(int(k), s) for k, s in zip(keys, sizes, strict=True)], "key long, size long")
    capacity, starts = sharding.minimax_cuts(atoms, 8)
    assert capacity == brute_capacity(sizes, 8)
    of = np.searchsorted(starts, keys, side="right")
    assert max(sum(s for s, o in zip(sizes, of, strict=True) if o == i) for i in range(8)) <= capacity


def test_sharding(spark):
    rows = [(i, f"text {i % 37}" * (1 + i % 5)) for i in range(300)] + [(1000, None), (1001, ""), (None, "é"), (1002, "long" * 20_000), (5, "text 5"), (5, "text 5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = sharding.shard(docs, 8).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, groups = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        groups[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert all(len(s) == 1 for s in groups.values())
    assert sharding.shard(docs.limit(0), 8).count() == 0


def test_records_round_trip():
    record = warc.encode_record(5, "http://x/\r\ny", b"a\r\n\r\nb", warc.base32_sha1(b"a\r\n\r\nb"))
    assert warc.decode_record(record) == (5, "http://x/y", "response", warc.base32_sha1(b"a\r\n\r\nb"), 6, None, b"a\r\n\r\nb")
    revisit = warc.encode_record(None, None, b"abc", warc.base32_sha1(b"abc"), 7, True)
    assert warc.decode_record(revisit) == (None, None, "revisit", warc.base32_sha1(b"abc"), 3, 7, None)


def test_archive_starts_with_its_dictionary():
    import zstandard

    records = [f"record {i} ".encode() * 40 for i in range(300)]
    raw = warc.train_dictionary(records, 4096)
    packer = zstandard.ZstdCompressor(dict_data=warc._dictionary(raw))
    data = warc.dictionary_frame(raw) + b"".join(packer.compress(r) for r in records)
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    assert list(warc.read_frames(io.BytesIO(data), chunk=100)) == records
    with pytest.raises(ValueError):
        list(warc.read_frames(io.BytesIO(data[:-3])))


def test_warc(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 4}</p>" * 50) for i in range(20)] + [(50, None, None), (51, "u", ""), (None, "v", "<p>1</p>" * 50), (60, "w", "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    manifest = warc.write_archives(pages, f"file://{tmp_path}/out", archive_bytes=2000, sample_bytes=1000)
    assert sum(r.n_records for r in manifest.collect()) == len(rows)
    got = {(r.page_id, r.url): r for r in warc.read_archives(manifest).collect()}
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    for i, u, h in rows:
        r, payload = got[i, u], (h or "").encode()
        keeps = i is not None and largest[h or ""] == i
        assert (r.record_type, r.refers_to) == (("response", None) if keeps else ("revisit", largest[h or ""]))
        assert (r.payload_bytes, r.payload_digest) == (len(payload), warc.base32_sha1(payload))
        assert (bytes(r.payload) == payload) if keeps else r.payload is None
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def brute_top(vectors, k):
    out = []
    for q, a in vectors.items():
        if q % 20:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in vectors.items() if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], start=1)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"max_pivots": 3, "part_rows": 40, "query_block": 5}])
def test_top_products(spark, options):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(300 + i, rows[20][1]) for i in range(80)] + [(400, [0.0] * 8), (420, rows[0][1])]
    bad = [(900, None), (920, [1.0, None] * 4), (940, [float("nan")] * 8), (960, [float("inf")] * 8), (None, rows[0][1])]
    df = spark.createDataFrame([*rows, *bad, rows[3]], "vec_id long, embedding array<float>")
    got = topk.top_products(topk.quantised(df), F.col("vec_id") % 20 == 0, 20, **options).collect()
    ints = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v in rows}
    assert sorted(tuple(r) for r in got) == brute_top(ints, 20)


def test_clustered_vectors_meet_few_groups(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16)) * 40
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=16)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    kept = []
    stash = topk.stash
    monkeypatch.setattr(topk, "stash", lambda frame, what="table": (kept.append((what, found := stash(frame, what))), found)[1])
    got = topk.top_products(topk.quantised(df), F.col("vec_id") % 20 == 0, 20, query_block=8).collect()
    ints = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v in rows}
    assert sorted(tuple(r) for r in got) == brute_top(ints, 20)
    asked = [frame for what, frame in kept if what == "asked"]
    pairs = asked[0].union(asked[1]).select("cell", "query_id").distinct().count()
    groups = next(frame for what, frame in kept if what == "cell-parts").count()
    assert groups > 20 and pairs < 60 * groups / 2


def test_routing_is_bounded_in_memory(spark, monkeypatch):
    """Many groups and many queries: no frame or array of a task grows with their product, and a query's vector goes to a
    bundle once."""
    monkeypatch.setattr(topk, "CELLS", 500)
    widest = []
    partition = np.partition
    monkeypatch.setattr(np, "partition", lambda a, *args, **named: (widest.append(a.size), partition(a, *args, **named))[1])
    rng = np.random.default_rng(8)
    n, k = 400, 5
    q = pd.DataFrame({"query_id": np.arange(n), "v": list(rng.integers(-9, 9, size=(n, 4))), "cells": [[0, 1]] * n, "least": [None] * n})
    x = pd.DataFrame({"cell": np.arange(n) % 2, "vec_id": np.arange(n), "v": q.v})
    got = topk.best_of(q, x, 4, k)
    assert max(widest) <= 500
    ints = {i: [int(c) for c in v] for i, v in zip(q.query_id, q.v, strict=True)}
    want = [(i, j, s) for i in range(n) for s, j in sorted(((sum(a * b for a, b in zip(ints[i], ints[j], strict=True)), j) for j in range(n) if j != i), key=lambda p: (-p[0], p[1]))[:k]]
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(want)
    df = spark.createDataFrame([(i, [float(c) for c in rng.normal(size=8)]) for i in range(900)], "vec_id long, embedding array<double>")
    ints = {r.vec_id: [int(np.floor(64 * c)) for c in r.embedding] for r in df.collect()}
    got = topk.top_products(topk.quantised(df), F.col("vec_id") % 20 == 0, 20, part_rows=100, query_block=7).collect()
    assert sorted(tuple(r) for r in got) == brute_top(ints, 20)


def test_top_products_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (20, [1e9, -1e9])], "vec_id long, embedding array<double>")
    got = topk.top_products(topk.quantised(df), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert topk.top_products(topk.quantised(df.limit(0)), F.lit(True)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns, name
        kept, before = {r.doc_id for r in after.select("doc_id").collect()}, {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= before and len(kept) > 0.6 * len(before), name
        docs = after
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
