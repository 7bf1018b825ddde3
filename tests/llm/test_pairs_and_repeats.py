"""Near-duplicates and repeated strings against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm.common import stash
from graphloom.llm.components import connected_components
from graphloom.llm.near_dedup import candidate_pairs, near_duplicates, sketches, without_near_duplicates
from graphloom.llm.repeats import keep_rest, merge_spans, removal_report, without_repeats
from graphloom.llm.shingles import shingle_sets
from graphloom.llm.suffixes import repeated_starts, suffix_array

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def make_documents():
    rng = random.Random(5)
    docs = []
    base = sentence(rng, 120)
    for _ in range(60):  # a large group of near copies, some of them far from each other
        w = base.split()
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        docs.append(" ".join(w))
    docs += [base] * 12
    docs += [sentence(rng, rng.randrange(20, 200)) for _ in range(30)]
    passage = sentence(rng, 60)
    docs += [sentence(rng, 30) + " " + passage + " " + sentence(rng, rng.randrange(5, 90)) for _ in range(25)]
    docs += ["", None, "one", "One", "two words", "a b c d", "A b  c d", "tab\tnew\nline", "and " * 300, "é" * 700, "naïve café " * 60, "x" * 5000]
    return list(enumerate(docs, start=3))


DOCS = make_documents()


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # names that the operators use inside must not clash
    return df.select("*", F.lit("en").alias("lang"), F.lit(1).alias("rep"), F.lit("s").alias("key"))


def brute_sets(text):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent=85):
    sets = {i: brute_sets(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            a = len(sets[x] & sets[y])
            if x < y and a and 100 * a >= percent * (len(sets[x]) + len(sets[y]) - a):
                p, q = root(x), root(y)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    want = brute_components(DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, DOCS)).collect()}
    assert got == want


def test_near_duplicate_stage_at_four_fifths(spark):
    """The pipeline's stage against brute force at 0.8: pairs between 0.8 and 0.85, and sets of four and five shingles."""
    import corpus_pipeline

    rng = random.Random(11)
    texts = []
    for _ in range(20):
        w = sentence(rng, 104, 5000).split()
        texts += [" ".join(w), " ".join(w[:36] + ["changed"] + w[37:72] + ["too"] + w[73:])]  # 90 of 110: 0.82
    for n in [8] * 12 + [9] * 12 + [7] * 4:  # 4 of 5 (0.8), 5 of 6 (0.83) and 3 of 4 (0.75) shingles
        w = sentence(rng, n + 1, 5000).split()
        texts += [" ".join(w), " ".join(w[:n])]
    core = sentence(rng, 8, 5000)
    texts += [f"{core} {x}" for x in "abcdefgh"] + [core]  # alike only through the last one
    rows = list(enumerate(DOCS[i][1] for i in range(len(DOCS)))) + list(enumerate(texts, start=1000))
    want = brute_components(rows, 80)
    near = {i: c for i, (_, c) in want.items()}
    assert near != {i: c for i, (_, c) in brute_components(rows, 85).items()}
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, c in near.items() if i == c)


def test_near_duplicates_in_blocks(spark):
    """Clusters larger than a block are searched block by block."""
    got = near_duplicates(frame(spark, DOCS), block_bytes=4000)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: c for i, (_, c) in brute_components(DOCS).items()}


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f g"), (None, "nobody else has these words"), (1, None), (2, ""), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "A B c d e f g"), (3, "another text of this very id")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows)).collect()), key=repr)
    want = [(None, 3, 3, False), (None, 1, None, False), (1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True), (3, 3, 3, True), (3, 3, 3, True), (4, 3, 3, False), (3, 2, 3, True)]
    assert got == sorted(want, key=repr)
    assert near_duplicates(frame(spark, [])).count() == 0
    stays = sorted(((r.doc_id, r.text) for r in without_near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert stays == sorted([rows[1], rows[2], rows[3], rows[4], rows[5], rows[8]], key=repr)
    text_ids = frame(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert {(r.doc_id, r.component_id) for r in near_duplicates(text_ids).collect()} == {(i and f"d{i}", c and f"d{c}") for i, _, c, _ in want}


def test_large_families_draw_few_pairs(spark):
    """Near copies of one text: pairs in proportion, whole components."""
    rng = random.Random(8)
    base = sentence(rng, 300, 5000).split()
    pairs = {}
    for n in (1000, 4000):
        rows = []
        for i in range(n):
            w = list(base)
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((i, " ".join(w)))
        docs = frame(spark, rows).repartition(4)
        reps = stash(sketches(docs, 5, 64))
        pairs[n] = candidate_pairs(reps, 3).count() / reps.count()
    assert near_duplicates(docs).select("component_id").distinct().count() == 1
    assert pairs[4000] < 8 and pairs[4000] < 1.3 * pairs[1000]


@pytest.mark.parametrize("percent", [80, 85])
def test_links_across_unlike_documents(spark, percent):
    """Families around shared boilerplate, chains of small changes, and variants that no confirmed pair joins at first."""
    rng = random.Random(percent)
    boiler = sentence(rng, 200, 5000)
    texts = [boiler + " " + sentence(rng, rng.randrange(10, 120), 5000) for _ in range(60)]
    texts += [t + " " + sentence(rng, 3) for t in texts[:30]]
    chain = sentence(rng, 120, 5000).split()
    for _ in range(40):  # neighbours are alike, the ends are not
        chain[rng.randrange(120)] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(chain))
    slots = sentence(rng, 100, 5000).split()
    for _ in range(120):  # a template with four slots of few values
        w = list(slots)
        for at in (10, 35, 60, 85):
            w[at] = f"v{rng.randrange(5)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    want = {i: c for i, (_, c) in brute_components(rows, percent).items()}
    assert {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), percent=percent, block_bytes=20_000).collect()} == want


def test_shingles_count_like_sets():
    texts = [t for _, t in DOCS]
    assert [len(s) for s in shingle_sets(texts, group_bytes=3000)] == [len(brute_sets(t)) for t in texts]


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 60), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {40: 40, 50: 40, 60: 40}


def brute_report(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        hit = np.zeros(len(b) + 1, dtype=int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                hit[k] += 1
                hit[k + length] -= 1
        gone = np.cumsum(hit)[: len(b)] > 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"crowd": 3}, {"block_bytes": 500}])
def test_repeats_match_brute_force(spark, options):
    rows = [*DOCS, (1, "q" * 1000), (1, "q" * 1000), (None, None), (None, "z" * 250)]
    got = removal_report(frame(spark, rows), 200, **options)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == brute_report(rows, 200)


def test_repeats_of_nothing(spark):
    assert removal_report(frame(spark, [])).count() == 0
    assert [tuple(r)[1:4] for r in removal_report(frame(spark, [(1, None), (2, "short")])).collect()] == [(0, 0, 0), (5, 0, 0)]


def test_texts_without_repeats_stay_valid(spark):
    shared = "é" * 150  # 300 bytes
    docs = frame(spark, [(1, "a" + shared + "b"), (2, "cc" + shared + "d"), (3, None), (4, "alone")])
    got = {r.doc_id: r.text for r in without_repeats(docs).collect()}
    assert got == {1: "ab", 2: "ccd", 3: None, 4: "alone"}
    assert without_repeats(docs).columns == docs.columns


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=120).map(lambda b: bytes(x % 3 + 97 for x in b)))
def test_suffix_array_is_sorted(text):
    data = np.frombuffer(text, dtype=np.uint8)
    assert suffix_array(data, 256).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    count = Counter(text[i : i + 8] for i in range(len(text) - 7))
    assert repeated_starts(data, 8).tolist() == [i + 8 <= len(text) and count[text[i : i + 8]] > 1 for i in range(len(text))]


def test_spans_merge():
    spans = [{"first": 0, "last": 2}, {"first": 12, "last": 12}, {"first": 30, "last": 30}]
    assert merge_spans(spans, 10) == [(0, 22), (30, 40)]
    assert keep_rest(b"x" * 50, merge_spans(spans, 10)) == b"x" * 18
