"""Periodic runs, ranked search and the set join against brute force, with nulls, ties, repeats, long texts and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm import periodic, search, set_join

DOC = "doc_id long, text string"


def brute_runs(w, least=12):
    """All runs by trying every period; an interval belongs to its smallest."""
    out, seen = [], set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= 2 * q and (s, n) not in seen:
                seen.add((s, n))
                if n >= least:
                    out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 6)):
            k, n = rng.choice([1, 2, 2, 3, 5, 20]), rng.randint(0, 60)
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        for w, found in zip(texts, periodic.runs_of(texts), strict=True):
            assert [tuple(r) for r in found.tolist()] == brute_runs(w)


def test_runs_of_strings_with_many_squares(monkeypatch):
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    words = [b, [0] * 500, [0, 1, 1, 0, 2] * 90, [i % 7 for i in range(300)] * 2]
    want = [brute_runs(w) for w in words]
    assert [[tuple(r) for r in x.tolist()] for x in periodic.runs_of(words)] == want
    monkeypatch.setattr(periodic, "WALK", 1)  # by scans of the batch instead of walks along lists
    assert [[tuple(r) for r in x.tolist()] for x in periodic.runs_of(words)] == want


def planted(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    h, n = zlib.crc32(str(i).encode()), len(w)
    if h % 10 or not n:
        return text
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(n))


def test_periodic_runs(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "dd", "é"]) for _ in range(rng.randint(0, 90)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (None, "x y " * 20), (503, "x y " * 20), (503, "x y " * 20), (504, "lang wort " * 60_000), (505, "\x0bA\x1ca\x0bA\x1ca\x0b" * 9)]
    docs = spark.createDataFrame(rows, DOC).withColumn("runs", F.lit("clash")).withColumn("start", F.lit(1))
    got = periodic.periodic_runs(docs).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        runs = brute_runs(w) if i != 504 else [(0, 120_000, 2)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((i, len(runs), s, n, q, 1000 * n // q if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    assert sorted((tuple(r)[:8] for r in got), key=repr) == sorted(want, key=repr)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_planted_tails(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 40))) for i in range(400)] + [(None, "a b"), (20, None), (30, ""), (7, "  x\ty ")]
    docs = spark.createDataFrame(rows, DOC)
    got = docs.select("doc_id", periodic.with_planted_runs(F.col("text"), F.col("doc_id")).alias("t")).collect()
    want = [(i, t if t is None or i is None else planted(i, t)) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_search(docs, items, k=10):
    found = [(i, r, Counter(TERM.findall((t or "").translate(LOWER)))) for r, (i, t) in enumerate(docs)]
    n_docs = sum(1 for _, _, c in found if c)
    terms = sum(sum(c.values()) for _, _, c in found)
    df = Counter(t for _, _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, r, c in found:
            m = 10 + (90 * sum(c.values()) * n_docs) // max(1, terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, r))
        out += [(item, k, None if none else i, -s) for k, (s, none, i, _) in enumerate(sorted(scored)[:k], start=1)]
    return out


@pytest.mark.parametrize("block_docs", [3, 256])
def test_search(spark, block_docs):
    rng = random.Random(block_docs)
    words = [f"w{i}" for i in range(40)] + ["Ünïcode", "ÀB", "a1b2", "X", "x"]
    weights = [1 / (1 + i) for i in range(len(words))]
    docs = [(i, "; ".join(rng.choices(words, weights, k=rng.randint(0, 50)))) for i in rng.sample(range(1000), 150)]
    docs += [(2000, None), (2001, ""), (2002, "!?"), (None, "w1 w2 w3 rare"), (2003, "w1 " * 30_000 + "rare"), (2004, "tie rare"), (2005, "tie rare"), (2005, "tie rare")] + [(3000 + i, "twin alike") for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(12)] + [(50, None), (51, ""), (52, "absent"), (53, "TIE rare, rare"), (54, "twin"), (55, "w0 w0 X")]
    frame = spark.createDataFrame(docs, DOC).withColumn("score", F.lit("clash")).withColumn("item_id", F.lit(1)).repartition(5)
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash")).withColumn("rank", F.lit(1))
    got = [tuple(r) for r in search.search(frame, queries, block_docs=block_docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_search(docs, items), key=repr)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOC), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    empty = search.search(docs, spark.createDataFrame([(1, "zz")], "item_id long, text string"))
    assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0


def test_search_bounds_skip_blocks(spark, monkeypatch):
    """A term that one block holds far more often than others: the other blocks are never scored."""
    rows = [(i, "needle " * 5 if i < 20 else "needle " + f"other{i} filler words here to be long " * 30) for i in range(400)]
    docs = spark.createDataFrame(rows, DOC)
    asked = []
    score = search.score_blocks
    monkeypatch.setattr(search, "score_blocks", lambda now, *a: (asked.append(now.count()), score(now, *a))[1])
    items = spark.createDataFrame([(1, "needle")], "item_id long, text string")
    got = [tuple(r) for r in search.search(docs, items, block_docs=20).collect()]
    assert sorted(got) == brute_search(rows, [(1, "needle")]) and sum(asked) < 20


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent, width):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                parent[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    smallest = {r: min((d for d in x if d is not None), default=None) for r, x in ids.items()}
    return [(d, len(sets[i]), smallest[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def family(rng, base, edits):
    w = base.split()
    for _ in range(rng.randint(0, edits)):
        w[rng.randrange(len(w))] = rng.choice(["new", "other", "word"]) + str(rng.randrange(99))
    return " ".join(w)


@pytest.mark.parametrize(("percent", "members"), [(90, 64), (90, 3), (70, 5)])
def test_set_join(spark, percent, members):
    rng = random.Random(percent + members)
    words = [f"v{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=30))
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(120)]
    for f in range(6):
        base = " ".join(rng.choices(words, k=rng.choice([9, 12, 40, 120])))
        rows += [(200 + 40 * f + i, family(rng, base, 4)) for i in range(25)]
    rows += [(600 + i, " ".join(rng.choices(words, k=30)) + " " + passage) for i in range(20)]
    rows += [(800, None), (801, ""), (802, "  "), (803, "Two words"), (804, "two  WORDS"), (None, rows[130][1]), (805, rows[130][1]), (805, rows[130][1]), (806, "a b c d e f g h i j k"), (807, "a b c d e f g h i j k l")]
    docs = spark.createDataFrame(rows, DOC).withColumn("component_id", F.lit("clash")).withColumn("node", F.lit(1))
    got = set_join.similar_sets(docs, percent, 3, members).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(brute_components(rows, percent, 3), key=repr)


def test_set_join_of_odd_texts(spark):
    thue = "a"
    while len(thue) < 2048:
        thue += thue.translate({97: 98, 98: 97})
    other = thue.translate({97: 98, 98: 97})
    long = " ".join(f"t{i * 7 % 90001}" for i in range(90_000))
    rows = [(1, thue), (2, other), (3, f"x {thue} y z"), (4, f"x {other} y z"), (5, long), (6, long + " end"), *[(7, "same text again and again")] * 300]
    got = set_join.similar_sets(spark.createDataFrame(rows, DOC)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7} and len(got) == len(rows)
    assert set_join.similar_sets(spark.createDataFrame(rows[:1], DOC).limit(0)).count() == 0
    with pytest.raises(ValueError):
        set_join.similar_sets(spark.createDataFrame(rows[:1], DOC), percent=100)


def test_set_join_moves_texts_and_tokens_once_and_asks_once(spark, monkeypatch):
    """Nothing but what draws candidates is written or sent twice, at any size."""
    rng = random.Random(13)
    words = [f"v{i}" for i in range(400)]
    rows = []
    for f in range(4):
        base = " ".join(rng.choices(words, k=60))
        rows += [(100 * f + i, family(rng, base, 4)) for i in range(25)]
    plans, asked, stash, across = {}, [], set_join.stash, set_join.links_across

    def stashed(df, what="table"):
        plans.setdefault(what, df._jdf.queryExecution().executedPlan().toString())
        return stash(df, what)

    def asks(pairs, *rest):
        asked.append({tuple(r) for r in pairs.select("node", "group").collect()})
        return across(pairs, *rest)

    monkeypatch.setattr(set_join, "stash", stashed)
    monkeypatch.setattr(set_join, "links_across", asks)
    got = set_join.similar_sets(spark.createDataFrame(rows, DOC), 90, 3, 3).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(brute_components(rows, 90, 3), key=repr)
    first = list(plans)[: list(plans).index("links-within")]
    assert "sets" not in first and "shared-tokens" not in plans and "rarest" not in plans
    assert len([x for x in plans["token-groups"].splitlines() if "Exchange hashpartitioning(token" in x]) == 1
    assert len(asked) > 1 and sum(map(len, asked)) == len(set().union(*asked))


def test_search_takes_few_blocks_at_once(spark, monkeypatch):
    """A worker gets texts and blocks in small frames, whatever the session's number of rows; that is left as it was."""
    from graphloom.llm import search as s

    key, sizes = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    before, stash = spark.conf.get(key), s.stash
    monkeypatch.setattr(s, "stash", lambda frame, what="table": (sizes.update({what: int(spark.conf.get(key))}), stash(frame, what))[1])
    docs = spark.createDataFrame([(i, f"word{i % 7} word{i % 3} text") for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word2 word1"), (2, "nothing")], "item_id long, text string")
    got = s.search(docs, items, block_docs=4).collect()
    assert len(got) == 10 and spark.conf.get(key) == before
    assert sizes["index-blocks"] <= 1024 and sizes["asked-postings"] <= 8 and sizes["block-maxima"] <= 8
