"""Every pipeline stage and the repeat and near-duplicate operators on nulls, empty and very long texts, equal rows, colliding
look-alikes, clashing columns and empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import langid, shingles, toxicity, topk
from graphloom.llm.common import held_out
from graphloom.llm.near_dedup import near_duplicates
from graphloom.llm.repeats import removal_report

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))


def look_alikes():
    thue = "a"
    while len(thue) < 2048:
        thue += thue.translate({97: 98, 98: 97})
    return thue, thue.translate({97: 98, 98: 97})


def brute_removed(texts, length=200):
    seen: dict = {}
    for t in texts:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(sum(gone))
    return out


def test_repeats_of_many_equal_rows(spark):
    rng = random.Random(1)
    text, other = words(rng, 280), words(rng, 260)
    rows = [(1, text)] * 3000 + [(None, other)] * 2000 + [(2, words(rng, 90)), (3, None), (4, "")]
    got = removal_report(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    want = {(1, len(text), len(text), 1, 3000), (None, len(other), len(other), 1, 2000), (2, len(rows[5000][1]), 0, 0, 1), (3, 0, 0, 0, 1), (4, 0, 0, 0, 1)}
    assert {tuple(r) for r in got} == want


def test_repeats_of_look_alikes_and_long_texts(spark):
    rng = random.Random(2)
    a, b = look_alikes()
    long = words(rng, 150_000)
    texts = [a, b, f"x {a} y", f"z {b} w", words(rng, 40) + a[:400] + words(rng, 40), words(rng, 40) + b[:400] + words(rng, 40)]
    rows = [*enumerate(texts), (10, long + long[7000:7500]), (11, words(rng, 60) + long[90_000:90_300])]
    got = {r.doc_id: r.n_removed for r in removal_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(6)] == brute_removed(texts)
    assert got[10] == 1000 + 300 and got[11] == 300


def test_near_duplicates_of_look_alikes_and_long_texts(spark):
    rng = random.Random(3)
    a, b = look_alikes()
    long = words(rng, 150_000)
    rows = [(1, a), (2, b), (3, f"one {a} two three four five"), (4, f"one {b} two three four five"), (5, long), (6, long + " more"), *[(7, "equal rows all of them here")] * 500, *[(None, "equal rows all of them here")] * 500]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").distinct().collect()
    assert {tuple(r) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7), (None, 7)}


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    passage = words(rng, 60)
    rows = [(i, f"{words(rng, 30)} {passage if i % 3 == 0 else ''} {words(rng, 20)}") for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \t"), (None, words(rng, 40)), (None, None), (103, words(rng, 60_000)), (104, "twice the same row")] + [(104, "twice the same row")] * 6
    rows += [(105, rows[1][1]), (106, rows[1][1] + " tail"), (5, words(rng, 25))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = {c: F.lit("clash") for c in ("rid", "node", "key", "score", "spans", "row", "component_id", "hash", "length", "piece", "h")}
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.char_length("text").cast("long")} | extra)


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_filtering_stage(spark, odd, name):
    after = STAGES[name](spark, odd, SF)
    assert after.columns == odd.columns and after.schema["text"].dataType == odd.schema["text"].dataType
    got = after.collect()
    assert {r.doc_id for r in got} >= {100, 101, 102, 103, None, *(i for i in range(40) if i % 3)} - {1, 105, 106}
    assert sum(r.text is None for r in got) == 2 and {1, 105} & {r.doc_id for r in got}
    assert sum(r.doc_id == 104 for r in got) == (1 if name == "near_dedup" else 7)
    if name == "suffix_dedup":
        texts = [r.text for r in odd.orderBy("doc_id").collect() if r.doc_id != 103]
        assert sum(len(r.text or "") for r in got if r.doc_id != 103) == sum(len(t or "") for t in texts) - sum(brute_removed(texts))
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert STAGES[name](spark, odd.limit(0), SF).count() == 0


def test_packing_stage(spark, odd):
    got = STAGES["packing"](spark, odd, SF)
    pieces = got.collect()
    assert sum(r.piece == 0 for r in pieces) == odd.count()
    assert sum(r.length == 1 and r.start == 0 for r in pieces if r.doc_id in (100, 101)) == 2
    assert STAGES["packing"](spark, odd.limit(0), SF).count() == 0


def test_clashing_columns_elsewhere(spark, odd):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    scored = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert len(scored) == odd.count() and len({r.score for r in scored if r.doc_id in (100, 101, 102)}) == 1
    found = langid.identify(odd, langid.train(odd)).collect()
    assert len(found) == odd.count() and {r.lang_pred for r in found if r.doc_id in (100, 101, 102)} == {"und"}
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    clash = vectors.withColumns({c: F.lit("clash") for c in ("v", "cell", "far", "block", "part", "least", "parts")})
    plain = topk.top_products(topk.quantised(vectors), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, topk.top_products(topk.quantised(clash), F.col("vec_id") % 20 == 0).collect())) == sorted(map(tuple, plain))


def test_toxic_stage_learns_from_every_labelled_row(spark, tmp_path):
    n, telling = 30_000, ["idiot", "moron", "loser", "pathetic", "stupid", "wretch", "cretin", "dimwit"]
    told = {1_000 * k + j: w for k, w in enumerate(telling) for j in range(4)}
    ids = [r.doc_id for r in spark.range(n).select(F.col("id").alias("doc_id")).filter(~held_out()).orderBy("doc_id").collect()]
    rows = [(i, f"plain text {told.get(at, 'here')} a{i}", int(at in told)) for at, i in enumerate(ids)]
    spark.createDataFrame([(i, toxic) for i, _, toxic in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(i, text) for i, text, _ in rows], "doc_id long, text string")
    left = {r.doc_id for r in STAGES["toxicity"](spark, docs, str(tmp_path)).collect()}
    assert len(rows) > 20_000 and left == {i for i, _, toxic in rows if not toxic}


def test_toxic_stage_learns_from_rows_that_op1_holds_out_and_from_unlabelled_texts(spark, tmp_path):
    ids = [r.doc_id for r in spark.range(4_000).select(F.col("id").alias("doc_id")).filter(held_out()).orderBy("doc_id").collect()]
    rows = [(i, f"plain text {'dimwit' if at % 20 == 0 else 'here'} a{i}", int(at % 20 == 0)) for at, i in enumerate(ids)]
    labels = spark.createDataFrame([(i, toxic) for i, _, toxic in rows], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([*[(i, text) for i, text, _ in rows], (-1, "unlabelled quux"), (None, "quux")], "doc_id long, text string")
    left = {r.doc_id for r in STAGES["toxicity"](spark, docs, str(tmp_path)).collect()}
    assert left == {i for i, _, toxic in rows if not toxic} | {-1, None}
    counts = toxicity.train(docs, labels, whole=True)["trigrams"]
    assert counts["quu"] == 2 and counts["dim"] == sum(toxic for *_, toxic in rows)


def test_toxic_stage_keeps_all_without_labels(spark, odd, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert STAGES["toxicity"](spark, odd, str(tmp_path)).count() == odd.count()


def test_shingles_keep_no_words_in_a_worker():
    before = {name: len(x) for name, x in vars(shingles).items() if isinstance(x, dict)}
    assert all(len(s) for s in shingles.shingle_sets([" ".join(f"w{i}" for i in range(n, n + 500)) for n in range(0, 5_000, 500)]))
    assert {name: len(x) for name, x in vars(shingles).items() if isinstance(x, dict)} == before


def test_trigrams_add_up_over_parts():
    parts = [Counter({"idiot": 3, "über": 2}), Counter({"idiot": 4, "noooo": 9}), Counter()]
    want: Counter = Counter()
    for word, k in (parts[0] + parts[1]).items():
        padded = f"^^{word}$"
        want.update({padded[i : i + 3]: k for i in range(len(padded) - 2)} if word != "noooo" else {})
    rows = toxicity.trigram_rows([toxicity.trigram_counts(p) for p in parts])
    assert dict(zip(rows.gram, rows.k, strict=True)) == want
    assert not len(toxicity.trigram_rows([toxicity.trigram_counts(Counter())]))
