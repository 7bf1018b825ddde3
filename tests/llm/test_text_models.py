"""Toxicity, language identification, language-model scores, decontamination."""

import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import decontamination, langid, lm_scores, toxicity
from graphloom.llm.common import held_out

EN = "the cat sat on the mat and then it went away with another animal"
DE = "der hund lief durch den wald und dann kam er wieder nach hause"


def words(text):
    counts = Counter()
    for w in (text * 20).split():
        w = f"^^{w}$"
        counts.update(w[i : i + 3] for i in range(len(w) - 2))
    return counts


MODEL = toxicity.CharModel(words(EN + " idiot stupid moron loser pathetic " + DE))


@pytest.mark.parametrize("disguised, plain", [("1d10t", "idiot"), ("stuuuupid", "stupid"), ("m0r0n", "moron"), ("l0$er", "loser"), ("p@thet1c", "pathetic"), ("cat", "cat")])
def test_viterbi_restores(disguised, plain):
    assert toxicity.viterbi(disguised, MODEL) == plain


def test_restored_words():
    restore = toxicity.Restorer(MODEL).words
    assert "idiot" in restore("You are an i d i o t today")
    assert "idiot" in restore("what an i.d.i.o.t!!!")
    assert {"the", "idiot"} <= restore("t h e  i d 1 o t")
    assert "stupid" in restore("he is so s t u p 1 d")
    assert "stupid" in restore("-".join("stupid") + "-" * 50)
    assert {"stupid", "cat"} <= restore("a STUPIIIID cat***")
    assert restore(None) == restore("") == restore("   ") == set()
    assert restore("a" * 30_000)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="idot1o 0tcas@", min_size=1, max_size=7))
def test_viterbi_is_the_best_path(token):
    """Against all readings of a short token."""
    from graphloom.llm.toxicity import DROP_LOOKALIKE, DROP_REPEAT, DROP_SYMBOL, GLUE, LEET, SPLIT, SUBSTITUTE, WIDE_GLUE, WIDE_SPLIT

    readings = [("^^", 0.0, "")]
    previous = ""
    for m in re.finditer(r"\s+|\S", token):
        c, after = m.group(), []
        for state, score, out in readings:
            if c.isspace():
                after.append((state, score + (WIDE_GLUE if len(c) > 1 else GLUE), out))
                if state != "^^":
                    after.append(("^^", score + MODEL.score(state, "$") + (WIDE_SPLIT if len(c) > 1 else SPLIT), out + " "))
                continue
            after += [(state[1] + x, score + (0.0 if c.isalpha() else SUBSTITUTE) + MODEL.score(state, x), out + x) for x in (c if c.isalpha() else LEET.get(c, ""))]
            if not c.isalpha():
                after.append((state, score + (DROP_LOOKALIKE if c in LEET else DROP_SYMBOL), out))
            elif c == previous:
                after.append((state, score + DROP_REPEAT, out))
        previous = previous if c.isspace() else c
        readings = after
    final = [(score + (MODEL.score(state, "$") if state != "^^" else 0.0), out) for state, score, out in readings]
    best = max(final)[0]
    assert any(out == toxicity.viterbi(token, MODEL) and score >= best - 1e-9 for score, out in final)


def toxic_rows(n=400):
    import random

    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice((EN + " " + DE).split()) for _ in range(30))
        bad = i % 5 == 0
        if bad:
            text += " " + rng.choice(["idiot", "m0ron", "l o s e r", "stuuupid", "pathetic"])
        docs.append((i, text))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_learns_from_training_rows_only(spark):
    docs, labels = toxic_rows()
    d = spark.createDataFrame([*docs, (None, None), (-1, ""), (-2, "x" * 20_000)], "doc_id long, text string")
    given = spark.createDataFrame([*labels, (7, None), (None, 1), (0, 1)], "doc_id long, toxic int")
    model = toxicity.train(d, given)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    truth = dict(labels)
    assert all((got[i] >= 0.3) == bool(y) for i, y in truth.items())
    assert 0 <= got[None] < 0.3 and 0 <= got[-1] < 0.3 and 0 <= got[-2] < 0.3
    assert toxicity.score(d.limit(0), model).count() == 0
    empty = toxicity.train(d, given.limit(0))
    assert all(0 <= r.score <= 1 for r in toxicity.score(d, empty).collect())


def test_toxicity_learns_from_every_labelled_row(spark):
    n, telling = 40_000, ["idiot", "moron", "loser", "pathetic", "stupid", "wretch", "cretin", "dimwit"]
    plain = (EN + " " + DE).split()
    learned = spark.range(n).select(F.col("id").alias("doc_id")).filter(~held_out())
    ids = [r.doc_id for r in learned.orderBy("doc_id").collect()]
    assert len(ids) > 20_000
    told = {i: telling[k % len(telling)] for k, i in enumerate(ids[:: len(ids) // (3 * len(telling))][: 3 * len(telling)])}
    docs = [(i, f"{plain[i % len(plain)]} {told.get(i, plain[i * 7 % len(plain)])} a{i}") for i in range(n)]
    labels = [(i, int(i in told)) for i in range(n)]
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    bound = toxicity.lower_bound(3, 3)  # each word is in three texts
    asked = toxicity.score(spark.createDataFrame(list(enumerate(telling)), "doc_id long, text string"), model)
    assert all(r.score >= bound for r in asked.collect())


def test_toxic_rules_leave_no_sure_feature(spark):
    rng = random.Random(5)
    names = [f"w{i:02}" for i in range(30)]
    texts = [(sorted(rng.sample(names, rng.randint(0, 4))), rng.randint(0, 1)) for _ in range(300)]
    texts = [(own, int(toxic or "w03" in own or "w07" in own)) for own, toxic in texts]
    patterns = spark.createDataFrame(texts, "names array<string>, toxic int").groupBy("names").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    rules, base = toxicity.cover(patterns, 0.4, 3)
    assert {"w03", "w07"} <= rules.keys()
    left = [(own, toxic) for own, toxic in texts if not rules.keys() & set(own)]
    assert base == (sum(toxic for _, toxic in left) + 0.5) / (len(left) + 1)
    for f in names:
        own = [toxic for having, toxic in left if f in having]
        assert sum(own) < 3 or round(toxicity.lower_bound(sum(own), len(own)), 2) < 0.4


def test_language_backs_off_to_ngrams(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(40)] + [(100, EN, None), (101, None, "en")]
    asked = [(1, "the animal", None), (2, "wieder durch", None), (3, "animalic", None), (4, "waldhund", None), (5, "12 !! \u00bd \u2167", None), (6, None, None), (7, "", None), (None, "the", "x"), (1, "the animal", None), (8, "the " * 30_000, None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame(asked, "doc_id long, text string, lang string")
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect()]
    assert sorted(got, key=repr) == sorted([(1, "en"), (2, "de"), (3, "en"), (4, "de"), (5, "und"), (6, "und"), (7, "und"), (None, "en"), (1, "en"), (8, "en")], key=repr)
    # scores by the definition: log frequencies of known words, mean log frequencies of the longest known n-grams of others
    counts = {(x, n): Counter() for x in ("de", "en") for n in range(6)}
    for _, text, lang in rows[:40]:
        if text and lang and zlib.crc32(str(_).encode()) % 4 != 2:
            for w in text.lower().split():
                counts[lang, 0][w] += 1
                for n in range(1, 6):
                    counts[lang, n].update(langid.grams(w, n))
    known = {n: {g for x in ("de", "en") for g, k in counts[x, n].items() if k >= 2} for n in range(6)}

    def log(x, n, g):
        k = counts[x, n][g]
        return math.log((k if k >= 2 else 0) + 0.5) - math.log(counts[x, n].total() + 0.5 * len(known[n]))

    def word(x, w):
        for n, names in [(0, [w]), *((n, langid.grams(w, n)) for n in range(5, 0, -1))]:
            if found := [log(x, n, g) for g in names if g in known[n]]:
                return sum(found) / len(found)
        return 0.0

    for text in ("the animal wald", "animalic zzz", "hundehaus cat"):
        total = {x: sum(word(x, w) for w in text.split()) for x in ("de", "en")}
        lang, posterior = langid.Scorer(model)(text)
        assert lang == max(total, key=total.get) and math.isclose(posterior, 1 / (1 + math.exp(min(total.values()) - max(total.values()))))
    none = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("order, least", [(3, 2), (3, 1), (2, 3), (1, 2)])
def test_scores_match_brute_force(spark, order, least):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(i, f"{EN} number {i % 3}" if i % 2 else DE) for i in range(30)] + [(50, None), (51, ""), (52, EN), (52, EN), (None, "alone zebra"), (53, "the " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS batch", "1 AS gram").repartition(3)
    tokenizer = Tokenizer.from_file(path)
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    count, n_docs, n = Counter(), sum(len(x) > 0 for x in ids), sum(map(len, ids))
    padded = [(49406,) * (order - 1) + tuple(x) for x in ids]
    for x, own in zip(padded, ids, strict=True):
        for i in range(order - 1, order - 1 + len(own)):
            count.update(x[i - m : i + 1] for m in range(order))

    def s(gram):
        if len(gram) == 1:
            return math.log10(count[gram] / n)
        before = n_docs if set(gram[:-1]) == {49406} else count[gram[:-1]]
        return math.log10(count[gram] / before) if count[gram] >= least else math.log10(0.4) + s(gram[1:])

    want = [(i, len(own), round(sum(s(x[k : k + order]) for k in range(len(own))), 6)) for (i, _), x, own in zip(rows, padded, ids, strict=True)]
    got = lm_scores.lm_scores(docs, path, 49_408, 49_406, order, least, batch_tokens=300, slot=50).collect()
    assert sorted(((r.doc_id, r.n_tokens, round(r.log10_score, 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert lm_scores.lm_scores(docs.limit(0), path, 49_408, 49_406).count() == 0


def test_totals_of_whole_keys_across_batches(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for batch in range(6):
        for key in range(40):
            own = sorted(rng.sample(range(9), rng.randint(1, 5)))
            rows.append((batch, key, own, [rng.randint(1, 2) for _ in own]))
    total = Counter()
    for _, key, own, ks in rows:
        total.update({(key, w): k for w, k in zip(own, ks, strict=True)})
    want = {(b, key, tuple(w << lm_scores.TOTAL_BITS | total[key, w] for w in own if total[key, w] >= 5)) for b, key, own, _ in rows}
    dealt = spark.createDataFrame(rows, "batch long, key long, words array<int>, ks array<int>").repartition(2, "key").sortWithinPartitions("key")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # keys go on in the next Arrow batch
    try:
        for most in (1, 50, 1_000_000):
            monkeypatch.setattr(lm_scores, "SUMMED", most)
            got = lm_scores.summed(dealt, 5).collect()
            assert {(r.batch, r.key, tuple(r.packed)) for r in got} == {x for x in want if x[2]}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_totals_of_unordered_grams():
    names = [3, 5, 8, 1 << 40]
    packed = [n << 2 | 1 for n in (10, 20, 30, 40)]
    names, packed = (lm_scores.np.array(x, dtype="int64") for x in (names, packed))
    got = lm_scores.totals(lm_scores.np.array([1 << 40, 9, 3, 1 << 50, 3, 8]), names, packed)
    assert got.tolist() == [161, 0, 41, 0, 41, 121]
    assert lm_scores.totals(names, names[:0], packed[:0]).tolist() == [0, 0, 0, 0]


def test_templates():
    tokens, behind = decontamination.template("Then Anna bought 12 kg of rice. She paid 3.50 dollars")
    assert tokens == ["then", "<name>", "bought", "<num>", "<unit>", "of", "rice", "she", "paid", "<num>", "<unit>"]
    assert behind[1] == "anna" and behind[3] == "12"


def test_decontamination(spark):
    item = "A farmer called Peter sells 12 boxes of apples to Maria and keeps 12 boxes for his own family at home today"
    changed = item.replace("12", "31").replace("Peter", "Paul").replace("Maria", "Zoe")
    broken = item.replace("12", "31", 1)
    filler = "nothing to see here at all just some words that go on and on without any meaning for a while "
    rows = [(1, filler + item + ". " + filler), (2, filler + changed), (3, filler * 30), (4, None), (5, ""), (None, item), (6, broken), (6, broken), (7, "short one"), (8, filler * 2000 + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "short one"), (None, item)], "item_id long, text string")
    got = {(r.doc_id, r.contaminated, r.item_id, r.exact) for r in decontamination.contamination(docs, bench).collect()}
    # one number that became two different ones is no re-parameterised copy; the first number's change alone is
    assert {(1, True, 10, True), (2, True, 10, False), (3, False, None, None), (4, False, None, None), (5, False, None, None), (None, True, 10, True), (7, True, 13, True), (8, True, 10, True)} <= got
    assert decontamination.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.contamination(docs.limit(0), bench).count() == 0


FILLER = "nothing to see here at all just some words that go on and on without any meaning for a while. "


def flagged(spark, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    best = {(r.doc_id, r.item_id): (r.coverage, r.exact) for r in decontamination.leaks(docs, bench).collect()}
    return best, sorted((r.doc_id, r.contaminated) for r in decontamination.contamination(docs, bench).collect())


def test_decontamination_judges_each_occurrence(spark):
    def item(n):
        return f"A baker sells {n} loaves of bread each morning and wants to know how much flour that takes. "

    three = FILLER.join(item(n) for n in (5, 7, 9))
    variants = FILLER + item(21) + FILLER + item(34) + FILLER + item(34)
    chance = item(5) + FILLER + "he sells 88 loaves of bread each morning and wants. " + FILLER + "who sells 99 loaves of bread each morning and wants. "
    broken = "A baker sells 5 loaves of bread each morning and sells 5 loaves of cake each evening to his own friends"
    wrong = broken.replace("5", "6", 1).replace(" 5 ", " 8 ")
    shifted = broken.replace("5", "6").replace("and sells", "and really sells")  # three windows before and three behind
    rows = [(1, three), (2, variants), (3, chance), (4, wrong), (5, item(77)), (5, FILLER), (6, "".join(item(n) for n in (5, 7, 9))), (7, shifted)]
    best, found = flagged(spark, rows, [(1, item(5)), (2, item(7)), (3, item(9)), (4, broken)])
    assert {(1, i) for i in (1, 2, 3)} | {(6, i) for i in (1, 2, 3)} <= {k for k, v in best.items() if v == (1.0, True)}
    assert best[2, 1] == (1.0, False) and best[3, 1] == (1.0, True) and (7, 4) in best
    # two values for one in a single occurrence are no copy; rows that share an id are judged by their own text
    assert (4, 4) not in best
    assert found == [(1, True), (2, True), (3, True), (4, False), (5, False), (5, True), (6, True), (7, True)]


def test_decontamination_finds_items_of_placeholders(spark):
    items = [(1, "12 + 30 + 7 + 5 = ?"), (2, "Who Wrote War And Peace And Anna Karenina In Moscow"), (3, "Anna, Bertha, Carl, Dora, Emil, Friedrich, Gustav, Heinrich, Ida and Julius")]
    items += [(4, "Please add up all of these numbers for me now: 11, 22, 33, 44, 55, 66, 77, 88, 99, 110, 121, 132")]
    rows = [(i, FILLER + "so " + text + " and so on") for i, text in items]
    other = FILLER + "13 + 31 + 8 + 6 = ? and Who Sold War And Hunger And Bread Pudding In Berlin. " + FILLER
    variant = FILLER + items[3][1].replace("1", "6").replace("2", "7").replace("3", "8")
    best, found = flagged(spark, [*rows, (5, other), (6, variant), (7, FILLER + "100 200 300 400 500 600 700 800 900")], items)
    assert {k for k in best if k[0] < 5} == {(1, 1), (2, 2), (3, 3), (4, 4)}
    assert best[1, 1] == (1.0, True) and best[4, 4][1]
    assert found == [(1, True), (2, True), (3, True), (4, True), (5, False), (6, True), (7, False)]
    assert best[6, 4] == (1.0, False)


def brute_leaks(docs, items, width=8, coverage=0.5, run_windows=6, tolerance=8):
    """(document number, item) of every leak, from all pairs of windows, by the definition in leaks()."""
    marks = decontamination.PLACEHOLDERS
    known = []  # item, text number, place, windows of the item, template, words, slots, telling
    for number, (item, body) in enumerate(items):
        tokens, words = decontamination.template(body)
        wide = min(width, len(tokens))
        for i in range(len(tokens) - wide + 1 if wide else 0):
            t, w = tuple(tokens[i : i + wide]), tuple(words[i : i + wide])
            known.append((item, number, i, len(tokens) - wide + 1, t, w, [x for x, k in zip(w, t, strict=True) if k in marks], 2 * sum(k in marks for k in t) < wide))
    found = set()
    for d, body in enumerate(docs):
        tokens, words = decontamination.template(body)
        per: dict = {}
        for wide in {len(k[4]) for k in known}:
            at_template, at_words = {}, {}
            for k in known:
                if len(k[4]) == wide:
                    for i in range(len(tokens) - wide + 1):
                        if tuple(tokens[i : i + wide]) == k[4]:
                            at_template.setdefault(i, []).append(k)
                        if not k[7] and tuple(words[i : i + wide]) == k[5]:
                            at_words.setdefault(i, []).append(k)
            strong = {i for i, ks in at_template.items() if all(k[7] for k in ks)} | set(at_words)
            places = sorted({*at_template, *at_words})
            good, run = set(), []
            for p in [*places, None]:
                if run and (p is None or p > run[-1] + 1):
                    good |= set(run) if strong & set(run) else set()
                    run = []
                run.append(p)
            for i in set(at_template) & good:
                slots = [w for w, t in zip(words[i : i + wide], tokens[i : i + wide], strict=True) if t in marks]
                for k in at_template[i]:
                    per.setdefault((k[0], k[1]), []).append((i, k[2], k[3], k[6], slots, k[7]))
            for i, ks in at_words.items():
                for k in ks:
                    per.setdefault((k[0], k[1]), []).append((i, k[2], k[3], [], [], True))
        for (item, _), rows in per.items():
            alone: dict = {}
            for r in rows:
                alone.setdefault(r[0] - r[1], []).append(r)
            groups = [g for g in alone.values() if any(r[5] for r in g)]
            begins, chain, n_item = sorted(alone), [], rows[0][2]
            for b in [*begins, None]:
                if chain and (b is None or b - chain[-1] > min(tolerance, n_item - 1)):
                    joined = [r for c in chain for r in alone[c]]
                    groups += [joined] if len(chain) > 1 and any(r[5] for r in joined) else []
                    chain = []
                chain.append(b)
            # windows with the item's own values count together wherever they stand
            groups.append([(*r[:3], [], [], True) for g in alone.values() if any(r[5] for r in g) for r in g if r[3] == r[4]])
            for g in groups:
                n = len({r[1] for r in g})
                pairs = {(a, b) for r in g for a, b in zip(r[3], r[4], strict=True)}
                changed = [a for a, b in pairs if a != b]
                agree = not changed or len({a for a, _ in pairs}) == len(pairs) or len(set(changed)) == len(changed)
                if g and agree and (n >= coverage * n_item or n >= run_windows):
                    found.add((d, item))
    return found


def test_decontamination_against_brute_force(spark):
    rng = random.Random(12)
    common = "the of a train car ship leaves goes sells weighs and costs per from with how much many what is".split()
    slots = [lambda: str(rng.randrange(99)), lambda: rng.choice(["kg", "km", "hours"]), lambda: rng.choice(["Anna", "Bob", "Paris", "Rome"]), lambda: rng.choice(["two", "ten"])]

    def words(n, share):
        return [rng.choice(slots)() if rng.random() < share else rng.choice(common) for _ in range(n)]

    items = [(f"item{i}", " ".join(words(rng.choice([3, 7, 8, 9, 14, 25]), rng.choice([0.1, 0.3, 0.7])))) for i in range(14)] + [("none", None), ("empty", ""), (None, "a b c d e f g h i")]
    docs = [None, "", "12 kg"]
    for _ in range(90):
        own = items[rng.randrange(14)][1].split()
        cut = own[rng.choice([0, 0, 1, 4]) : len(own) - rng.choice([0, 0, 2])]
        swap = {w: rng.choice(slots)() if rng.random() < 0.5 else w for w in cut if not w.islower() or w in ("kg", "km", "hours", "two", "ten")}
        cut = [swap.get(w, w) for w in cut]
        if rng.random() < 0.4 and cut:
            cut.insert(rng.randrange(len(cut)), rng.choice(common))
        docs.append(" ".join([*words(rng.randint(0, 12), 0.2), *cut, *words(rng.randint(0, 12), 0.2), *(cut if rng.random() < 0.2 else [])]))
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("hash", F.lit("clash")).withColumn("item_id", F.lit(5))
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("rid", F.lit("clash"))
    want = brute_leaks(docs, [i for i in items if i[0] is not None and i[1] is not None])
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(frame, bench).collect()} == want and len(want) > 20
    flagged = {r.doc_id for r in decontamination.contamination(frame, bench).filter("contaminated").collect()}
    assert flagged == {d for d, _ in want}
    kept = {r.doc_id for r in decontamination.without_leaks(frame, bench).collect()}
    assert kept == set(range(len(docs))) - flagged
