"""Toxicity scores of texts whose spelling may be disguised.

Noisy channel: a suspicious token (letters mixed with digits or symbols, letters repeated three times or more, letters
set apart by spaces or punctuation) spans a lattice in which a symbol may stand for a letter or be noise and a repeated
letter may be kept or dropped. The Viterbi path under a character trigram model, learned from the corpus, is its
restored form. Restored texts are scored by an ordered list of rules (a word, or the beginning of a word), learned
from labelled texts by sequential covering.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import drop_path, held_out, release, spread, stash, tidy
from graphloom.llm.near_dedup import BROADCAST_ROWS

#: Letters that a digit or symbol may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "&": "a", "*": "aeiou"}
SUBSTITUTE, DROP_REPEAT, DROP_SYMBOL, DROP_LOOKALIKE, STRANGE = -0.7, -0.4, -0.5, -7.0, -9.0
RUN = re.compile(r"([^\W\d_])\1\1")
PARTS = re.compile(r"[^\W\d_]+")
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S(?!\S)){2,}")  # single characters with spaces between
GLUE, SPLIT, WIDE_GLUE, WIDE_SPLIT = -0.1, -1.5, -4.0, -0.1  # a space, and a wider one, within or between words
Z = 1.64  # of the lower bound of a share
HELD = 200_000  # counters that a training task holds
WORDS = 50_000  # distinct words whose trigrams are counted at a time
GROUP = 256  # texts whose restored words are held at a time
CANDIDATES = 500_000  # features that every training task holds; of more, all are counted and joined
EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "¿¡«»„“”‘’…–—"


class CharModel:
    """Character trigrams with fallback to shorter contexts; ``counts`` maps trigrams (words are padded) to numbers."""

    def __init__(self, counts: dict[str, int]):
        two: Counter = Counter()
        one: Counter = Counter()
        last: Counter = Counter()
        after: Counter = Counter()
        for g, k in counts.items():
            two[g[:2]] += k
            last[g[1:]] += k
            after[g[1]] += k
            one[g[2]] += k
        total = sum(one.values()) + 1
        self.letters = {c: math.log((k + 0.1) / total) for c, k in one.items()}
        self.three = {g: math.log(0.9 * k / two[g[:2]] + 0.1 * last[g[1:]] / after[g[1]]) for g, k in counts.items()}
        self.pairs = {g: math.log(0.1 * k / after[g[0]]) for g, k in last.items()}

    def score(self, context: str, c: str) -> float:
        found = self.three.get(context + c)
        if found is None:
            found = self.pairs.get(context[1] + c)
        return found if found is not None else self.letters.get(c, STRANGE) - 3.0


def viterbi(token: str, model: CharModel) -> str:
    """The most likely text that ``token`` disguises: a word, or words if it holds spaces.

    A letter stands for itself, and a repeated one may be dropped; a look-alike stands for one of its letters or is noise;
    other symbols are noise; a space is noise within a word or ends it.
    """
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    previous, at = "", 0
    while at < len(token):
        c = token[at]
        after: dict[str, tuple[float, tuple | None]] = {}

        def reach(state, score, path, after=after):
            if state not in after or score > after[state][0]:
                after[state] = (score, path)

        if c.isspace():
            wide = token[at : at + 2].isspace() and at + 1 < len(token)
            while at < len(token) and token[at].isspace():
                at += 1
            for state, (score, path) in states.items():
                reach(state, score + (WIDE_GLUE if wide else GLUE), path)
                if state != "^^":
                    reach("^^", score + model.score(state, "$") + (WIDE_SPLIT if wide else SPLIT), (" ", path))
            states = after
            continue
        at += 1
        letter = c.isalpha()
        options = [(c, 0.0)] if letter else [(x, SUBSTITUTE) for x in LEET.get(c, "")]
        for state, (score, path) in states.items():
            for x, cost in options:
                reach(state[1] + x, score + cost + model.score(state, x), (x, path))
            if not letter:
                reach(state, score + (DROP_LOOKALIKE if c in LEET else DROP_SYMBOL), path)
            elif c == previous:
                reach(state, score + DROP_REPEAT, path)
        states, previous = after, c
    best = max(((s + (model.score(k, "$") if k != "^^" else 0.0), p) for k, (s, p) in states.items()), key=lambda x: x[0])[1]
    out = []
    while best is not None:
        out.append(best[0])
        best = best[1]
    return "".join(reversed(out))


class Restorer:
    """The set of restored words of a text."""

    def __init__(self, model: CharModel, remember: int = 100_000):
        self.model, self.remember, self.seen = model, remember, {}

    def token(self, token: str) -> tuple[str, ...]:
        found = self.seen.get(token)
        if found is None:
            core = token.strip(EDGES)
            parts = PARTS.findall(token)
            words = [*parts]
            if len(parts) > 2 and all(len(p) == 1 for p in parts):  # s.e.t-a.p.a.r.t, with repeats dropped
                words.append(viterbi("".join(parts), self.model))
            if len(parts) > 1:  # s_et ap.art
                words.append("".join(parts))
            if parts and (not core.isalpha() or RUN.search(core)) and any(not x.isalpha() and x in LEET for x in core) | bool(RUN.search(core)):
                words.append(viterbi(core, self.model))
            if core != token:  # a symbol at the edge may be a letter
                edge = token.strip(".,;:?\"'()[]{}-_~#%&*…")
                if edge != core and any(x in LEET and not x.isalnum() for x in (edge[:1], edge[-1:])):
                    words.append(viterbi(edge, self.model))
            found = tuple(words)
            if len(self.seen) >= self.remember:
                self.seen.clear()
            if len(token) <= 64:
                self.seen[token] = found
        return found

    def words(self, text: str | None) -> set[str]:
        if not text:
            return set()
        text = text.lower()
        tokens = set(text.split())
        words = {t for t in tokens if t.isalpha()}
        for t in tokens - words:
            words.update(self.token(t))
        if RUN.search(text):
            for t in [t for t in tokens if t.isalpha() and RUN.search(t)]:
                words.update(self.token(t))
        if sum(len(t) == 1 for t in tokens) > 1:
            for m in SPACED.finditer(text):
                if sum(x.isalpha() for x in m.group()) > 1:
                    words.update(viterbi(m.group(), self.model).split())
        return words


def features(words: Iterable[str], shortest: int = 3, longest: int = 10) -> set[str]:
    """The words, and their beginnings marked by a star."""
    found = set(words)
    for w in list(found):
        found.update(w[:n] + "*" for n in range(shortest, min(longest, len(w) - 1) + 1))
    return found


def lower_bound(hits: float, n: float, z: float = Z) -> float:
    """Wilson's lower bound of a share."""
    if n <= 0:
        return 0.0
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _lower_bound(hits: Column, n: Column, z: float = Z) -> Column:
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def trigram_counts(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Codes and numbers of the trigrams of padded words, without those that repeat a letter three times; ``words`` with
    their numbers."""
    held = [(f"^^{w}$", k) for w, k in words.items() if not RUN.search(w)]
    codes = np.frombuffer("".join(w for w, _ in held).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    length = np.array([len(w) for w, _ in held], dtype=np.int64)
    whole = np.ones(len(codes), dtype=bool)
    ends = np.cumsum(length)
    whole[np.concatenate([ends - 1, ends - 2])] = False  # trigrams that begin there would reach into the next word
    at = np.flatnonzero(whole)
    grams, place = np.unique(codes[at] << 42 | codes[at + 1] << 21 | codes[at + 2], return_inverse=True)
    k = np.bincount(place, weights=np.repeat(np.array([k for _, k in held], dtype=np.int64), length)[at], minlength=len(grams))
    return grams, k.astype(np.int64)


def trigram_rows(counted: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """gram, k: the sums over several :func:`trigram_counts`."""
    grams, place = np.unique(np.concatenate([g for g, _ in counted]), return_inverse=True)
    k = np.zeros(len(grams), dtype=np.int64)
    np.add.at(k, place, np.concatenate([k for _, k in counted]))
    names = [chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF) for g in grams.tolist()]
    return pd.DataFrame({"gram": pd.Series(names, dtype=object), "k": k})


def feature_counts(texts: DataFrame, wanted: set[str] | None = None) -> DataFrame:
    """feature, n: the number of ``texts`` (words: distinct words of each) that have it; only those ``wanted``, if given."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, seen = Counter(), {}
        for batch in batches:
            for words in batch.words:
                for w in words:
                    if w not in seen:
                        own = features((w,))
                        seen[w] = tuple(own if shared.value is None else own & shared.value)
                size.update(set(chain.from_iterable(map(seen.__getitem__, words))))
                if max(len(size), len(seen)) >= HELD:
                    yield pd.DataFrame(list(size.items()), columns=["feature", "n"])
                    size.clear()
                    seen.clear()
        yield pd.DataFrame(list(size.items()), columns=["feature", "n"])

    return texts.select("words").mapInPandas(tidy(run), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def cover(patterns: DataFrame, least: float, support: int) -> tuple[dict[str, float], float]:
    """Rules from ``patterns`` (names: distinct features of a text, toxic: toxic texts, n: all texts that have just these),
    and the share of toxic texts among those that no rule covers.

    In each round the counts are taken over the texts that no rule covers yet. A feature becomes a rule if in each of its
    texts no other is surer (by the lower bound; of about equal bounds more hits, then the name); such features share no
    text, so a round takes all of them. Only counts of features reach the driver.
    """
    rules: dict[str, float] = {}
    while True:
        own = patterns.select(F.explode("names").alias("f"), "toxic", "n").groupBy("f").agg(F.sum("toxic").alias("hits"), F.sum("n").alias("size"))
        bounds = {r.f: (lower_bound(r.hits, r["size"]), r.hits) for r in own.filter(F.col("hits") >= support).collect()}
        order = sorted(((round(b, 2), hits, f) for f, (b, hits) in bounds.items() if round(b, 2) >= least), reverse=True)
        if not order:
            break
        rank = patterns.sparkSession.sparkContext.broadcast({f: i for i, (_, _, f) in enumerate(order)})

        def behind(batches: Iterable[pd.DataFrame], rank=rank) -> Iterator[pd.DataFrame]:
            found: set[str] = set()
            for batch in batches:
                for names in batch.names:
                    found.update(sorted((f for f in names if f in rank.value), key=rank.value.__getitem__)[1:])
            yield pd.DataFrame({"f": sorted(found)}, dtype=object)

        later = {r.f for r in patterns.select("names").mapInPandas(tidy(behind), "f string").distinct().collect()}
        chosen = [f for _, _, f in order if f not in later]
        rules |= {f: bounds[f][0] for f in chosen}
        patterns = stash(patterns.filter(~F.arrays_overlap("names", F.lit(chosen))), "toxic-patterns")
    left, n = patterns.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return rules, (left + 0.5) / (n + 1) if n else 0.0  # without any text nothing speaks for toxic ones


def train(docs: DataFrame, labels: DataFrame, least: float = 0.4, support: int = 3, sure_at: float = 0.85, whole: bool = False) -> dict:
    """A scoring model from all labelled rows of ``docs`` that are not held out, or, if ``whole``, from all rows: rules from
    every labelled one, trigrams from the words of every text, labelled or not.

    Equal labelled texts count once. Counts stay distributed until only trigrams and features that may become rules are left; these
    are the model, and are all that reaches the driver. A doc_id that is labelled twice counts as toxic if one label says so.
    """
    spark = docs.sparkSession
    given = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    given = (given if whole else given.filter(~held_out())).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    given = F.broadcast(given) if given.count() <= BROADCAST_ROWS else given
    known = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(given, "doc_id")
    known = stash(known.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("h"), "toxic-texts")

    def trigrams(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        counted: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for text in batch.text:
                words.update(PARTS.findall(text.lower()))
                if len(words) >= WORDS:
                    counted.append(trigram_counts(words))
                    words.clear()
                    if sum(len(g) for g, _ in counted) >= HELD:
                        yield trigram_rows(counted)
                        counted.clear()
        yield trigram_rows([*counted, trigram_counts(words)])

    spelt = spread(docs.filter(F.col("text").isNotNull()).select("text")) if whole else known.select("text")
    counts = spelt.mapInPandas(tidy(trigrams), "gram string, k long").groupBy("gram").agg(F.sum("k").alias("k"))
    counts = {r.gram: r.k for r in counts.collect()}
    shared = spark.sparkContext.broadcast(counts)

    def restored(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(CharModel(shared.value))
        for batch in batches:
            for at in range(0, len(batch), GROUP):
                part = batch.iloc[at : at + GROUP]
                yield pd.DataFrame({"toxic": part.toxic, "words": [sorted(restorer.words(t)) for t in part.text]})

    texts = stash(known.select("toxic", "text").mapInPandas(tidy(restored), "toxic int, words array<string>"), "toxic-words")
    drop_path(spark, known)

    bad = stash(feature_counts(texts.filter("toxic = 1")).withColumnRenamed("n", "hits").filter(F.col("hits") >= support), "toxic-hits")
    bad = bad.withColumn("misses", F.lit(0).cast("long"))
    # what a part of the clean texts rules out already needs no count in the rest; the others are counted in both
    part = F.pmod(F.xxhash64("words"), F.lit(3)) == 0
    for clean in (texts.filter("toxic = 0").filter(part), texts.filter("toxic = 0").filter(~part)):
        wanted = {r.feature for r in bad.select("feature").collect()} if bad.count() <= CANDIDATES else None
        more = feature_counts(clean, wanted)
        bad = bad.join(more, "feature", "left").select("feature", "hits", (F.col("misses") + F.coalesce("n", F.lit(0))).alias("misses"))
        bad = stash(bad.filter(_lower_bound(F.col("hits"), F.col("hits") + F.col("misses")) >= least), "toxic-hits")
    useful = {r.feature: lower_bound(r.hits, r.hits + r.misses) for r in bad.collect()}
    heads = {f[:3] for f in useful}
    shared_useful = spark.sparkContext.broadcast((frozenset(useful), heads))

    def incidence(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        useful, heads = shared_useful.value
        for batch in batches:
            names = [sorted(features([w for w in words if w[:3] in heads]) & useful) for words in batch.words]
            yield pd.DataFrame({"names": names, "toxic": batch.toxic})

    rows = texts.mapInPandas(tidy(incidence), "names array<string>, toxic int")
    patterns = stash(rows.groupBy("names").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")), "toxic-patterns")
    drop_path(spark, texts)
    rules, base = cover(patterns, least, support)
    # features that are sure by themselves also count where the rules before them found every text
    return {"trigrams": counts, "rules": {f: b for f, b in useful.items() if b >= sure_at} | rules, "base": base}


class TextScorer:
    """Score, number of rules met and the surest of them."""

    def __init__(self, model: dict):
        self.restorer, self.rules, self.base = Restorer(CharModel(model["trigrams"])), model["rules"], model["base"]
        self.heads = {f[:3] for f in self.rules}

    def __call__(self, text: str | None) -> tuple[float, int, str | None]:
        telling = [w for w in self.restorer.words(text) if w[:3] in self.heads]
        met = features(telling) & self.rules.keys() if telling else ()
        clean = 1.0 - self.base
        for f in met:
            clean *= 1.0 - self.rules[f]
        return 1.0 - clean, len(met), max(met, key=lambda f: (self.rules[f], f), default=None)


def score_column(spark, model: dict, text):
    """The score of a text column, as a column."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = TextScorer(shared.value)
        try:
            for batch in batches:
                yield batch.map(lambda t: scorer(t)[0]).astype(float)
        finally:
            release()

    return F.pandas_udf(run, "double")(text)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1), n_rules (distinct rules that the restored text meets), most_telling (the surest of them).

    A null or empty text has no words and scores the share of toxic texts that no rule finds; repeated rows and null
    ids are scored like any other; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = TextScorer(shared.value)
        for batch in batches:
            out = [scorer(t) for t in batch.text]
            yield pd.DataFrame({"doc_id": batch.doc_id, "score": [x[0] for x in out], "n_rules": [x[1] for x in out], "most_telling": [x[2] for x in out]})

    rows = spread(docs.select(F.col("doc_id").cast("string"), "text"))
    return rows.mapInPandas(tidy(run), "doc_id string, score double, n_rules int, most_telling string").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
