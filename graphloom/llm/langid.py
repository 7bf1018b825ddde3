"""Language identification by word-first backoff.

A word seen in training scores its log relative frequency in every language. A word never seen falls back to its
character n-grams, the longest first: the first length of which any n-gram is known decides, with the mean log
relative frequency of its known n-grams. A text's language has the largest sum over its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import held_out, spread, stash, tidy

WORD = re.compile(r"[^\W\d_]+")  # the letters among these are picked by str.isalpha
NO_LANGUAGE = "und"


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters; numerals such as \u00bd or \u2167 are no letters."""
    found = WORD.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def grams(word: str, n: int) -> list[str]:
    """n-grams of a word with its ends marked; single letters without the marks, which every word has."""
    if n > 1:
        word = f"^{word}$"
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def train(docs: DataFrame, max_documents: int = 20_000, least: int = 2, longest: int = 5) -> dict:
    """Counts from labelled rows of ``docs`` (text, lang) that are not held out.

    ``max_documents`` bounds the sample of rows, taken by the hash of their id (a fixed bound, so that the model does
    not grow with the corpus). Words and n-grams seen fewer than ``least`` times in a language are unknown there.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    n = rows.count()
    if n > max_documents:
        share = int(max_documents / n * 2**31)
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < share)

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for text, lang in zip(batch.text, batch.lang, strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
            for lang, words in seen.items():
                parts: Counter = Counter()
                for word, k in words.items():
                    parts[0, word] += k
                    for length in range(1, longest + 1):
                        for g in grams(word, length):
                            parts[length, g] += k
                yield pd.DataFrame([(lang, length, g, k) for (length, g), k in parts.items()], columns=["lang", "length", "gram", "k"])

    counted = stash(spread(rows.select("text", "lang")).mapInPandas(tidy(count), "lang string, length int, gram string, k long").groupBy("lang", "length", "gram").agg(F.sum("k").alias("k")), "language-counts")
    totals = {(r.lang, r.length): r.total for r in counted.groupBy("lang", "length").agg(F.sum("k").alias("total")).collect()}
    languages = sorted({lang for lang, _ in totals})
    number = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")) - 1 if languages else F.lit(0)
    kept = counted.filter(F.col("k") >= least).select(number.cast("int").alias("lang"), "length", "gram", "k").toPandas()  # of a sample of bounded size
    index: list[dict[str, int]] = [{} for _ in range(longest + 1)]
    tables = []
    for length in range(longest + 1):
        part = kept[kept.length == length]
        for g in part.gram:
            index[length].setdefault(g, len(index[length]))
        table = np.full((len(index[length]), len(languages)), 0.5)
        table[[index[length][g] for g in part.gram], part.lang.to_numpy()] = part.k.to_numpy() + 0.5
        total = np.array([totals.get((x, length), 1) for x in languages], dtype=np.float64)
        tables.append(np.log(table) - np.log(total + 0.5 * max(1, len(table))))
    return {"languages": languages, "index": index, "tables": tables, "longest": longest}


class Scorer:
    """Scores texts; unseen words are remembered up to ``remember`` entries."""

    def __init__(self, model: dict, remember: int = 300_000):
        self.model, self.remember = model, remember
        self._reset()

    def _reset(self):
        self.words = dict(self.model["index"][0])
        base = self.model["tables"][0]
        self.known = len(base)
        self.vectors = np.vstack([base, np.zeros((max(1024, len(base) // 2), len(self.model["languages"])))]) if len(base) else np.zeros((1024, max(1, len(self.model["languages"]))))
        self.used = len(base)

    def unseen(self, word: str) -> np.ndarray:
        for n in range(self.model["longest"], 0, -1):
            index = self.model["index"][n]
            rows = [index[g] for g in grams(word, n) if g in index]
            if rows:
                return self.model["tables"][n][rows].mean(axis=0)
        return np.zeros(len(self.model["languages"]))

    def _add(self, word: str) -> int:
        if self.used == len(self.vectors):
            self.vectors = np.vstack([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[self.used] = self.unseen(word)
        self.words[word] = self.used
        self.used += 1
        return self.used - 1

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = Counter(words_of(text)) if text else None
        if not words or not self.model["languages"]:
            return NO_LANGUAGE, 0.0
        if self.used - self.known > self.remember:
            self._reset()
        get = self.words.get
        rows = [get(w, -1) for w in words]
        if -1 in rows:
            rows = [self._add(w) if r < 0 else r for r, w in zip(rows, words, strict=True)]
        total = np.fromiter(words.values(), dtype=np.float64, count=len(rows)) @ self.vectors[rows]
        top = int(total.argmax())
        return self.model["languages"][top], 1.0 / float(np.exp(np.maximum(total - total[top], -700)).sum())


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score (the posterior of the predicted language under equal priors).

    A null text or one without a letter, and any text when nothing could be learned, is ``und`` with score 0; ties go to
    the language that sorts first; repeated rows and null ids are scored like any other; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def score(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer(t) for t in batch.text]
            yield pd.DataFrame({"doc_id": batch.doc_id, "lang_pred": [x for x, _ in found], "score": [s for _, s in found]})

    rows = spread(docs.select(F.col("doc_id").cast("string"), "text"))
    return rows.mapInPandas(tidy(score), "doc_id string, lang_pred string, score double").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
