"""Benchmark decontamination by canonical templates.

Numbers, units after numbers and names (capitalised words within a sentence) become typed placeholders; everything else
is lower-cased. Windows of template tokens are hash-joined between documents and benchmark items, so a question that was
re-used with other numbers or names still matches. For each occurrence of an item in a document the values in the
placeholders are then compared: a re-parameterised copy replaces equal values by equal values. Windows that are mostly
placeholders match by their literal words, and as templates only where they continue another match.

Documents are tokenised once against the benchmark's vocabulary: a window with a token that no item has cannot match, so
only possible matches are emitted and shuffled. Benchmarks above ``MAX_WINDOWS`` windows are taken in several passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import row_id, spread, stash, tidy
from graphloom.llm.shingles import mix

MAX_WINDOWS = 1_000_000  # benchmark windows that a pass broadcasts: about 50 MB
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]")
LITERAL = np.uint64(0xA24BAED4963EE407)  # keeps hashes of words apart from hashes of templates
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
PLACEHOLDERS = frozenset((NUMBER, UNIT, NAME))
#: Words that stand for numbers, and units.
NUMBER_WORDS = frozenset("two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
UNITS = frozenset("mm cm m km kg g mg t lb lbs oz ml l s h min hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram grams kilogram kilograms liter liters litre litres dollar dollars euro euros cent cents percent degree degrees kmh mph".split())


def template(text: str | None) -> tuple[list[str], list[str]]:
    """Template tokens of a text and the words behind them."""
    out: list[str] = []
    words: list[str] = []
    begins, after_number = True, False
    for t in TOKEN.findall(text or ""):
        c = t[0]
        if c in ".!?\n":
            begins = True
            continue
        low = t.lower()
        if c.isdigit() or low in NUMBER_WORDS:
            kind = NUMBER
        elif after_number and low in UNITS:
            kind = UNIT
        elif low != t and not begins and not t.isupper():
            kind = NAME
        else:
            kind = low
        after_number = kind is NUMBER
        begins = False
        out.append(kind)
        words.append(low)
    return out, words


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all windows of token numbers."""
    n = max(0, len(ids) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n])
    return out


class Benchmark:
    """Vocabulary and windows of benchmark items.

    ``rows``: hash, item, text, place, n_item, slots, telling, wide of every window. A window of which half or more are
    placeholders is not telling as a template and has a second row with the hash of its literal words, which is.
    """

    def __init__(self, items: list[tuple], width: int):
        self.width = width
        templates = [(item, text, *template(body)) for item, text, body in items]
        self.vocabulary = {t: i + 1 for i, t in enumerate(sorted({t for *_, tokens, _ in templates for t in tokens}))}
        self.rows, literal, heavy = [], [], []
        for item, text, tokens, words in templates:
            wide = min(width, len(tokens))
            if not wide:
                continue
            ids = np.array([self.vocabulary[t] for t in tokens], dtype=np.uint64)
            hashes = window_hashes(ids, wide) + np.uint64(wide != width) * np.uint64(wide)
            for i in range(len(hashes)):
                telling = 2 * sum(t in PLACEHOLDERS for t in tokens[i : i + wide]) < wide
                slots = [words[j] for j in range(i, i + wide) if tokens[j] in PLACEHOLDERS]
                self.rows.append((int(hashes[i].view(np.int64)), item, text, i, len(hashes), slots, telling, wide))
                if not telling:
                    heavy.append((item, text, i, len(hashes), words[i : i + wide], wide))
        known = {w: np.unique(np.array([r[0] for r in self.rows if r[-1] == w], dtype=np.int64)) for w in {r[-1] for r in self.rows}}
        weak = {r[0] for r in self.rows if not r[-2]}
        #: By width the sorted hashes of templates, and which of them are telling.
        self.by_width = {w: (h, np.array([int(x) not in weak for x in h], dtype=bool)) for w, h in known.items()}
        self.words = {t: i + 1 for i, t in enumerate(sorted({t for *_, words, _ in heavy for t in words}))}
        for item, text, i, n, words, wide in heavy:
            h = int(self.literal(np.array([self.words[t] for t in words], dtype=np.uint64), wide)[0])
            literal.append((h, item, text, i, n, [], True, wide))
        self.rows += literal
        #: By width the sorted hashes of literal words.
        self.exact = {w: np.unique(np.array([r[0] for r in literal if r[-1] == w], dtype=np.int64)) for w in {r[-1] for r in literal}}

    @staticmethod
    def literal(ids: np.ndarray, wide: int) -> np.ndarray:
        return mix(window_hashes(ids, wide) + LITERAL + np.uint64(wide)).view(np.int64)


def hits(ids: np.ndarray, wide: int, hashes, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows of known tokens that have a known hash, and the hashes' numbers."""
    none = np.zeros(0, dtype=np.int64)
    if len(ids) < wide:
        return none, none
    strange = np.concatenate([[0], np.cumsum(ids == 0)])
    at = np.flatnonzero(strange[wide:] == strange[:-wide])
    if not len(at):
        return none, none
    found = hashes(ids, wide)[at]
    number = np.minimum(np.searchsorted(known, found), len(known) - 1)
    hit = known[number] == found
    return at[hit], number[hit]


def matches(docs: DataFrame, benchmark: Benchmark) -> DataFrame:
    """rid, at, hash, slots of the documents' windows that have the hash of a benchmark window.

    ``docs``: rid, text. Templates that are not telling count only next to a window that is.
    """
    shared = docs.sparkSession.sparkContext.broadcast((benchmark.vocabulary, benchmark.by_width, benchmark.words, benchmark.exact, benchmark.width))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, by_width, literal_words, exact, width = shared.value
        get, get_word = vocabulary.get, literal_words.get

        def hashed(ids: np.ndarray, wide: int) -> np.ndarray:
            return (window_hashes(ids, wide) + np.uint64(wide != width) * np.uint64(wide)).view(np.int64)

        for batch in batches:
            out = []
            for rid, text in zip(batch.rid, batch.text, strict=True):
                tokens, words = template(text)
                ids = np.array([get(t, 0) for t in tokens], dtype=np.uint64)
                literal = np.array([get_word(w, 0) for w in words], dtype=np.uint64) if exact else None
                for wide, (known, telling) in by_width.items():
                    at, number = hits(ids, wide, hashed, known)
                    if wide in exact:
                        same, which = hits(literal, wide, Benchmark.literal, exact[wide])
                        out.extend((rid, i, h, []) for i, h in zip(same.tolist(), exact[wide][which].tolist(), strict=True))
                        # runs of neighbouring windows that hold a telling one
                        places, where = np.unique(np.concatenate([at, same]), return_inverse=True)
                        run_of = np.cumsum(np.diff(places, prepend=-1) > 1)[where]
                        good = np.isin(run_of[: len(at)], np.concatenate([run_of[: len(at)][telling[number]], run_of[len(at) :]]))
                        at, number = at[good], number[good]
                    for i, h in zip(at.tolist(), known[number].tolist(), strict=True):
                        out.append((rid, i, h, [words[j] for j in range(i, i + wide) if tokens[j] in PLACEHOLDERS]))
            yield pd.DataFrame(out, columns=["rid", "at", "hash", "slots"])

    return spread(docs.filter("text is not null")).mapInPandas(tidy(run), "rid long, at int, hash long, slots array<string>")


def named(docs: DataFrame) -> DataFrame:
    """rid, text: rows with equal id and text are one, any others are judged one by one."""
    return docs.select(row_id().alias("rid"), "text")


def occurrences(found: DataFrame, tolerance: int) -> DataFrame:
    """rid, item_id, n_windows, n_item, pairs of places of an item in a document.

    Windows are one occurrence if they agree on where the item would begin; occurrences whose beginnings lie within
    ``tolerance`` (words put in or left out; less for items of few windows, so that copies in a row stay apart) also
    count together, as do all windows of a document that hold an item's own values.
    """
    key = ["rid", "item_id", "text"]
    own = F.col("slots") == F.col("item_slots")
    pairs = F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", "slots"))))
    begins = (F.col("at") - F.col("place")).alias("begins")
    alone = found.groupBy(*key, begins).agg(F.collect_set("place").alias("places"), F.collect_set(F.when(own, F.col("place"))).alias("own"), F.max("n_item").alias("n_item"), pairs.alias("pairs"), F.max("telling").alias("telling"))
    alone = stash(alone, "occurrences")
    order = Window.partitionBy(*key).orderBy("begins")
    apart = F.col("begins") - F.lag("begins").over(order) > F.least(F.lit(tolerance), F.col("n_item") - 1)
    chains = alone.withColumn("apart", apart.cast("int")).withColumn("chain", F.sum(F.coalesce("apart", F.lit(0))).over(order))
    joined = chains.groupBy(*key, "chain").agg(F.count("*").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_windows"), F.max("n_item").alias("n_item"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"), F.max("telling").alias("telling")).filter("n > 1 AND telling")
    places = alone.filter("telling").select(*key, "n_item", F.explode("own").alias("place"))
    literal = places.groupBy(*key).agg(F.count_distinct("place").alias("n_windows"), F.max("n_item").alias("n_item")).withColumn("pairs", F.lit(None).cast(alone.schema["pairs"].dataType))
    columns = ["rid", "item_id", "n_windows", "n_item", "pairs"]
    return alone.filter("telling").withColumn("n_windows", F.size("places")).select(columns).unionByName(joined.select(columns)).unionByName(literal.select(columns).withColumn("pairs", F.coalesce("pairs", F.array())))


def judged(docs: DataFrame, benchmark: DataFrame, width: int, coverage: float, run_windows: int, tolerance: int) -> DataFrame:
    """rid, item_id, n_windows, coverage, exact, consistent; ``docs``: rid, text."""
    spark = docs.sparkSession
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    found = None
    chunk, held = [], 0
    chunks = []
    for number, row in enumerate(benchmark.filter("item_id is not null and text is not null").select("item_id", "text").toLocalIterator()):
        chunk.append((row.item_id, number, row.text))
        held += len(row.text) // 4 + 1
        if held >= MAX_WINDOWS:
            chunks.append(chunk)
            chunk, held = [], 0
    for chunk in [*chunks, chunk] if chunk else chunks:
        table = Benchmark(chunk, width)
        if not table.rows:
            continue
        windows = spark.createDataFrame([r[:7] for r in table.rows], f"hash long, item_id {item_type}, text int, place int, n_item int, item_slots array<string>, telling boolean")
        both = matches(docs, table).join(F.broadcast(windows), "hash")  # at most MAX_WINDOWS rows, and literal ones
        found = both if found is None else found.unionByName(both)
    schema = f"rid long, item_id {item_type}, n_windows long, coverage double, exact boolean, consistent boolean"
    if found is None:
        return spark.createDataFrame([], schema)
    share = F.col("n_windows") / F.col("n_item")
    same = F.forall("pairs", lambda p: p["item_slots"] == p["slots"])
    sources = F.size(F.array_distinct(F.transform("pairs", lambda p: p["item_slots"])))
    # a value of the item may become one other value; one text may hold the item and a variant of it, so equal pairs count first
    changed = F.filter("pairs", lambda p: p["item_slots"] != p["slots"])
    consistent = same | (sources == F.size("pairs")) | (F.size(F.array_distinct(F.transform(changed, lambda p: p["item_slots"]))) == F.size(changed))
    rows = occurrences(found, tolerance).select("rid", "item_id", F.col("n_windows").cast("long"), share.alias("coverage"), same.alias("exact"), consistent.alias("consistent"))
    passed = rows.filter((F.col("coverage") >= coverage) | (F.col("n_windows") >= run_windows)).filter("consistent")
    best = F.max(F.struct("coverage", "n_windows", "exact", "consistent")).alias("best")
    return passed.groupBy("rid", "item_id").agg(best).select("rid", "item_id", "best.n_windows", "best.coverage", "best.exact", "best.consistent")


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, coverage: float = 0.5, run_windows: int = 6, tolerance: int = 8) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, exact, consistent of every benchmark item of which a document holds at
    least the share ``coverage`` of the windows, or ``run_windows`` windows (13 words in a row), with consistent slots in
    one occurrence, or with the item's own values anywhere.

    Items of fewer words than ``width`` are one window. Null texts match nothing; null ids are judged like any other; an
    item id that occurs twice is found by either text, one that is null by none; rows that repeat a doc_id are judged one
    by one and give the best; an empty table or benchmark gives no rows.
    """
    best = F.max(F.struct("coverage", "n_windows", "exact", "consistent")).alias("best")
    found = judged(named(docs), benchmark, width, coverage, run_windows, tolerance)
    rows = docs.select("doc_id", row_id().alias("rid")).join(found, "rid").groupBy("doc_id", "item_id").agg(best)
    return rows.select("doc_id", "item_id", "best.n_windows", "best.coverage", "best.exact", "best.consistent")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 8, coverage: float = 0.5, run_windows: int = 6, tolerance: int = 8) -> DataFrame:
    """One row for every row of ``docs``: doc_id, contaminated, n_items, item_id (of the best match: highest coverage, most
    windows, smallest id), coverage, exact. Item ids may be of any type that orders."""
    best = F.min(F.struct((-F.col("coverage")).alias("less_coverage"), (-F.col("n_windows")).alias("less_windows"), "item_id", (~F.col("exact")).alias("changed")))
    found = judged(named(docs), benchmark, width, coverage, run_windows, tolerance)
    found = stash(found.groupBy("rid").agg(F.count("*").alias("n_items"), best.alias("best")), "leaks")
    rows = docs.select("doc_id", row_id().alias("rid")).join(found, "rid", "left")
    return rows.select("doc_id", F.col("best").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("best.item_id").alias("item_id"), (-F.col("best.less_coverage")).alias("coverage"), (~F.col("best.changed")).alias("exact"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, coverage: float = 0.5, run_windows: int = 6, tolerance: int = 8) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item (see :func:`leaks`), with their columns; each is judged by its own
    text, whatever its id."""
    found = stash(judged(named(docs), benchmark, width, coverage, run_windows, tolerance).select("rid").distinct(), "leaks")
    return docs.select(F.struct(*docs.columns).alias("row"), row_id().alias("rid")).join(found, "rid", "left_anti").select("row.*")
