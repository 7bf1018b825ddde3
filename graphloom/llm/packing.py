"""Packing of tokenised documents into fixed-size sequences by bounded-space online best fit.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut. Pieces are dealt evenly to tasks
(a bounded number of them each) and packed there, the longest first. A task keeps a fixed number of open bins, found by
a bitset over their free space: a piece goes to the fullest bin that can hold it, and when a new bin is needed while all
are open, the fullest one closes first.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import spread, stash, tidy, utf8_text

PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


PUNCTUATION = re.compile(r"([.,;:!?])(?<=[^\W_].)(?=\s|$)")


def byte_letters() -> list[str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others for
    the characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


class Tokens:
    """Token ids of texts. White space never joins two tokens, the vocabulary has no capitals, and a run of punctuation
    after a letter or digit starts a token; so texts are cut into stretches of lower-case letters or of other characters,
    and each stretch is encoded once and remembered (up to ``remember`` stretches). A word of plain letters goes to the
    tokenizer's model directly, anything else through the whole tokenizer."""

    def __init__(self, path: str, remember: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.remember = Tokenizer.from_file(path), remember
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self._reset()

    def _reset(self):
        self.code = {"": 0}
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.first, self.size, self.n = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64), 1

    def _store(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(names) > len(self.first):
            self.first, self.size = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.flat[self.used : self.used + len(ids)] = ids
        new = slice(self.n, self.n + len(names))
        self.first[new], self.size[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.code.update(zip(names, range(self.n, self.n + len(names)), strict=True))
        self.used += len(ids)
        self.n += len(names)

    def _encode(self, stretch: str) -> list[int]:
        if stretch.isalpha():
            if stretch.isascii():
                return [x.id for x in self.model.tokenize(stretch)]
            if max(stretch) < "\u0250" and stretch == stretch.lower():  # composed Latin letters
                return [x.id for x in self.model.tokenize("".join([self.letters[b] for b in stretch.encode()]))]
        return self.tokenizer.encode(stretch, add_special_tokens=False).ids

    def _learn(self, stretches: set[str]) -> None:
        names = list(stretches)
        ids = [self._encode(s) for s in names]
        self._store(names, np.array([x for own in ids for x in own], dtype=np.uint32), np.array([len(own) for own in ids]))

    def cut(self, text: str) -> list[str]:
        if "\u0130" in text:  # its lower case ends in a combining mark, which joins what follows
            return [text]
        text = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        if "<|" not in text:  # special tokens are written with punctuation
            text = PUNCTUATION.sub(r" \1", text)
        for c in "\n\t\r\v\f":
            text = text.replace(c, " ")
        return text.split(" ")

    def many(self, texts: list[str], group: int = 1 << 18) -> Iterator[np.ndarray]:
        """The ids of each text, in groups of about ``group`` characters."""
        at = 0
        while at < len(texts):
            if self.n > self.remember:
                self._reset()
            held, size = [], 0
            while at < len(texts) and size < group:
                held.append(self.cut(texts[at]))
                size += len(texts[at])
                at += 1
            new = set().union(*held).difference(self.code)
            if new:
                self._learn(new)
            for stretches in held:
                codes = np.fromiter(map(self.code.__getitem__, stretches), dtype=np.int64, count=len(stretches))
                sizes = self.size[codes]
                ends = np.cumsum(sizes)
                yield self.flat[np.repeat(self.first[codes] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class OpenBins:
    """Bounded-space best fit, one piece at a time: at most ``most`` bins are open, found through a bitset of their free
    space; a piece goes to the fullest bin that holds it, and if a new bin is needed and none may open, the fullest closes."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        found = own.pop()
        if not own:
            self.bits &= ~(1 << free)
        return found

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            where = self._take(free)
        else:
            if self.n_open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.n_open -= 1
            free, where = self.capacity, self.n_bins
            self.n_bins += 1
            self.n_open += 1
        if free > size:
            self.by_free[free - size].append(where)
            self.bits |= 1 << (free - size)
        else:
            self.n_open -= 1
        return where, self.capacity - free


def best_fit(lengths: Iterable[int], capacity: int, open_bins: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, in the order given."""
    bins = OpenBins(capacity, open_bins)
    return [bins.place(size) for size in lengths]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids followed by ``end_id``."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(tokenizer_path)
        for batch in batches:
            out = []
            for doc_id, found in zip(batch.doc_id, tokens.many(batch.text.tolist()), strict=True):
                ids = np.append(found, np.uint32(end_id)).astype("<u4")
                for i, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out.append((doc_id, i, at, len(part), zlib.crc32(part.tobytes())))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return spread(docs.select(F.col("doc_id").cast("string"), utf8_text().alias("text"))).mapInPandas(tidy(run), PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, open_bins: int = 256, pieces_per_task: int = 65_536) -> DataFrame:
    """The pieces of all documents with their sequence_id and offset, placed online, in the order in which they arrive.

    A null or empty text is one piece of the end id alone; repeated rows and null ids are packed like any other; an
    empty table gives no rows. ``pieces_per_task``: pieces that share a set of open bins; each set leaves its last bins
    partly filled.
    """
    cut = stash(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    tasks = max(1, -(-cut.count() // pieces_per_task))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 32
        for batch in batches:
            placed = [bins.place(n) for n in batch.length.tolist()]
            yield batch.assign(sequence_id=[base + b for b, _ in placed], offset=[o for _, o in placed])

    return cut.repartition(tasks).mapInPandas(tidy(run), PACKED).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
