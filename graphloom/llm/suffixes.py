"""Suffix arrays by two-stage sorting, with numpy, for blocks of bounded size.

A suffix is of type S if it is smaller than its successor and of type L otherwise. Only S suffixes are sorted directly.
A scan over the buckets of first bytes, in ascending order, induces the order of the L suffixes: the one before an
already placed suffix goes to the next free place of its bucket. The order is exact for the first ``depth`` bytes, which
is all that common prefixes up to that length need. Where only some suffixes are asked for, those and the successors
that induce them are sorted, and no others.
"""

from __future__ import annotations

import numpy as np


def words8(text: np.ndarray) -> np.ndarray:
    """For each position its next 8 bytes as a big-endian number (zeros beyond the end)."""
    w = np.zeros(len(text) + 8, dtype=np.uint64)
    w[: len(text)] = text
    for step in (1, 2, 4):
        w[:-step] = (w[:-step] << np.uint64(8 * step)) | w[step:]
    return w[: len(text)]


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """True for suffixes of type S; the last suffix is of type L (it is larger than the empty one)."""
    n = len(text)
    change = np.zeros(n, dtype=np.int8)
    change[:-1] = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1]).astype(np.int8)
    change[-1:] = -1
    same = np.flatnonzero(change == 0)
    if len(same):  # equal bytes take the type of the next position
        at = np.flatnonzero(change)
        change[same] = change[at[np.searchsorted(at, same)]]
    return change > 0


def with_inducers(asked: np.ndarray, is_s: np.ndarray) -> np.ndarray:
    """``asked`` and the successors of its L suffixes, up to the next S suffix."""
    out = asked.copy()
    at = np.flatnonzero(asked[:-1] & ~asked[1:] & ~is_s[:-1])
    while len(at):
        at = at + 1
        out[at] = True
        at = at[~is_s[at] & (at + 1 < len(asked))]
    return out


def packed(text: np.ndarray, room: int) -> tuple[np.ndarray, int, int]:
    """For each position its next bytes as one number of at most ``room`` bits that orders like them (0 stands for the
    end), with the bits of the number and the bytes in it. Bytes are re-coded by the text's own alphabet."""
    alphabet = np.flatnonzero(np.bincount(text, minlength=256))
    code = np.zeros(256, dtype=np.uint64)
    code[alphabet] = np.arange(1, len(alphabet) + 1)
    bits = int(len(alphabet)).bit_length()
    n, width = len(text), max(1, room // bits)
    one = np.zeros(n + 64, dtype=np.uint64)
    one[:n] = code[text]
    out, have = None, 0
    part, size = one, 1
    while size <= width:  # widths by powers of two, put together
        if width & size:
            out = part.copy() if out is None else (part << np.uint64(bits * have)) | _shifted(out, size)
            have += size
        part = (part << np.uint64(bits * size)) | _shifted(part, size)
        size *= 2
    return out[:n], bits * width, width


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[:-by] = x[by:]
    return out


def sort_directly(which: np.ndarray, depth: int, text: np.ndarray) -> np.ndarray:
    """Positions ``which`` by their first ``depth`` bytes, by refining groups that are still tied. A group and the next
    bytes are packed into one key of 64 bits."""
    n = len(text)
    words, bits, width = packed(text, 64 - int(max(1, len(which))).bit_length())
    key = words[which]
    by = np.argsort(key)
    order, key = which[by], key[by]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    # a group is named by the place of its first member, so names stay in order when it splits
    group = np.maximum.accumulate(np.where(fresh, np.arange(len(order), dtype=np.uint64), np.uint64(0)))
    open_at = np.arange(len(order))
    for done in range(width, depth, width):
        g = group[open_at]
        tied = np.zeros(len(g), dtype=bool)
        tied[1:] = g[1:] == g[:-1]
        tied[:-1] |= tied[1:]
        open_at = open_at[tied]
        if not len(open_at):
            break
        suffix = order[open_at]
        at = suffix + done
        key = (g[tied] << np.uint64(bits)) | np.where(at < n, words[np.minimum(at, n - 1)], np.uint64(0))
        by = np.argsort(key)
        key = key[by]
        order[open_at] = suffix[by]
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        group[open_at] = open_at[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))].astype(np.uint64)
    return order


def suffix_array(text: np.ndarray, depth: int, asked: np.ndarray | None = None) -> np.ndarray:
    """Positions of ``text`` (uint8), ordered by the first ``depth`` bytes of their suffixes: all, or those ``asked``
    for with the ones that induce them."""
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    is_s = smaller_than_successor(text)
    inside = np.ones(n, dtype=bool) if asked is None else with_inducers(asked, is_s)
    direct = sort_directly(np.flatnonzero(is_s & inside), depth, text)
    ends = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if inside[-1]:
        waiting[text[-1]].append(np.array([n - 1]))  # it follows the empty suffix
    out = []
    for c in range(256):
        level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, dtype=np.int64)
        placed = []
        while len(level):  # runs of the same byte, one step at a time
            placed.append(level)
            before = level[level > 0] - 1
            level = before[(text[before] == c) & inside[before]]
        bucket = np.concatenate([*placed, direct[ends[c] : ends[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = text[before]
        later = (first > c) & inside[before]
        before, first = before[later], first[later]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, cuts) if len(before) else []:
            waiting[text[part[0]]].append(part)
        waiting[c] = []
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def common_prefix_reaches(order: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """For each neighbour pair in ``order`` whether their common prefix has at least ``length`` bytes (a multiple of 8)."""
    a, b = order[:-1], order[1:]
    alive = np.flatnonzero(np.maximum(a, b) + length <= len(words))
    for at in range(0, length, 8):
        alive = alive[words[a[alive] + at] == words[b[alive] + at]]
    out = np.zeros(max(0, len(order) - 1), dtype=bool)
    out[alive] = True
    return out


def repeated_starts(text: np.ndarray, length: int, asked: np.ndarray | None = None) -> np.ndarray:
    """True where a ``length``-byte string starts that starts at another position too (of those ``asked`` for)."""
    order = suffix_array(text, length, asked)
    same = common_prefix_reaches(order, words8(text), length)
    out = np.zeros(len(text), dtype=bool)
    out[order[:-1][same]] = True
    out[order[1:][same]] = True
    return out
