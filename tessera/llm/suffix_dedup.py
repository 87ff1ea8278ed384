"""Substring dedup of bytes by hash-compared suffix sorting.

Where two runs of windows share an anchor (see ``_windows``), the suffixes that start at the anchors
are sorted, and so are the reversed prefixes that end there. The order comes from a mergesort whose
comparisons find the longest common extension by binary search over polynomial prefix hashes, so one
comparison takes a logarithmic number of steps. Neighbours' common extensions are then verified
byte by byte; if a hash collision misled one, the group is sorted by the bytes themselves. Two windows with
the anchor at offset x are equal when their suffixes share ``length - x`` bytes and their prefixes x.

Runs that are equal from end to end are compared byte by byte with the first of them, and only different ones sorted.

Cases: null and empty texts have no window; texts shorter than ``length`` stay whole; an empty table gives no
rows; other columns are ignored. Rows with the same doc_id and text are one document, each reported; rows without a
doc_id, or with one doc_id and other texts, are documents of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from ._batch import BASE, ranges
from ._windows import MOST, keyed, marked, removed, repeats

LENGTH, SEED = 100, 24


def tokenise(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, None, None]:
    return np.ascontiguousarray(buf), offsets, None, None


def laid_out(flat: np.ndarray, at: np.ndarray, count: np.ndarray, width: int, step: int) -> np.ndarray:
    """A row for each run: flat[at], flat[at + step], ... for count tokens plus one, then zeros."""
    out = np.zeros((len(at), width), np.int64)
    count = np.minimum(count, width)
    row = np.repeat(np.arange(len(at)), count)
    column = ranges(np.zeros(len(at), np.int64), count)
    out[row, column] = flat[at[row] + step * column].astype(np.int64) + 1
    return out


class Suffixes:
    """Rows of tokens with prefix hashes, compared by longest common extension."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.hash = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
        for i in range(rows.shape[1]):
            self.hash[:, i + 1] = self.hash[:, i] * np.uint64(BASE) + rows[:, i].astype(np.uint64)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of rows i and j, by binary search over the hashes."""
        low, high = np.zeros(len(i), np.int64), np.full(len(i), self.rows.shape[1])
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.hash[i, middle] == self.hash[j, middle]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def below(self, i: np.ndarray, j: np.ndarray, ties: bool) -> np.ndarray:
        """Whether row i comes before row j; equal rows if ties."""
        k = self.extension(i, j)
        end = k == self.rows.shape[1]
        k = np.minimum(k, self.rows.shape[1] - 1)
        return np.where(end, ties, self.rows[i, k] < self.rows[j, k])

    def sort(self, group: np.ndarray) -> np.ndarray:
        """The rows in order within each group (groups are in a row), by merging runs of 1, 2, 4, ... rows."""
        n = len(group)
        head = np.searchsorted(group, group)
        end = np.searchsorted(group, group, "right")
        order, width = np.arange(n), 1
        while n and width < int((end - head).max()):
            place = np.arange(n)
            block = (place - head) // width
            left = block % 2 == 0
            other = head + (block + np.where(left, 1, -1)) * width
            low, stop = np.minimum(other, end), np.minimum(other + width, end)
            base = low.copy()
            # a left element passes those strictly below it, a right one also its equals: stable
            while (todo := np.flatnonzero(low < stop)).size:
                middle = (low[todo] + stop[todo]) >> 1
                under = np.where(
                    left[todo], self.below(order[middle], order[todo], False), self.below(order[middle], order[todo], True)
                )
                low[todo] = np.where(under, middle + 1, low[todo])
                stop[todo] = np.where(under, stop[todo], middle)
            pair = head + (block - block % 2) * width
            to = pair + (place - (head + block * width)) + (low - base)
            merged = np.empty(n, np.int64)
            merged[to] = order
            order, width = merged, width * 2
        return order

    def ordered(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order, and each row's verified common prefix with the one before (-1 at the head of a group)."""
        order = self.sort(group)
        common = np.full(len(order), -1)
        near = np.flatnonzero(group[1:] == group[:-1]) + 1
        common[near] = self.extension(order[near - 1], order[near])
        differ = self.rows[order[near - 1]] != self.rows[order[near]]
        true = np.where(differ.any(axis=1), differ.argmax(axis=1), self.rows.shape[1])
        if (true != common[near]).any():  # a collision: the bytes decide
            order = np.lexsort((*self.rows.T[::-1], group))
            differ = self.rows[order[near - 1]] != self.rows[order[near]]
            common[near] = np.where(differ.any(axis=1), differ.argmax(axis=1), self.rows.shape[1])
        return order, common


def solver(length: int, seed: int):
    wide = length - seed + 1

    def solve(flat, at, group, o, n, rank, spell):
        m = len(at)
        right = Suffixes(laid_out(flat, at + o, n + length - 1 - o, length, 1))
        left = Suffixes(laid_out(flat, at + o - 1, o, wide - 1, -1))
        right_order, right_common = right.ordered(group)
        left_order, left_common = left.ordered(group)
        dup = np.zeros((m, wide), bool)
        for x in range(wide):
            on = np.flatnonzero((x <= o) & (x > o - n))
            if len(on) < 2:
                continue
            r, l = np.empty(m, np.int64), np.empty(m, np.int64)
            r[right_order] = np.cumsum(right_common < length - x)
            l[left_order] = np.cumsum(left_common < x)
            kind = r[on] * (m + 1) + l[on]
            by = np.lexsort((rank[on], kind))
            kind, own = kind[by], rank[on][by]
            head = np.maximum.accumulate(np.where(np.r_[True, kind[1:] != kind[:-1]], np.arange(len(by)), 0))
            dup[on[by], x] = own > own[head]
        return dup

    return solve


def remove_repeats(documents: DataFrame, length: int = LENGTH, seed: int = SEED, most: int = MOST) -> DataFrame:
    """Each document without the bytes of any ``length``-byte string that also starts earlier.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the remaining bytes) and
    spans (array of [start, end) byte positions)."""
    docs = keyed(documents)
    spans = repeats(docs, tokenise, solver(length, seed), length, seed, most)

    def finish(text, firsts, counts):
        gone = removed(firsts, counts, length, len(text))
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
        kept = text[~gone].tobytes() if len(edges) else text.tobytes()
        return len(text), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), kept, edges.tolist()

    return marked(docs, spans, finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<long>")
