"""Substring dedup of words by level-wise doubling.

A window of 20 words can repeat only if each window of 5 in it does. The first level takes, for each
window, the 5 words with the least hash (see ``_windows``) and keeps those that occur again in
other surroundings. Those alone are extended to the 10 words around them, and the 10-word windows
that repeat to 20, until no candidate survives. At the last level the words themselves are
compared with those of the earliest window. Runs that are equal from end to end are compared with the first of them, word by word, and only
different ones go through the levels.

Cases: null and empty texts have no words; texts with fewer words than a window stay whole (words
joined by one space); an empty table gives no rows; other columns are ignored. Rows with the same doc_id and text are
one document, each reported; rows without a doc_id, or with one doc_id and other texts, are documents of their own.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame

from ._batch import BASE, mix, words
from ._windows import MOST, keyed, marked, ranges, removed, repeats

LENGTH, SEED = 20, 5


def tokenise(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hashes, begin, end, at = words(buf, offsets)
    return hashes, at, begin, end


def solver(length: int, seed: int):
    wide = length - seed + 1

    def levels() -> list[int]:
        out = [length]
        while out[-1] // 2 > seed:
            out.append(out[-1] // 2)
        return out[::-1]

    def solve(flat, at, group, o, n, rank, spell):
        m = len(at)
        size = n + length - 1
        # every run's tokens around its anchor, which is at column wide - 1
        table = np.zeros((m, 2 * wide - 2 + seed), np.uint64)
        row = np.repeat(np.arange(m), size)
        table[row, ranges(wide - 1 - o, size)] = flat[np.repeat(at, size) + ranges(np.zeros(m, np.int64), size)]
        sums = np.zeros((m, table.shape[1] + 1), np.uint64)
        for i in range(table.shape[1]):
            sums[:, i + 1] = sums[:, i] * np.uint64(BASE) + table[:, i]
        alive = np.ones((m, wide), bool)  # windows by the anchor's offset x; first, those whose 5 words repeat
        x = np.arange(wide)
        alive &= (x[None, :] <= o[:, None]) & (x[None, :] > (o - n)[:, None])
        first = None
        for size_now in levels():
            power = np.uint64(pow(BASE, size_now, 1 << 64))
            most = size_now - seed  # greatest offset of the anchor within a window of this size
            found = np.zeros((m, wide), bool)
            for y in range(min(most, wide - 1) + 1):
                # at the last level each window stands for itself; before, for all windows of the full length with it inside
                inside = (x == y) if size_now == length else (np.minimum(x, most) == y)
                rows = np.flatnonzero(alive[:, inside].any(axis=1))
                if len(rows) < 2:
                    continue
                begin = wide - 1 - y
                h = mix(sums[rows, begin + size_now] - sums[rows, begin] * power)
                by = np.lexsort((rank[rows], h, group[rows]))
                g, hs, own = group[rows][by], h[by], rank[rows][by]
                new = np.r_[True, (g[1:] != g[:-1]) | (hs[1:] != hs[:-1])]
                head = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
                if size_now < length:
                    again = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
                    found[np.ix_(rows[by[again]], np.flatnonzero(inside))] = True
                    continue
                again = own > own[head]
                mine, theirs = rows[by[again]], rows[by[head[again]]]
                lo, hi = o - y, o - y + length
                same = np.array([p == q for p, q in zip(spell(mine, lo[mine], hi[mine]), spell(theirs, lo[theirs], hi[theirs]), strict=True)], bool)
                found[mine[same], y] = True
                # one hash for several windows: the words themselves are the key
                for i in np.unique(hs[again][~same]).tolist():
                    seen: dict[tuple, int] = {}
                    clash = by[hs == i]
                    for j in clash.tolist():
                        key = (group[rows[j]], spell(rows[j : j + 1], lo[rows[j : j + 1]], hi[rows[j : j + 1]])[0])
                        found[rows[j], y] = rank[rows[j]] > seen.setdefault(key, rank[rows[j]])
            alive &= found
            first = alive
        return first

    return solve


def remove_repeats(documents: DataFrame, length: int = LENGTH, seed: int = SEED, most: int = MOST) -> DataFrame:
    """Each document without the words of any window of ``length`` words that also starts earlier.

    Returns doc_id, n_words, n_removed, kept_sha256, kept (the remaining words joined by one space, UTF-8) and
    spans (array of [start, end) word positions)."""
    docs = keyed(documents)
    spans = repeats(docs, tokenise, solver(length, seed), length, seed, most)

    def finish(text, firsts, counts):
        every = text.tobytes().split()
        if not len(firsts):
            kept = b" ".join(every)
            return len(every), 0, hashlib.sha256(kept).hexdigest(), kept, []
        gone = removed(firsts, counts, length, len(every))
        kept = b" ".join(compress(every, (~gone).tolist()))
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
        return len(every), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept, edges.tolist()

    return marked(docs, spans, finish, "n_words long, n_removed long, kept_sha256 string, kept binary, spans array<long>")
