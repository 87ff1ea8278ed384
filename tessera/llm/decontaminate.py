"""Benchmark decontamination by greedy string tiling.

Documents and test items share seeds (runs of ``shortest`` words). For pairs whose seeds could cover enough
of an item, the longest common runs of unmarked words are found by running Karp-Rabin, marked, and so on with shorter ones
down to the seed. The tiles' share of the item's words is its coverage, whatever their order, so
reordered passages count in full.

The items are a stated set of queries: they go to the tasks in blocks of at most ``block_bytes`` of text, one pass over the
documents for each, so what is broadcast is bounded whatever the benchmark's size.

Words are runs of characters other than ASCII punctuation and white space, with A-Z lower-cased. Cases: null and empty texts
have no words and give no rows; items without words are never found; items shorter than a seed must
occur whole; rows that repeat an id each give their rows; either table may be empty; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batch import LOWER, grams, mix, parts, prefix, ranges, slices, utf8, words

SHORTEST = 4
COVERAGE = 0.6
BLOCK_BYTES = 4 << 20
_PLAIN = LOWER.copy()
_PLAIN[[ord(c) for c in string.punctuation]] = 32


def plain_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, _, at = words(_PLAIN[buf], offsets)
    return hashes, at


#: Pairs of equal windows that are looked at together.
PAIRS = 1 << 20


def tiles(item: np.ndarray, text: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, words) of tiles. The longest run of unmarked words that both share is marked, of equals the
    first in the item and then in the text, and so on down to ``shortest``.

    Rounds look for runs of a size and more, which is halved from one to the next. In a round, windows of that size meet by their running hash, the
    longest run around each is found by binary search over prefix hashes and compared word by word, and a heap gives the runs from the longest; one that a tile has
    cut goes back with what is left of it."""
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    sums_item, sums_text = prefix(item), prefix(text)
    out: list[tuple[int, int, int]] = []
    size = max(min(len(item), len(text)), shortest)
    while size >= shortest and size <= min(len(item), len(text)):
        heap = [(-int(n), int(i), int(t)) for i, t, n in _matches(item, text, sums_item, sums_text, free_item, free_text, size)]
        heapq.heapify(heap)
        while heap:
            n, i, t = heapq.heappop(heap)
            both = free_item[i : i - n] & free_text[t : t - n]
            if both.all():
                free_item[i : i - n] = free_text[t : t - n] = False
                out.append((i, t, -n))
                continue
            edges = np.flatnonzero(np.diff(np.r_[0, both.astype(np.int8), 0]))
            for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if hi - lo >= size:
                    heapq.heappush(heap, (lo - hi, i + lo, t + lo))
        size = max(shortest, size // 2) if size > shortest else 0
    return sorted(out)


def _matches(item, text, sums_item, sums_text, free_item, free_text, size: int) -> Iterator[tuple[int, int, int]]:
    """The runs of at least so many unmarked words that both share and that cannot be made longer."""

    def windows(sums: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        used = np.r_[0, np.cumsum(~free)]
        at = np.flatnonzero(used[size:] == used[:-size])
        return at, mix(slices(sums, at, at + size))

    def reach(free: np.ndarray) -> np.ndarray:
        """Where the unmarked run that a place lies in ends."""
        marked = np.r_[np.flatnonzero(~free), len(free)]
        return marked[np.searchsorted(marked, np.arange(len(free)))]

    at_item, h_item = windows(sums_item, free_item)
    at_text, h_text = windows(sums_text, free_text)
    order = np.argsort(h_item, kind="stable")
    h_item, at_item = h_item[order], at_item[order]
    low, high = np.searchsorted(h_item, h_text), np.searchsorted(h_item, h_text, "right")
    some = np.flatnonzero(low < high)
    ends_item, ends_text = reach(free_item), reach(free_text)
    before = np.cumsum(high[some] - low[some])
    lo = 0
    while lo < len(some):
        # so many pairs at a time, or those of one window of the text
        hi = max(lo + 1, int(np.searchsorted(before, (before[lo - 1] if lo else 0) + PAIRS, "right")))
        part = some[lo:hi]
        lo = hi
        many = high[part] - low[part]
        i, t = at_item[ranges(low[part], many)], np.repeat(at_text[part], many)
        inner = (i > 0) & (t > 0)
        goes_on = inner & free_item[i - 1] & free_text[t - 1] & (item[i - 1] == text[t - 1])
        i, t = i[~goes_on], t[~goes_on]
        # the longest common run from there, by binary search over the hashes
        least, most = np.full(len(i), size), np.minimum(ends_item[i] - i, ends_text[t] - t)
        while (least < most).any():
            middle = (least + most + 1) >> 1
            same = slices(sums_item, i, i + middle) == slices(sums_text, t, t + middle)
            least, most = np.where(same, middle, least), np.where(same, most, middle - 1)
        for x, y, n in zip(i.tolist(), t.tolist(), least.tolist(), strict=True):
            if (item[x : x + n] == text[y : y + n]).all():  # else the hashes misled
                yield x, y, n


class Items:
    """Test items' words, and an index of their seeds."""

    def __init__(self, ids: list[int], texts: list[str], shortest: int):
        raw = [x.encode("utf-8", "replace") for x in texts]
        offsets = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
        hashes, at = plain_words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        self.ids, self.words = ids, [hashes[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = {}
        by: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            if len(w):
                by.setdefault(min(shortest, len(w)), []).append(k)
        for size, members in by.items():
            h = [grams(self.words[k], size) for k in members]
            item = np.repeat(members, [len(x) for x in h])
            place = np.concatenate([np.arange(len(x)) for x in h])
            h = np.concatenate(h)
            order = np.lexsort((item, h))
            h, item, place = h[order], item[order], place[order]
            # a seed that an item has several times is one entry with several places
            heads = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (item[1:] != item[:-1])])
            self.seeds[size] = h[heads], item[heads], np.split(place, heads[1:])
        self.filters = {}
        for size, (h, _, _) in self.seeds.items():
            self.filters[size] = np.zeros(1 << 20, bool)
            self.filters[size][h >> np.uint64(44)] = True


def hits(items: Items, coverage: float, column: pa.Array) -> list[tuple]:
    """(row, item_id, coverage, matched words, item's words, tiles) of the texts and items whose tiles cover enough."""
    buf, offsets = utf8(column)
    rows = []
    for lo, hi in parts(offsets):
        hashes, at = plain_words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        for size, (h, item, places_of) in items.seeds.items():
            g = grams(hashes, size)
            hit = np.flatnonzero(items.filters[size][g >> np.uint64(44)])
            doc = np.searchsorted(at, hit, "right") - 1
            inside = hit + size <= at[doc + 1]
            hit, doc = hit[inside], doc[inside]
            low, high = np.searchsorted(h, g[hit]), np.searchsorted(h, g[hit], "right")
            hit, doc, low, high = (x[low < high] for x in (hit, doc, low, high))
            seen: dict[tuple[int, int], tuple[set, list]] = {}
            for t, d, x, y in zip(hit.tolist(), doc.tolist(), low.tolist(), high.tolist(), strict=True):
                for k in range(x, y):
                    entries, texts = seen.setdefault((d, int(item[k])), (set(), []))
                    entries.add(k)
                    texts.append(t)
            for (d, k), (entries, texts) in seen.items():
                w = items.words[k]
                within = np.zeros(len(w), bool)
                for i in np.concatenate([places_of[x] for x in entries]).tolist():
                    within[i : i + size] = True
                if within.sum() < coverage * len(w):
                    continue
                # only words in a seed can be in a tile; the parts between are replaced by one word that nothing equals
                spots = np.unique(np.array(texts)[:, None] + np.arange(size))
                gaps = np.flatnonzero(np.diff(spots) > 1) + 1
                text = np.insert(hashes[spots], gaps, _stranger(w))
                found = tiles(w, text, size)
                matched = sum(x[2] for x in found)
                if matched >= coverage * len(w):
                    rows.append((lo + d, items.ids[k], matched / len(w), matched, len(w), len(found)))
    return rows


def tiled(items: Items, coverage: float, ids: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if rows := hits(items, coverage, batch.column(1)):
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(columns[0])), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), *(pa.array(x, pa.int64()) for x in columns[3:])],
                    names=[ids, "item_id", "coverage", "matched_words", "item_words", "n_tiles"],
                )

    return run


def _stranger(w: np.ndarray) -> np.uint64:
    x = np.uint64(0x5DEECE66D)
    while (w == x).any():
        x += np.uint64(1)
    return x


def blocks(benchmark: DataFrame, shortest: int, block_bytes: int) -> Iterator[Items]:
    """The test items, in blocks of bounded size."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        block.append(row)
        size += len(row[1]) * 4
        if size > block_bytes:
            yield Items([r[0] for r in block], [r[1] for r in block], shortest)
            block, size = [], 0
    if block:
        yield Items([r[0] for r in block], [r[1] for r in block], shortest)


def overlaps(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, shortest: int = SHORTEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item whose tiles cover that share of the item's words: doc_id, item_id, coverage, matched_words, item_words, n_tiles."""
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id long, coverage double, matched_words long, item_words long, n_tiles long"
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    out = None
    for items in blocks(benchmark, shortest, block_bytes):
        found = docs.mapInArrow(tiled(items, coverage, "doc_id"), schema)
        out = out.union(found) if out else found
    return out or documents.sparkSession.createDataFrame([], schema)


def clean(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, shortest: int = SHORTEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of documents, whole, in which no item is found. Each row is judged by its own text: no join, no shuffle."""
    at = documents.columns.index("text")

    def without(items: Items) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in hits(items, coverage, batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        return run

    for items in blocks(benchmark, shortest, block_bytes):
        documents = documents.mapInArrow(without(items), documents.schema)
    return documents
