"""Exact search for windows of ``length`` consecutive tokens that also start earlier in the corpus.

Shared by the byte and the word operator. A window is named by its *anchor*: the ``seed`` tokens in it
with the least hash (the leftmost of equals). Equal windows have equal anchors at equal offsets, so a
window can only repeat where its anchor does. Consecutive windows with one anchor form a *run*.

1. ``scan`` finds the runs of each document and gives one row for each: hash of the anchor, hash of
   all the run's tokens, document, place. Equal runs within a task are merged before the shuffle, each compared byte by byte.
2. ``resolving`` streams the rows in order of those hashes and lets go of all runs that are alone with their anchor.
3. For the others ``contexts`` takes their bytes from the texts. ``solving`` streams them in order of anchor and bytes: a run
   with the bytes of an earlier one repeats throughout; the different runs of an anchor go to a solver, which tells which windows repeat. A group holds different runs only, however many copies there are.
4. Anchors with more than ``most`` different runs are not gathered: those runs are also dealt out window by window, by the hash of
   the whole window, merged within a task first and compared byte by byte, so they spread over all tasks and stream. The result is the same.

No removal rests on a hash: every one is confirmed on bytes. Documents are ordered by doc_id, a null first. Rows with one doc_id
and the same text count as one document; those with one doc_id (or none) and other texts are documents of their own, ordered by
the hash of their text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batch import BYTES, grams, longs, mix, packed, parts, powers, ranges, unpacked, utf8
from ._runtime import cut

PIECE = 1 << 20
#: Bytes of text within which equal runs are merged before the shuffle.
MERGE = 16 << 20
NULL = -(1 << 63)
#: v: the place of the first window (32 bits), the anchor's offset and the number of windows (8 each); below 0 for runs known to repeat.
RUNS = "a long, c long, did long, fp long, v long"
#: v: the place of the first window, the number of windows (16 bits).
SPANS = "did long, fp long, v long"
PLACE = (1 << 32) - 1
LOCAL = -(1 << 63)
ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
#: doc_ids of several rows that are broadcast; more are joined.
REPEATED = 100_000
#: Different runs of one anchor that are solved together, and the bit of v that marks first runs of anchors with more.
MOST, HOT = 10_000, 1 << 15
_MASK = np.uint64((1 << 22) - 1)


def keyed(documents: DataFrame) -> DataFrame:
    """did (doc_id, a null as the least), fp (0, or the hash of the text where several rows have that doc_id or it is null), doc_id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL)).alias("did"), F.col("doc_id"), text.alias("text"))
    several = cut(docs.groupBy("did").count().where((F.col("count") > 1) | (F.col("did") == NULL)).select("did", F.lit(1).alias("several")))
    size = several.count()
    if not size:
        return docs.select("did", F.lit(0).cast("long").alias("fp"), "doc_id", "text")
    fp = F.when(F.col("several") == 1, F.xxhash64("text")).otherwise(F.lit(0)).cast("long")
    return docs.join(F.broadcast(several) if size <= REPEATED else several, "did", "left").select("did", fp.alias("fp"), "doc_id", "text")


def anchors(tokens: np.ndarray, valid: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor's place and anchor's hash for every run; valid: the windows that count."""
    h = grams(tokens, seed)
    key = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)
    wide, span = length - seed + 1, 1
    while span * 2 <= wide:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    n = len(tokens) - length + 1
    least = np.minimum(key[:n], key[wide - span : wide - span + n]) & _MASK
    at = np.flatnonzero(valid)
    anchor = least[at].astype(np.int64)
    heads = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else at
    return at[heads], np.diff(np.r_[heads, len(at)]), anchor[heads], h[anchor[heads]]


def segments(starts: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents (number, start, end) in groups of about PIECE tokens; longer ones in pieces that overlap by length - 1."""
    doc = np.flatnonzero(ends - starts >= length)
    lo = 0
    while lo < len(doc):
        first = doc[lo]
        if ends[first] - starts[first] > 2 * PIECE - length:
            for s in range(int(starts[first]), int(ends[first]) - length + 1, PIECE):
                yield np.array([first]), np.array([s]), np.array([min(int(ends[first]), s + PIECE + length - 1)])
            lo += 1
            continue
        hi = lo + 1
        while hi < len(doc) and ends[doc[hi]] - starts[first] <= PIECE:
            hi += 1
        yield doc[lo:hi], starts[doc[lo:hi]], ends[doc[lo:hi]]
        lo = hi


def runs_of(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, seed: int):
    """Document number, first window within it, windows, anchor's offset in the first window, anchor hash, first window in tokens."""
    for doc, s, e in segments(starts, ends, length):
        lo = int(s[0])
        t = _wide(tokens[lo : int(e[-1])])
        edge = np.zeros(len(t) + 1, np.int64)
        np.add.at(edge, s - lo, 1)
        np.add.at(edge, e - lo - length + 1, -1)
        first, n, at, a = anchors(t, np.cumsum(edge)[: len(t) - length + 1] > 0, length, seed)
        own = np.searchsorted(s - lo, first, "right") - 1
        yield doc[own], first + lo - starts[doc[own]], n, at - first, a, first + lo


def spelled(raw: bytes | memoryview, begin: np.ndarray | None, end: np.ndarray | None, first: np.ndarray, last: np.ndarray) -> list[bytes]:
    """The bytes of tokens first to last (not included): of words, with one space between."""
    if begin is None:
        return [bytes(raw[x:y]) for x, y in zip(first.tolist(), last.tolist(), strict=True)]
    return [b" ".join(bytes(raw[x:y]).split()) for x, y in zip(begin[first].tolist(), end[last - 1].tolist(), strict=True)]


def hashed(tokens: np.ndarray, first: np.ndarray, n: np.ndarray, o: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run's tokens and of the place of the anchor in it, as both must be equal."""
    raw, size, digest = memoryview(np.ascontiguousarray(tokens)).cast("B"), tokens.itemsize, xxhash.xxh3_64_intdigest
    c = np.fromiter((digest(raw[x:y]) for x, y in zip((first * size).tolist(), ((first + n + length - 1) * size).tolist(), strict=True)), np.uint64, len(first))
    c ^= (o.astype(np.uint64) << np.uint64(8) | n.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return c.view(np.int64)


def scan(tokenise: Callable, length: int, seed: int) -> Callable:
    """Of each batch of (did, fp, text) the rows RUNS. tokenise(buf, offsets): tokens, their n + 1 offsets, and first byte and end of each (None: a byte is a token)."""

    def merged(found: list[tuple], texts: list[tuple]) -> pa.RecordBatch:
        """The runs found in texts, but for equal ones of which the first stands for all."""
        a, c, v, d, f, own, first, n = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((v, f, d, c, a))
        a, c, v, d, f, own, first, n = (x[order] for x in (a, c, v, d, f, own, first, n))
        new = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])] if len(a) else np.zeros(0, bool)
        head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
        same = ~new & (d == d[head]) & (f == f[head]) & (v == v[head])
        local = ~new & ~same
        again = np.flatnonzero(local)

        def spell(at: np.ndarray) -> list[bytes]:
            out: list[bytes] = [b""] * len(at)
            for k, (raw, begin, end) in enumerate(texts):
                here = np.flatnonzero(own[at] == k)
                x = at[here]
                for i, text in zip(here.tolist(), spelled(raw, begin, end, first[x], first[x] + n[x] + length - 1), strict=True):
                    out[i] = text
            return out

        for x in range(0, len(again), 100_000):
            some = again[x : x + 100_000]
            local[some] = [y == z for y, z in zip(spell(some), spell(head[some]), strict=True)]
        # what is settled here needs no company: it is spread evenly
        a, c, v = np.where(local, d * np.int64(-7046029254386353131) + v, a), np.where(local, 0, c), np.where(local, v | LOCAL, v)
        return pa.RecordBatch.from_arrays([pa.array(x[~same], pa.int64()) for x in (a, c, d, f, v)], names=["a", "c", "did", "fp", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        texts: list[tuple] = []
        held = 0
        for batch in batches:
            buf, offsets = utf8(batch.column(2))
            did, fp = longs(batch.column(0)), longs(batch.column(1))
            for lo, hi in parts(offsets):
                part = buf[offsets[lo] : offsets[hi]]
                tokens, at, begin, end = tokenise(part, offsets[lo : hi + 1] - offsets[lo])
                for doc, s0, n, o, a, first in runs_of(tokens, at[:-1], at[1:], length, seed):
                    c = hashed(tokens, first, n, o, length)
                    found.append((a.view(np.int64), c, s0 << 16 | o << 8 | n, did[lo:hi][doc], fp[lo:hi][doc], np.full(len(a), len(texts)), first, n))
                texts.append((memoryview(np.ascontiguousarray(part)), begin, end))
                held += len(part)
                if held >= MERGE:
                    if found:
                        yield merged(found, texts)
                    found, texts, held = [], [], 0
        if found:
            yield merged(found, texts)

    return run


def _wide(tokens: np.ndarray) -> np.ndarray:
    """Tokens as words of 64 bits: bytes go through the table."""
    return BYTES[tokens] if tokens.itemsize == 1 else tokens


def resolving(most: int) -> Callable:
    """Rows in order of a, c, did, fp, v. Gives (did, fp, v, open): open 0 for runs that a task has settled, 1 for all whose anchor other runs share, with HOT in v for first runs of an anchor with over ``most`` different ones.

    Between batches it keeps the first runs of the last anchor, ``most`` at the most."""

    def out(did: np.ndarray, fp: np.ndarray, v: np.ndarray, opened: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (did, fp, v)), pa.array(np.full(len(did), opened, np.int32))], names=["did", "fp", "v", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        last = head = None  # (a, c) of the last row, (did, fp, v) of the first row of its run
        held, copied, hot = (none, none, none), np.zeros(0, bool), False  # first runs of the last anchor, which of them have copies, and that it has too many
        for batch in batches:
            a, c, did, fp, v = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            local = v < 0
            if local.any():
                yield out(did[local], fp[local], v[local] & ~LOCAL, 0)
                a, c, did, fp, v = (x[~local] for x in (a, c, did, fp, v))
            n = len(a)
            if not n:
                continue
            group, first = np.ones(n, bool), np.ones(n, bool)
            group[1:] = a[1:] != a[:-1]
            first[1:] = group[1:] | (c[1:] != c[:-1])
            if last is not None:
                group[0] = a[0] != last[0]
                first[0] = group[0] or c[0] != last[1]
            at = np.maximum.accumulate(np.where(first, np.arange(n), -1))
            heads = [x[at] for x in (did, fp, v)]
            if head is not None:
                heads = [np.where(at < 0, h, x) for h, x in zip(head, heads, strict=True)]
            again = ~first & ((did != heads[0]) | (fp != heads[1]) | (v != heads[2]))
            yield out(did[again], fp[again], v[again], 1)
            last, head = (a[-1], c[-1]), tuple(x[-1] for x in heads)
            # first runs with those held before them; group 0 is the one that goes on
            number = np.r_[np.zeros(len(held[0]), np.int64), np.cumsum(group)[first]]
            rows = [np.r_[x, y[first]] for x, y in zip(held, (did, fp, v), strict=True)]
            copied = np.r_[copied, np.zeros(int(first.sum()), bool)]
            own = len(held[0]) - 1 + np.cumsum(first)[again]
            copied[own[own >= 0]] = True  # below 0: a copy of a run that is out already
            ends = int(np.cumsum(group)[-1])
            count = np.bincount(number, minlength=ends + 1)
            many = count > most
            many[0] |= hot
            settled = (number < ends) | many[number]
            several = settled & (many[number] | (count > 1)[number] | copied)
            d, f, w = (x[several] for x in rows)
            yield out(d, f, np.where(many[number[several]], w | HOT, w), 1)
            held, copied, hot = tuple(x[~settled] for x in rows), copied[~settled], bool(many[ends])
        if len(held[0]) > 1 or copied.any():
            yield out(*held, 1)

    return run


AROUND = "a long, did long, fp long, v long, tokens binary, k int"


def contexts(tokenise: Callable, length: int, seed: int) -> Callable:
    """Of (did, fp, body, vs) the open runs, as rows AROUND: k 0 with the run's bytes; of hot runs also, for each window, k 1 with its hash in a and its bytes, or k 2 for windows in a row that repeat others in the batch."""

    def rows(a, did, fp, v, tokens, k: int) -> pa.RecordBatch:
        columns = [*(pa.array(x, pa.int64()) for x in (a, did, fp, v)), pa.array(tokens, pa.binary()), pa.array(np.full(len(a), k, np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["a", "did", "fp", "v", "tokens", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, fp, lists = longs(batch.column(0)), longs(batch.column(1)), batch.column(3)
            ends = np.r_[0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            for lo, hi, buf, offsets in unpacked(batch, 2):
                tokens, at, begin, end = tokenise(buf, offsets)
                raw = memoryview(np.ascontiguousarray(buf))
                v = flat[ends[lo] : ends[hi]]
                own = np.repeat(np.arange(lo, hi), np.diff(ends[lo : hi + 1]))
                place, o, n = v >> 16 & PLACE, v >> 8 & 127, v & 255
                s = at[own - lo] + place
                a = _seeds(tokens, s + o, seed).view(np.int64)
                for x in range(0, len(v), 4096):
                    i = np.arange(x, min(x + 4096, len(v)))
                    yield rows(a[i], did[own[i]], fp[own[i]], v[i], spelled(raw, begin, end, s[i], s[i] + n[i] + length - 1), 0)
                hot = np.flatnonzero(v & HOT)
                for x in range(0, len(hot), 1024):
                    part = hot[x : x + 1024]
                    i = np.repeat(part, n[part])
                    step = ranges(np.zeros(len(part), np.int64), n[part])
                    body = spelled(raw, begin, end, s[i] + step, s[i] + step + length)
                    d, f, w = did[own[i]], fp[own[i]], (place[i] + step) << 16 | 1
                    keys = list(zip(d.tolist(), f.tolist(), w.tolist(), strict=True))
                    seen: dict[bytes, tuple] = {}
                    for text, key in zip(body, keys, strict=True):
                        seen[text] = min(seen.get(text, key), key)
                    later = np.array([seen[text] != key for text, key in zip(body, keys, strict=True)], bool)
                    h = np.fromiter((xxhash.xxh3_64_intdigest(text) for text in body), np.uint64, len(body)).view(np.int64)
                    fresh, repeated = np.flatnonzero(~later), np.flatnonzero(later)
                    yield rows(h[fresh], d[fresh], f[fresh], w[fresh], [body[j] for j in fresh.tolist()], 1)
                    if len(repeated):
                        # windows in a row are one span
                        heads = repeated[np.r_[True, (np.diff(repeated) > 1) | (i[repeated[1:]] != i[repeated[:-1]])]]
                        many = np.diff(np.r_[np.searchsorted(repeated, heads), len(repeated)])
                        yield rows(h[heads], d[heads], f[heads], w[heads] - 1 + many, [b""] * len(heads), 2)

    return run


def _seeds(tokens: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    up = powers(seed)[0]
    for i in range(seed):
        h += _wide(tokens[at + i]) * up[i]
    return mix(h)


def solving(solve: Callable, tokenise: Callable, length: int, limit: int = 12_000) -> Callable:
    """Of open runs in order of a, k, tokens, did, fp, v the windows that repeat, as SPANS.

    solve(tokens, at, group, o, n, rank, spell): for different runs, laid out around their anchors, a table of whether
    window x (its anchor at offset x) of each repeats one of lower rank; spell(runs, firsts, lasts) gives bytes of tokens. Whole groups go to it
    together, until they hold ``limit`` runs. Between batches it keeps the different runs of one anchor."""

    def spans(did, fp, v) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (did, fp, v)], names=["did", "fp", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (a, did, fp, v, bytes) of different runs, in order of a
        last, heads = None, {}  # (a, bytes) of the last run, and the first place for each place of the anchor in it
        now, firsts = None, {}  # the hash of the last window, and the first place of each window with it

        def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
            """Windows in order of their hash, document and place: all but the first of equal ones repeat."""
            nonlocal now, firsts
            keep = []
            for a, d, f, v, text, k in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if k == 2:
                    keep.append(True)
                    continue
                if a != now:
                    now, firsts = a, {}
                keep.append(firsts.setdefault(text, (d, f, v)) != (d, f, v))
            return batch.select(["did", "fp", "v"]).filter(pa.array(keep, pa.bool_()))

        def copies(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """Runs with the bytes of the one before repeat throughout; the others are held."""
            nonlocal last, heads
            again: tuple[list, list, list] = ([], [], [])
            for a, d, f, v, text in zip(*(x.to_pylist() for x in batch.columns[:5]), strict=True):
                if last is None or last[0] != a or last[1] != text:
                    last, heads = (a, text), {}
                key = (d, f, v >> 16)
                first = heads.setdefault(v >> 8 & 127, key)
                if first is key:
                    if not v & HOT:
                        held.append((a, d, f, v, text))
                elif first != key:
                    again[0].append(d), again[1].append(f), again[2].append(v >> 16 << 16 | v & 255)
            if again[0]:
                yield spans(*again)

        def flush(rows: list[tuple]) -> pa.RecordBatch | None:
            a, did, fp, v = (np.array([r[i] for r in rows], np.int64) for i in range(4))
            alone = np.r_[True, a[1:] != a[:-1]] & np.r_[a[1:] != a[:-1], True]
            keep = np.flatnonzero(~alone)
            if not len(keep):
                return None
            a, did, fp, v, text = a[keep], did[keep], fp[keep], v[keep], [rows[i][4] for i in keep.tolist()]
            raw = b"".join(text)
            edges = np.r_[0, np.cumsum([len(x) for x in text])].astype(np.int64)
            tokens, at, begin, end = tokenise(np.frombuffer(raw, np.uint8), edges)
            s, o, n = v >> 16 & PLACE, v >> 8 & 127, v & 255
            order = np.lexsort((s + o, fp, did))
            changed = lambda x: x[order][1:] != x[order][:-1]
            rank = np.empty(len(v), np.int64)
            rank[order] = np.cumsum(np.r_[0, changed(did) | changed(fp) | changed(s + o)])
            group = np.cumsum(np.r_[0, a[1:] != a[:-1]])
            spell = lambda i, lo, hi: spelled(raw, begin, end, at[i] + lo, at[i] + hi)
            dup = solve(tokens, at[:-1], group, o, n, rank, spell)  # (runs, offsets)
            # windows in order of their start have falling offsets
            row, x = np.nonzero(dup[:, ::-1])
            start = s[row] + o[row] - (dup.shape[1] - 1 - x)
            new = np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)] if len(row) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            many = np.diff(np.r_[first, len(row)])
            return spans(did[row[first]], fp[row[first]], start[first] << 16 | many)

        for batch in batches:
            if not batch.num_rows:
                continue
            if np.any(single := batch.column(5).to_numpy() > 0):
                yield windows(batch.filter(pa.array(single)))
                batch = batch.filter(pa.array(~single))
            yield from copies(batch)
            if len(held) < limit:
                continue
            edge = next((i for i in range(len(held) - 1, 0, -1) if held[i][0] != held[i - 1][0]), 0)
            if edge and (found := flush(held[:edge])):
                yield found
            del held[:edge]
        if held and (found := flush(held)):
            yield found

    return run


def repeats(docs: DataFrame, tokenise: Callable, solve: Callable, length: int, seed: int, most: int = MOST) -> DataFrame:
    """(did, fp, vs) of documents of keyed(documents): the windows that also start earlier, v as in SPANS."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("did", "fp", "text")
    opened = F.collect_list(F.when(F.col("open") == 1, F.col("v"))).alias("vs")
    closed = F.collect_list(F.when(F.col("open") == 0, F.col("v").bitwiseAND(~(255 << 8)))).alias("closed")
    parted = lambda: texts.mapInArrow(scan(tokenise, length, seed), RUNS).repartition(n, "a").sortWithinPartitions("a", "c", "did", "fp", "v")
    # kept by document: an eighth of what a row for each run would take
    settled = cut(parted().mapInArrow(resolving(most), f"{SPANS}, open int").groupBy("did", "fp").agg(opened, closed))

    def solved() -> DataFrame:
        left = settled.where(F.size("vs") > 0).select("did", "fp", "vs")
        taken = packed(texts).join(left, ["did", "fp"]).select("did", "fp", "body", "vs")
        around = taken.mapInArrow(contexts(tokenise, length, seed), AROUND)
        around = around.repartition(n, "a").sortWithinPartitions("a", "k", "tokens", "did", "fp", "v")
        found = around.mapInArrow(solving(solve, tokenise, length), SPANS)
        found = found.union(settled.select("did", "fp", F.explode("closed").alias("v")))
        return found.groupBy("did", "fp").agg(F.collect_list("v").alias("vs"))

    return cut(solved())


def marked(docs: DataFrame, lists: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """finish(text as bytes, firsts, counts) of every document, with the windows of lists(did, fp, vs), as columns of schema after doc_id."""
    joined = packed(docs.select("did", "fp", "doc_id", "text")).join(lists, ["did", "fp"], "left").select("doc_id", "body", "vs")
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", *(x.split()[0] for x in schema.split(","))]
    # every column has a type of its own: a slice in which nothing is removed tells none
    kinds = [ARROW[x.split()[1]] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = np.r_[0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            for lo, hi, buf, offsets in unpacked(batch, 1):
                rows = []
                for i in range(lo, hi):
                    v = np.sort(flat[ends[i] : ends[i + 1]])
                    rows.append(finish(buf[offsets[i - lo] : offsets[i - lo + 1]], v >> 16 & PLACE, v & 65535))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return joined.mapInArrow(run, f"doc_id {kind}, {schema}")


def removed(firsts: np.ndarray, counts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of total tokens lie in a window that starts in one of the ranges."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, firsts, 1)
    np.add.at(edge, np.minimum(firsts + counts + length - 1, total), -1)
    return np.cumsum(edge[:-1]) > 0


__all__ = ["keyed", "marked", "ranges", "removed", "repeats"]
