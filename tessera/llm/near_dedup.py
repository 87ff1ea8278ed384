"""Near-duplicate documents by MinHash with odd sketches, confirmed on full shingle sets.

1. Each text gives its set of distinct 5-word shingles, a digest of the set, MinHash band keys, and an
   odd sketch: each MinHash value flips one bit of a parity bitmap, so the population count of the XOR
   of two bitmaps tells how many values differ, most precisely where few do. Documents with equal sets are one
   class, and one of them stands for it from here on.
2. In each band bucket the sketches alone, compared from one document outwards, give a spanning forest of the pairs
   that may be similar: a document once reached is not compared again, so a bucket of copies costs
   one comparison each, and no bucket emits more links than it has members. A bucket of more than
   ``BUCKET`` members is split into parts that meet in pairs, each pair a bucket of its own.
3. Components of those links bound where true links can be. Each is gathered with its full sets, a large one by its band buckets
   instead of as a whole, and there links are decided exactly.
4. Components of the true links are the result.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Cases: a text with fewer than 5 words is one
shingle; without words it has an empty set and is linked with nothing; null counts as empty; rows with the same doc_id are
one document; a null doc_id is the least, and gives a null component_id; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._batch import grams, mix, packed, parts, prefix, ranges, slices, unpacked, utf8, words
from ._runtime import components, cut
from ._windows import keyed

SHINGLE = 5
#: Rows of a band; the values of SKETCHED bands make the sketch, and no similarity has fewer bands.
ROWS, SKETCHED = 4, 20
BITS = 256
#: The share of pairs at the least similarity that may share no band, and by how many deviations more than the mean of their bits may differ.
MISS, DEVIATIONS = 4e-7, 6
#: Shingles that a component, or a bucket of a larger one, may hold to be gathered in one block.
BLOCK = 2_000_000
#: Members of a band bucket that are gathered together; the keys of larger buckets are broadcast if there are at most HOT_KEYS.
BUCKET, HOT_KEYS = 100_000, 100_000


def bands_for(percent: int) -> int:
    """Bands of ROWS rows at which a pair of that similarity shares none with a chance of MISS at most: 20 at 85, 28 at 80."""
    return max(SKETCHED, math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))) if percent < 100 else SKETCHED


def far_for(percent: int) -> int:
    """Bits of two sketches that may differ: 56 at 85 (22 do, with a deviation of 6), 65 at 80 (28, with 6).

    Of SKETCHED * ROWS values a binomial number differ, each flips a bit in either sketch, and the first two moments of the parities are exact."""
    j, values = percent / 100, SKETCHED * ROWS
    one, two = ((j + (1 - j) * (1 - x / BITS) ** 2) ** values for x in (2, 4))
    return math.ceil(BITS / 2 * (1 - one) + DEVIATIONS / 2 * math.sqrt(BITS + BITS * (BITS - 1) * two - (BITS * one) ** 2))


def factors(bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of the hash functions; those of fewer bands come first."""
    drawn = np.random.default_rng(8).integers(0, 1 << 63, (bands * ROWS, 2), dtype=np.uint64)
    return drawn[:, 0] * np.uint64(2) + np.uint64(1), drawn[:, 1]


def shingles(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, and their n + 1 offsets."""
    hashes, _, _, at = words(buf, offsets, lower=True)
    count = np.diff(at)
    doc = np.repeat(np.arange(len(count)), np.maximum(count - size + 1, 0))
    h = grams(hashes, size)[ranges(at[:-1], np.maximum(count - size + 1, 0))]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        p = prefix(hashes)
        doc, h = np.r_[doc, short], np.r_[h, mix(slices(p, at[:-1][short], at[1:][short]) + count[short].astype(np.uint64))]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(count) + 1))


def signed_sets(size: int, bands: int) -> Callable:
    factor, summand = factors(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column(2))
            for lo, hi in parts(offsets):
                h, at = shingles(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                n = np.diff(at)
                full = np.flatnonzero(n)
                keys = np.zeros((hi - lo, bands), np.uint64)
                sketch = np.zeros((hi - lo, BITS // 64), np.uint64)
                if len(full):
                    heads = at[:-1][full]
                    for b in range(bands):
                        key = np.full(len(full), b + 1, np.uint64)
                        for j in range(b * ROWS, (b + 1) * ROWS):
                            least = np.minimum.reduceat(h * factor[j] + summand[j], heads)
                            key = mix(key ^ least)
                            if b >= SKETCHED:
                                continue
                            bit = (mix(least ^ factor[j]) % np.uint64(BITS)).astype(np.int64)
                            sketch[full, bit >> 6] ^= np.uint64(1) << (bit & 63).astype(np.uint64)
                        keys[full, b] = key
                raw = memoryview(h).cast("B") if len(h) else b""
                digest = [xxhash.xxh3_128_digest(raw[8 * x : 8 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                digest = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n),
                        pa.array(np.ascontiguousarray(digest[:, 0])), pa.array(np.ascontiguousarray(digest[:, 1])),
                        pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64))),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                    ],
                    names=["did", "fp", "n", "d1", "d2", "bands", "sketch"],
                )

    return run


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows that agree in the first columns; the rows come in order of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        columns = [rows.column(i).to_numpy() for i in range(keys)]
        same = np.logical_and.reduce([x == x[-1] for x in columns])
        edge = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if edge:
            yield rows.slice(0, edge)
            held = rows.slice(edge).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def bounds(columns: list[np.ndarray]) -> np.ndarray:
    new = np.logical_or.reduce([np.r_[True, x[1:] != x[:-1]] for x in columns])
    return np.r_[np.flatnonzero(new), len(new)]


def spread(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """A spanning forest of the graph where near(i, others) tells which others i is linked to, searched breadth first."""
    left, a, b = np.arange(n), [], []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            hit = near(i, left)
            found = left[hit]
            left = left[~hit]
            a += [i] * len(found)
            b += found.tolist()
            front += found.tolist()
    return a, b


def sketch_links(far: int) -> Callable:
    """Rows (key, did, sketch) in order of key to links (a, b) of sketches that differ in so many bits at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 1):
            key, did = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            at = bounds([key])
            size = np.diff(at)
            if (size < 2).all():
                continue
            bits = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint64).reshape(len(key), -1)
            apart = lambda i, j: np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1)
            two = at[:-1][size == 2]
            two = two[apart(two, two + 1) <= far]
            a, b = [did[two]], [did[two + 1]]
            for s, n in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                x, y = spread(n, lambda i, others, s=s: apart([s + i], s + others) <= far)
                a.append(did[s + np.array(x, np.int64)])
                b.append(did[s + np.array(y, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def meetings(name: str, many: Column, pair: Callable[[Column, Column], Column]) -> Column:
    """pair(i, j) for each pair of parts, i <= j, that a row of the part to which its ``name`` is hashed belongs to."""
    own = F.pmod(F.xxhash64(name), many).cast("int")
    return F.transform(F.sequence(F.lit(0), many - 1), lambda j: pair(F.least(own, j), F.greatest(own, j)))


def bounded(buckets: DataFrame) -> DataFrame:
    """Buckets (key, did, sketch) of a bounded size, in which all that share a bucket still meet."""
    count = buckets.groupBy("key").count().where(F.col("count") > BUCKET)
    hot = cut(count.select("key", F.ceil(F.col("count") / BUCKET).cast("int").alias("many")))
    size = hot.count()
    if not size:
        return buckets
    split = buckets.join(F.broadcast(hot) if size <= HOT_KEYS else hot, "key", "left")
    keys = meetings("did", F.col("many"), lambda i, j: F.xxhash64("key", i, j))
    return split.select(F.explode(F.when(F.col("many").isNull(), F.array("key")).otherwise(keys)).alias("key"), "did", "sketch")


def by_buckets(members: DataFrame) -> DataFrame:
    """members(root, did, fp, n, bands) of large components as (did, fp, root, blocks): the band buckets in which each meets others.

    So a set goes to its bands at most, however large the component; only a single bucket beyond BLOCK is split into parts that meet in pairs."""
    rows = members.select("root", "did", "fp", "n", F.explode("bands").alias("key"))
    count = rows.groupBy("root", "key").agg(F.count("*").alias("count"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("many")).where("count > 1")
    pairs = meetings("did", F.col("many"), lambda i, j: F.struct(F.col("key").alias("key"), i.alias("i"), j.alias("j")))
    return rows.join(count, ["root", "key"]).select("did", "fp", "root", pairs.alias("blocks")).groupBy("did", "fp", "root").agg(F.flatten(F.collect_list("blocks")).alias("blocks"))


def full_sets(size: int) -> Callable:
    """(did, body, root, blocks) to (did, set, root, blocks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in unpacked(batch, 1):
                h, at = shingles(buf, offsets, size)
                raw = h.tobytes()
                sets = [raw[8 * x : 8 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                cells = [batch.column(i).slice(lo, hi - lo) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([cells[0], pa.array(sets, pa.binary()), *cells[1:]], names=["did", "set", "root", "blocks"])

    return run


def true_links(percent: int) -> Callable:
    """Rows (root, key, i, j, did, set) in order of the first four to links (a, b) with percent of the union in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 4):
            at = bounds([rows.column(i).to_numpy() for i in range(4)])
            did, sets = rows.column(4).to_numpy(), rows.column(5)
            a, b = [], []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                own = [np.frombuffer(x.as_py(), np.uint64) for x in sets.slice(s, e - s)]
                n = np.array([len(x) for x in own])
                flat, heads = np.concatenate(own), np.r_[0, np.cumsum(n)[:-1]]

                def near(i: int, others: np.ndarray, own=own, n=n, flat=flat, heads=heads) -> np.ndarray:
                    hit = 100 * np.minimum(n[i], n[others]) >= percent * np.maximum(n[i], n[others])
                    close = others[hit]
                    if len(close):
                        values = flat[ranges(heads[close], n[close])]
                        place = np.minimum(np.searchsorted(own[i], values), n[i] - 1)
                        common = np.add.reduceat((own[i][place] == values).astype(np.int64), np.r_[0, np.cumsum(n[close])[:-1]])
                        hit[hit] = 100 * common >= percent * (n[i] + n[close] - common)
                    return hit

                x, y = spread(e - s, near)
                a.append(did[s + np.array(x, np.int64)])
                b.append(did[s + np.array(y, np.int64)])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def near_groups(documents: DataFrame, percent: int = 85, size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    kind = dict(documents.dtypes)["doc_id"]
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = keyed(documents)
    schema = "did long, fp long, n long, d1 long, d2 long, bands array<long>, sketch binary"
    every = cut(docs.select("did", "fp", "text").mapInArrow(signed_sets(size, bands_for(percent)), schema))
    first = F.min(F.struct("did", "fp")).alias("rep")
    reps = cut(every.where("n > 0").groupBy("d1", "d2").agg(first, F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    reps = reps.select("d1", "d2", F.col("rep.did").alias("did"), F.col("rep.fp").alias("fp"), "n", "bands", "sketch")

    buckets = reps.select(F.explode("bands").alias("key"), "did", "sketch")
    maybe = bounded(buckets).repartition(n, "key").sortWithinPartitions("key", "did").mapInArrow(sketch_links(far_for(percent)), "a long, b long")
    near = components(maybe)

    members = near.withColumnRenamed("node", "did").join(reps.select("did", "fp", "n", "bands"), "did")
    load = members.groupBy("root").agg(F.sum("n").alias("load"))
    large = cut(load.where(F.col("load") > BLOCK).select("root", F.lit(True).alias("large")))
    blocks = members.select("did", "fp", "root", F.array(F.struct(F.lit(0).cast("long").alias("key"), F.lit(0).alias("i"), F.lit(0).alias("j"))).alias("blocks"))
    if large.count():
        blocks = blocks.join(large, "root", "left_anti").unionByName(by_buckets(members.join(large, "root")))
    gathered = packed(docs.select("did", "fp", "text")).join(blocks, ["did", "fp"]).select("did", "body", "root", "blocks")
    sets = gathered.mapInArrow(full_sets(size), "did long, set binary, root long, blocks array<struct<key:bigint,i:int,j:int>>")
    met = sets.select("did", "set", "root", F.explode("blocks").alias("block")).select("root", "block.key", "block.i", "block.j", "did", "set")
    links = met.repartition(n, "root", "key", "i", "j").sortWithinPartitions("root", "key", "i", "j", "did").mapInArrow(true_links(percent), "a long, b long")
    # an id of several rows is one document: its sets are linked through it
    several = every.where("n > 0 AND fp <> 0").join(reps.select("d1", "d2", F.col("did").alias("rep")), ["d1", "d2"])
    groups = components(links.union(several.where("did <> rep").select(F.col("rep").alias("a"), F.col("did").alias("b"))))

    real = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c)).cast(kind)
    labelled = reps.select("d1", "d2", F.col("did").alias("rep")).join(groups, F.col("rep") == F.col("node"), "left")
    labelled = labelled.select("d1", "d2", F.coalesce("root", "rep").alias("least"))
    out = every.select("did", "n", "d1", "d2").join(labelled, ["d1", "d2"], "left")
    out = out.withColumn("component", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("did")))
    return out.select(real("did").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"), (F.col("did") == F.col("component")).alias("kept"))
