"""Quality scores from random Fourier features of document statistics.

Statistics of the whole text are standardised over all documents and mapped through random cosines, which
approximate a Gaussian kernel. Each task adds up its part of the normal equations of a ridge regression on the
labels; the parts are added row by row and the small system is solved. Labelled rows kept out of that fit, binned by raw
score, give an isotonic curve (pool adjacent violators) from raw scores to probabilities.

Only the text is an input. Rows whose crc32(doc_id as text) mod 4 is 2 are held out: their labels are never read.
The remainder 3 calibrates, the others fit. Cases: null and empty texts have all statistics 0 and get a score;
unlabelled rows and null labels are scored, not learned from; several labels of one doc_id count by their mean; without any
labels all scores are 0.5; a null doc_id is not held out and has no label; rows that repeat each get a
score; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._batch import SPACE, mix, parts, utf8, words
from ._runtime import cut, shared_folder

STATISTICS = (
    "log_chars", "log_words", "upper", "digits", "marks", "odd_marks", "bars", "high", "distinct", "top", "runs", "twos", "threes",
    "word_length", "word_spread", "short", "line_length", "no_letters", "ends_marked", "marks_spread",
)
WIDTH = 384
RIDGE = 1e-3
THRESHOLD = 0.7
BINS = 2000
#: Partial sums of the normal equations come from the shuffle partitions, or so many tasks if those are fewer.
PARTIALS = 64


def _table(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in chars])


_UPPER, _LETTER = (np.zeros(256, bool) for _ in range(2))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = _table("0123456789")
_MARK = ~(_LETTER | _DIGIT | SPACE)
_ODD = _MARK & ~_table(".,;:'\"-()")


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text."""
    n = np.diff(offsets)
    rows = len(n)

    def total(flags: np.ndarray, at: np.ndarray = offsets) -> np.ndarray:
        sums = np.r_[0.0, np.cumsum(flags, dtype=np.float64)]
        return sums[at[1:]] - sums[at[:-1]]

    h, s, e, at = words(buf, offsets)
    count = np.diff(at)
    doc = np.repeat(np.arange(rows), count)
    safe, letters = np.maximum(count, 1), np.maximum(total(_LETTER[buf]), 1)
    length = (e - s).astype(np.float64)
    same = lambda k: np.r_[np.zeros(min(k, len(h)), bool), (h[k:] == h[:-k]) & (doc[k:] == doc[:-k])] if len(h) > k else np.zeros(len(h), bool)

    def variety(x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values and the count of the commonest, by row."""
        order = np.lexsort((x, d))
        x, d = x[order], d[order]
        new = np.r_[True, (x[1:] != x[:-1]) | (d[1:] != d[:-1])] if len(x) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        most = np.zeros(rows)
        np.maximum.at(most, d[head], np.diff(np.r_[head, len(x)]))
        return np.bincount(d[head], minlength=rows), most

    distinct, top = variety(h, doc)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    kinds, most = variety(mix(h[pair] + h[pair + 1] * np.uint64(3)), doc[pair])
    pairs = np.maximum(count - 1, 1)
    mean = total(length, at) / safe
    letter_sums = np.r_[0, np.cumsum(_LETTER[buf])]
    marked = _MARK[buf[e - 1]] if len(e) else np.zeros(0, bool)
    share = total(marked, at) / safe
    columns = [
        np.log1p(n), np.log1p(count), total(_UPPER[buf]) / letters, total(_DIGIT[buf]) / np.maximum(n, 1), total(_MARK[buf]) / np.maximum(n, 1),
        total(_ODD[buf]) / np.maximum(n, 1), total(buf == 124) / safe, total(buf >= 128) / np.maximum(n, 1), distinct / safe, top / safe, total(same(1), at) / safe,
        (1 - kinds / pairs) * (count > 1), most / pairs, mean, np.sqrt(np.maximum(total(length**2, at) / safe - mean**2, 0)), total(length <= 3, at) / safe,
        np.log1p(count / (1 + total(buf == 10))), total(letter_sums[e] == letter_sums[s], at) / safe, share, total(same(2), at) / safe,
    ]
    return np.stack(columns, axis=1)


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, x)."""
    for batch in batches:
        buf, offsets = utf8(batch.column(1))
        for lo, hi in parts(offsets):
            x = statistics(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _lists(x)], names=["doc_id", "x"])


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class Model:
    """Standardisation, random directions, ridge weights and the isotonic curve."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.c_[np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases)), z / 10, np.ones(len(x))]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def isotonic(at: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order of at: centres and means of the blocks."""
    blocks: list[list[float]] = []
    for x, y, n in zip(at.tolist(), total.tolist(), count.tolist(), strict=True):
        blocks.append([x * n, y, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            x2, y2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + x2, blocks[-1][1] + y2, blocks[-1][2] + n2]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def remainder(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


def fit(x: DataFrame, labels: DataFrame, width: int = WIDTH, ridge: float = RIDGE, seed: int = 6) -> Model:
    """x: (doc_id, x) of all documents; labels: (doc_id, quality), of which held-out ones are not read."""
    d = len(STATISTICS)
    sums = [f(F.get("x", F.lit(i))) for i in range(d) for f in (F.avg, F.stddev_pop)]
    got = np.array([v or 0.0 for v in x.agg(*sums).first()]).reshape(d, 2)
    random = np.random.default_rng(seed)
    width_of = np.repeat([1.5, 3.0, 6.0], -(-width // 3))[:width]  # bandwidths about the root of the number of statistics
    model = Model(got[:, 0], np.maximum(got[:, 1], 1e-9), random.normal(size=(d, width)) / width_of, random.uniform(0, 2 * np.pi, width), np.zeros(width + d + 1), np.zeros(1), np.full(1, 0.5))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    known = known.withColumn("rest", remainder(F.col("doc_id"))).where("rest <> 2")
    train = cut(x.join(known, "doc_id").select("x", "y", "rest"))
    size = width + d + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                z = model.features(_matrix(part.column(0), d))
                total += z.T @ np.c_[z, part.column(1).to_numpy()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), _lists(total)], names=["i", "row"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), size + 1), strict=True):
                total[i] = total.get(i, 0) + row
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), _lists(np.stack(list(total.values())))], names=["i", "row"])

    partial = train.where("rest <> 3").select("x", "y").coalesce(max(PARTIALS, int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(equations, "i int, row array<double>")
    rows = partial.repartition(8, "i").mapInArrow(added, "i int, row array<double>").collect()
    system = np.zeros((size, size + 1))
    for i, row in rows:
        system[i] = row
    n = system[-1, size - 1]  # the constant's square: the number of rows
    if not n:
        return model
    a = system[:, :size] + ridge * n / size * np.eye(size)
    model.weights = np.linalg.solve(a, system[:, size])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch.column(0), d))), batch.column(1)], names=["raw", "y"])

    bin_of = F.least(F.greatest(F.floor((F.col("raw") + 1) * (BINS / 3)), F.lit(0)), F.lit(BINS - 1))
    scored = train.where("rest = 3").select("x", "y").mapInArrow(raw, "raw double, y int")
    bins = sorted(scored.groupBy(bin_of.alias("bin")).agg(F.avg("raw").alias("at"), F.sum("y").alias("y"), F.count("*").alias("n")).collect())
    if bins:
        at, y, count = (np.array([float(b[i]) for b in bins]) for i in (1, 2, 3))
        model.knots, model.values = isotonic(at, y, count)
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def scored(x: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of (doc_id, x)."""
    kind = dict(x.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1), len(STATISTICS))))], names=["doc_id", "score"])

    return x.mapInArrow(run, f"doc_id {kind}, score double")


def measure(documents: DataFrame) -> DataFrame:
    """(doc_id, x) of every document, kept in the checkpoint folder: the texts are read once."""
    kind = dict(documents.dtypes)["doc_id"]
    return cut(documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(measured, f"doc_id {kind}, x array<double>"))


def score(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    x = measure(documents)
    out = scored(x, fit(x, labels))
    return out.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents, whole, that reach the threshold.

    Texts are measured once: the rows and their statistics are written as a table in the shared folder, of which the fit reads the statistics alone."""
    spark = documents.sparkSession
    at, x = documents.columns.index("text"), "x"
    while x in documents.columns:
        x = f"_{x}"
    width = len(STATISTICS)

    def with_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column(at).cast(pa.string()))
            for lo, hi in parts(offsets):
                found = _lists(statistics(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, found], names=[*batch.schema.names, x])

    path = shared_folder(spark, "measured")
    schema = T.StructType([*documents.schema.fields, T.StructField(x, T.ArrayType(T.DoubleType()))])
    documents.mapInArrow(with_statistics, schema).write.parquet(path)
    whole = spark.read.parquet(path)
    model = fit(whole.select("doc_id", F.col(x).alias("x")), labels)

    @F.pandas_udf("double")
    def score_of(column: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(column.to_list()).reshape(-1, width)) if len(column) else np.zeros(0))

    return whole.where(score_of(F.col(x)) >= threshold).select(*documents.columns)
