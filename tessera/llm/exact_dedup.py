"""Exact dedup by Grace hash partitioning.

Each task merges the equal texts of a few megabytes and deals out one row per different text (compressed, with
its best copy and their number), so a text that a third of all documents share arrives as one row of constant
size per slice. The receiving task writes its rows to spill files by further bits of the hash, recursively, until a
file's texts, by their true size, fit an open-addressing table that compares complete contents, and gives one row per text. The
ids meet these rows by the text's digest in a plain join, which the engine splits where many share one; a digest of two
different contents is an error. Spill files lie in the executor's own scratch folders and die with the task, which
can be run again anywhere.

Texts are equal when identical after deleting U+0020 and U+0009 to U+000D. Of equal texts the one with the most
code points stays, then the smallest doc_id (a null before all).

Cases: null counts as empty, and all empty texts are one group; rows with the same doc_id are separate members, and
all of them are kept if that id is; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import pickle
import re
import shutil
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batch import longs, parts, utf8

SPACES = b" \t\n\r\x0b\x0c"
NULL = -(1 << 63)
#: Bytes of different texts that one table may hold.
TABLE_BYTES = 64 << 20
FAN = 16
#: Bytes of text that are merged before they are dealt out.
DEAL_BYTES = 4 << 20


def sliced(batch: pa.RecordBatch, did: int, text: int) -> Iterator[tuple[dict[bytes, tuple[bytes, list[int]]], list[int], list[int]]]:
    """The slices of a batch: by digest the normalised text and its places, and the ids and code points of all rows."""
    buf, offsets = utf8(batch.column(text))
    ids = longs(batch.column(did), NULL)
    for lo, hi in parts(offsets, DEAL_BYTES):
        part, at = buf[offsets[lo] : offsets[hi]], (offsets[lo : hi + 1] - offsets[lo]).tolist()
        starts = np.zeros(len(part) + 1, np.int32)
        np.cumsum((part & 0xC0) != 0x80, dtype=np.int32, out=starts[1:])
        raw = memoryview(np.ascontiguousarray(part))
        groups: dict[bytes, tuple[bytes, list[int]]] = {}
        for i in range(hi - lo):
            normal = raw[at[i] : at[i + 1]].tobytes().translate(None, SPACES)
            groups.setdefault(hashlib.sha256(normal).digest(), (normal, []))[1].append(i)
        yield groups, ids[lo:hi].tolist(), np.diff(starts[at]).tolist()


def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to a row for each different text of a slice: its best copy (-points, then doc_id) and the number of copies."""
    for batch in batches:
        for groups, ids, points in sliced(batch, 0, 1):
            best = [min((-points[i], ids[i]) for i in places) for _, places in groups.values()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int.from_bytes(k[:8], "little", signed=True) for k in groups], pa.int64()),
                    pa.array(list(groups), pa.binary()),
                    pa.array([zlib.compress(x[0], 1) for x in groups.values()], pa.binary()),
                    pa.array([x[0] for x in best], pa.int64()),
                    pa.array([x[1] for x in best], pa.int64()),
                    pa.array([len(x[1]) for x in groups.values()], pa.int64()),
                    pa.array([len(x[0]) for x in groups.values()], pa.int64()),
                ],
                names=["h", "sha", "body", "points", "did", "copies", "size"],
            )


def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to a row for each different text of a slice: its digest and the ids of its copies."""
    for batch in batches:
        for groups, ids, _ in sliced(batch, 0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(list(groups), pa.binary()), pa.array([[ids[i] for i in x[1]] for x in groups.values()], pa.list_(pa.int64()))], names=["sha", "ids"])


class Table:
    """Open addressing with linear probing; a slot's content is compared in full."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 64
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.digests: list[bytes] = []
        self.best: list[tuple[int, int]] = []  # (-points, doc_id)
        self.count: list[int] = []

    def add(self, h: int, sha: bytes, text: bytes, best: tuple[int, int], copies: int) -> None:
        """Counts copies of a text, which is entered if new."""
        g = self.find(h, text)
        if g == len(self.best):
            self.digests.append(sha)
            self.best.append(best)
            self.count.append(0)
        self.best[g] = min(self.best[g], best)
        self.count[g] += copies

    def find(self, h: int, text: bytes) -> int:
        """The group of this text, made if new."""
        mask = len(self.slots) - 1
        i = (h >> 20) & mask
        while (g := self.slots[i]) >= 0:
            if self.hashes[g] == h and self.texts[g] == text:
                return g
            i = (i + 1) & mask
        g = self.slots[i] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        if 2 * len(self.texts) > len(self.slots):
            self.slots = [-1] * (4 * len(self.slots))
            mask = len(self.slots) - 1
            for other, value in enumerate(self.hashes):
                i = (value >> 20) & mask
                while self.slots[i] >= 0:
                    i = (i + 1) & mask
                self.slots[i] = other
        return g


def grouped(rows_of, folder: str, size: int, level: int, limit: int) -> Iterator[tuple[bytes, int, int]]:
    """rows_of(): (h, sha, body, points, did, copies, size). Gives (sha, keep, count) of each text.

    Files are parted again, by a hash that differs from level to level, until the texts of one fit the limit or it holds a single text, which a table has once."""
    if size > limit and several(rows_of):
        paths = [os.path.join(folder, f"{level}-{i}") for i in range(FAN)]
        files = [open(x, "wb") for x in paths]
        sizes = [0] * FAN
        for row in rows_of():
            part = hashlib.blake2b(row[1], digest_size=1, salt=level.to_bytes(16, "little")).digest()[0] % FAN
            pickle.dump(row, files[part], 5)
            sizes[part] += weight(row)
        for f in files:
            f.close()
        for i, path in enumerate(paths):
            inner = f"{path}.d"
            os.mkdir(inner)
            yield from grouped(lambda path=path: spilled(path), inner, sizes[i], level + 1, limit)
            shutil.rmtree(inner)
            os.remove(path)
        return
    table = Table()
    for h, sha, body, points, did, copies, _ in rows_of():
        table.add(h, sha, zlib.decompress(body), (points, did), copies)
    if len(set(table.digests)) < len(table.digests):
        raise RuntimeError("one digest stands for two texts")
    for sha, (_, keep), count in zip(table.digests, table.best, table.count, strict=True):
        yield sha, keep, count


def several(rows_of) -> bool:
    """Whether there are rows of more than one text."""
    rows = iter(rows_of())
    first = next(rows, None)
    return first is not None and any(row[1] != first[1] for row in rows)


def weight(row) -> int:
    """What a row takes in a table: its text unpacked, and the row itself."""
    return row[6] + len(row[2]) + 300


def spilled(path: str):
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def scratch() -> str:
    """A new folder in this executor's scratch space."""
    spaces = [x for name in ("SPARK_EXECUTOR_DIRS", "SPARK_LOCAL_DIRS", "LOCAL_DIRS") for x in re.split(r"[,:]", os.environ.get(name, "")) if os.path.isdir(x)]
    return tempfile.mkdtemp(prefix="grace-", dir=spaces[os.getpid() % len(spaces)] if spaces else None)


def collected(limit: int):
    """(h, sha, body, points, did, copies, size) to a row for each text: sha, keep, group_size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = scratch()
        try:
            path, held, size = os.path.join(folder, "all"), [], 0
            spill = None
            for batch in batches:
                for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    held.append(row)
                    size += weight(row)
                if size > limit:
                    spill = spill or open(path, "wb")
                    for row in held:
                        pickle.dump(row, spill, 5)
                    held.clear()
            if spill:
                for row in held:
                    pickle.dump(row, spill, 5)
                held.clear()
                spill.close()
            found = grouped((lambda: spilled(path)) if spill else (lambda: held), folder, size, 0, limit)
            while rows := list(itertools.islice(found, 20_000)):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["sha", "keep", "group_size"])
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def exact_groups(documents: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    kind = dict(documents.dtypes)["doc_id"]
    docs = documents.select(F.col("doc_id").cast("long").alias("did"), F.col("text").cast("string").alias("text"))
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = docs.mapInArrow(dealt, "h long, sha binary, body binary, points long, did long, copies long, size long").repartition(n, "h")
    groups = parted.mapInArrow(collected(table_bytes), "sha binary, keep long, group_size long")
    found = docs.mapInArrow(members, "sha binary, ids array<long>").join(groups, "sha").select(F.explode("ids").alias("did"), "keep", "group_size", F.lower(F.hex("sha")).alias("text_sha256"))
    real = lambda c: F.when(F.col(c) != NULL, F.col(c)).cast(kind)
    return found.select(
        real("did").alias("doc_id"), real("keep").alias("keep_id"), "group_size", (F.col("did") == F.col("keep")).alias("kept"), "text_sha256"
    )
