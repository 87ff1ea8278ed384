"""WARC archives: writing captures, reading them back, and assembling transactions.

A capture is written as three records: the response (or a revisit, if another record holds the same
payload), the request and a metadata record; the latter two name the first in WARC-Concurrent-To.
Archives are WARC/1.1 files, gzipped unless told otherwise, written by Spark's text writer (a record ends with CR LF CR LF,
which is that writer's line separator) and read by Spark's text reader with the same separator: records are put together from its pieces by their
Content-Length as they stream by, so an archive may be of any size and a task holds one record at a time. Any store that Spark reaches will do.
Payloads cross shuffles compressed.

Of equal payloads (by SHA-1 over the whole payload) of at least ``least`` bytes, the capture with the largest
page_id is the response, and so is every other capture of that page with the payload. Cases: null html is an empty payload; null
urls become ``urn:page:<id>``; rows with a null page_id are left out unless ``nameless``, and then are the response only of a payload that no
page has; rows that repeat a page_id are captures of their own, and equal rows are numbered apart; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batch import packed
from ._runtime import cut, shared_folder

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: At most so many captures go to one archive. Gzipped archives are read by one task each.
FILE_CAPTURES = 5000
#: Bytes of records that are handed on together.
HANDED = 4 << 20
#: Equal rows are numbered in runs of so many, which are dealt out; as many keys of equal rows are broadcast.
RUN = 1000
PARTS = ("response", "request", "metadata")
RECORD = "archive string, record_id string, type string, concurrent_to array<string>, refers_to_id string, target_uri string, digest string, headers map<string,string>, block binary"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(kind: str, name: str, fields: list[tuple[str, str]], block: str) -> str:
    size = len(block.encode("utf-8", "surrogatepass"))
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {size}"]
    return "\r\n".join(lines) + END + block


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, copy, url, packed html, digest as hex, page and copy referred to or null, number among equal rows) to the text of three records."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out, held = [], 0
        for page, copy, url, body, sha, other, again, number in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            html = unpack(body).decode("utf-8", "surrogatepass")
            page, other = ("" if x is None else x for x in (page, other))
            name = f"urn:capture:{page}:{copy}" + (f":{number}" if number else "")
            target = "".join(c for c in (url or "") if c > " ") or f"urn:page:{page}"
            digest = "sha1:" + base32(bytes.fromhex(sha))
            size = len(html.encode("utf-8", "surrogatepass"))
            fields = [("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response")]
            head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {size}" + END
            if again is None:
                first = record("response", f"{name}:response", fields, head + html)
            else:
                profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                first = record("revisit", f"{name}:response", [*fields, ("WARC-Refers-To", f"<urn:capture:{other}:{again}:response>"), ("WARC-Profile", profile)], head)
            link = [("WARC-Target-URI", target), ("WARC-Concurrent-To", f"<{name}:response>")]
            asked = "GET " + target + " HTTP/1.1" + END
            out.append(
                END.join(
                    [
                        record("request", f"{name}:request", [*link, ("Content-Type", "application/http;msgtype=request")], asked),
                        first,
                        record("metadata", f"{name}:metadata", [*link, ("Content-Type", "application/warc-fields")], f"page: {page}\r\npayloadBytes: {size}\r\n"),
                    ]
                )
            )
            held += len(out[-1])
            if held > HANDED:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def numbered(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows with their number, 0 unless other rows equal them: one of equal rows is kept and repeated as often as they are."""
    many = counts.where("many > 1").select(F.col("page_id").alias("_page"), F.col("copy").alias("_copy"), "many")
    size = many.count()
    if not size:
        return rows.withColumn("number", F.lit(0).cast("long"))
    same = rows["page_id"].eqNullSafe(F.col("_page")) & (rows["copy"] == F.col("_copy"))
    rows = rows.join(F.broadcast(many) if size <= RUN else many, same, "left").drop("_page", "_copy")
    keys = ["page_id", "copy"]
    others = [c for c in rows.columns if c not in keys]
    kept = rows.where("many is not null").groupBy(*keys).agg(*(F.first(c).alias(c) for c in others))
    runs = kept.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / RUN)))).repartition(*keys, "run")
    last = F.least(F.col("many") - 1, F.col("run") * RUN + RUN - 1)
    runs = runs.withColumn("number", F.explode(F.sequence(F.col("run") * RUN, last))).drop("run", "many")
    return rows.where("many is null").drop("many").withColumn("number", F.lit(0).cast("long")).unionByName(runs)


def write(pages: DataFrame, path: str, least: int = 0, compression: str = "gzip", nameless: bool = False) -> None:
    """Archives of the captures ``pages(page_id, url, html)`` in the new folder path."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages if nameless else pages.where("page_id is not null")
    p = p.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    digest = F.sha1(F.col("html").cast("binary")).alias("digest")
    p = p.select("page_id", "url", digest, F.xxhash64("url", digest).alias("copy"), F.octet_length("html").alias("n"), "html")
    own = F.struct("page_id", "copy")
    counts = cut(p.groupBy("page_id", "copy", "digest", "n").agg(F.count("*").alias("many")))
    heads = counts.where(F.col("n") >= least).groupBy("digest").agg(F.max(own).alias("head"))
    p = packed(p).join(heads, "digest", "left")
    apart = F.when(F.col("page_id").isNull(), F.col("head") != own).otherwise(F.col("head.page_id") != F.col("page_id"))
    other = lambda c: F.when(F.col("head").isNotNull() & apart, F.col(f"head.{c}"))
    rows = p.select("page_id", "copy", "url", "body", "digest", other("page_id").alias("other"), other("copy").alias("again"))
    rows = numbered(rows, counts).select("page_id", "copy", "url", "body", "digest", "other", "again", "number")
    writer = rows.mapInArrow(records, "value string").write.option("lineSep", END).option("maxRecordsPerFile", FILE_CAPTURES)
    writer.option("compression", compression).text(path)


class Assembly:
    """Records from pieces of archives that were parted at each CR LF CR LF, in order."""

    def __init__(self) -> None:
        self.path: str | None = None
        self.head: list[tuple[str, str]] | None = None  # of the record whose block is being gathered
        self.block, self.size, self.need = [], 0, 0

    def add(self, path: str, piece: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
        """(headers, block) of the records that the piece completes."""
        if path != self.path:
            self.path, self.head = path, None
        while True:
            if self.head is None:
                piece = piece.lstrip(b"\r\n")
                if not piece:
                    return
                if not piece.startswith(b"WARC/"):
                    raise ValueError(f"{path}: no record where one should begin")
                lines = piece.decode("utf-8", "replace").split("\r\n")[1:]
                self.head = [tuple(x.partition(": ")[::2]) for x in lines]
                self.need = next(int(v) for k, v in self.head if k.lower() == "content-length")
                self.block, self.size = [], 0
                if self.need:
                    return
                rest = b""
            else:
                if self.block:
                    piece = END.encode() + piece
                self.block.append(piece)
                self.size += len(piece)
                if self.size < self.need:
                    return
                whole = b"".join(self.block)
                self.block, rest = [whole[: self.need]], whole[self.need :]
            yield self.head, b"".join(self.block)
            self.head, piece = None, rest


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, piece) of archives, whole or parted at the separator, to their records."""
    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = ["archive", "record_id", "type", "concurrent_to", "refers_to_id", "target_uri", "digest", "headers", "block"]
    clean = lambda x: x.strip().strip("<>")
    pack = zstandard.ZstdCompressor(level=1).compress
    assembly, rows, held = Assembly(), [], 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    for batch in batches:
        pieces = batch.column(1).cast(pa.binary())
        for path, piece in zip(batch.column(0), pieces, strict=True):
            path = path.as_py()
            for head, block in (found for x in (piece.as_py() or b"").split(END.encode()) for found in assembly.add(path, x)):
                headers = dict(head)
                of = lambda k: None if k not in headers else clean(headers[k])  # noqa: B023, E731
                digest = headers.get("WARC-Payload-Digest")
                together = [clean(v) for k, v in head if k == "WARC-Concurrent-To"]
                rows.append((path, of("WARC-Record-ID"), headers["WARC-Type"], together, of("WARC-Refers-To"), headers.get("WARC-Target-URI"), digest and digest.partition(":")[2], list(headers.items()), pack(block)))
                held += len(block)
                if held > HANDED or len(rows) >= 5000:
                    yield out()
                    rows, held = [], 0
    if rows:
        yield out()


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the gzipped archives in a folder; block is packed (zstd). Archives that are not gzipped are read as a whole, and must be below 2 GB."""
    stream = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece"))
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,txt}").load(path).select("path", "content")
    return stream.mapInArrow(parsed, RECORD).union(plain.mapInArrow(parsed, RECORD))


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unpacks the blocks in capture_id, response, request, metadata, and adds size and digest of a response's payload."""
    unpack = zstandard.ZstdDecompressor().decompress
    for whole in batches:
        # so many bytes of blocks at a time
        size = sum(np.array([0 if x is None else zstandard.frame_content_size(x) for x in whole.column(1 + i).field("block").to_pylist()], np.int64) for i in range(len(PARTS)))
        lo, ends = 0, np.cumsum(size)
        while lo < whole.num_rows:
            hi = max(lo + 1, min(lo + 500, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HANDED, "right"))))
            batch = whole.slice(lo, hi - lo)
            lo = hi
            columns, found = [batch.column(0)], []
            for c in (batch.column(1 + i) for i in range(len(PARTS))):
                children = dict(zip((f.name for f in c.type), c.flatten(), strict=True))
                children["block"] = pa.array([None if x is None else unpack(x) for x in children["block"].to_pylist()], pa.binary())
                columns.append(pa.StructArray.from_arrays(list(children.values()), list(children), mask=pa.array(~np.asarray(c.is_valid()))))
            response = columns[1]
            for kind, block in zip(response.field("type").to_pylist(), response.field("block").to_pylist(), strict=True):
                at = block.find(b"\r\n\r\n") if kind == "response" else -1
                payload = memoryview(block)[at + 4 :] if at >= 0 else None
                found.append((None, None) if payload is None else (len(payload), base32(hashlib.sha1(payload).digest())))
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())],
                names=["capture_id", *PARTS, "payload_bytes", "payload_digest"],
            )


def transactions(read_records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response (the response or revisit), request, metadata, and payload_bytes and payload_digest as measured on a response's payload.

    A response or revisit is a capture by its own name; requests and metadata join each record that their WARC-Concurrent-To headers name, and of several of a
    kind the first by name is taken. A request whose response is missing still makes a row, with a null response."""
    part = F.struct("record_id", "type", "refers_to_id", "target_uri", "digest", "headers", "block")
    main = F.col("type").isin("response", "revisit")
    keys = F.when(main | (F.size("concurrent_to") == 0), F.array("record_id")).otherwise(F.array_distinct("concurrent_to"))
    first = lambda where: F.min_by(F.when(where, part), F.when(where, F.col("record_id")))
    rows = read_records.where(F.col("type").isin("response", "revisit", "request", "metadata")).withColumn("capture_id", F.explode(keys)).groupBy("capture_id").agg(
        first(main).alias("response"), first(F.col("type") == "request").alias("request"), first(F.col("type") == "metadata").alias("metadata")
    )
    return rows.mapInArrow(opened, f"{rows.schema.simpleString()[7:-1]},payload_bytes:bigint,payload_digest:string")


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 0, nameless: bool = False) -> DataFrame:
    """Writes pages as archives, reads them back and gives one nested row per capture, with page_id, payload_bytes, payload_digest, record_type and refers_to."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    write(pages, folder, least, nameless=nameless)
    rows = transactions(read(spark, folder))
    page = lambda c: F.nullif(F.regexp_extract(c, r"^urn:capture:(-?\d*):", 1), F.lit("")).cast("long")
    told = F.regexp_extract(F.col("metadata.block").cast("string"), r"payloadBytes: (\d+)", 1).cast("long")
    whole = F.col("response.type") == "response"
    return rows.select(
        page("capture_id").alias("page_id"),
        F.when(whole, F.col("payload_bytes")).otherwise(told).alias("payload_bytes"),
        F.when(whole, F.col("payload_digest")).otherwise(F.col("response.digest")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(~whole, page("response.refers_to_id")).alias("refers_to"),
        F.struct("capture_id", "response", "request", "metadata").alias("capture"),
    )
