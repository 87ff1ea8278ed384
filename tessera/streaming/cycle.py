"""Periodic work as streaming queries: snapshot changes, the scoring batch, triggers and supervision."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.runtime import cut
from ..operators import cleaning, notify
from ..operators.changes import changes, overlay, price_drops, split_known, upsert, with_details
from ..operators.dedup import registry_after, unsent
from ..operators.extraction import RESULT, analyse
from ..operators.scoring import checked_pool, export, score
from ..sources import sinks
from ..sources.pages import detail_rows, fetch
from ..sources.tables import DETAIL, exists

log = logging.getLogger(__name__)


def newest(spark: SparkSession, folder: str, below: int) -> int | None:
    """The greatest number below a given one that names a folder in folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not exists(spark, folder):
        return None
    names = [x.getPath().getName() for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return max((int(n) for n in names if n.isdigit() and int(n) < below), default=None)


def snapshot_changes(folder: str, key: str = "id") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows (snapshot, id, price, ...), each snapshot a whole window. Writes what is new or cheaper than the last snapshot before, whatever its number.

    The state is replaced by each snapshot, so an id that was away is new again; the first snapshot only makes the state.
    States and outputs carry the batch and snapshot in their path, so a repeated batch writes the same again."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        for s in sorted(r[0] for r in batch.select("snapshot").distinct().collect()):
            now = batch.where(F.col("snapshot") == s)
            before = newest(spark, f"{folder}/state", s)
            if before is not None:
                found = changes(now, spark.read.parquet(f"{folder}/state/{before}"), key)
                found.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}/part={s}")
            sinks.state(now, f"{folder}/state/{s}")

    return run


def process(incoming: DataFrame, source: str, reason: str, details: DataFrame | None, pool: DataFrame, registry: DataFrame | None, order: list[str], now: str, cache: DataFrame | None = None, extractor=None):
    """One batch: overlay details, clean softly, extract, score, keep what may be sent and has not been. Returns (rows to send, journal rows, registry after, cache after)."""
    rows = notify.candidates(incoming, source, reason)
    if details is not None:
        rows = overlay(rows, details, order)
    rows = cleaning.soft_clean(rows.where(notify.sane()), order)
    if extractor is not None:
        rows, cache = analyse(rows, cache, extractor)
    scored = export(score(rows, checked_pool(pool)))
    eligible = scored.where(notify.sendable())
    # read for the journal, the registry and the caller
    to_send = cut(unsent(eligible, registry, order))
    return to_send, notify.journal_rows(to_send, F.lit(now)), registry_after(registry, to_send, F.lit(now)), cache


def outbox(folder: str, post=None, **fixed) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: process(), then journal, cache, registry and messages in that order, so a failure may repeat a journal batch (it is overwritten) but never a message.

    The registry and, with an extractor, the cache of a batch are those of the last batch before it, whatever its number."""

    def run(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        before = newest(spark, f"{folder}/registry", number)
        registry = None if before is None else spark.read.parquet(f"{folder}/registry/{before}")
        last = newest(spark, f"{folder}/cache", number)
        known = {**fixed} if last is None else {**fixed, "cache": spark.read.parquet(f"{folder}/cache/{last}")}
        if known.get("extractor") is not None and known.get("cache") is None:
            known["cache"] = spark.createDataFrame([], f"cache_key string, text_hash string, result {RESULT}")
        _, rows, after, cache = process(batch, registry=registry, **known)
        rows = rows.persist()
        try:
            sinks.journal(rows, f"{folder}/journal", batch=number)
            if known.get("extractor") is not None:
                sinks.state(cache, f"{folder}/cache/{number}")
            sinks.state(after, f"{folder}/registry/{number}")
            sinks.send(rows.select(notify.message()), post)
        finally:
            rows.unpersist()

    return run


def fast_job(window: DataFrame, known: DataFrame | None, opener: Callable[[str], str], scraped_at: Column, base_url: str = "", warm_up: bool = False, **how) -> tuple[DataFrame, DataFrame]:
    """One turn of the fast cycle: (rows to process, state after). window: (id, url, price) of the pages scanned; known: the state, none at first.

    Only the pages of new and cheaper ids are fetched, and only those had make rows; the state becomes the window."""
    state = window.select("id", "price")
    if known is None or warm_up:
        return spark_empty(window.sparkSession), state
    found = cut(changes(window, known))
    pages = fetch(found.select("id", "url"), opener, **how).where("html is not null")
    return with_details(found, detail_rows(pages, scraped_at, base_url)), state


def spark_empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in DETAIL) + ", reason string, old_price double")


def slow_job(listed: DataFrame, details: DataFrame, known: DataFrame | None, opener: Callable[[str], str], scraped_at: Column, base_url: str = "", **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One turn of the slow cycle: (price drops to process, details after, state after). listed: the whole list as (id, url, price, scraped_at).

    Pages are fetched for ids without details only; the others have their price patched from the list. Drops are those of the list against the state."""
    _, unknown = split_known(listed, details)
    got = fetch(unknown.select("id", "url"), opener, **how).where("html is not null")
    after = cut(upsert(details, listed, detail_rows(got, scraped_at, base_url).select(*details.columns)))
    state = listed.select("id", "price")
    drops = price_drops(listed, known) if known is not None else price_drops(listed, state).limit(0)
    return drops.withColumn("reason", F.lit("price_drop")), after, state


def unless_failed(worker: Callable[[], object], job: Callable[[object], object]) -> object | None:
    """job(what the worker made); nothing is processed if the worker fails, least of all what an earlier turn left behind."""
    try:
        made = worker()
    except Exception:
        log.exception("the worker failed; its batch is not processed")
        return None
    return job(made)


def every(writer: DataStreamWriter, seconds: int) -> DataStreamWriter:
    """At a fixed rate, first at once; slots missed by a long batch are skipped."""
    return writer.trigger(processingTime=f"{seconds} seconds")


def supervised(start: Callable[[], object], seconds: float, restarts: int | None = None) -> None:
    """Starts a query again, after a pause, whenever it fails."""
    n = 0
    while True:
        try:
            start().awaitTermination()
            return
        except Exception:
            n += 1
            if restarts is not None and n > restarts:
                raise
            time.sleep(seconds)
