"""Writing snapshots, states, journals and messages."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import JOURNAL
from ..operators.cleaning import split
from .tables import exists


def swapped(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Writes a new folder beside path and puts it in its place by renaming, so that a failed write leaves the old one whole, also where it is read from.

    A reader sees the old folder, then for the length of two renames none, then the new one."""
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    mark = jvm.java.util.UUID.randomUUID().toString()
    new, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
    try:
        write(new)
        had = fs.exists(at(path))
        if had and not fs.rename(at(path), at(old)):
            raise OSError(f"{path} cannot be moved")
        if not fs.rename(at(new), at(path)):
            if had:
                fs.rename(at(old), at(path))
            raise OSError(f"{new} cannot be moved to {path}")
        if had:
            fs.delete(at(old), True)
    finally:
        if fs.exists(at(new)):
            fs.delete(at(new), True)


def snapshot(df: DataFrame, path: str) -> None:
    """Replaces a CSV folder as a whole; an empty one still has its header."""
    rows = df if df.take(1) else df.coalesce(1)
    swapped(df.sparkSession, path, lambda to: rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(to))


def state(df: DataFrame, path: str) -> None:
    """Replaces a keyed state, kept as Parquet, as a whole."""
    swapped(df.sparkSession, path, lambda to: df.write.parquet(to))


def append_csv(df: DataFrame, path: str) -> None:
    """Adds rows to a CSV folder; each file has the header. An empty df leaves a header where there is nothing yet."""
    if df.take(1) or not exists(df.sparkSession, path):
        df.coalesce(1).write.mode("append").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def journal(df: DataFrame, path: str, batch: int | None = None) -> None:
    """Appends journal rows; none, none is written. The columns must be the journal's. batch: written once, whatever retries."""
    if df.columns != JOURNAL:
        raise ValueError(f"a journal row has the columns {JOURNAL}, not {df.columns}")
    if batch is not None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    elif df.take(1):
        df.write.mode("append").parquet(path)


def kept_and_dropped(tagged: DataFrame, kept_path: str, dropped_path: str) -> None:
    kept, dropped = split(tagged)
    snapshot(kept, kept_path)
    snapshot(dropped, dropped_path)


def once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; built only if it is not there."""
    if not exists(spark, path):
        build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def send(messages: DataFrame, post: Callable[[str], None] | None, attempts: int = 3, backoff: float = 2.0, gap: float = 1.2) -> int:
    """Posts texts one by one, best effort; returns how many went. Off without post. Texts reach the driver one partition at a time."""
    if post is None:
        return 0
    sent = 0
    for row in messages.toLocalIterator():
        for i in range(attempts):
            try:
                post(row[0])
                sent += 1
                break
            except Exception:  # noqa: BLE001  a lost message must not stop the rest
                time.sleep(backoff * (i + 1))
        time.sleep(gap)
    return sent
