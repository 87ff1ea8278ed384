"""Long scans of a site that can be taken up again: list pages, detail pages, progress, and the openers they use."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import last_by
from .pages import cards, detail_rows, fetch, page_count
from .sinks import swapped
from .tables import DETAIL, exists


def http_get(timeout: float = 20.0, headers: dict[str, str] | None = None) -> Callable[[str], str]:
    """An opener for fetch(): the page at a url as text. A status of 400 or more is a failure."""

    def opener(url: str) -> str:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as answer:  # noqa: S310  the caller names the urls
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")

    return opener


def progress(spark: SparkSession, path: str) -> dict:
    """The progress kept at path; nothing if it is missing or broken."""
    try:
        found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    except Exception:  # noqa: BLE001  whatever is wrong with it, the scan starts anew
        return {}
    return found if isinstance(found, dict) else {}


def save_progress(spark: SparkSession, path: str, found: dict) -> None:
    swapped(spark, path, lambda to: spark.createDataFrame([(json.dumps(found, ensure_ascii=False),)], "value string").coalesce(1).write.text(to))


def _begun(spark: SparkSession, folder: str, fresh: dict) -> dict:
    """The progress of an unfinished run in folder, or a fresh one in an emptied folder."""
    found = progress(spark, f"{folder}/progress")
    if found.get("run_finished", True):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        found = {"run_finished": False, **fresh}
        save_progress(spark, f"{folder}/progress", found)
    return found


def list_scan(spark: SparkSession, folder: str, url: Callable[[int], str], opener: Callable[[str], str], most_pages: int | None = None, block: int = 50, base_url: str = "", **how) -> DataFrame:
    """The whole list as a snapshot: id, url, price, page_number, a later page's row for an id replacing an earlier one's.

    Pages are fetched in blocks; after each, its cards and the last completed page are kept in folder, so a run that broke off goes on from there, while
    one that ended is followed by a new one from the first page. Pages that fail are left out. Without even the first page there are no rows."""
    request = lambda numbers: spark.createDataFrame([(str(n), url(n)) for n in numbers], "id string, url string")
    state = _begun(spark, folder, {"last_completed_page": 0, "pages": None})
    empty = spark.createDataFrame([], "id string, url string, price long, page_number long")
    if state.get("pages") is None:
        first = fetch(request([1]), opener, **how).select("html", page_count(F.col("html")).alias("n")).first()
        if first is None or first[0] is None:
            return empty
        state["pages"] = min(first[1], most_pages) if most_pages else first[1]
    while state["last_completed_page"] < state["pages"]:
        lo = state["last_completed_page"] + 1
        hi = min(lo + block - 1, state["pages"])
        got = fetch(request(range(lo, hi + 1)), opener, **how).where("html is not null")
        found = cards(got.select(F.col("id").cast("long").alias("page_number"), "html"), base_url)
        found.write.mode("overwrite").parquet(f"{folder}/cards/block={lo}")
        state["last_completed_page"] = hi
        save_progress(spark, f"{folder}/progress", state)
    rows = spark.read.schema(empty.schema).option("recursiveFileLookup", True).parquet(f"{folder}/cards") if exists(spark, f"{folder}/cards") else empty
    state["run_finished"] = True
    save_progress(spark, f"{folder}/progress", state)
    return last_by(rows, "id", ["page_number"])


def detail_scan(spark: SparkSession, folder: str, todo: DataFrame, opener: Callable[[str], str], scraped_at: Column, block: int = 1000, base_url: str = "", **how) -> DataFrame:
    """The detail rows of todo(id, url). Ids are fetched in blocks of a run that can be taken up again: done ones are not fetched twice; those that fail are left out."""
    state = _begun(spark, folder, {"blocks": 0})
    schema = ", ".join(f"{c} string" for c in DETAIL)
    path = f"{folder}/rows"
    rows = lambda: spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    tried = f"{folder}/tried"
    while True:
        left = todo.select("id", "url")
        if exists(spark, tried):
            left = left.join(spark.read.schema("id string, url string").option("recursiveFileLookup", True).parquet(tried), "id", "left_anti")
        part = left.dropDuplicates(["id"]).orderBy("id").limit(block).persist()
        try:
            if not part.take(1):
                break
            number = state["blocks"] = state["blocks"] + 1
            got = fetch(part, opener, **how).where("html is not null")
            detail_rows(got, scraped_at, base_url).write.mode("overwrite").parquet(f"{path}/block={number}")
            part.write.mode("overwrite").parquet(f"{tried}/block={number}")
        finally:
            part.unpersist()
        save_progress(spark, f"{folder}/progress", state)
    state["run_finished"] = True
    save_progress(spark, f"{folder}/progress", state)
    return rows()


class Breaker:
    """An opener that, after so many failures in a row, waits before its next call, as a site that refuses all is not to be pressed.

    It counts within one worker process; with a single request at a time (``requests.coalesce(1)``) that is all of them."""

    def __init__(self, opener: Callable[[str], str], failures: int = 8, cooldown: float = 180.0, sleep: Callable[[float], None] = time.sleep):
        self.opener, self.failures, self.cooldown, self.sleep = opener, failures, cooldown, sleep
        self.in_a_row, self.open = 0, False

    def __call__(self, url: str) -> str:
        if self.open:
            self.open = False
            self.sleep(self.cooldown)
        try:
            page = self.opener(url)
        except Exception:
            self.in_a_row += 1
            if self.in_a_row >= self.failures:
                self.in_a_row, self.open = 0, True
            raise
        self.in_a_row = 0
        return page
