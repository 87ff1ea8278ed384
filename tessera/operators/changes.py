"""What changed between snapshots: new ids, price drops, upserts, overlays, replaced state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import filled, number


def last_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each non-blank key, by order."""
    row = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")
    return df.where(filled(F.col(key)).isNotNull()).groupBy(F.col(key).alias("_k")).agg(row).select("r.*")


def window_of(pages: DataFrame, most_pages: int, page: str = "page_number", key: str = "id") -> DataFrame:
    """The bounded scan window: pages up to a number, a later page's row for an id replacing an earlier one's."""
    return last_by(pages.where(F.col(page) <= most_pages), key, [page])


def new_ids(current: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is not known."""
    return current.join(known.select(key).distinct(), key, "left_anti")


def price_drops(current: DataFrame, known: DataFrame, key: str = "id", detected_at: Column | None = None) -> DataFrame:
    """Rows with a known price above the present one: old_price, new_price, price_drop. known: one row per id."""
    old = known.select(F.col(key), number(F.col("price")).alias("old_price"))
    rows = current.withColumn("new_price", number(F.col("price"))).join(old, key).where("new_price < old_price")
    rows = rows.withColumn("price_drop", F.col("old_price") - F.col("new_price"))
    return rows if detected_at is None else rows.withColumn("detected_at", detected_at)


def changes(current: DataFrame, known: DataFrame, key: str = "id", warm_up: bool = False) -> DataFrame:
    """New ids and price drops of a window against the state, with reason and old_price. warm_up, or an empty state: nothing."""
    new = new_ids(current, known, key).withColumn("reason", F.lit("new")).withColumn("old_price", F.lit(None).cast("double"))
    drop = price_drops(current, known, key).drop("new_price", "price_drop").withColumn("reason", F.lit("price_drop"))
    found = new.unionByName(drop)
    if warm_up:
        return found.limit(0)
    return found.join(F.broadcast(known.limit(1).select(F.lit(1).alias("_any"))), how="cross").drop("_any")


def with_details(found: DataFrame, details: DataFrame, key: str = "id") -> DataFrame:
    """The details of changed ids, with the reason and old price of the change. An id whose page was not had is left out."""
    return details.join(found.select(key, "reason", "old_price"), key)


def split_known(listed: DataFrame, details: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Listed rows with details, and without."""
    have = details.select(key).distinct()
    return listed.join(have, key, "left_semi"), listed.join(have, key, "left_anti")


def upsert(details: DataFrame, listed: DataFrame, fetched: DataFrame, key: str = "id", patched: tuple[str, ...] = ("price", "scraped_at")) -> DataFrame:
    """details with the patched columns from listed rows that have a price; fetched rows of unknown ids are added; nothing is removed. One row per id in each."""
    cells = listed.where(filled(F.col("price")).isNotNull()).select(key, *(F.col(c).alias(f"_{c}") for c in patched), F.lit(True).alias("_hit"))
    rows = details.join(cells, key, "left").withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}").cast(dict(details.dtypes)[c])).otherwise(F.col(c)) for c in patched})
    return rows.select(*details.columns).unionByName(new_ids(fetched, details, key).select(*details.columns))


def overlay(rows: DataFrame, details: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """rows over the last details of their id: a filled cell of the row wins. Columns are those of both."""
    latest = last_by(details, key, order)
    shared = [c for c in rows.columns if c != key and c in details.columns]
    extra = [c for c in details.columns if c not in rows.columns]
    base = latest.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in shared), *extra)
    kind = dict(rows.dtypes)
    cell = lambda c: F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), F.col(f"_{c}").cast(kind[c]), F.col(c)).alias(c)
    return rows.join(base, key, "left").select(*(cell(c) if c in shared else F.col(c) for c in rows.columns), *extra)
