"""Duplicate listings: by photos, by address and layout, and against what has been sent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import filled, freshness, have, number
from ..functions.vocabulary import AREA_TOLERANCE, OTHER_SELLER, PRICE_TOLERANCE


def seller_key() -> Column:
    part = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    return F.concat(part("owner_name"), F.lit("\u0001"), part("seller_type"))


def differs(price_a: Column, seller_a: Column, price_b: Column, seller_b: Column) -> Column:
    """Whether two rows with one photo set or address are different listings: prices over 3 % apart and another seller."""
    apart = F.abs(price_a - price_b) / F.greatest(price_a, price_b) > PRICE_TOLERANCE
    return F.coalesce((price_a > 0) & (price_b > 0) & apart & (seller_a != seller_b), F.lit(False))


class Survivors:
    """The survivors of one group, as far as later rows can tell: the lowest and highest price, and those of another seller.

    A row differs from some survivor if it differs from one of these, so the state does not grow with the group."""

    def __init__(self) -> None:
        self.ends: list[list[tuple[float, str]]] = [[], []]
        self.any = False

    def different(self, price: float, seller: str) -> bool:
        if not price > 0:
            return False
        return any(s != seller and abs(price - p) / max(price, p) > PRICE_TOLERANCE for end in self.ends for p, s in end)

    def add(self, price: float, seller: str) -> None:
        self.any = True
        if not price > 0:
            return
        for sign, end in zip((1, -1), self.ends, strict=True):
            best: dict[str, float] = {}
            for p, s in [*end, (price, seller)]:
                best[s] = p if s not in best else sign * min(sign * best[s], sign * p)
            end[:] = sorted(((p, s) for s, p in best.items()), key=lambda x: sign * x[0])[:2]


def fold(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """df with _state: 'kept', 'flagged' or 'dropped', for rows whose group columns are not null; in order, a row stays if it differs from some row that stayed.

    Rows stream through each task in order of their group, so a group of any size takes constant memory."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_price", F.coalesce(number(F.col("price")), F.lit(0.0))).withColumn("_seller", seller_key())
    rows = rows.withColumn("_group", F.to_json(F.struct(*group))).repartition(n, "_group").sortWithinPartitions("_group", *order)
    schema = f"{df.schema.simpleString()[7:-1]},_state:string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, Survivors()
        for batch in batches:
            out = []
            for g, price, seller in zip(batch["_group"], batch["_price"], batch["_seller"], strict=True):
                if g != last:
                    last, state = g, Survivors()
                if not state.any:
                    out.append("kept")
                elif state.different(price, seller):
                    out.append("flagged")
                else:
                    out.append("dropped")
                    continue
                state.add(price, seller)
            yield batch.drop(columns=["_price", "_seller", "_group"]).assign(_state=out)

    return rows.mapInPandas(run, schema)


def _tagged(folded: DataFrame, untouched: DataFrame, reason: Column, stage: str) -> DataFrame:
    state = F.col("_state")
    rows = folded.withColumn("baseline_warning", F.when(state == "flagged", OTHER_SELLER).otherwise(F.col("baseline_warning")))
    rows = rows.withColumn("drop_reason", F.when(state == "dropped", reason)).withColumn("drop_stage", F.when(state == "dropped", stage)).drop("_state")
    rest = untouched.withColumn("drop_reason", F.lit(None).cast("string")).withColumn("drop_stage", F.lit(None).cast("string"))
    return rows.unionByName(rest)


_NEEDS = ("price", "owner_name", "seller_type", "scraped_at", "added_at", "baseline_warning")


def by_photos(df: DataFrame, order: list[str]) -> DataFrame:
    """df with drop_stage, drop_reason and baseline_warning. Rows without a photo hash are left alone."""
    df = have(df, "photo_set_hash", *_NEEDS)
    has = filled(F.col("photo_set_hash")).isNotNull()
    rows = df.where(has).withColumn("_key", F.trim("photo_set_hash"))
    folded = fold(rows, ["_key"], [freshness("scraped_at", "added_at").desc_nulls_last(), *(F.col(c) for c in order)]).drop("_key")
    return _tagged(folded, df.where(~has), F.lit("duplicate_photo_set_hash"), "photo_dedup")


def area_clusters(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _key (street, house, floor, rooms) and _cluster: areas in a row whose gaps are within the tolerance. Null for rows that are left alone."""
    part = lambda c, low=True: (F.lower if low else lambda x: x)(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    area = number(F.col("square_m2"))
    has = (part("street") != "") & (part("house_num") != "") & area.isNotNull()
    rows = df.withColumn("_area", area).withColumn("_key", F.when(has, F.struct(part("street").alias("street"), part("house_num").alias("house"), part("floor", False).alias("floor"), part("rooms", False).alias("rooms"))))
    window = Window.partitionBy("_key").orderBy("_area", *order)
    gap = F.coalesce(((F.col("_area") - F.lag("_area").over(window)) > AREA_TOLERANCE).cast("int"), F.lit(0))
    found = rows.where("_key is not null").withColumn("_gap", gap)
    found = found.withColumn("_cluster", F.sum("_gap").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")
    return found.unionByName(rows.where("_key is null").withColumn("_cluster", F.lit(None).cast("long")))


def by_address(df: DataFrame, order: list[str]) -> DataFrame:
    """df with drop_stage, drop_reason and baseline_warning. Rows without a street, house or area are left alone."""
    df = have(df, "street", "house_num", "floor", "rooms", "square_m2", *_NEEDS)
    rows = area_clusters(df, order)
    found = rows.where("_key is not null")
    folded = fold(found, ["_key", "_cluster"], [freshness("scraped_at", "added_at").desc_nulls_last(), F.col("_area"), *(F.col(c) for c in order)])
    # the key's parts in quotes, as the log has them
    reason = F.concat(
        F.lit("duplicate_address_layout (street='"), F.col("_key.street"), F.lit("', house='"), F.col("_key.house"), F.lit("', floor='"), F.col("_key.floor"),
        F.lit("', rooms='"), F.col("_key.rooms"), F.lit(f"', square within {AREA_TOLERANCE}m2)"),
    )
    return _tagged(folded, rows.where("_key is null"), reason, "address_layout_dedup").drop("_key", "_cluster", "_area")


def unsent(candidates: DataFrame, registry: DataFrame | None, order: list[str]) -> DataFrame:
    """Candidates (id, price, ...) to send: the id is new, or the price is below the last one sent, within the batch too.

    The last price sent is the least so far, so a running minimum decides. registry: (id, price)."""
    rows = candidates.withColumn("_price", number(F.col("price"))).where(filled(F.col("id")).isNotNull() & F.col("_price").isNotNull())
    window = Window.partitionBy("id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.min("_price").over(window))
    if registry is None:
        known = F.col("_before")
    else:
        rows = rows.join(registry.groupBy(F.col("id").alias("_id")).agg(F.min(number(F.col("price"))).alias("_sent")), F.col("id") == F.col("_id"), "left")
        known = F.least("_sent", "_before")
    return rows.where(known.isNull() | (F.col("_price") < known)).drop("_price", "_before", "_id", "_sent")


def registry_after(registry: DataFrame | None, sent: DataFrame, now: Column) -> DataFrame:
    """(id, price, reason, sent_at) after sending: the lowest price of each id."""
    new = have(sent, "reason").select("id", number(F.col("price")).alias("price"), "reason", now.cast("string").alias("sent_at"))
    every = new if registry is None else registry.select("id", number(F.col("price")).alias("price"), "reason", "sent_at").unionByName(new)
    best = F.min_by(F.struct("price", "reason", "sent_at"), F.col("price")).alias("b")
    return every.groupBy("id").agg(best).select("id", "b.price", "b.reason", "b.sent_at")
