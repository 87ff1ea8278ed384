"""Hard and soft cleaning of listing rows. Every dropped row keeps its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import filled, freshness, have, number


def drop_reason() -> Column:
    """The first rule that a row fails, or null."""
    price, square = number(F.col("price")), number(F.col("square_m2"))
    storage = F.lower(F.trim(F.col("storage").cast("string")))
    bad = lambda c: c.isNull() | ~((c > 0) | F.isnan(c))
    return (
        F.when(bad(price), "no_valid_price")
        .when(bad(square), "no_valid_square")
        .when(filled(F.col("rooms")).isNull(), "no_rooms")
        .when((storage != "") & (storage != "live"), F.concat(F.lit("not_live (storage="), storage, F.lit(")")))
    )


def freshest(df: DataFrame, key: Column, order: list[Column], times: tuple[str, ...]) -> DataFrame:
    """df with _rank: 1 for the freshest row of each key; rows without a time come last, ties by order."""
    window = Window.partitionBy(key).orderBy(freshness(*times).desc_nulls_last(), *order)
    return df.withColumn("_rank", F.row_number().over(window))


def hard_clean(df: DataFrame, order: list[str]) -> DataFrame:
    """df with drop_stage and drop_reason (null where kept). The freshest row of each id is judged; staler ones are duplicates, valid or not."""
    df = have(df, "id", "price", "square_m2", "rooms", "storage", "scraped_at", "added_at")
    ranked = freshest(df, F.coalesce(F.trim(F.col("id").cast("string")), F.lit("")), [F.col(c) for c in order], ("scraped_at", "added_at"))
    reason = F.when(F.col("_rank") > 1, "duplicate_id").otherwise(drop_reason())
    return ranked.withColumn("drop_reason", reason).withColumn("drop_stage", F.when(F.col("drop_reason").isNotNull(), "stage1")).withColumn("is_installment_segment", F.lit(False)).drop("_rank")


def split(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and dropped rows with stage and reason."""
    return tagged.where("drop_reason is null").drop("drop_reason", "drop_stage"), tagged.where("drop_reason is not null")


def drop_counts(tagged: DataFrame) -> DataFrame:
    """Rows by reason, with what stands in brackets left out."""
    return tagged.groupBy(F.coalesce(F.regexp_extract("drop_reason", r"^\w+", 0), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def incoming_warnings(price: Column, square: Column) -> Column:
    storage = F.lower(F.trim(F.coalesce(F.col("storage").cast("string"), F.lit(""))))
    low = lambda c: c.isNull() | (c <= 0)
    return F.array_compact(
        F.array(
            F.when(filled(F.col("id")).isNull(), "missing_id"),
            F.when(low(price), "invalid_or_missing_price"),
            F.when(low(square), "invalid_or_missing_square"),
            F.when(filled(F.col("rooms")).isNull(), "missing_rooms"),
            F.when((storage != "") & (storage != "live"), F.concat(F.lit("not_live_storage:"), storage)),
            F.when(filled(F.col("full_description")).isNull(), "no_description"),
            F.when(filled(F.col("photo_count")).isNull(), "photo_count_unknown"),
        )
    )


def soft_clean(df: DataFrame, order: list[str]) -> DataFrame:
    """The freshest row of each trimmed id (all blank ids are one), with normalised numbers and incoming_data_warnings; nothing else is dropped."""
    df = have(df, "id", "price", "new_price", "square_m2", "rooms", "storage", "full_description", "photo_count", "scraped_at", "added_at", "updated_at")
    ranked = freshest(df, F.coalesce(F.trim(F.col("id").cast("string")), F.lit("")), [F.col(c) for c in order], ("scraped_at", "added_at", "updated_at"))
    raw = F.coalesce(F.when(F.col("price").cast("string") != "", F.col("price").cast("string")), F.col("new_price").cast("string"))
    price, square = number(raw, locale=True), number(F.col("square_m2"), locale=True)
    return (
        ranked.where("_rank = 1").drop("_rank")
        .withColumn("incoming_data_warnings", F.to_json(incoming_warnings(price, square)))
        .withColumn("price", F.coalesce(price.cast("string"), F.col("price").cast("string")))
        .withColumn("square_m2", F.coalesce(square.cast("string"), F.col("square_m2").cast("string")))
        .withColumn("incoming_requires_manual_review", F.lit(False))
    )
