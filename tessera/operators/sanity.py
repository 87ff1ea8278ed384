"""Integrity and outlier filters; each adds drop_stage and drop_reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exclusive_quartiles, number
from ..functions.vocabulary import AREA_BOUNDS, LEAST_OUTLIER_GROUP, OUTLIER_FACTOR, PRICE_M2_BOUNDS
from .ranks import ranked


def _drop(df: DataFrame, reason: Column, stage: str) -> DataFrame:
    return df.withColumn("drop_reason", reason).withColumn("drop_stage", F.when(F.col("drop_reason").isNotNull(), stage))


def floor_integrity(df: DataFrame) -> DataFrame:
    """Drops floors above the building; a null on either side is kept."""
    floor, total = number(F.col("floor")), number(F.col("floor_total"))
    return _drop(df, F.when(floor > total, F.concat(F.lit("floor_gt_floor_total ("), floor, F.lit(">"), total, F.lit(")"))), "floor_integrity")


def bounds_reason(value: Column, low: float, high: float, label: str) -> Column:
    note = lambda what: F.concat(F.lit(f"{label}_{what} ("), value.cast("string"), F.lit(")"))
    return F.when(value.isNull(), f"no_valid_{label}_for_sanity_check").when(value < low, note("too_low_hard")).when(value > high, note("too_high_hard"))


def hard_bounds(df: DataFrame, value: Column, low: float, high: float, label: str, stage: str) -> DataFrame:
    return _drop(df, bounds_reason(value, low, high, label), stage)


def fences(df: DataFrame, value: Column, group: Column, factor: float = OUTLIER_FACTOR, least: int = LEAST_OUTLIER_GROUP) -> DataFrame:
    """(grp, n, q1, q3, low, high) of groups with at least ``least`` values, quartiles by the exclusive method."""
    below = lambda i, n: F.greatest(F.lit(1), F.least(n - 1, F.floor(F.lit(i) * (n + 1) / 4)))  # noqa: E731  a rank from 1
    rows = df.select(group.alias("grp"), value.cast("double").alias("v"))
    found = ranked(rows, ["grp"], "v", lambda n: {f"_{i}{k}": F.least(below(i, n) + k, n) - 1 for i in (1, 3) for k in range(2)})

    def quartile(i: int) -> Column:
        delta = F.lit(i) * (F.col("n") + 1) - below(i, F.col("n")) * 4
        return (F.col(f"_{i}0") * (4 - delta) + F.col(f"_{i}1") * delta) / 4

    out = found.where(F.col("n") >= least).select("grp", "n", quartile(1).alias("q1"), quartile(3).alias("q3"))
    spread = (F.col("q3") - F.col("q1")) * factor
    return out.withColumn("low", F.col("q1") - spread).withColumn("high", F.col("q3") + spread)


def outliers(df: DataFrame, value: Column, group: Column, label: str, stage: str) -> DataFrame:
    """Drops values strictly outside the fences of their group; small groups are untouched."""
    rows = df.withColumn("_v", value).withColumn("_g", group)
    rows = rows.join(fences(df, value, group).select(F.col("grp").alias("_g"), "low", "high"), "_g", "left")
    outside = (F.col("_v") < F.col("low")) | (F.col("_v") > F.col("high"))
    reason = F.when(outside, F.concat(F.lit(f"{label}_outlier_iqr ("), F.col("_v").cast("string"), F.lit(")")))
    return _drop(rows, reason, stage).drop("_v", "_g", "low", "high")


def price_m2_value() -> Column:
    """price_m2 if it is a number at all, else price by area where both are non-zero."""
    price, area = number(F.col("price")), number(F.col("square_m2"))
    return F.coalesce(number(F.col("price_m2")), F.when((price != 0) & (area != 0), price / area))


PRICE = (price_m2_value, *PRICE_M2_BOUNDS, "price_m2", "price_sanity")
AREA = (lambda: number(F.col("square_m2")), *AREA_BOUNDS, "square_m2", "square_sanity")

__all__ = ["AREA", "PRICE", "exclusive_quartiles", "fences", "floor_integrity", "hard_bounds", "outliers", "price_m2_value"]
