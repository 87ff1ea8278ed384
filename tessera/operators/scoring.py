"""Scores and verdicts of targets against a pool."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.columns import clamp, decimal_round, percent, truth
from ..functions.runtime import cut
from .cohort import STATS, floor_factor, in_pool, ladder, statistics, target_segments, with_segments
from .features import enrich, quality_score, warnings


def to_places(c: Column, places: int) -> Column:
    """Rounds half up, in plain arithmetic that is the same in every engine."""
    return F.floor(c * 10**places + 0.5) / 10**places


def cohort_confidence(level: Column, size: Column) -> Column:
    weight = F.coalesce(*(F.when(level == k, F.lit(w)) for k, w in V.LEVEL_WEIGHT.items()), F.lit(0.25))
    return to_places(clamp(0.35 * F.least(F.lit(1.0), F.log1p(F.greatest(size, F.lit(0)).cast("double")) / math.log1p(30)) + 0.65 * weight, 0, 1), 3)


def data_confidence(found: Column) -> Column:
    counted = F.size(F.array_except(found, F.array(F.lit("риелтор_или_агентство"), F.lit("продавец_не_определён"))))
    core = F.size(F.array_intersect(found, F.array(F.lit("нет_price_m2"), F.lit("нет_rooms"))))
    return clamp(1.0 - 0.10 * counted - 0.25 * core, 0, 1)


def combined_confidence(benchmark: Column, data: Column) -> Column:
    return to_places(0.72 * benchmark + 0.28 * data, 3)


def value_score(diff: Column) -> Column:
    return clamp(50 + 500 * diff, 0, 100)


def composite(diff: Column, quality: Column, benchmark: Column, data: Column) -> Column:
    """65 % price advantage, 25 % evidence of quality, 10 % confidence."""
    return clamp(0.65 * value_score(diff) + 0.25 * quality + 0.10 * (100 * (0.72 * benchmark + 0.28 * data)), 0, 100)


def label(diff: Column, quality: Column, found: Column) -> Column:
    base = F.when((diff >= 0.10) & (quality >= 55), "сильное цена/качество").when(diff >= 0.05, "хорошее цена/качество").when(diff <= -0.10, "слабое цена/качество").otherwise("обычное цена/качество")
    photos = F.when(F.arrays_overlap(found, F.array(F.lit("нет_фото"), F.lit("мало_фото"))), "; качество не подтверждено фото").otherwise("")
    finish = F.when(F.array_contains(found, "finish_type_неизвестен"), "; состояние не подтверждено текстом").otherwise("")
    return F.when(diff.isNull(), "нет оценки").otherwise(F.concat(base, photos, finish))


def verdict(diff: Column, confidence: Column, review: Column) -> Column:
    """The verdict by the thresholds of the confidence."""
    find = F.coalesce(*(F.when(confidence >= c, F.lit(f)) for c, f, _ in V.THRESHOLDS))
    over = F.coalesce(*(F.when(confidence >= c, F.lit(o)) for c, _, o in V.THRESHOLDS))
    return F.when(diff.isNull(), V.TOO_LITTLE).when(review, V.BY_HAND).when(diff >= find, V.FIND).when(diff <= over, V.OVERPRICED).otherwise(V.FAIR)


def verdict_reason(found: Column, diff: Column) -> Column:
    """The reason in words; percentages are printed as the exact value rounds (a pandas UDF)."""
    return (
        F.when(diff.isNull(), V.REASON_NO_BASE)
        .when(found == V.BY_HAND, V.REASON_RED_FLAG)
        .when(found == V.FIND, F.concat(F.lit("цена ниже скорректированной базы на "), percent(diff)))
        .when(found == V.OVERPRICED, F.concat(F.lit("цена выше скорректированной базы на "), percent(F.abs(diff))))
        .otherwise(F.concat(F.lit("цена близка к скорректированной базе ("), percent(diff, signed=True), F.lit(")")))
    )


_SIGNATURE = ["_id", "_price_m2", "_rooms", "_finish", "_complex", "street", "_lat", "_lon", "_extreme"]


def prepared(targets: DataFrame, pool: DataFrame, recompute_price_m2: bool = False) -> tuple[DataFrame, DataFrame]:
    """Enriched targets with _tid and _self, and the usable pool with _segment. Both are kept: every level of the ladder reads them."""
    ident = F.coalesce(F.trim(F.col("id").cast("string")), F.lit(""))
    own = ["_id", "street", "_price_m2", "_rooms", "_finish", "_complex", "_lat", "_lon", "_extreme"]
    usable = cut(with_segments(cut(enrich(pool, recompute_price_m2).where("not _excluded").withColumn("_id", ident).select(*own))))
    t = enrich(targets, recompute_price_m2).withColumn("_id", ident)
    t = t.withColumn("_tid", F.md5(F.to_json(F.struct(*_SIGNATURE))))
    inside = usable.select("_id").distinct().withColumn("_self", F.lit(True))
    return cut(t.join(inside, "_id", "left").withColumn("_self", F.coalesce("_self", F.lit(False)))), usable


def checked_pool(pool: DataFrame, least: int = 10) -> DataFrame:
    """The pool, if it has rows, the columns that scoring needs, and enough usable rows; else an error."""
    missing = sorted({"id", "rooms", "square_m2"} - set(pool.columns))
    if missing:
        raise ValueError(f"the reference pool lacks the columns {missing}")
    if not pool.take(1):
        raise ValueError("the reference pool is empty")
    usable = enrich(pool).where("not _excluded").limit(least).count()
    if usable < least:
        raise ValueError(f"only {usable} rows of the reference pool are usable; scoring needs {least}")
    return pool


def score(targets: DataFrame, pool: DataFrame, strict: bool = False, recompute_price_m2: bool = False) -> DataFrame:
    """targets with their scores. Doubles are not rounded but where a rounded value is used on; export() rounds.

    strict: rows that could not be in a pool are not scored."""
    t, usable = prepared(targets, pool, recompute_price_m2)
    kept = t.where("_price_m2 is not null" + (" and not _excluded" if strict else ""))
    one = kept.dropDuplicates(["_tid"])
    found = cut(ladder(one, usable))
    wide = statistics(usable, ["_finish", "_rooms"]).select("_finish", "_rooms", *(F.col(c).alias(f"w_{c}") for c in ("n_extreme", "m_extreme", "n_normal", "m_normal")))
    whole = target_segments(one, usable, [], "price_segment", in_pool(one)).select("_tid", "price_segment")
    rows = t.join(found, "_tid", "left").join(wide, ["_finish", "_rooms"], "left").join(whole, "_tid", "left")
    col = F.col
    factor = F.coalesce(
        floor_factor(col("n_extreme"), col("m_extreme"), col("n_normal"), col("m_normal")),
        floor_factor(col("w_n_extreme"), col("w_m_extreme"), col("w_n_normal"), col("w_m_normal")), F.lit(V.FLOOR_DEFAULT),
    )
    review = truth(col("requires_manual_review"))
    status = F.when(col("_price_m2").isNull(), V.NO_NUMBERS)
    if strict:
        status = status.when(col("_excluded"), F.when(review, V.EXCLUDED_REVIEW).otherwise(V.EXCLUDED_INSTALLMENT))
    status = status.when(col("median").isNull(), V.NO_COMPARABLES).otherwise(V.SCORED)
    rows = rows.withColumns({"status": status, "_warnings": warnings(), "quality_evidence_score": quality_score()})
    scored, compared = col("status") == V.SCORED, col("status").isin(V.SCORED, V.NO_COMPARABLES)
    rows = rows.withColumns(
        {
            "finish_bucket": F.when(compared, col("_finish")), "price_segment": F.when(scored, col("price_segment")),
            "cohort_level": F.when(scored, col("level")).when(compared, "none"), "cohort_size": F.when(scored, col("size")).when(compared, 0),
            "floor_adjustment_factor": F.when(scored, F.when(col("_extreme"), factor).otherwise(1.0)), "is_extreme_floor": F.when(scored, col("_extreme")),
            "base_price_m2": F.when(scored, col("median")), "data_confidence": F.when(col("status").isin(V.EXCLUDED_REVIEW, V.EXCLUDED_INSTALLMENT), 0.0).otherwise(data_confidence(col("_warnings"))),
        }
    )
    rows = rows.withColumn("base_price_m2_corrected", col("base_price_m2") * col("floor_adjustment_factor"))
    rows = rows.withColumns(
        {
            "diff_pct": F.when(col("base_price_m2_corrected") != 0, (col("base_price_m2_corrected") - col("_price_m2")) / col("base_price_m2_corrected")),
            "robust_z": F.when(scored & (col("mad") > 0), clamp(0.6745 * (col("_price_m2") - col("base_price_m2")) / col("mad"), -10, 10)),
            "confidence_weight": F.when(compared, F.least(F.lit(1.0), col("cohort_size") / V.FULL_COHORT)),
            "benchmark_confidence": F.when(scored, cohort_confidence(col("cohort_level"), col("cohort_size"))).when(compared, 0.0),
        }
    )
    given = verdict(col("diff_pct"), combined_confidence(col("benchmark_confidence"), col("data_confidence")), review)
    other = F.when(col("status").isin(V.EXCLUDED_REVIEW, V.EXCLUDED_INSTALLMENT), V.BY_HAND).otherwise(V.TOO_LITTLE)
    return rows.withColumns(
        {
            "verdict": F.when(scored, given).otherwise(other), "value_score": F.when(scored, value_score(col("diff_pct"))),
            "price_quality_score": F.when(scored, composite(col("diff_pct"), col("quality_evidence_score"), col("benchmark_confidence"), col("data_confidence"))),
            "price_quality_label": F.when(scored, label(col("diff_pct"), col("quality_evidence_score"), col("_warnings"))),
            "seller_class": col("_seller.class"), "seller_confidence": col("_seller.confidence"), "seller_reason": col("_seller.reason"), "data_warnings": F.array_join("_warnings", ";"),
        }
    ).drop("_tid", "_self", "_id", "mad", "median", "size", "level", *STATS, "w_n_extreme", "w_m_extreme", "w_n_normal", "w_m_normal")


PLACES = {"confidence_weight": 2, "floor_adjustment_factor": 4, "base_price_m2": 1, "base_price_m2_corrected": 1, "diff_pct": 4, "robust_z": 2, "value_score": 1, "quality_evidence_score": 1, "price_quality_score": 1}
EXTRAS = [
    "status", "verdict", "verdict_reason", "finish_bucket", "price_segment", "cohort_level", "cohort_size", "confidence_weight", "benchmark_confidence", "is_extreme_floor",
    "floor_adjustment_factor", "base_price_m2", "base_price_m2_corrected", "diff_pct", "robust_z", "value_score", "quality_evidence_score", "price_quality_score",
    "price_quality_label", "data_confidence", "seller_class", "seller_confidence", "seller_reason", "data_warnings",
]


def export(scored: DataFrame) -> DataFrame:
    """Public columns and the 24 scores, rounded and with the reason in words."""
    why = F.when(F.col("status") == V.SCORED, verdict_reason(F.col("verdict"), F.col("diff_pct"))).when(F.col("status") == V.NO_NUMBERS, V.REASON_NO_NUMBERS)
    why = why.when(F.col("status") == V.NO_COMPARABLES, V.REASON_NO_COMPARABLES).otherwise(V.REASON_EXCLUDED)
    rows = scored.withColumn("verdict_reason", why).withColumns({c: decimal_round(F.col(c), n) for c, n in PLACES.items()})
    rows = rows.withColumn("data_confidence", F.when(F.col("status") == V.SCORED, F.col("data_confidence")).otherwise(decimal_round(F.col("data_confidence"), 3)))
    return rows.select(*(c for c in rows.columns if not c.startswith("_") and c not in EXTRAS), *EXTRAS)


def histogram(scored: DataFrame, column: str = "verdict") -> DataFrame:
    return scored.groupBy(column).agg(F.count("*").alias("n"))
