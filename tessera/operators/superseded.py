"""The superseded scorer: quartiles by index, a two-way finish, a fixed discount for extreme floors, and the segment of a target looked up by its id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import truth
from ..functions.runtime import cut, kept
from ..functions.vocabulary import BUSINESS, COMFORT, ECONOMY, FAR_BAND, FAR_KM, LEAST_COHORT, NEAR_KM
from .cohort import PLACE, TARGET, city_medians, medians_within
from .features import enrich
from .ranks import quantiles, ranked

DISCOUNT, FULL = 0.05, 6


def with_segments(pool: DataFrame) -> DataFrame:
    """pool with _segment by the values at a quarter and three quarters of the sorted list; under four values all are comfort."""
    one = ranked(pool, [], "_price_m2", lambda n: {"_q25": F.floor(n / 4), "_q75": F.floor(n * 3 / 4)})
    edges = F.broadcast(one.withColumnRenamed("n", "_n"))
    v = F.col("_price_m2")
    found = F.when((F.coalesce("_n", F.lit(0)) < 4) | v.isNull(), COMFORT).when(v <= F.col("_q25"), ECONOMY).when(v >= F.col("_q75"), BUSINESS).otherwise(COMFORT)
    return pool.join(edges, how="left").withColumn("_segment", found).drop("_n", "_q25", "_q75")


POOL = ["_id", "_finish", "_rooms", "_complex", "street", "_lat", "_lon", "_price_m2", "_extreme"]


def _level(targets: DataFrame, pool: DataFrame, keys: list[str], some: bool) -> DataFrame:
    """(_tid, size, median) of the pool rows with a target's keys. some: targets may be in the pool; those alone are paired, with all rows but their own."""
    p = pool.where(" and ".join(f"{k} is not null" for k in keys))
    stats = p.groupBy(*keys).agg(F.count("*").alias("size")).join(quantiles(p, keys, "_price_m2", {"median": 0.5}).drop("n"), keys, "left")
    alone = targets.where("not _self").select("_tid", *keys).join(stats, keys).select("_tid", "size", "median")
    if not some:
        return alone
    own = targets.where("_self").select("_tid", "_id", *keys).join(p.select(*keys, F.col("_id").alias("p_id"), F.col("_price_m2").alias("p_price")), keys).where("p_id <> _id")
    return alone.unionByName(own.groupBy("_tid").agg(F.count("*").alias("size"), F.median("p_price").alias("median")))


def score(targets: DataFrame, pool: DataFrame) -> DataFrame:
    """targets with status, cohort_level, cohort_size, confidence_weight, base_price_m2, base_price_m2_corrected and diff_pct.

    The pool is written once with what scoring reads of it; each level is computed for those targets only that no earlier one has settled."""
    ident = F.coalesce(F.trim(F.col("id").cast("string")), F.lit(""))
    usable = kept(enrich(pool, old=True).where("not _excluded").withColumn("_id", ident).select(*POOL))
    t = enrich(targets, old=True).withColumn("_id", ident)
    t = cut(t.withColumn("_tid", F.md5(F.to_json(F.struct("_id", "_price_m2", "_rooms", "_finish", "_complex", "street", "_lat", "_lon")))))
    ids = t.select("_id").distinct()
    # equal ids have equal hashes, which are less to deal out than the ids
    h = F.xxhash64("_id").alias("h")
    some = usable.select(h).join(ids.select(h), "h", "left_semi").agg(F.count("*")).first()[0] > 0
    if some:
        usable = kept(with_segments(usable))
        known = usable.join(ids, "_id", "left_semi").groupBy("_id").agg(F.max("_segment").alias("price_segment"))
        t = cut(t.join(known, "_id", "left").withColumn("_self", F.col("price_segment").isNotNull()))
    else:
        t = t.withColumns({"price_segment": F.lit(None).cast("string"), "_self": F.lit(False)})
    one = cut(t.where("not _excluded and _price_m2 is not null").select(*TARGET, "price_segment").dropDuplicates(["_tid"]))
    at = lambda rows, level, least: rows.where(F.col("size") >= least).select("_tid", F.lit(level).alias("level"), "size", "median")
    found = at(_level(one, usable, ["_finish", "_rooms", "_complex"], some), "1-2", LEAST_COHORT)
    if some:
        # only a target that is itself in the pool has a segment to compare
        streets = one.where("price_segment is not null and street <> ''").withColumn("_segment", F.col("price_segment"))
        found = found.unionByName(at(_level(streets, usable, ["_finish", "_rooms", "street", "_segment"], some), "3", LEAST_COHORT))
    found = cut(found)
    left = cut(one.join(found.select("_tid"), "_tid", "left_anti").withColumn("_own", F.when(F.col("_self") & (F.col("_id") != ""), F.col("_id"))))
    places = left.where(" and ".join(f"{k} is not null" for k in PLACE)).select(*PLACE, "_own").distinct()
    places = cut(places.withColumn("_gid", F.monotonically_increasing_id()))
    near = medians_within(places, usable, NEAR_KM, LEAST_COHORT, some).withColumn("level", F.lit("4"))
    rest = places.join(near.select("_gid"), "_gid", "left_anti")
    if rest.take(1):
        band = F.col("_price_m2").between(F.col("city_median") * (1 - FAR_BAND), F.col("city_median") * (1 + FAR_BAND))
        banded = usable.join(city_medians(usable).where("city_median <> 0"), "_rooms").where(band)
        near = near.unionByName(medians_within(rest, banded, FAR_KM, LEAST_COHORT, some).withColumn("level", F.lit("5")))
    around = places.join(near, "_gid").withColumnsRenamed({k: f"_at_{k}" for k in (*PLACE, "_own")})
    same = F.col("_own").eqNullSafe(F.col("_at__own"))
    for k in PLACE:
        same = same & (F.col(k) == F.col(f"_at_{k}"))
    found = cut(found.unionByName(left.join(around, same).select("_tid", "level", "size", "median")))
    last = one.where("_rooms is not null").join(found.select("_tid"), "_tid", "left_anti")
    if last.take(1):
        found = found.unionByName(at(_level(last, usable, ["_finish", "_rooms"], some), "6", 1))
    best = cut(found.groupBy("_tid").agg(F.min_by(F.struct("level", "size", "median"), F.col("level")).alias("b")).select("_tid", "b.*"))
    rows = t.join(best, "_tid", "left")
    excluded = F.when(truth(F.col("requires_manual_review")), "excluded_manual_review").otherwise("excluded_installment")
    status = F.when(F.col("_excluded"), excluded).when(F.col("_price_m2").isNull(), "no_price_m2").when(F.col("median").isNull(), "no_comparables").otherwise("scored")
    corrected = F.col("base_price_m2") * F.when(F.col("_extreme"), 1 - DISCOUNT).otherwise(1.0)
    rows = rows.withColumn("status", status).withColumn("base_price_m2", F.col("median")).withColumn("base_price_m2_corrected", corrected)
    return rows.withColumns(
        {
            "cohort_level": F.col("level"), "cohort_size": F.col("size"), "confidence_weight": F.least(F.lit(1.0), F.col("size") / FULL),
            "diff_pct": F.when(F.col("base_price_m2_corrected") != 0, (F.col("base_price_m2_corrected") - F.col("_price_m2")) / F.col("base_price_m2_corrected")),
        }
    ).drop("_tid", "_self", "_id", "median", "size", "level")


__all__ = ["score", "with_segments"]
