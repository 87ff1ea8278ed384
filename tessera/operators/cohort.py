"""Comparable cohorts: price segments, medians by rooms, the location ladder and robust statistics.

The ladder goes from the same complex to the whole city; a target takes the first level with enough
rows. Levels by equal keys (complex, street and segment, rooms) use statistics that are computed once for each
key, so no pairs are made of a target and a group; only the radius levels pair rows, within
neighbouring grid cells and only for targets that no earlier level has settled. Where numbers are all
that is asked, rows of one point are counted before they are paired. Targets whose id is
itself in the pool must leave their own rows out; those alone are paired at every level."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import haversine_km
from ..functions.runtime import cut
from .ranks import between, cell, quantiles, ranked
from ..functions.vocabulary import (
    BUSINESS, COMFORT, EARTH_KM, ECONOMY, FAR_BAND, FAR_KM, FLOOR_DEFAULT, FLOOR_HIGH, FLOOR_LOW, LEAST_COHORT, LEAST_FLOOR, LEAST_SEGMENT_POOL, NEAR_KM,
)

LAT_LIMIT = 70.0
_KM = EARTH_KM * math.pi / 180


def segment(value: Column, n: Column, q25: Column, q75: Column) -> Column:
    """The price segment; the low edge is tested first, and a small pool is all comfort."""
    return F.when(F.coalesce(n, F.lit(0)) < LEAST_SEGMENT_POOL, COMFORT).when(value.isNull(), COMFORT).when(value <= q25, ECONOMY).when(value >= q75, BUSINESS).otherwise(COMFORT)


def quartiles(pool: DataFrame, *keys: str) -> DataFrame:
    """n and the inclusive quartiles q (q25, q75) of each key; without keys one row, with _all."""
    found = quantiles(pool, list(keys), "_price_m2", {"q25": 0.25, "q75": 0.75})
    return found.select(*(keys or [F.lit(1).alias("_all")]), "n", F.array("q25", "q75").alias("q"))


def city_medians(pool: DataFrame) -> DataFrame:
    medians = quantiles(pool, ["_rooms"], "_price_m2", {"city_median": 0.5}).drop("n")
    return pool.select("_rooms").distinct().join(medians.withColumnRenamed("_rooms", "_r"), F.col("_rooms").eqNullSafe(F.col("_r")), "left").drop("_r")


def with_segments(pool: DataFrame) -> DataFrame:
    """Usable pool rows with _segment, by the quartiles of all of them."""
    edges = F.broadcast(quartiles(pool).select(F.col("n").alias("_n"), F.col("q").alias("_q")))
    return pool.join(edges, how="left").withColumn("_segment", segment(F.col("_price_m2"), F.col("_n"), F.get("_q", F.lit(0)), F.get("_q", F.lit(1)))).drop("_n", "_q")


def statistics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Size, median, MAD and the numbers and medians of extreme and normal floors, by keys."""
    v, low = F.col("_price_m2"), F.col("_extreme")
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("size"), F.median(v).alias("median"),
        F.count_if(low & v.isNotNull()).alias("n_extreme"), F.median(F.when(low, v)).alias("m_extreme"),
        F.count_if(~low & v.isNotNull()).alias("n_normal"), F.median(F.when(~low, v)).alias("m_normal"),
    )
    spread = rows.join(base.select(*keys, "median"), keys).groupBy(*keys).agg(F.median(F.abs(v - F.col("median"))).alias("mad"))
    return base.join(spread, keys)


STATS = ["size", "median", "mad", "n_extreme", "m_extreme", "n_normal", "m_normal"]
TARGET = ["_tid", "_id", "_price_m2", "_rooms", "_finish", "_complex", "street", "_lat", "_lon", "_self"]


def _cells(lat: Column, lon: Column, km: float) -> tuple[Column, Column]:
    """Grid cells at least km wide on both axes up to the latitude limit."""
    checked = F.when(F.abs(lat) > LAT_LIMIT, F.raise_error(F.lit(f"latitude beyond {LAT_LIMIT}"))).otherwise(lat)
    return F.floor(checked / (km / _KM * 1.001)), F.floor(lon / (km / _KM / math.cos(math.radians(LAT_LIMIT)) * 1.001))


def paired(targets: DataFrame, pool: DataFrame, km: float, *keys: str) -> DataFrame:
    """Pairs of a row of targets (_rooms, _finish, _lat, _lon) and one of pool (_rooms, _finish, p_lat, p_lon) of equal rooms, finish and keys at most km apart, with km."""
    cy, cx = _cells(F.col("_lat"), F.col("_lon"), km)
    near = F.array(*(F.struct((cy + i).alias("cy"), (cx + j).alias("cx")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    t = targets.where("_lat is not null and _lon is not null").withColumn("_near", F.explode(near)).selectExpr("*", "_near.cy AS _cy", "_near.cx AS _cx").drop("_near")
    cy, cx = _cells(F.col("p_lat"), F.col("p_lon"), km)
    p = pool.where("p_lat is not null and p_lon is not null").select("*", cy.alias("_cy"), cx.alias("_cx"))
    pairs = t.join(p, ["_finish", "_rooms", "_cy", "_cx", *keys])
    # what is too far by latitude alone needs no distance
    pairs = pairs.where(F.abs(F.col("p_lat") - F.col("_lat")) <= km / _KM * 1.001)
    return pairs.withColumn("km", haversine_km(F.col("_lat"), F.col("_lon"), F.col("p_lat"), F.col("p_lon"))).where(F.col("km") <= km).drop("_cy", "_cx")


def within(targets: DataFrame, pool: DataFrame, km: float) -> DataFrame:
    """Pairs of a target (its columns _tid, _id, _rooms, _finish, _lat, _lon) and a pool row of its rooms and finish at most km apart, with km."""
    p = pool.select(F.col("_id").alias("p_id"), "_rooms", "_finish", F.col("_lat").alias("p_lat"), F.col("_lon").alias("p_lon"), F.col("_price_m2").alias("p_price"), F.col("_extreme").alias("p_extreme"))
    return paired(targets, p, km).where((F.col("p_id") != F.col("_id")) | (F.col("_id") == ""))


PLACE = ["_finish", "_rooms", "_lat", "_lon"]


def spotted(rows: DataFrame) -> DataFrame:
    """Pool rows with the names that paired() knows them by."""
    return rows.withColumnsRenamed({"_lat": "p_lat", "_lon": "p_lon"})


def counts_within(targets: DataFrame, pool: DataFrame, radii: dict[str, float], some: bool = True) -> DataFrame:
    """targets with a pool row of their rooms and finish within the widest radius, with the number of those within each. some: targets may be in the pool, of which rows with their own id do not count.

    Rows of equal finish, rooms and point are counted first, and only what differs in one of these is paired."""
    t = cut(targets.where(" and ".join(f"{k} is not null" for k in PLACE)))
    n = lambda weight: [F.sum(F.when(F.col("km") <= r, weight).otherwise(0)).alias(k) for k, r in radii.items()]
    widest = max(radii.values())
    spots = pool.groupBy(*PLACE).agg(F.count("*").alias("_n"))
    found = t.join(paired(t.select(*PLACE).distinct(), spotted(spots), widest).groupBy(*PLACE).agg(*n(F.col("_n"))), PLACE)
    if some:
        places = t.where("_id <> ''").select("_id", *PLACE).distinct()
        own = paired(places, spotted(pool.select("_id", *PLACE)), widest, "_id").groupBy("_id", *PLACE).agg(*n(F.lit(1)))
        found = found.join(own.withColumnsRenamed({k: f"_own_{k}" for k in radii}), ["_id", *PLACE], "left")
        found = found.withColumns({k: F.col(k) - F.coalesce(F.col(f"_own_{k}"), F.lit(0)) for k in radii}).drop(*(f"_own_{k}" for k in radii))
    return found.where(F.greatest(F.lit(0), *radii) > 0)


#: Cells of the unit price that medians_within counts a point's rows by. All but the first and last lie between the quartiles of all rows, where most medians are.
PRICE_CELLS = 32


def medians_within(places: DataFrame, pool: DataFrame, km: float, least: int, some: bool = True) -> DataFrame:
    """(_gid, size, median) of the pool rows of a place's finish and rooms at most km away, for places with at least so many. Rows without a price count, but have no part in the median.

    places: _gid, PLACE, and _own: the id whose rows do not count, or null. some: there are such ids. The rows of a point are counted by cell of the
    price; of the rows around a place only those in the one or two cells that hold the middle are met one by one, those of one point and price together."""
    v, last = F.col("_price_m2"), PRICE_CELLS - 1
    low, high = pool.where(v.isNotNull()).select(F.percentile_approx(cell(v), F.array(F.lit(0.25), F.lit(0.75)), 1000).alias("x")).first().x or (0, 1)
    inner = F.least(F.lit(last - 1), F.floor((cell(v) - low).cast("double") / max(1, high - low) * (last - 1)) + 1)
    rows = pool.withColumn("_b", F.when(cell(v) < low, 0).when(cell(v) >= high, last).otherwise(inner).cast("long")).withColumn("_b", F.when(v.isNotNull(), F.col("_b")))
    counted = [f"_c{i}" for i in range(PRICE_CELLS)]
    spots = rows.groupBy(*PLACE).agg(F.count("*").alias("size"), *(F.count_if(F.col("_b") == i).alias(c) for i, c in enumerate(counted)))
    sums = [F.sum(c).alias(c) for c in ("size", *counted)]
    near = paired(places, spotted(spots), km).groupBy("_gid").agg(*sums)
    if some:
        mine = places.where("_own is not null").withColumn("_id", F.col("_own"))
        own = cut(paired(mine, spotted(rows.select("_id", *PLACE, "_price_m2", "_b")), km, "_id").select("_gid", "_price_m2", "_b"))
        less = own.groupBy("_gid").agg((-F.count("*")).alias("size"), *((-F.count_if(F.col("_b") == i)).alias(c) for i, c in enumerate(counted)))
        near = near.unionByName(less).groupBy("_gid").agg(*sums)
    zero = F.lit(0).cast("long")
    # the cell that holds a rank, and the number of values in the cells below it
    state = F.struct(zero.alias("upto"), zero.alias("below"), F.lit(-1).cast("long").alias("at"))
    step = lambda rank: lambda s, x: F.when(s.upto > rank, s).otherwise(F.struct((s.upto + x).alias("upto"), s.upto.alias("below"), (s.at + 1).alias("at")))
    n = F.aggregate("_cs", zero, lambda s, x: s + x)
    near = near.where(F.col("size") >= least).select("_gid", "size", F.array(*counted).alias("_cs")).withColumn("_n", n)
    near = near.withColumns({"_lo": F.floor((F.col("_n") - 1) / 2), "_hi": F.floor(F.col("_n") / 2)})
    near = cut(near.select("_gid", "size", "_n", *(F.when(F.col("_n") > 0, F.aggregate("_cs", state, step(F.col(r)))).alias(f"{r}c") for r in ("_lo", "_hi")), "_lo", "_hi"))
    asked = near.where("_n > 0").select("_gid", "_lo", "_hi", F.explode(F.array_distinct(F.array(*(F.struct(F.col(f"{r}c.at").alias("_b"), F.col(f"{r}c.below").alias("_below")) for r in ("_lo", "_hi"))))).alias("x"))
    # ranks within the cell; those of another cell are below 0, or beyond its last value
    asked = asked.select("_gid", "x._b", (F.col("_lo") - F.col("x._below")).alias("_lo"), (F.col("_hi") - F.col("x._below")).alias("_hi"))
    cells = [x._b for x in asked.select("_b").distinct().collect()]
    values = rows.where(F.col("_b").isin(cells)).groupBy(*PLACE, "_b", "_price_m2").agg(F.count("*").alias("_w"))
    met = ["_gid", "_b", "_lo", "_hi", "_price_m2", "_w"]
    found = paired(places.select("_gid", *PLACE).join(asked, "_gid"), spotted(values), km, "_b").select(*met)
    if some:
        found = found.unionByName(own.join(asked, ["_gid", "_b"]).withColumn("_w", F.lit(-1).cast("long")).select(*met))
    # equal prices are added up together, so what is taken away goes with what it is taken from
    found = found.withColumn("_upto", F.sum("_w").over(Window.partitionBy("_gid", "_b").orderBy("_price_m2")))
    first = lambda rank: F.min(F.when((F.col(rank) >= 0) & (F.col("_upto") > F.col(rank)), v)).alias(rank)
    middle = found.groupBy("_gid").agg(first("_lo"), first("_hi")).select("_gid", between(F.col("_lo"), F.col("_hi"), F.when(F.col("_lo") == F.col("_hi"), 0.0).otherwise(0.5)).alias("median"))
    return cut(near.select("_gid", "size").join(middle, "_gid", "left"))


def _pair_stats(pairs: DataFrame) -> DataFrame:
    return statistics(pairs.select("_tid", F.col("p_price").alias("_price_m2"), F.col("p_extreme").alias("_extreme")), ["_tid"])


def in_pool(targets: DataFrame) -> bool:
    """Whether any target is in the pool itself; if none is, what would leave its own rows out need not be planned."""
    return bool(targets.where("_self").take(1))


def _key_level(targets: DataFrame, pool: DataFrame, keys: list[str], some: bool = True) -> DataFrame:
    """(_tid, STATS) of the pool rows with a target's keys. some: targets may be in the pool."""
    p = pool.where(" and ".join(f"{k} is not null" for k in keys))
    alone = targets.where("not _self").select("_tid", *keys).join(statistics(p, keys), keys).select("_tid", *STATS)
    if not some:
        return alone
    own = targets.where("_self").select("_tid", "_id", *keys).join(p.select(*keys, F.col("_id").alias("p_id"), F.col("_price_m2").alias("p_price"), F.col("_extreme").alias("p_extreme")), keys).where("p_id <> _id")
    return alone.unionByName(_pair_stats(own).select("_tid", *STATS))


def left_out(v: Column, n: Column, stats: Column, i: int) -> Column:
    """Inclusive quartile i (0 or 1) of n values without v, from six order statistics of all n. A cleaned pool has an id once, so one value goes."""
    a = [F.get(stats, F.lit(3 * i + k)) for k in range(3)]
    at = F.lit((0.25, 0.75)[i]) * (n - 2)
    low = F.when(v > a[0], a[0]).otherwise(a[1])
    high = F.when(v > a[1], a[1]).otherwise(a[2])
    return low + (high - low) * (at - F.floor(at))


def order_statistics(pool: DataFrame, *keys: str) -> DataFrame:
    """n, and for each quartile the three values around the place it has when one row is left out."""
    places = lambda n: {f"_{i}{k}": F.least(F.floor(F.lit(p) * (n - 2)) + k, n - 1) for i, p in enumerate((0.25, 0.75)) for k in range(3)}
    found = ranked(pool, list(keys), "_price_m2", places)
    return found.select(*(keys or [F.lit(1).alias("_all")]), "n", F.array(*(f"_{i}{k}" for i in range(2) for k in range(3))).alias("os"))


def target_segments(targets: DataFrame, pool: DataFrame, keys: list[str], name: str, some: bool = True) -> DataFrame:
    """targets with their segment by the quartiles of the pool rows with their keys, their own rows left out. some: targets may be in the pool."""
    by = keys or ["_all"]
    t = targets if keys else targets.withColumn("_all", F.lit(1))
    alone = t.where("not _self").join(quartiles(pool, *keys).select(*by, F.col("n").alias("_n"), F.col("q").alias("_q")), by, "left")
    alone = alone.withColumn(name, segment(F.col("_price_m2"), F.col("_n"), F.get("_q", F.lit(0)), F.get("_q", F.lit(1)))).drop("_n", "_q")
    if not some:
        return alone.drop("_all")
    mine = pool.select(F.col("_id").alias("_pid"), F.col("_price_m2").alias("_own"), *keys).groupBy("_pid", *keys).agg(F.first("_own").alias("_own"))
    own = t.where("_self").join(order_statistics(pool, *keys).select(*by, F.col("n").alias("_n"), F.col("os").alias("_os")), by, "left")
    own = own.join(mine.withColumnRenamed("_pid", "_id"), ["_id", *keys], "left")
    kept = lambda i: F.when(F.col("_own").isNull(), F.lit(None).cast("double")).otherwise(left_out(F.col("_own"), F.col("_n"), F.col("_os"), i))
    size = F.col("_n") - F.when(F.col("_own").isNotNull(), 1).otherwise(0)
    own = own.withColumn(name, segment(F.col("_price_m2"), size, kept(0), kept(1))).drop("_n", "_os", "_own")
    return alone.unionByName(own).drop("_all")


def ladder(targets: DataFrame, pool: DataFrame) -> DataFrame:
    """(_tid, level, STATS) for targets; pool: usable rows with _segment. Targets without any comparable are left out."""
    some = in_pool(targets)
    t = cut(target_segments(targets.select(*TARGET), pool, ["_finish"], "_segment", some))
    on_street = pool.where("trim(street) <> ''")
    at = lambda rows, level, least: rows.where(F.col("size") >= least).select("_tid", F.lit(level).alias("level"), *STATS)
    same = at(_key_level(t, pool, ["_finish", "_rooms", "_complex"], some), "1-2", LEAST_COHORT)
    same = same.unionByName(at(_key_level(t, on_street, ["_finish", "_rooms", "street", "_segment"], some), "3", LEAST_COHORT))
    # only what these leave is paired by distance, once for both radii
    left = t.join(same.select("_tid"), "_tid", "left_anti")
    pairs = cut(within(left, pool, FAR_KM).select("_tid", "_rooms", "km", "p_price", "p_extreme"))
    near = at(_pair_stats(pairs.where(F.col("km") <= NEAR_KM)), "4", LEAST_COHORT)
    medians = city_medians(pool).where("city_median <> 0")
    band = F.col("p_price").between(F.col("city_median") * (1 - FAR_BAND), F.col("city_median") * (1 + FAR_BAND))
    far = at(_pair_stats(pairs.join(medians, "_rooms").where(band)), "5", LEAST_COHORT)
    # a target that is in the pool meets all rows of its finish and rooms here, so only those without another level come this far
    earlier = cut(same.unionByName(near).unionByName(far))
    last = at(_key_level(t.join(earlier.select("_tid"), "_tid", "left_anti"), pool, ["_finish", "_rooms"], some), "6", 1)
    every = earlier.unionByName(last)
    # the levels' names sort in the ladder's order
    best = F.min_by(F.struct("level", *STATS), F.col("level")).alias("best")
    return every.groupBy("_tid").agg(best).select("_tid", "best.*")


def floor_factor(n_extreme: Column, m_extreme: Column, n_normal: Column, m_normal: Column) -> Column:
    """The factor for extreme floors where both kinds are numerous enough, else null."""
    raw = 0.75 * m_extreme / m_normal + 0.25 * FLOOR_DEFAULT
    enough = (n_extreme >= LEAST_FLOOR) & (n_normal >= LEAST_FLOOR) & (m_normal > 0)
    return F.when(enough, F.greatest(F.lit(FLOOR_LOW), F.least(F.lit(FLOOR_HIGH), raw)))
