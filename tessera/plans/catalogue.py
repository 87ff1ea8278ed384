"""The library's operators as queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import vocabulary as V
from ..functions.runtime import folder as new_folder
from ..operators import baseline, changes, cleaning, cohort, dedup, extraction, features, notify, sanity, scoring
from ..sources import pages as P
from ..streaming import cycle, registry
from .listings import ORDER, listings, pool, table, targets
from .sql import SQL

__all__ = ["QUERIES", "SQL"]
_ROW = ["l_orderkey", *ORDER]


def q_hard_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The reason for every row."""
    return cleaning.hard_clean(listings(spark, folder), ORDER).select(*_ROW, "drop_stage", "drop_reason")


def q_drop_reasons(spark, folder):
    return cleaning.drop_counts(cleaning.hard_clean(listings(spark, folder), ORDER))


def q_dedup_freshest(spark, folder):
    """The freshest row of each id."""
    rows = cleaning.freshest(listings(spark, folder), F.col("id"), [F.col(c) for c in ORDER], ("scraped_at", "added_at"))
    return rows.where("_rank = 1").select(*_ROW)


def q_incoming_soft(spark, folder):
    return cleaning.soft_clean(listings(spark, folder), ORDER).select("id", *ORDER, "incoming_data_warnings")


def q_photo_hash(spark, folder):
    """A set hash per order over its parts' names."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("https://host/"), F.col("l_partkey"), F.lit("-"), F.col("l_linenumber"))).alias("urls"))
    return lines.select("l_orderkey", C.set_hash(F.col("urls")).alias("photo_set_hash"), F.size("urls").cast("long").alias("photo_count"))


def q_photo_dedup(spark, folder):
    rows = dedup.by_photos(listings(spark, folder), ORDER)
    return rows.select(*_ROW, "drop_reason", "baseline_warning")


def q_different_listing(spark, folder):
    """Pairs of listings with photos in one order, and whether they differ."""
    rows = listings(spark, folder).where("photo_set_hash <> ''").select("l_orderkey", "price", dedup.seller_key().alias("s"), "l_linenumber", "l_extendedprice")
    other = rows.select("l_orderkey", *(F.col(c).alias(f"o_{c}") for c in ("price", "s", "l_linenumber", "l_extendedprice")))
    pairs = rows.join(other, "l_orderkey").where("l_linenumber < o_l_linenumber")
    return pairs.select("l_orderkey", "l_linenumber", "o_l_linenumber", "l_extendedprice", "o_l_extendedprice", dedup.differs(F.col("price"), F.col("s"), F.col("o_price"), F.col("o_s")).alias("different"))


def q_addr_clusters(spark, folder):
    rows = dedup.area_clusters(listings(spark, folder), ORDER)
    return rows.select(*_ROW, F.col("_cluster").cast("long").alias("cluster"))


def q_addr_dedup(spark, folder):
    return dedup.by_address(listings(spark, folder), ORDER).select(*_ROW, F.col("drop_reason").isNotNull().alias("dropped"), "baseline_warning")


def q_floor_integrity(spark, folder):
    return sanity.floor_integrity(listings(spark, folder)).select(*_ROW, F.col("drop_reason").isNotNull().alias("dropped"))


def q_hard_bounds(spark, folder):
    rows = sanity.hard_bounds(listings(spark, folder), F.col("square_m2"), 12.0, 45.0, "square_m2", "square_sanity")
    return rows.select(*_ROW, F.regexp_extract(F.coalesce("drop_reason", F.lit("kept")), r"^\w+", 0).alias("reason"))


def q_iqr_exclusive(spark, folder):
    """Exclusive quartiles and fences of the price by rooms."""
    return sanity.fences(listings(spark, folder), F.col("price"), F.col("rooms")).withColumnRenamed("grp", "rooms")


def q_iqr_filter(spark, folder):
    rows = sanity.outliers(listings(spark, folder).withColumn("unit", F.col("price") / F.col("square_m2")), F.col("unit"), F.col("rooms"), "price_m2", "price_sanity")
    return rows.select(*_ROW, F.col("drop_reason").isNotNull().alias("dropped"))


def _usable(spark, folder):
    return features.enrich(listings(spark, folder)).where("not _excluded")


def q_segments(spark, folder):
    return cohort.with_segments(_usable(spark, folder)).select(*_ROW, F.col("_segment").alias("segment"))


def q_city_median(spark, folder):
    return cohort.city_medians(_usable(spark, folder)).select(F.col("_rooms").alias("rooms"), "city_median")


def q_robust_stats(spark, folder):
    """Median and MAD of unit prices by return flag."""
    rows = listings(spark, folder).select(table_flag().alias("flag"), (F.col("price") / F.col("square_m2")).alias("_price_m2"), F.lit(False).alias("_extreme")).where("_price_m2 is not null")
    return cohort.statistics(rows, ["flag"]).select("flag", "size", "median", "mad")


def table_flag():
    return F.coalesce(F.trim("finish_type"), F.lit("-"))


def q_floor_factor(spark, folder):
    """Factor for extreme floors by rooms and finish."""
    stats = cohort.statistics(_usable(spark, folder), ["_rooms", "_finish"])
    factor = cohort.floor_factor(F.col("n_extreme"), F.col("m_extreme"), F.col("n_normal"), F.col("m_normal"))
    return stats.select(F.col("_rooms").alias("rooms"), F.col("_finish").alias("finish"), "n_extreme", "n_normal", F.round(F.coalesce(factor, F.lit(V.FLOOR_DEFAULT)), 9).alias("factor"))


def _rich(spark, folder):
    return features.enrich(listings(spark, folder))


def q_seller_class(spark, folder):
    s = F.col("_seller")
    return _rich(spark, folder).select(*_ROW, s["class"].alias("seller_class"), s["confidence"].alias("seller_confidence"), s["reason"].alias("seller_reason"))


def q_finish_bucket(spark, folder):
    return _rich(spark, folder).groupBy(F.col("_finish").alias("finish"), F.col("_extreme").alias("extreme"), F.col("_rooms").alias("rooms"), F.col("_excluded").alias("excluded")).agg(F.count("*").alias("n"))


def q_warnings(spark, folder):
    return _rich(spark, folder).select(*_ROW, F.array_join(features.warnings(), ";").alias("data_warnings"))


def q_quality(spark, folder):
    return _rich(spark, folder).select(*_ROW, features.quality_score().alias("quality"))


def q_haversine_pairs(spark, folder):
    """Distances of all rows from the middle of the city, in metres."""
    rows = listings(spark, folder)
    km = C.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(51.1), F.lit(71.4))
    return rows.select(*_ROW, F.round(km * 1000, 3).alias("metres"))


def q_radius_join(spark, folder):
    """Pool rows of a target's rooms and finish within the two radii."""
    rows = listings(spark, folder)
    t = features.enrich(targets(rows)).where("_price_m2 is not null").select(*_ROW, *cohort.PLACE)
    usable = features.enrich(pool(rows)).where("not _excluded").select(*cohort.PLACE)
    found = cohort.counts_within(t, usable, {"near": V.NEAR_KM, "far": V.FAR_KM}, some=False)
    return found.groupBy(*_ROW).agg(F.sum("near").alias("near"), F.sum("far").alias("far"))


def _scored(spark, folder):
    rows = listings(spark, folder)
    return scoring.score(targets(rows), pool(rows))


def q_cohort_ladder(spark, folder):
    return _scored(spark, folder).select(*_ROW, "cohort_level", F.col("cohort_size").cast("long").alias("cohort_size"), "base_price_m2")


def q_score(spark, folder):
    """Which items are priced below their comparable cohort?"""
    r6 = lambda c: F.round(c, 6).alias(c)
    return _scored(spark, folder).select(
        *_ROW, "status", "verdict", "price_segment", "cohort_level", F.col("cohort_size").cast("long").alias("cohort_size"), r6("base_price_m2_corrected"), r6("diff_pct"), r6("robust_z"),
        r6("benchmark_confidence"), r6("data_confidence"), r6("quality_evidence_score"), r6("price_quality_score"), "price_quality_label", "data_warnings",
    )


def q_verdict_hist(spark, folder):
    return _scored(spark, folder).groupBy("verdict", "cohort_level").agg(F.count("*").alias("n"))


def q_score_self(spark, folder):
    """Targets that are in the pool themselves, each scored against all ids but its own."""
    rows = cleaning.freshest(listings(spark, folder), F.col("id"), [F.col(c) for c in ORDER], ("scraped_at", "added_at")).where("_rank = 1").drop("_rank")
    return scoring.score(targets(rows), rows, strict=True).select(*_ROW, "status", "cohort_level", F.col("cohort_size").cast("long").alias("cohort_size"), "price_segment", F.round("diff_pct", 6).alias("diff_pct"))


def q_overlay_join(spark, folder):
    """Events of the second half over the last of the first, by user and type."""
    before, after = _halves(spark, folder)
    rows = after.select("id", F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("price")).alias("price"), F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("props")).alias("props"), F.col("event_id").alias("row_id"))
    return changes.overlay(rows, before.select("id", "price", "props", "event_id", "ts"), ["ts", "event_id"]).select("id", "row_id", "price", "props", F.col("event_id").alias("detail_id"))


def _halves(spark, folder):
    """Events as (id, price, ...), before and after the middle of the ids' range of the table."""
    rows = table(spark, folder, "events").select(F.concat_ws("-", "user_id", "event_type").alias("id"), F.col("value").alias("price"), "ts", "event_id", "props")
    return rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")


def _states(spark, folder):
    return tuple(changes.last_by(x, "id", ["ts", "event_id"]) for x in _halves(spark, folder))


def q_upsert(spark, folder):
    details, listed = _states(spark, folder)
    listed = listed.withColumn("price", F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("price")))
    return changes.upsert(details, listed, listed, patched=("price", "ts")).select("id", "price", "ts", "event_id")


def q_new_ids(spark, folder):
    known, current = _states(spark, folder)
    return changes.new_ids(current, known).select("id", "price")


def q_price_drops(spark, folder):
    known, current = _states(spark, folder)
    return changes.price_drops(current, known).select("id", "old_price", "new_price", F.round("price_drop", 6).alias("price_drop"))


def q_state_replace(spark, folder):
    """What a window reports against the state it replaces."""
    known, current = _states(spark, folder)
    return changes.changes(current, known).select("id", "price", "reason", "old_price")


def q_semi_anti(spark, folder):
    """Customers with orders and without."""
    c = table(spark, folder, "customer").withColumnRenamed("c_custkey", "id")
    known, unknown = changes.split_known(c, table(spark, folder, "orders").withColumnRenamed("o_custkey", "id"))
    return known.select("id", F.lit(True).alias("has_orders")).unionByName(unknown.select("id", F.lit(False).alias("has_orders")))


def _candidates(spark, folder):
    return table(spark, folder, "events").select(F.col("user_id").cast("string").alias("id"), F.col("value").alias("price"), "ts", "event_id")


def q_registry(spark, folder):
    """Events that are a user's first or cheaper than all before."""
    return dedup.unsent(_candidates(spark, folder), None, ["ts", "event_id"]).select("id", "price", "event_id")


def q_registry_known(spark, folder):
    """The same for the later events, with the earlier ones' lowest prices as the registry."""
    rows = _candidates(spark, folder)
    old = rows.where("event_id % 4 = 0")
    return dedup.unsent(rows.where("event_id % 4 <> 0"), old, ["ts", "event_id"]).select("id", "price", "event_id")


def q_page_title(spark, folder):
    """Titles, and the page count of the embedded data, which every second page is given."""
    p = table(spark, folder, "pages")
    data = F.concat(F.lit('<script>window.digitalData = {"listing": {"pagesCount": '), F.col("page_id") % 50 + 1, F.lit("}};</script>"))
    html = F.concat(F.when(F.col("page_id") % 2 == 0, data).otherwise(""), F.coalesce("html", F.lit("")))
    return p.select("page_id", F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"), P.page_count(html).cast("long").alias("pages"))


def q_page_links(spark, folder):
    """One row per link in the navigation, which is rewritten as cards."""
    card = '<div class="a-card" data-id="$1"><div class="a-card__price">$2 ₸</div></div>'
    p = table(spark, folder, "pages").select(F.col("page_id").alias("page_number"), F.regexp_replace("html", r'<li><a href="([^"]*)">([^<]*)</a>', card).alias("html"))
    return P.cards(p).select(F.col("page_number").alias("page_id"), F.col("id").alias("href"), F.col("price").alias("number"))


def q_page_digits(spark, folder):
    p = table(spark, folder, "pages")
    return p.select("page_id", P.digits(F.regexp_extract("url", r"/(\d+)(#|$)", 1)).alias("number"))


def q_json_props(spark, folder):
    e = table(spark, folder, "events")
    return e.select("event_id", F.element_at(C.json_map(F.col("props")), "k").try_cast("long").alias("k"))


def q_llm_cache_join(spark, folder):
    """Documents against a cache keyed by id and hash of version and text, of which half is stale."""
    rows = table(spark, folder, "documents").select("doc_id", "text").join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = _described(rows, F.col("text")).withColumn("id", F.col("doc_id").cast("string"))
    h = lambda version: features.text_hash(features.prompt_text(), version, "extract")
    found = F.struct(F.lit(V.ROUGH).alias("finish_type"), F.array().cast("array<string>").alias("red_flags"), F.array(F.col("quality").cast("string")).alias("premium_markers"), F.lit("{}").alias("extra_attributes"))
    known = rows.where("quality is not null")
    cache = known.select(features.cache_key(features.prompt_text(), "2", "extract").alias("cache_key"), F.when(F.col("doc_id") % 2 == 0, h("2")).otherwise(h("1")).alias("text_hash"), found.alias("result"))
    out, _ = extraction.analyse(rows, cache, lambda text: '{"finish_type": null}', "2", "extract")
    hit = F.coalesce(F.col("finish_type") == V.ROUGH, F.lit(False))
    return out.select("doc_id", features.text_hash(F.col("text"), "2", "extract").alias("hash"), F.get_json_object("premium_markers", "$[0]").cast("long").alias("result"), hit.alias("hit"))


def _described(rows, text):
    """rows with the columns that extraction reads, of which only the description has a text."""
    return rows.withColumns({"full_description": text, **{c: F.lit(None).cast("string") for c in ("furniture", "rent_renovation", "suited_for")}})


def q_red_flags(spark, folder):
    """Extraction by keywords from every document, to which a phrase is added, validated, and the severe ones."""
    phrase = F.when(F.col("doc_id") % 3 == 0, " после залив, чистовая").when(F.col("doc_id") % 3 == 1, " требует капремонта").otherwise(" тихий двор")
    rows = _described(table(spark, folder, "documents").select("doc_id", "text"), F.concat(F.coalesce("text", F.lit("")), phrase))
    rows = rows.withColumn("id", F.lit("")).withColumn("is_installment_segment", F.lit("False"))
    cache = spark.createDataFrame([], f"cache_key string, text_hash string, result {extraction.RESULT}")
    out, _ = extraction.analyse(rows, cache, extraction.keyword_answer)
    return extraction.exclude_flagged(out).select("doc_id", "finish_type", "red_flags", F.col("drop_reason").isNotNull().alias("excluded"))


def q_notification_rows(spark, folder):
    rows = notify.candidates(_scored(spark, folder), "fast_track", "new").where(notify.sane() & notify.sendable())
    return notify.journal_rows(rows, F.lit("2026-01-01T00:00:00+00:00")).select("id", "reason", "source", "sent_at", "verdict", "cohort_level", "cohort_size", "seller_class", "data_warnings", "url", "title")


def q_old_score(spark, folder):
    from ..operators import superseded

    rows = listings(spark, folder)
    return superseded.score(targets(rows), pool(rows)).select(*_ROW, "status", "cohort_level", F.col("cohort_size").cast("long").alias("cohort_size"), F.round("diff_pct", 6).alias("diff_pct"))


def q_baseline(spark, folder):
    """The whole pool builder: what is kept, and what each stage drops."""
    kept, dropped, _ = baseline.build(listings(spark, folder), ORDER)
    n = dropped.groupBy(F.col("drop_stage").alias("stage"), F.regexp_extract("drop_reason", r"^\w+", 0).alias("reason")).agg(F.count("*").alias("n"))
    return n.unionByName(kept.groupBy(F.lit("kept").alias("stage"), F.lit("kept").alias("reason")).agg(F.count("*").alias("n")))


def q_stream_registry(spark, folder):
    """The registry as a stream over the events, one query with a keyed state."""
    out = new_folder(spark, "stream-registry")
    schema = table(spark, folder, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    rows = events.select(F.col("user_id").cast("string").alias("id"), F.col("value").alias("price"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    query = registry.sent(rows, ["t", "event_id"]).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("id", "price", "event_id")


def q_stream_diff(spark, folder):
    """Two snapshots of the events through a stream; what the second reports."""
    out = new_folder(spark, "stream-diff")
    for n, part in enumerate(_states(spark, folder)):
        part.withColumn("snapshot", F.lit(n)).write.parquet(f"{out}/in/{n}")
    schema = spark.read.parquet(f"{out}/in/0").schema
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{out}/in")
    query = rows.writeStream.foreachBatch(cycle.snapshot_changes(out)).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/changes").select("id", "price", "reason", "old_price")


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}
