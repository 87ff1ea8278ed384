"""The listing operators on hand-made rows: each branch and tie, and golden rows."""

import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import vocabulary as V
from tessera.plans.listings import ORDER, listings, pool, targets
from tessera.operators import baseline, changes, cleaning, cohort, dedup, extraction, features, notify, sanity, scoring

FIELDS = ["id", "price", "price_m2", "square_m2", "rooms", "storage", "scraped_at", "added_at", "ord"]


def rows(spark, data, fields):
    return spark.createDataFrame(data, ", ".join(f"{f} {'int' if f == 'ord' else 'string'}" for f in fields))


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("text", "value"), [("1d", None), ("1_000", 1000.0), (" 5.5 ", 5.5), ("1e3", 1000.0), ("", None), (None, None), ("x", None), ("-2", -2.0), (".5", 0.5), ("0x1", None)])
def test_number(spark, text, value):
    assert one(spark, C.number(F.lit(text).cast("string")))[0] == value


def test_number_locale_and_types(spark):
    assert one(spark, C.number(F.lit("1 234,5"), locale=True))[0] == 1234.5
    assert one(spark, C.number(F.lit(7)), C.number(F.lit(7.25)))[:] == (7.0, 7.25)
    assert one(spark, F.isnan(C.number(F.lit("nan"))))[0]


def test_rounding_and_percent_follow_the_binary_value(spark):
    got = spark.createDataFrame([(2.675,), (0.125,), (85.65,), (None,)], "x double").select(C.decimal_round(F.col("x"), 2).alias("r"), C.percent(F.col("x") / 100, signed=True).alias("p")).collect()
    assert [r.r for r in got] == [2.67, 0.12, 85.65, None]
    assert [r.p for r in got] == [f"{x / 100:+.1%}" for x in (2.675, 0.125, 85.65)] + [None]


@pytest.mark.parametrize("n", [2, 3, 7, 8, 9, 10])
def test_exclusive_quartiles(spark, n):
    values = sorted(float((7 * i) % 13) for i in range(n))
    q = statistics.quantiles(values, n=4)
    got = one(spark, *C.exclusive_quartiles(F.array(*map(F.lit, values))))
    assert list(got) == pytest.approx([q[0], q[2]])


def test_hard_clean_keeps_the_freshest_even_if_invalid(spark):
    t = "2026-01-0"
    data = [
        ("1", "100", None, "10", "2", "live", t + "1", None, 0), ("1", "bad", None, "10", "2", "live", t + "2", None, 1),  # the fresh one is invalid
        ("2", "5", None, "10", " ", "", None, None, 2), ("3", "5", None, "0", "1", "", "garbage", t + "1", 3), ("3", "5", None, "9", "1", "LIVE", None, t + "2", 4),
        ("4", "5", None, "9", "1", " Sold ", t + "1", None, 5), ("4", "6", None, "9", "1", "live", t + "1", None, 6), ("", "5", None, "9", "1", "", None, None, 7), (None, "5", None, "9", "1", "", None, None, 8),
    ]
    got = {r.ord: r.drop_reason for r in cleaning.hard_clean(rows(spark, data, FIELDS), ["ord"]).collect()}
    assert got == {0: "duplicate_id", 1: "no_valid_price", 2: "no_rooms", 3: "duplicate_id", 4: None, 5: "not_live (storage=sold)", 6: "duplicate_id", 7: None, 8: "duplicate_id"}


def test_soft_clean(spark):
    data = [(" 7 ", None, "12 500,5", "40", "", "sold", None, None, "x", 0), ("7", "1", None, "40", "1", "", "2026-01-01", None, "", 1)]
    df = rows(spark, data, ["id", "price", "new_price", "square_m2", "rooms", "storage", "scraped_at", "added_at", "full_description", "ord"])
    got = cleaning.soft_clean(df, ["ord"]).collect()
    assert len(got) == 1 and got[0].price == "1.0" and got[0].incoming_data_warnings == '["no_description","photo_count_unknown"]'
    alone = cleaning.soft_clean(df.where("ord = 0"), ["ord"]).first()
    assert alone.price == "12500.5" and alone.incoming_data_warnings == '["missing_rooms","not_live_storage:sold","photo_count_unknown"]'


def listing(i, hash_="", price="100", owner="a", day=1, street="s", house="1", floor="1", area="50", rooms="2"):
    return (str(i), hash_, price, owner, None, f"2026-01-{day:02}", None, street, house, floor, rooms, area, i)


PLACE = ["id", "photo_set_hash", "price", "owner_name", "seller_type", "scraped_at", "added_at", "street", "house_num", "floor", "rooms", "square_m2", "ord"]


def test_photo_dedup_is_a_greedy_fold(spark):
    data = [
        listing(0, "h", "100", "a", 9), listing(1, "h", "101", "b", 8), listing(2, "h", "200", "b", 7), listing(3, "h", "200", "b", 6),  # the last equals a survivor but differs from the first
        listing(4, "h", "100", "a", 5), listing(5, "", "100"), listing(6, " ", "100"), listing(7, "k", "0", "z"), listing(8, "k", "50", "y"),
    ]
    got = {r.ord: (r.drop_reason, r.baseline_warning) for r in dedup.by_photos(rows(spark, data, PLACE), ["ord"]).collect()}
    dup, other = ("duplicate_photo_set_hash", None), (None, V.OTHER_SELLER)
    assert got == {0: (None, None), 1: dup, 2: other, 3: other, 4: other, 5: (None, None), 6: (None, None), 7: (None, None), 8: dup}


def test_survivors_state_is_enough():
    import random

    r = random.Random(1)
    for _ in range(300):
        state, alive = dedup.Survivors(), []
        for _ in range(r.randint(1, 25)):
            price, seller = r.choice([0, 50, 51, 52, 53, 80, 100, 101, 104]), r.choice("abc")
            brute = any(p > 0 and price > 0 and s != seller and abs(p - price) / max(p, price) > 0.03 for p, s in alive)
            assert state.different(price, seller) == brute
            if not alive or brute:
                alive.append((price, seller))
                state.add(price, seller)


def test_address_chain(spark):
    data = [listing(i, area=a, day=20 - i) for i, a in enumerate(["55.4", "55.6", "56.5", "57.6", "x"])] + [listing(9, street=" "), listing(10, house="")]
    df = rows(spark, data, PLACE)
    got = {r.ord: r.drop_reason for r in dedup.by_address(df, ["ord"]).collect()}
    assert [got[k] is not None for k in (0, 1, 2, 3, 4, 9, 10)] == [False, True, True, False, False, False, False]
    assert got[1] == "duplicate_address_layout (street='s', house='1', floor='1', rooms='2', square within 1.0m2)"


def test_registry_sends_new_and_cheaper(spark):
    df = rows(spark, [("1", "100", 0), ("1", "1100000", 1), ("1", "90", 2), ("1", "90", 3), ("2", "190000", 4), ("", "5", 5), (None, "5", 6), ("3", None, 7)], ["id", "price", "ord"])
    assert sorted(r.ord for r in dedup.unsent(df, None, ["ord"]).collect()) == [0, 2, 4]
    known = rows(spark, [("1", "95", 0), ("2", "1000", 0)], ["id", "price", "ord"])
    sent = dedup.unsent(df, known, ["ord"])
    assert sorted(r.ord for r in sent.collect()) == [2]  # as numbers, though "1000" < "95" as text
    state = known.selectExpr("id", "price", "'new' AS reason", "'t' AS sent_at")
    assert {(r.id, r.price) for r in dedup.registry_after(state, sent, F.lit("t2")).collect()} == {("1", 90.0), ("2", 1000.0)}


def test_sanity(spark):
    df = rows(spark, [("9", "5", "500", 0), ("5", "5", "1500", 1), (None, "5", None, 2), ("5", None, "50000", 3)], ["floor", "floor_total", "price_m2", "ord"])
    assert [r.drop_reason for r in sanity.floor_integrity(df).orderBy("ord").collect()] == ["floor_gt_floor_total (9.0>5.0)", None, None, None]
    got = [r.drop_reason for r in sanity.hard_bounds(df, C.number(F.col("price_m2")), 1000, 30000, "price_m2", "s").orderBy("ord").collect()]
    assert got == ["price_m2_too_low_hard (500.0)", None, "no_valid_price_m2_for_sanity_check", "price_m2_too_high_hard (50000.0)"]
    values = [10, 11, 12, 13, 14, 15, 16, 90]
    many = spark.createDataFrame([("a", float(v)) for v in values] + [("b", float(v)) for v in values[1:]], "rooms string, x double")
    out = sanity.outliers(many, F.col("x"), F.col("rooms"), "x", "s").where("drop_reason is not null").collect()
    assert [(r.rooms, r.x) for r in out] == [("a", 90.0)]  # seven rows are left alone


RICH = ["id", "price", "price_m2", "square_m2", "rooms", "floor", "floor_total", "finish_type", "owner_name", "seller_type", "is_identity_confirmed", "photo_count", "premium_markers", "extra_attributes", "furniture", "requires_manual_review", "latitude", "longitude", "complex_name", "ord"]


def test_features(spark):
    data = [
        ("1", "100", "-1", "50", " Студия ", "1", "9", "чистовая", "Хозяин", None, None, "12", "['a','b']", '{"parking":"да","view":0}', "полностью", "no", "51", "71", "", 0),
        ("2", "100", "7", None, "2.0", "9", "5", "Черновая", "Bob", "x", None, "3", "[]", "[]", "—", "true", None, "71", "c", 1),
        ("3", "0", None, "5", "Other", "5", "5", None, "", "Собственник", "True", "abc", None, None, None, None, None, None, None, 2),
    ]
    got = features.enrich(rows(spark, data, RICH)).withColumn("w", F.array_join(features.warnings(), ";")).withColumn("q", features.quality_score()).orderBy("ord").collect()
    assert [r["_price_m2"] for r in got] == [2.0, 7.0, None]
    assert [r["_rooms"] for r in got] == ["studio", "2", "other"]
    assert [r["_extreme"] for r in got] == [True, False, True]
    assert [r["_finish"] for r in got] == ["finished", "rough", "unknown"]
    assert [tuple(r["_seller"])[:2] for r in got] == [("owner", 1.0), ("agent", 0.8), ("owner", 1.0)]
    assert [r.q for r in got] == [40 + 20 + 10 + 8 + 5 + 2 + 10, 40 - 15 + 2 - 15, 30]
    assert got[1].w == "нет_square_m2;нет_координат;мало_фото;есть_red_flag;риелтор_или_агентство"
    again = features.enrich(features.enrich(rows(spark, data, RICH)))
    assert again.where("_price_m2 = 2.0").count() == 1


@pytest.mark.parametrize(("level", "size", "data", "quality", "diff", "bench", "total"), [
    ("4", 8, 0.9, 46.0, 0.1432, 0.731, 84.3), ("5", 27, 0.9, 59.0, 0.2334, 0.743, 87.6), ("4", 31, 1.0, 79.0, 0.1712, 0.857, 93.7), ("5", 49, 1.0, 95.0, -0.1539, 0.753, 32.0),
])
def test_golden_scores(spark, level, size, data, quality, diff, bench, total):
    found = one(spark, scoring.cohort_confidence(F.lit(level), F.lit(size)).alias("b"))
    assert found.b == bench
    got = one(spark, scoring.composite(F.lit(diff), F.lit(quality), F.lit(bench), F.lit(data)))[0]
    assert round(got, 1) == total


def test_verdicts(spark):
    v = lambda d, c, r=False: one(spark, scoring.verdict(F.lit(d).cast("double"), F.lit(c), F.lit(r)))[0]
    assert [v(0.10, 0.75), v(0.10, 0.74), v(0.13, 0.55), v(0.17, 0.2), v(0.18, 0.2)] == [V.FIND, V.FAIR, V.FIND, V.FAIR, V.FIND]
    assert [v(-0.07, 0.8), v(-0.07, 0.6), v(None, 0.9), v(0.5, 0.9, True)] == [V.OVERPRICED, V.FAIR, V.TOO_LITTLE, V.BY_HAND]


def test_ladder_falls_through_levels(spark):
    near, far = 51.0 + 0.5 / 111.2, 51.0 + 2.0 / 111.2

    def row(i, price, lat, complex_=None, rooms="2", street=""):
        return (str(i), float(price), 50.0, rooms, lat, 71.4, complex_, street)

    fields = "id string, price double, square_m2 double, rooms string, latitude double, longitude double, complex_id string, street string"
    base = [row(i, 5000 + 10 * i, near, "A" if i < 3 else None) for i in range(6)] + [row(10 + i, 5200 + i, far) for i in range(4)] + [row(20, 1, 51.5, rooms="9")]
    pool = spark.createDataFrame(base, fields)
    t = [row(100, 4000, 51.0, "A"), row(101, 4000, 51.0), row(102, 4000, 51.0 + 4 / 111.2), row(103, 4000, None), row(104, 4000, 51.0, rooms="7"), row(20, 2, 51.5, rooms="9"), row(0, 5000, 51.0, "A")]
    got = {r.id: (r.status, r.cohort_level, r.cohort_size) for r in scoring.score(spark.createDataFrame(t, fields), pool).collect()}
    assert got == {
        "100": ("scored", "1-2", 3), "101": ("scored", "4", 6), "102": ("scored", "5", 4), "103": ("scored", "6", 10), "104": ("no_comparables", "none", 0),
        "20": ("no_comparables", "none", 0), "0": ("scored", "4", 5),
    }
    out = scoring.export(scoring.score(spark.createDataFrame(t, fields), pool))
    assert out.columns[-24:] == scoring.EXTRAS and out.where("verdict_reason is null").count() == 0


def test_leaving_one_out_of_quartiles(spark):
    values = [3.0, 3.0, 4.0, 8.0, 9.0, 11.0, 11.0, 15.0, 20.0, 21.0]
    pool = spark.createDataFrame([(v,) for v in values], "_price_m2 double")
    stats = cohort.order_statistics(pool)
    for v in values:
        rest = list(values)
        rest.remove(v)
        q = statistics.quantiles(rest, n=4, method="inclusive")
        got = stats.select(*(cohort.left_out(F.lit(v), F.col("n"), F.col("os"), i) for i in (0, 1))).first()
        assert list(got) == pytest.approx([q[0], q[2]])


def test_changes(spark):
    known = rows(spark, [("1", "100", 0), ("2", "50", 0), ("3", None, 0)], ["id", "price", "ord"])
    now = rows(spark, [("1", "90", 1), ("2", "60", 1), ("3", "5", 1), ("4", "7", 1)], ["id", "price", "ord"])
    assert {(r.id, r.reason, r.old_price) for r in changes.changes(now, known).collect()} == {("1", "price_drop", 100.0), ("4", "new", None)}
    assert changes.changes(now, known.limit(0)).count() == 0 and changes.changes(now, known, warm_up=True).count() == 0
    pages = rows(spark, [("1", "5", 1), ("1", "6", 2), ("2", "7", 9)], ["id", "price", "ord"])
    assert [(r.id, r.price) for r in changes.window_of(pages, 5, page="ord").collect()] == [("1", "6")]


def test_overlay_and_upsert(spark):
    details = rows(spark, [("1", "10", "A", 0), ("1", "11", "B", 1), ("2", "5", "C", 0)], ["id", "price", "title", "ord"])
    work = rows(spark, [("1", "", 7), ("3", "8", 8)], ["id", "price", "ord"])
    got = {r.id: (r.price, r.title) for r in changes.overlay(work.drop("ord"), details, ["ord"]).collect()}
    assert got == {"1": ("11", "B"), "3": ("8", None)}
    base = details.where("ord = 0").withColumn("scraped_at", F.lit("t0")).drop("ord")
    listed = rows(spark, [("1", "9", 0), ("2", "", 0), ("3", "4", 0)], ["id", "price", "ord"]).withColumn("scraped_at", F.lit("t1"))
    fetched = rows(spark, [("3", "4", 0)], ["id", "price", "ord"]).selectExpr("id", "price", "'N' AS title", "'t1' AS scraped_at")
    assert {tuple(r) for r in changes.upsert(base, listed, fetched).collect()} == {("1", "9", "A", "t1"), ("2", "5", "C", "t0"), ("3", "4", "N", "t1")}


def test_answers():
    good = '<think>x</think>```json\n{"finish_type":"чистовая","red_flags":["залив","залив"],"premium_markers":[" a ","a",""],"extra_attributes":{"k":1}}\n```'
    assert extraction.parse_answer(good) == {"finish_type": "чистовая", "red_flags": ["залив"], "premium_markers": ["a"], "extra_attributes": '{"k": 1}'}
    assert all(extraction.parse_answer(x) is None for x in ("", "[]", '{"finish_type":"x"}', '{"red_flags":["?"]}', '{"red_flags":"залив"}', '{"extra_attributes":[]}', None))


def test_extraction_uses_and_extends_the_cache(spark):
    df = rows(spark, [("1", "тихо", 0), ("2", "был залив", 1), ("3", "fail", 2)], ["id", "full_description", "ord"])
    df = df.selectExpr("*", "'' AS furniture", "'' AS rent_renovation", "'' AS suited_for")
    empty = spark.createDataFrame([], f"cache_key string, text_hash string, result {extraction.RESULT}")
    answer = lambda text: "broken" if "fail" in text else extraction.keyword_answer(text)
    out, cache = extraction.analyse(df, empty, answer, attempts=1)
    assert {r.id: (r.requires_manual_review, r.llm_skipped_error) for r in out.collect()} == {"1": (False, False), "2": (True, False), "3": (False, True)}
    kept = cache.toPandas()
    assert sorted(kept.cache_key) == ["1", "2"]

    def refuse(text):
        raise RuntimeError

    again, after = extraction.analyse(df.where("id <> '3'"), spark.createDataFrame(cache.collect(), cache.schema), refuse, attempts=1)
    assert again.where("llm_skipped_error").count() == 0 and after.count() == 2


def test_baseline_keeps_or_logs_every_row(spark):
    data = [(str(i % 25), "h" if i % 7 == 0 else "", str(100000 + i), f"o{i}", None, f"2026-01-{i % 20 + 1:02}", None, "s" if i % 3 else "", "1", "3", "2", str(30 + i % 9), i) for i in range(40)]
    df = rows(spark, data, PLACE).withColumn("storage", F.lit("live")).withColumn("floor_total", F.lit("5"))
    kept, dropped, _ = baseline.build(df, ["ord"])
    a, b = [r.ord for r in kept.collect()], [r.ord for r in dropped.collect()]
    assert sorted(a + b) == list(range(40)) and dropped.where("drop_stage is null or drop_reason is null").count() == 0


def test_journal_and_message(spark):
    df = spark.createDataFrame([("1", "T<b>", 5.0, V.FIND, 0.125, "http://u"), ("2", None, 5.0, V.BY_HAND, 0.05, None)], "id string, title string, price double, verdict string, diff_pct double, url string")
    got = notify.candidates(df, "s", "new").where(notify.sane() & notify.sendable())
    out = notify.journal_rows(got, F.lit("t"))
    assert out.columns == V.JOURNAL and out.count() == 1
    text = out.select(notify.message()).first()[0]
    assert "T&lt;b&gt;" in text and "+12.5%" in text and text.startswith("🔥")


def test_freshness(spark):
    df = rows(spark, [("2026-08-14T06:34:55+00:00", "2020-01-01", 0), ("bad", "2026-08-13", 1), (None, "", 2)], ["a", "b", "ord"])
    got = [r[0] for r in df.orderBy("ord").select(C.freshness("a", "b")).collect()]
    assert got == [datetime(2026, 8, 14, 6, 34, 55), datetime(2026, 8, 13), None]


def test_each_miss_is_one_call(spark, tmp_path):
    """Rows and cache come from the same answers, made once; an answer cut off is tried again."""
    calls = tmp_path / "calls"

    def extractor(text):
        with open(calls, "a") as f:
            f.write("x\n")
        if "cut" in text and calls.read_text().count("x") % 2:
            return '{"finish_type": null}', "length"
        return extraction.keyword_answer(text), "stop"

    rows = spark.createDataFrame([(str(i), f"text {i}") for i in range(5)], "id string, full_description string")
    for c in ("furniture", "rent_renovation", "suited_for"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    none = spark.createDataFrame([], f"cache_key string, text_hash string, result {extraction.RESULT}")
    out, cache = extraction.analyse(rows, none, extractor)
    assert out.count() == 5 and cache.count() == 5 and calls.read_text().count("x") == 5
    out.collect(), cache.collect()
    assert calls.read_text().count("x") == 5
    calls.write_text("")
    one_row = rows.limit(1).withColumn("full_description", F.lit("cut"))
    assert not extraction.analyse(one_row, none, extractor)[0].first().llm_skipped_error and calls.read_text().count("x") == 2


def test_a_pool_that_cannot_be_used_is_an_error(spark):
    pool = spark.createDataFrame([(str(i), "100", "50", "2") for i in range(10)], "id string, price string, square_m2 string, rooms string")
    assert scoring.checked_pool(pool).count() == 10
    for bad in (pool.limit(9), pool.limit(0), pool.drop("rooms")):
        with pytest.raises(ValueError):
            scoring.checked_pool(bad)


def test_the_outbox_keeps_the_cache(spark, tmp_path):
    """A second batch with the same texts makes no call, whatever the batches' numbers."""
    from tessera.streaming import cycle

    listed = listings(spark, "/root/testdata/sf0.001")
    batch = targets(listed).limit(30).withColumn("rent_renovation", F.lit(None).cast("string")).withColumn("suited_for", F.lit(""))
    calls = tmp_path / "calls"
    calls.write_text("")

    def extractor(text):
        with open(calls, "a") as f:
            f.write("x\n")
        return extraction.keyword_answer(text)

    folder = str(tmp_path / "out")
    run = cycle.outbox(folder, source="fast", reason="new", details=None, pool=pool(listed), order=ORDER, now="now", extractor=extractor)
    run(batch, 3)
    n = calls.read_text().count("x")
    assert n > 0
    run(batch, 7)
    assert calls.read_text().count("x") == n


def test_values_at_ranks(spark):
    """Quantiles by cells against sorting, with ties, negative values, zeros, a null key, one value and none."""
    import random

    from tessera.operators import ranks

    r = random.Random(7)
    table = [(k, r.choice([0.0, -0.5, 1e9, -3.25, 7.0]) if r.random() < 0.2 else round(r.uniform(-50, 1e6), r.randint(0, 6))) for k in ("a", "b", None) for _ in range(r.randint(300, 900))]
    table += [("one", 5.0), ("none", None), ("two", 1.0), ("two", -1.0), ("same", 3.0)] + [("same", 3.0)] * 9
    df = spark.createDataFrame(table, "k string, v double").repartition(7)
    got = {x.k: x for x in ranks.quantiles(df, ["k"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()}
    want = {x.k: x for x in df.where("v is not null").groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).collect()}
    assert set(got) == set(want) == {"a", "b", None, "one", "two", "same"}
    for k, x in got.items():
        assert (x.n, [x.q1, x.q2, x.q3]) == (want[k].n, want[k].q)
    whole = ranks.ranked(df, [], "v", lambda n: {"low": F.lit(0), "high": n - 1}).first()
    values = [v for _, v in table if v is not None]
    assert tuple(whole) == (len(values), min(values), max(values))
    assert ranks.ranked(df.limit(0), ["k"], "v", lambda n: {"x": F.lit(0)}).count() == 0


def test_review_needs_no_flags(spark):
    """A row to be reviewed goes, also where its flags are missing."""
    table = spark.createDataFrame([("1", "True", None, "False"), ("2", "True", '["x"]', "False"), ("3", "False", None, "False"), ("4", None, None, "True")], "id string, requires_manual_review string, red_flags string, is_installment_segment string")
    got = {r.id: r.drop_reason for r in extraction.exclude_flagged(table).collect()}
    assert got == {"1": "requires_manual_review (red_flags=[])", "2": "requires_manual_review (red_flags=['x'])", "3": None, "4": "is_installment_segment"}


def _km(a, b):
    from math import asin, cos, radians, sin, sqrt

    (y, x), (v, u) = a, b
    h = sin((radians(v) - radians(y)) / 2) ** 2 + cos(radians(y)) * cos(radians(v)) * sin((radians(u) - radians(x)) / 2) ** 2
    return 2 * 6371.0 * asin(sqrt(min(1.0, h)))


def _around(r, n, ids, at=51.0):
    """n random rows (_id, _finish, _rooms, _lat, _lon, _price_m2, _extreme): few points, some without coordinates, rooms or price, ids from ids."""
    point = lambda: (round(at + r.randint(0, 12) * 0.004, 6), round(71.0 + r.randint(0, 12) * 0.007, 6)) if r.random() < 0.9 else (None, 71.0)
    made = [(str(r.choice(ids)), r.choice(["rough", "finished"]), r.choice(["1", "2", "2", None]), *point(), r.choice([None, 5.0, 7.0, float("nan"), float("inf"), *[round(r.uniform(1, 900), 1) for _ in range(9)]]), r.random() < 0.2) for _ in range(n)]
    return made + [("", "rough", "2", at, 71.0, 3.0, False)]


_AROUND = "_id string, _finish string, _rooms string, _lat double, _lon double, _price_m2 double, _extreme boolean"


@pytest.mark.parametrize("at", [51.0, -0.02, -69.0])
def test_counts_within_radii(spark, at):
    """Numbers of rows around against all pairs, also of targets that are in the pool, whose own rows do not count but where the id is blank."""
    import random

    r = random.Random(5)
    pool_, some = _around(r, 400, range(60), at), _around(r, 60, range(50, 70), at)
    got = {}
    for own in (True, False):
        found = cohort.counts_within(spark.createDataFrame(some, _AROUND).withColumn("n", F.monotonically_increasing_id()), spark.createDataFrame(pool_, _AROUND), {"near": 1.0, "far": 3.0}, some=own)
        got[own] = sorted((x._id, x._finish, x._rooms, x._lat, x._lon, x.near, x.far) for x in found.collect())
        want = []
        for t in some:
            d = [_km(t[3:5], p[3:5]) for p in pool_ if None not in (t[2], t[3], p[3]) and p[1:3] == t[1:3] and (not own or p[0] != t[0] or t[0] == "")]
            near, far = sum(x <= 1 for x in d), sum(x <= 3 for x in d)
            want += [(*t[:5], near, far)] if far else []
        assert got[own] == sorted(want) and want
    assert got[True] != got[False]


def test_copies_make_no_pairs_in_a_radius(spark):
    """3 billion pairs, if targets and rows of one point were paired one by one."""
    row = lambda n: spark.range(n).selectExpr("cast(id as string) AS _id", "'rough' AS _finish", "'2' AS _rooms", "51d AS _lat", "71d AS _lon")
    found = cohort.counts_within(row(30_000), row(100_000), {"near": 1.0, "far": 3.0}, some=False)
    assert [tuple(x) for x in found.groupBy("near", "far").count().collect()] == [(100_000, 100_000, 30_000)]


def test_rooms_written_as_their_key(spark):
    """Rooms that are spared the patterns have the key that these give."""
    texts = ["2", " 2 ", "02", "+2", "-2", "-0", "2.0", "2e0", "2_0", "999999999999999", "9007199254740993", "", " ", None, "Studio", "студия", "nan", "5 и более", "1d"]
    df = spark.createDataFrame([(x,) for x in texts], "rooms string").select("rooms", features.rooms_key().alias("k"))
    assert {x.rooms: x.k for x in df.collect()} == dict(zip(texts, ["2", "2", "2", "2", "-2", "0", "2", "2", "20", "999999999999999", "9007199254740992", None, None, None, "studio", "studio", "nan", "5 и более", "1d"]))


def test_medians_within_a_radius(spark):
    """Sizes and medians against all pairs: rows without price, NaN, infinity, equal prices, ids left out, and medians between two cells."""
    import random

    r = random.Random(11)
    pool_, some = _around(r, 700, range(40)), [(i, *x[1:5], x[0] if i % 2 and x[0] else None) for i, x in enumerate(_around(r, 50, range(30, 50)))]
    places = spark.createDataFrame(some, "_gid long, _finish string, _rooms string, _lat double, _lon double, _own string")
    for own in (True, False):
        given = places if own else places.where("_own is null")
        got = {x._gid: (x.size, str(x.median)) for x in cohort.medians_within(given, spark.createDataFrame(pool_, _AROUND), 1.0, 3, some=own).select("_gid", F.col("size"), F.round("median", 6).alias("median")).toLocalIterator()}
        pairs = [(g, p[5]) for g, f, m, y, x, o in some for p in pool_ if (own or o is None) and None not in (m, y, p[3]) and p[1:3] == (f, m) and p[0] != o and _km((y, x), p[3:5]) <= 1]
        want = spark.createDataFrame(pairs, "g long, v double").groupBy("g").agg(F.count("*").alias("n"), F.round(F.median("v"), 6).alias("m")).where("n >= 3")
        assert got == {x.g: (x.n, str(x.m)) for x in want.collect()} and len(got) > 5


def test_the_superseded_scorer_makes_no_pairs_of_copies(spark):
    """100 million pairs, if targets and pool rows of one point were paired one by one; one target is in the pool, one has no rooms."""
    from tessera.operators import superseded

    row = "cast(id + {0} as string) AS id, {1} AS price, 50d AS square_m2, '2' AS rooms, 51d AS latitude, 71d AS longitude"
    pool_ = spark.range(50_000).selectExpr(*row.format(0, "5000d + id").split(", "))
    some = spark.range(2_000).selectExpr(*row.format(49_999, "4000d").split(", ")).withColumn("rooms", F.when(F.col("id") != "50000", F.col("rooms")))
    got = superseded.score(some, pool_).groupBy("status", "cohort_level", "cohort_size", "base_price_m2").count().collect()
    assert {tuple(x) for x in got} == {("scored", "4", 50_000, 599.99, 1998), ("scored", "4", 49_999, 599.98, 1), ("no_comparables", None, None, None, 1)}
