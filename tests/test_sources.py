"""Files, pages, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions.vocabulary import JOURNAL
from tessera.sources import pages, sinks, tables


def test_csv_with_repair(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('\ufeffcomplex_id,price,complex_id,note\n1,10,c,"two\nlines, ""q"""\n', encoding="utf-8")
    got = tables.csv(spark, str(p), repair=True).collect()
    assert [tuple(r) for r in got] == [("1", "10", "c", 'two\nlines, "q"')]
    (tmp_path / "c.csv").write_text("\ufeffid;price\n1;2\n", encoding="utf-8")
    assert tables.csv(spark, str(tmp_path / "c.csv"), repair=True).first()[:] == ("1", "2")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        tables.csv(spark, str(tmp_path / "b.csv"), repair=True)
    assert tables.csv(spark, str(tmp_path / "none.csv")).columns == tables.DETAIL
    assert tables.details(spark, str(tmp_path / "b.csv"), ["scraped_at"]).count() == 0


def test_headers():
    assert tables.separator("id;price") == ";" and tables.separator("id\tprice") == "\t" and tables.separator("a|b") == ","
    assert tables.repaired(["complex_id", "x", "complex_id"]) == (["id", "x", "complex_id"], True)
    assert tables.repaired(["id", "complex_id", "complex_id"])[1] is False


def test_states(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"1": 5, "2": None}))
    bad.write_text("{broken")
    assert {tuple(r) for r in tables.state(spark, str(good), "bigint").collect()} == {("1", 5), ("2", None)}
    assert tables.state(spark, str(bad), "bigint", quarantine=True).count() == 0
    assert (tmp_path / "bad.json.corrupted").exists() and not bad.exists()
    assert tables.state(spark, str(tmp_path / "none"), "bigint").count() == 0


def test_cards(spark):
    html = '<div class="x a-card" data-id="7"><br><a href="/q">t</a><div class="a-card__price">1 250 ₸</div></div><div class="a-card"></div><div class="a-card" data-id="8"><p>no</p></div>'
    got = pages.cards(spark.createDataFrame([(3, html), (4, None)], "page_number long, html string"), "https://h/").collect()
    assert [tuple(r) for r in got] == [("7", "https://h/7", 1250, 3), ("8", "https://h/8", None, 3)]


def test_detail_page(spark):
    data = {"advert": {"title": "T", "price": 0, "rooms": 2, "square": 45, "photos": [{"src": "b"}, {"src": "a"}, {}], "address": {"street": "S"}, "map": {"lat": 51.1, "lon": 71.4}, "storage": "live"},
            "adverts": [{"priceM2": 5, "owner": {"title": "", "isChecked": True}, "addedAt": "2026-01-02"}]}
    html = (
        f"<script>window.digitalData = {{\"listing\":{{\"pagesCount\":12}}}};</script><script>window.data = {json.dumps(data)};</script>"
        '<div class="offer__price">9 000 ₸</div><div class="js-description">one<br><b>two</b></div>'
        '<div class="offer__info-item" data-name="flat.floor"><div class="offer__advert-short-info">3 из 9</div></div>'
        '<div class="offer__info-item" data-name="map.complex"><a href="/complex/show/city/alias/">Name</a></div>'
    )
    df = spark.createDataFrame([("5", html), ("6", "<p>none</p>")], "id string, html string")
    got = {r.id: r for r in pages.detail_rows(df, F.lit("now"), "https://h/").collect()}
    r = got["5"]
    assert (r.price, r.floor, r.floor_total, r.complex_alias, r.complex_name, r.full_description) == ("9000", "3", "9", "alias", "Name", "one two")
    assert (r.photo_count, r.photo_urls, r.square_m2, r.added_at, r.published_date) == ("2", '["b","a"]', "45", "2026-01-02", "2026-01-02")
    assert got["6"].price is None and got["6"].photo_count == "0" and got["6"].photo_set_hash is None
    assert df.select(pages.page_count(F.col("html"))).collect()[0][0] == 12 and df.select(pages.page_count(F.col("html"))).collect()[1][0] == 1
    assert spark.range(1).select(*pages.floors(F.lit("этаж 4"))).first()[:] == (4, None)


def test_fetch_retries(spark):
    def opener(url):
        if url == "bad":
            raise OSError
        return f"<{url}>"

    got = pages.fetch(spark.createDataFrame([("1", "a"), ("2", "bad")], "id string, url string"), opener, attempts=2, backoff=0).collect()
    assert [(r.id, r.html) for r in got] == [("1", "<a>"), ("2", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", 'x "q"\ny')], "id string, t string")
    sinks.snapshot(df, str(tmp_path / "s"))
    assert tables.csv(spark, str(tmp_path / "s")).first()[:] == ("1", 'x "q"\ny')
    sinks.snapshot(df.limit(0), str(tmp_path / "e"))
    assert tables.csv(spark, str(tmp_path / "e")).columns == ["id", "t"]
    rows = spark.createDataFrame([tuple("v" for _ in JOURNAL)], ", ".join(f"{c} string" for c in JOURNAL))
    for batch in (0, 0, 1):
        sinks.journal(rows, str(tmp_path / "j"), batch=batch)
    assert spark.read.parquet(str(tmp_path / "j")).count() == 2
    with pytest.raises(ValueError):
        sinks.journal(df, str(tmp_path / "j"))
    built = []
    for _ in range(2):
        sinks.once(spark, str(tmp_path / "o"), lambda: built.append(1) or df)
    assert built == [1]
    sent = []
    assert sinks.send(df.select("id"), sent.append, gap=0) == 1 and sent == ["1"] and sinks.send(df, None) == 0


def test_a_failed_write_leaves_the_old_state(spark, tmp_path):
    path = str(tmp_path / "state")
    sinks.state(spark.createDataFrame([(1,)], "id int"), path)
    sinks.state(spark.read.parquet(path).withColumn("id", F.col("id") + 1), path)  # read from where it goes
    assert [r.id for r in spark.read.parquet(path).collect()] == [2]
    with pytest.raises(Exception):
        sinks.state(spark.read.parquet(path).withColumn("id", F.raise_error(F.lit("broken"))), path)
    assert [r.id for r in spark.read.parquet(path).collect()] == [2] and [p.name for p in tmp_path.iterdir()] == ["state"]
    sinks.append_csv(spark.createDataFrame([], "a string"), str(tmp_path / "log"))
    sinks.append_csv(spark.createDataFrame([("x",)], "a string"), str(tmp_path / "log"))
    assert [tuple(r) for r in tables.csv(spark, str(tmp_path / "log")).collect()] == [("x",)]


def site(pages_):
    cards = lambda n: "".join(f'<div class="a-card" data-id="{n}{i}"><div class="a-card__price">{100 * n + i}</div></div>' for i in range(2)) + '<div class="a-card" data-id="99"><div class="a-card__price">%d</div></div>' % n
    return {f"u{n}": f'<script>window.digitalData = {{"listing":{{"pagesCount":{pages_}}}}};</script>{cards(n)}' for n in range(1, pages_ + 1)}


def test_list_scan_goes_on_where_it_broke_off(spark, tmp_path):
    from tessera.sources import scan

    pages_ = site(7)
    calls = tmp_path / "calls"

    def opener(url, broken=(), stop=None):
        with open(calls, "a") as f:
            f.write(url + "\n")
        if url in broken:
            raise OSError(url)
        return pages_[url]

    folder = str(tmp_path / "scan")
    assert scan.progress(spark, f"{folder}/progress") == {}
    scan.save_progress(spark, f"{folder}/progress", {"run_finished": False, "last_completed_page": 4, "pages": 7})
    pages.cards(spark.createDataFrame([(n, pages_[f"u{n}"]) for n in range(1, 5)], "page_number long, html string")).write.parquet(f"{folder}/cards/block=1")
    got = scan.list_scan(spark, folder, lambda n: f"u{n}", lambda u: opener(u, broken=("u6",)), block=2, attempts=1)
    want = {f"{n}{i}": 100 * n + i for n in (1, 2, 3, 4, 5, 7) for i in range(2)} | {"99": 7}
    assert {r.id: r.price for r in got.collect()} == want
    assert set(calls.read_text().split()) == {"u5", "u6", "u7"}
    assert scan.progress(spark, f"{folder}/progress")["run_finished"]
    again = scan.list_scan(spark, folder, lambda n: f"u{n}", opener, most_pages=2, attempts=1)  # a new run, from the first page
    assert {r.id for r in again.collect()} == {"10", "11", "20", "21", "99"}
    assert scan.list_scan(spark, str(tmp_path / "dead"), lambda n: "none", opener, attempts=1).count() == 0


def test_detail_scan_fetches_each_id_once(spark, tmp_path):
    from tessera.sources import scan

    calls = tmp_path / "calls"

    def opener(url):
        with open(calls, "a") as f:
            f.write(url + "\n")
        if url == "u3":
            raise OSError
        return '<div class="offer__price">5</div>'

    todo = spark.createDataFrame([(str(i), f"u{i}") for i in range(6)], "id string, url string")
    got = scan.detail_scan(spark, str(tmp_path / "scan"), todo, opener, F.lit("now"), block=2, attempts=1)
    assert sorted(r.id for r in got.collect()) == ["0", "1", "2", "4", "5"]
    assert sorted(calls.read_text().split()) == [f"u{i}" for i in range(6)]


def test_breaker_waits_after_failures_in_a_row():
    from tessera.sources.scan import Breaker

    waits, answers = [], iter([1, 0, 0, 0, 0, 1, 0, 1])

    def opener(url):
        if not next(answers):
            raise OSError
        return url

    get = Breaker(opener, failures=3, cooldown=180.0, sleep=waits.append)
    seen = []
    for _ in range(8):
        try:
            get("u")
            seen.append(len(waits))
        except OSError:
            seen.append(-1)
    assert waits == [180.0] and seen == [0, -1, -1, -1, -1, 1, -1, 1]


def test_cells_with_python_literals(spark):
    from tessera.functions import columns as C

    cells = ['["a","b"]', "['a', \"it's\"]", "['say \"x\"', 'it\\'s']", "('a', 'b',)", "[]", "no list", "['a", None, "['é', 'None']"]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(C.json_list(F.col("c")).alias("x")).collect()
    assert [r.x for r in got] == [["a", "b"], ["a", "it's"], ['say "x"', "it's"], ["a", "b"], [], None, None, None, ["é", "None"]]
    maps = ["{'parking': True, 'view': None, \"o'k\": 1.5}", '{"a":"b"}', "{}", "x"]
    got = spark.createDataFrame([(c,) for c in maps], "c string").select(C.json_map(F.col("c")).alias("x")).collect()
    assert [r.x for r in got] == [{"parking": "true", "view": None, "o'k": "1.5"}, {"a": "b"}, {}, None]
    assert spark.range(1).select(C.first_chars(F.lit("ab" * 300))).first()[0] == "ab" * 100
    long = "[" + ", ".join(["'word'"] * 100_000) + "]"
    assert spark.createDataFrame([(long,)], "c string").select(F.size(C.json_list(F.col("c")))).first()[0] == 100_000


def test_finding_and_checking(spark, tmp_path, monkeypatch):
    from tessera.config import Config, find

    (tmp_path / "a" / "b" / "c").mkdir(parents=True)
    (tmp_path / "a" / "one.csv").write_text("x")
    (tmp_path / "a" / "b" / "c" / "deep.csv").write_text("x")
    assert find(str(tmp_path / "one.csv"), str(tmp_path)) == str(tmp_path / "a" / "one.csv")
    with pytest.raises(FileNotFoundError):
        find("deep.csv", str(tmp_path))
    (tmp_path / "a" / "b" / "one.csv").write_text("x")
    with pytest.raises(RuntimeError):
        find("one.csv", str(tmp_path))
    monkeypatch.setenv("MESSAGES_TOKEN", "secret-token")
    monkeypatch.setenv("MESSAGES_CHAT", "1")
    said = Config({"pool": str(tmp_path)}).check(spark)
    assert said[-1] == "messages = on (secret...)" and "secret-token" not in " ".join(said)
    with pytest.raises(FileNotFoundError):
        Config({"pool": str(tmp_path / "none")}).check(spark)


def test_entry_points(spark, tmp_path):
    from tessera.__main__ import main

    lines = ["id,price,square_m2,rooms,scraped_at", *(f"{i},{1000 + i},50,2,2026-01-01" for i in range(40))]
    (tmp_path / "rows.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "old.csv").write_text("id,price\n1,9999\n2,5\n")
    at = lambda name: str(tmp_path / name)
    main(["new", "--input", at("rows.csv"), "--known", at("old.csv"), "--output", at("new")], spark)
    assert tables.csv(spark, at("new")).count() == 38
    main(["drops", "--input", at("rows.csv"), "--known", at("old.csv"), "--output", at("drops")], spark)
    assert [(r.id, float(r.price_drop)) for r in tables.csv(spark, at("drops")).collect()] == [("1", 8998.0)]
    with pytest.raises(FileNotFoundError):
        main(["score", "--input", at("rows.csv"), "--pool", at("none"), "--output", at("x")], spark)


def test_cycles_and_streams(spark, tmp_path):
    """Snapshots with a gap in their numbers, the fast and the slow turn, and two sources in one registry."""
    from tessera.streaming import cycle, registry

    folder = str(tmp_path / "states")
    run = cycle.snapshot_changes(folder)
    schema = "snapshot int, id string, price double"
    run(spark.createDataFrame([(0, "a", 5.0), (0, "b", 5.0)], schema), 0)
    run(spark.createDataFrame([(2, "a", 4.0), (2, "c", 1.0), (5, "a", 3.0), (5, "c", 1.0)], schema), 1)
    got = {(r.id, r.reason, r.old_price) for r in spark.read.parquet(f"{folder}/changes").collect()}
    assert got == {("c", "new", None), ("a", "price_drop", 5.0), ("a", "price_drop", 4.0)}

    def opener(url):
        if url.endswith("3"):
            raise OSError
        return f'<div class="offer__price">{url[-1]}00</div>'

    window = spark.createDataFrame([("1", "u1", 90.0), ("2", "u2", 80.0), ("3", "u3", 1.0)], "id string, url string, price double")
    known = spark.createDataFrame([("1", 100.0), ("9", 1.0)], "id string, price double")
    first, state = cycle.fast_job(window, None, opener, F.lit("now"), attempts=1)
    assert first.count() == 0 and state.count() == 3
    found, _ = cycle.fast_job(window, known, opener, F.lit("now"), attempts=1)
    assert {(r.id, r.reason, r.old_price, r.price) for r in found.collect()} == {("1", "price_drop", 100.0, "100"), ("2", "new", None, "200")}
    listed = window.withColumn("scraped_at", F.lit("now"))
    details = spark.createDataFrame([("1", "7", "before")], "id string, price string, scraped_at string")
    drops, after, state = cycle.slow_job(listed, details, known, opener, F.lit("now"), attempts=1)
    assert [(r.id, r.reason, r.price_drop) for r in drops.collect()] == [("1", "price_drop", 10.0)]
    assert {(r.id, r.price) for r in after.collect()} == {("1", "90.0"), ("2", "200")} and state.count() == 3

    def broken():
        raise OSError

    assert cycle.unless_failed(broken, lambda x: 1) is None and cycle.unless_failed(lambda: 2, lambda x: x + 1) == 3
    both = registry.merged(fast=known, slow=known.withColumn("note", F.lit("x")))
    assert sorted((r.source, r.id) for r in both.collect()) == [("fast", "1"), ("fast", "9"), ("slow", "1"), ("slow", "9")]
