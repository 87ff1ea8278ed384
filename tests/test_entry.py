"""Every query runs on the smallest tables, and streams agree with their batch twins."""

import pytest

from tessera.plans import catalogue

DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("stream,batch", [("q_stream_registry", "q_registry"), ("q_stream_diff", "q_state_replace")])
def test_streams(spark, stream, batch):
    a, b = (sorted(map(str, catalogue.QUERIES[q](spark, DATA).collect())) for q in (stream, batch))
    assert a == b and a


@pytest.mark.parametrize("name", ["q_hard_clean", "q_photo_dedup", "q_addr_dedup", "q_iqr_exclusive", "q_score", "q_score_self", "q_old_score", "q_baseline", "q_notification_rows"])
def test_runs_like_duckdb(spark, name):
    import duckdb

    df = catalogue.QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in catalogue.SQL:
        assert got
        return
    con = duckdb.connect()
    for t in ("lineitem", "part", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    r = con.sql(catalogue.SQL[name])
    order = [r.columns.index(c) for c in df.columns]
    assert sorted(str(tuple(x)) for x in got) == sorted(str(tuple(x[i] for i in order)) for x in r.fetchall())


def test_a_batch_is_sent_once(spark):
    from pyspark.sql import functions as F

    from tessera.plans.listings import ORDER, listings, pool, targets
    from tessera.streaming.cycle import process

    rows = listings(spark, DATA)
    sent, journal, registry, _ = process(targets(rows), "fast", "new", None, pool(rows), None, ORDER, "now")
    registry = spark.createDataFrame(registry.collect(), registry.schema)
    assert sent.count() == journal.count() == registry.count() > 0
    again, _, after, _ = process(targets(rows), "fast", "new", None, pool(rows), registry, ORDER, "later")
    assert again.count() == 0 and after.where(F.col("sent_at") != "now").count() == 0
