"""Checkpoints in the shared folder, and connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: the one in spark.checkpoint.dir. Only a session of one machine may do without."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = context.getConf().get("spark.checkpoint.dir")
        if not path and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the session's checkpoint folder. The shuffle files that led to them go as soon as they are written."""
    spark = df.sparkSession
    _folder(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df = df.select("*")  # a plan takes the setting when it is made
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path for a new folder in the shared checkpoint folder."""
    return f"{_folder(spark)}/{name}-{spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()}"


#: A key with over a HUBS-th of the rows, and over LEAST_HUB, is a hub: there are at most HUBS.
HUBS, LEAST_HUB = 256, 1000


def _joined(rows: DataFrame, key: str, other: str, table: DataFrame, hub: int) -> DataFrame:
    """rows left join table(key, up), where rows of keys with over ``hub`` rows do not meet in one task.

    There are at most HUBS such keys, so they and their values are broadcast; their rows are dealt out by their other column."""
    hot = rows.groupBy(key).count().where(F.col("count") > hub).select(F.col(key).alias("_hub"))
    hot = hot.join(table.select(F.col(key).alias("_hub"), F.col("up").alias("_hub_up")), "_hub", "left")
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col("_hub"), "left")
    probe = F.when(F.col("_hub").isNotNull(), F.col(other)).otherwise(F.col(key))
    found = rows.withColumn("_probe", probe).join(table.select(F.col(key).alias("_probe"), "up"), "_probe", "left")
    return found.select(key, other, F.when(F.col("_hub").isNotNull(), F.col("_hub_up")).otherwise(F.col("up")).alias("up"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node it can reach.

    Each round points every node at the smallest of its parents, links the other parents to that
    one, and replaces parents by their own parents, until a round changes nothing: parents only ever fall, so that comes to pass.
    Only joins and combinable aggregates are used, a hub's rows are dealt out over all tasks, and no link reaches the driver."""
    tree = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("r")).distinct()
    )
    seen = None
    while True:
        # one pass tells whether anything has changed, and the most rows of one node
        ends = tree.select(F.col("x").alias("k"), F.lit(0).alias("end"), "x", "r").union(tree.select("r", F.lit(1), "x", "r"))
        by = ends.groupBy("k", "end").agg(F.count("*").alias("n"), F.sum(F.xxhash64("x", "r").cast("decimal(38,0)")).alias("h"))
        now = by.agg(F.sum("n"), F.sum("h"), F.max(F.when(F.col("end") == 0, F.col("n"))), F.max(F.when(F.col("end") == 1, F.col("n")))).first()
        if now[:2] == seen:
            break
        seen = now[:2]
        hub = max(LEAST_HUB, (now[0] or 0) // (2 * HUBS))
        least = tree.groupBy("x").agg(F.min("r").alias("up"))
        hooked = _joined(tree, "x", "r", least, hub) if (now[2] or 0) > hub else tree.join(least, "x")
        hooks = hooked.where("r <> up").select(F.col("r").alias("x"), F.col("up").alias("r"))
        every = least.select("x", F.col("up").alias("r")).union(hooks)
        above = least.select(F.col("x").alias("r"), "up")
        raised = _joined(every, "r", "x", above, hub) if (now[3] or 0) > hub else every.join(above, "r", "left")
        tree = cut(raised.select("x", F.coalesce("up", "r").alias("r")).distinct())
    roots = tree.select(F.col("r").alias("node")).distinct()
    return tree.select(F.col("x").alias("node"), F.col("r").alias("root")).union(roots.select("node", F.col("node").alias("root")))
