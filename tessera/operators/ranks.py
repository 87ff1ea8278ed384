"""Values at given ranks of a group, without gathering or sorting the group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells to a unit of the fourth root of a value.
CELLS = 1024


def cell(v: Column) -> Column:
    """A number that never falls as v rises: roots are rounded correctly, so their order is that of the values. NaN is above all."""
    return F.when(F.isnan(v), 2**63 - 1).otherwise((F.floor(F.sqrt(F.sqrt(F.abs(v))) * CELLS) * F.signum(v) + F.when(v < 0, -1).otherwise(0)).cast("long"))


def ranked(rows: DataFrame, by: list[str], value: str, ranks: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """(by..., n, names...): the numbers of non-null values, and the values at ranks(n), from 0, by name. Groups without a value have no row; a null key is a group.

    Values are counted, and the counts added up by cell of the value, of which a group has a bounded number; ranks fall into cells, and only the
    values in those are put in order. All but the cells are dealt out by value, so a group of any size has no task of its own."""
    counts = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")).groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_b", cell(F.col("_v")))
    group = by or [F.lit(1)]
    cells = counts.groupBy(*by, "_b").agg(F.sum("_c").alias("_m"))
    cells = cells.withColumn("_before", F.sum("_m").over(Window.partitionBy(*group).orderBy("_b")) - F.col("_m")).withColumn("n", F.sum("_m").over(Window.partitionBy(*group)))
    names = ranks(F.col("n"))
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in names.items()))).alias("_r")
    asked = cells.select(*by, "_b", "_m", "_before", "n", asked).where("_r.rank >= _before and _r.rank < _before + _m")
    asked = asked.select(*(F.col(k).alias(f"_k_{k}") for k in by), F.col("_b").alias("_at"), "_before", "n", F.col("_r.name").alias("_name"), F.col("_r.rank").alias("_rank"))
    same = F.col("_b") == F.col("_at")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    near = counts.join(asked, same)
    upto = F.sum("_c").over(Window.partitionBy(*by, "_name").orderBy("_v"))
    found = near.withColumn("_upto", F.col("_before") + upto).where(F.col("_rank").between(F.col("_upto") - F.col("_c"), F.col("_upto") - 1))
    return found.groupBy(*by).agg(F.first("n").alias("n"), *(F.max(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in names))


def between(low: Column, high: Column, place: Column) -> Column:
    """The value at a place between the ranks below and above it."""
    part = place - F.floor(place)
    return F.when((low == high) | (part == 0), low).otherwise((1 - part) * low + part * high)


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by..., n, names...): inclusive quantiles, interpolated."""
    place = lambda p: F.lit(p) * (F.col("n") - 1)
    found = ranked(rows, by, value, lambda n: {f"_{k}{end}": f(F.lit(p) * (n - 1)) for k, p in shares.items() for end, f in (("lo", F.floor), ("hi", F.ceil))})
    return found.select(*by, "n", *(between(F.col(f"_{k}lo"), F.col(f"_{k}hi"), place(p)).alias(k) for k, p in shares.items()))
