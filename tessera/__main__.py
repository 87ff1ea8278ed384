"""Entry points: python -m tessera clean|incoming|baseline|score|old-score|drops|new ..., each a thin wrapper of the functions."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import baseline, changes, cleaning, scoring, superseded
from .sources import sinks, tables

TIES = ["scraped_at", "url"]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera", description=__doc__)
    jobs = out.add_subparsers(dest="job", required=True)

    def job(name: str, *inputs: str, outputs: tuple[str, ...] = ("output",)) -> None:
        one = jobs.add_parser(name)
        for x in inputs:
            one.add_argument(f"--{x}", required=True)
        for x in outputs:
            one.add_argument(f"--{x}", required=True)
        one.add_argument("--key", default="id")

    job("clean", "input", outputs=("output", "dropped"))
    job("incoming", "input")
    job("baseline", "input", outputs=("output", "dropped"))
    job("score", "input", "pool")
    job("old-score", "input", "pool")
    job("drops", "input", "known")
    job("new", "input", "known")
    return out


def _order(df: DataFrame) -> list[str]:
    return [c for c in TIES if c in df.columns] or df.columns[:1]


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    given = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    Config({x: getattr(given, x) for x in ("input", "pool", "known") if hasattr(given, x)}).check(spark)
    rows = tables.csv(spark, given.input, repair=True)
    if given.job == "clean":
        sinks.kept_and_dropped(cleaning.hard_clean(rows, _order(rows)), given.output, given.dropped)
    elif given.job == "incoming":
        sinks.snapshot(cleaning.soft_clean(rows, _order(rows)), given.output)
    elif given.job == "baseline":
        kept, dropped, _ = baseline.build(rows, _order(rows))
        sinks.snapshot(kept, given.output)
        sinks.snapshot(dropped, given.dropped)
    elif given.job in ("score", "old-score"):
        pool = scoring.checked_pool(tables.csv(spark, given.pool, repair=True))
        found = scoring.export(scoring.score(rows, pool)) if given.job == "score" else superseded.score(rows, pool).select(*rows.columns, "status", "cohort_level", "cohort_size", "confidence_weight", "base_price_m2", "base_price_m2_corrected", "diff_pct")
        sinks.snapshot(found, given.output)
    else:
        known = tables.csv(spark, given.known, repair=True)
        found = changes.price_drops(rows, known, given.key, F.lit(None).cast("string")) if given.job == "drops" else changes.new_ids(rows, known, given.key)
        sinks.snapshot(found, given.output)


if __name__ == "__main__":
    main()
