"""The registry of sent items as a stream: one keyed state, whatever the sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def merged(**sources: DataFrame) -> DataFrame:
    """Streams (or tables) of several sources as one, each row with its source, for one registry: what one source has sent, another does not send again."""
    rows = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    out = rows[0]
    for df in rows[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def sent(candidates: DataFrame, order: list[str]) -> DataFrame:
    """A stream (id, price, ...) to the rows that are new or cheaper than any before of their id; order tells which come first within a batch.

    The state of an id is one number, the lowest price sent. It is kept for ever, as the registry is; streams of several sources are
    unioned first, so that no lock is needed."""
    schema = candidates.schema

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        least = state.get[0] if state.exists else float("inf")
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        rows = rows[rows["price"].notna()]
        before = rows["price"].cummin().shift(fill_value=float("inf")).clip(upper=least)
        out = rows[rows["price"] < before]
        if len(rows):
            state.update((min(least, float(rows["price"].min())),))
        yield out

    return candidates.where("id is not null").groupBy("id").applyInPandasWithState(run, schema, "least double", "append", GroupStateTimeout.NoTimeout)
