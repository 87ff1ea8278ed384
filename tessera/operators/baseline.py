"""The frozen reference pool: clean, dedup, sanity, extraction, exclusion, with one log of all drops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import have
from ..functions.runtime import cut
from . import sanity
from .cleaning import hard_clean, split
from .dedup import by_address, by_photos
from .extraction import analyse, exclude_flagged


def build(rows: DataFrame, order: list[str], cache: DataFrame | None = None, extractor: Callable[[str], str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(pool, dropped, cache after). Duplicates go before the quartiles are taken. Without an extractor the extracted columns are as given.

    order: columns that settle ties, as rows have no order of their own."""
    rows = have(rows, "baseline_warning", "price_m2", "floor", "floor_total")
    logs = []

    def step(tagged: DataFrame) -> DataFrame:
        kept, dropped = split(tagged)
        logs.append(dropped)
        return kept

    kept = step(hard_clean(rows, order))
    # what each stage tags is read twice, as kept and as dropped
    kept = step(cut(by_photos(kept, order)))
    kept = step(cut(by_address(kept, order)))
    kept = step(sanity.floor_integrity(kept))
    for value, low, high, label, stage in (sanity.PRICE, sanity.AREA):
        kept = step(sanity.hard_bounds(kept, value(), low, high, label, stage))
        kept = step(cut(sanity.outliers(kept, value(), F.col("rooms"), label, stage)))
    after = None
    if extractor is not None:
        kept, after = analyse(kept, cache, extractor)
    kept = step(exclude_flagged(have(kept, "requires_manual_review", "red_flags", "is_installment_segment")))
    dropped = logs[0]
    for log in logs[1:]:
        dropped = dropped.unionByName(log, allowMissingColumns=True)
    return kept, dropped, after
