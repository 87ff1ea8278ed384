"""From scored candidates to journal rows and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import escaped, filled, have, number, percent
from ..functions.vocabulary import BY_HAND, FIND, JOURNAL


def candidates(rows: DataFrame, source: str, reason: str) -> DataFrame:
    """rows with source, a reason where none is given, and numeric price and old_price, from new_price and the old price where needed."""
    rows = have(rows, "reason", "price", "old_price", "new_price")
    price = F.coalesce(number(F.col("price")), number(F.col("new_price")))
    why = F.coalesce(F.when(F.col("reason").cast("string") != "", F.col("reason")), F.lit(reason))
    return rows.withColumns({"source": F.lit(source), "reason": why, "price": price, "old_price": number(F.col("old_price"))})


def sane() -> Column:
    return filled(F.col("id")).isNotNull() & F.coalesce(number(F.col("price")) > 0, F.lit(False))


def sendable() -> Column:
    """A find, or one to review by hand that is at least a tenth below its base."""
    diff = number(F.col("diff_pct"))
    return F.coalesce((F.col("verdict") == FIND) | ((F.col("verdict") == BY_HAND) & (diff >= 0.10)), F.lit(False))


def journal_rows(rows: DataFrame, sent_at: Column) -> DataFrame:
    """The 27 columns of the journal as text; what is missing is empty."""
    rows = have(rows.withColumn("sent_at", sent_at), *JOURNAL)
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in JOURNAL))


def message(link_text: str = "Открыть") -> Column:
    """The text of a message for a journal row."""
    given = lambda c, other: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(other))
    was = F.when(~F.coalesce(F.col("old_price"), F.lit("")).isin("", "0"), F.concat(F.lit(" (было "), F.col("old_price"), F.lit(" ₸)"))).otherwise("")
    price = F.concat(given("price", "—"), F.lit(" ₸"), was)
    icon = F.when(F.col("verdict") == FIND, "🔥").otherwise("🔎")
    diff = F.coalesce(percent(number(F.col("diff_pct")), signed=True), F.lit("—"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.concat_ws(
        "\n",
        text(icon, " <b>", escaped(given("title", "Без названия")), "</b>"),
        text("💰 ", escaped(price)),
        text("📉 Отклонение от базы: ", diff),
        text("🏆 Вердикт: ", escaped(given("verdict", "—"))),
        text("ℹ️ ", escaped(F.col("verdict_reason"))),
        text("👤 Продавец: ", escaped(given("seller_class", "—")), " (уверенность ", escaped(given("seller_confidence", "—")), ")"),
        text("📊 Когорта: уровень ", escaped(given("cohort_level", "—")), ", n=", escaped(given("cohort_size", "—")), ", уверенность бенчмарка ", escaped(given("benchmark_confidence", "—"))),
        F.when(F.col("data_warnings") != "", text("⚠️ ", escaped(F.col("data_warnings")))),
        F.when(F.col("url") != "", text('🔗 <a href="', escaped(F.col("url")), f'">{link_text}</a>')),
    )
