"""Features of a listing row: unit price, rooms, seller, finish, warnings, evidence of quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TRUE, filled, have, json_list, json_map, number, truth
from ..functions.vocabulary import FINISHED, PRE_FINISHED, ROUGH, SEVERE_FLAGS

INPUTS = (
    "id", "price", "price_m2", "square_m2", "rooms", "floor", "floor_total", "latitude", "longitude", "complex_id", "complex_name", "street", "furniture",
    "photo_count", "seller_type", "owner_name", "is_identity_confirmed", "finish_type", "premium_markers", "extra_attributes", "requires_manual_review", "is_installment_segment",
)


def unit_price(recompute: bool = False) -> Column:
    """price_m2 if above 0, else price by area if both are. recompute: price by area first, since a patched price leaves price_m2 stale."""
    price, area, given = number(F.col("price")), number(F.col("square_m2")), number(F.col("price_m2"))
    given, made = F.when(given > 0, given), F.when((price > 0) & (area > 0), price / area)
    return F.coalesce(made, given) if recompute else F.coalesce(given, made)


def rooms_key() -> Column:
    """"studio", a whole number, other text in lower case, or null."""
    text = F.lower(F.trim(F.col("rooms").cast("string")))
    whole = number(text)
    # most are written as the key is, and need no pattern; beyond 15 digits a double may not hold them
    plain = (F.length(text) <= 15) & (text.try_cast("long").cast("string") == text)
    return F.when(plain, text).when(text.isin("studio", "студия"), "studio").when(whole.isNotNull() & ~F.isnan(whole), whole.cast("long").cast("string")).when(text != "", text)


def seller() -> Column:
    """(class, confidence, reason) by the first rule that holds."""
    owner, kind = F.trim(F.coalesce(F.col("owner_name").cast("string"), F.lit(""))), F.lower(F.trim(F.coalesce(F.col("seller_type").cast("string"), F.lit(""))))
    made = lambda a, b, c: F.struct(F.lit(a).alias("class"), (b if isinstance(b, Column) else F.lit(b)).alias("confidence"), F.lit(c).alias("reason"))
    sure = F.when(truth(F.col("is_identity_confirmed")), 1.0).otherwise(0.85)
    return (
        F.when(owner == "Хозяин", made("owner", 1.0, "owner_name=Хозяин"))
        .when(kind.rlike("owner|хозя|собствен"), made("owner", sure, "seller_type указывает на владельца"))
        .when(kind.rlike("agent|риел|агент|company|компан"), made("agent", 0.90, "seller_type указывает на агентство/риелтора"))
        .when(owner != "", made("agent", 0.80, "указано конкретное имя вместо 'Хозяин'"))
        .otherwise(made("unknown", 0.35, "маркер владельца/риелтора не определён"))
    )


def finish_bucket(two_way: bool = False) -> Column:
    """rough, finished or unknown; two_way: all but rough is finished."""
    finish = F.lower(F.trim(F.coalesce(F.col("finish_type").cast("string"), F.lit(""))))
    other = F.lit("finished") if two_way else F.when(finish.isin(FINISHED, PRE_FINISHED), "finished").otherwise("unknown")
    return F.when(finish == ROUGH, "rough").otherwise(other)


def enrich(df: DataFrame, recompute_price_m2: bool = False, old: bool = False) -> DataFrame:
    """df with the derived columns, each starting with an underscore. Applying it twice changes nothing. old: the superseded rules."""
    df = have(df, *INPUTS)
    floor, total = number(F.col("floor")), number(F.col("floor_total"))
    extreme = (floor == 1) | (floor == total)
    if not old:
        extreme = extreme & (total >= floor)
    out = df.withColumns(
        {
            "_price_m2": unit_price(recompute_price_m2), "_rooms": rooms_key(), "_lat": number(F.col("latitude")), "_lon": number(F.col("longitude")),
            "_complex": F.coalesce(*(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for c in ("complex_id", "complex_name"))),
            "_extreme": F.coalesce(extreme & floor.isNotNull() & total.isNotNull(), F.lit(False)), "_finish": finish_bucket(two_way=old), "_seller": seller(),
        }
    )
    review = truth(F.col("requires_manual_review")) | truth(F.col("is_installment_segment"))
    if not old:
        review = review | F.coalesce(F.col("id").cast("string") == "", F.lit(True)) | F.col("_price_m2").isNull() | F.col("_rooms").isNull()
    return out.withColumn("_excluded", review)


def photos() -> Column:
    n = number(F.col("photo_count"))
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), 0).otherwise(n.cast("long"))


def warnings() -> Column:
    """The warnings of an enriched row, in their order."""
    n = photos()
    return F.array_compact(
        F.array(
            F.when(F.col("_price_m2").isNull(), "нет_price_m2"), F.when(F.col("_rooms").isNull(), "нет_rooms"), F.when(number(F.col("square_m2")).isNull(), "нет_square_m2"),
            F.when(F.col("_lat").isNull() | F.col("_lon").isNull(), "нет_координат"), F.when(F.coalesce(F.col("finish_type").cast("string"), F.lit("")) == "", "finish_type_неизвестен"),
            F.when(n <= 0, "нет_фото").when(n < 5, "мало_фото"), F.when(truth(F.col("requires_manual_review")), "есть_red_flag"),
            F.when(truth(F.col("is_installment_segment")), "рассрочка"),
            F.when(F.col("_seller.class") == "agent", "риелтор_или_агентство").when(F.col("_seller.class") == "unknown", "продавец_не_определён"),
        )
    )


def quality_score() -> Column:
    """Evidence of quality, from 0 to 100."""
    finish = F.lower(F.trim(F.coalesce(F.col("finish_type").cast("string"), F.lit(""))))
    raw = F.coalesce(F.trim(F.col("premium_markers").cast("string")), F.lit(""))
    markers, extra = json_list(raw), json_map(F.col("extra_attributes").cast("string"))
    furniture = F.lower(F.trim(F.coalesce(F.col("furniture").cast("string"), F.lit(""))))
    n = photos()
    points = lambda c, x: F.when(c, x).otherwise(0)
    # values that count as nothing; JSON null is null, false and 0 are equal to False
    named = lambda k: F.coalesce(~F.get_json_object(F.to_json(extra), f"$.{k}").isin("", "false", "0", "0.0", "не указано", "нет"), F.lit(False))
    total = (
        F.lit(40.0)
        + F.when(finish == FINISHED, 20).when(finish == PRE_FINISHED, 10).when(finish == ROUGH, -15).otherwise(0)
        + F.when(markers.isNotNull(), F.least(F.lit(15), F.size(markers) * 5)).when(raw.rlike(r"^\s*(\{\s*\}|null|false|0)?\s*$"), 0).when(raw.rlike(r"^\s*[{\"1-9t]"), 8).otherwise(0)
        + points((furniture != "") & ~furniture.isin("нет", "—", "-"), 8)
        + points(furniture.isin("полностью", "полностью меблирована", "полностью меблирован"), 5)
        + F.when(extra.isNotNull(), sum((points(named(k), 2) for k in ("parking", "security", "balcony", "view")), F.lit(0))).otherwise(0)
        + F.when(n >= 10, 10).when(n >= 5, 6).when(n >= 1, 2).otherwise(-10)
        - points(truth(F.col("requires_manual_review")), 15)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def severe(flags: Column) -> Column:
    return F.coalesce(F.arrays_overlap(flags, F.array(*map(F.lit, SEVERE_FLAGS))), F.lit(False))


def prompt_text() -> Column:
    """What an extractor reads of a row."""
    field = lambda label, c: F.concat(F.lit(label), F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")), F.lit("—")))
    text = F.concat_ws(
        "\n", F.coalesce(F.col("full_description").cast("string"), F.lit("")), field("Мебель: ", "furniture"), field("Ремонт (как есть на сайте): ", "rent_renovation"), field("Кому подходит: ", "suited_for")
    )
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def text_hash(text: Column, version: str, instructions: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{version}\n{instructions}\n"), text), 256)


def cache_key(text: Column, version: str, instructions: str) -> Column:
    return F.coalesce(filled(F.trim(F.col("id").cast("string"))), text_hash(text, version, instructions))


__all__ = ["TRUE", "cache_key", "enrich", "finish_bucket", "photos", "prompt_text", "quality_score", "rooms_key", "seller", "severe", "text_hash", "unit_price", "warnings"]
