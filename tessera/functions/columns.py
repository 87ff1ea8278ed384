"""Column expressions: coercions, numbers, places and text. All run in the JVM unless said otherwise."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocabulary import EARTH_KM

TRUE = ("true", "1", "yes", "y")
TRUE_BASELINE = (*TRUE, "да")
TRUE_OLD = ("true", "1", "yes")
_NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?\s*$"
_SPECIAL = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"


def have(df: DataFrame, *names: str) -> DataFrame:
    """df with a null column for each name that it lacks."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def number(c: Column, locale: bool = False) -> Column:
    """A cell as double, null if it is none. Text must be a plain decimal, NaN or infinity. locale: blanks within are dropped and a comma is a point."""
    text = c.cast("string")
    if locale:
        text = F.replace(F.regexp_replace(text, r"[\s ]", ""), F.lit(","), F.lit("."))
    plain = F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit(""))).when(text.rlike(_SPECIAL), text)
    # the type is known when the plan is made, so only one branch is left in it
    typed = F.typeof(c).isin("double", "float", "tinyint", "smallint", "int", "bigint")
    return F.when(typed, c.try_cast("double")).otherwise(plain.try_cast("double"))


def truth(c: Column, words: Iterable[str] = TRUE) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*words), F.lit(False))


def filled(c: Column) -> Column:
    """The cell, null if it is empty or blank."""
    text = F.trim(c.cast("string"))
    return F.when(text != "", c)


def clamp(c: Column, low: float, high: float) -> Column:
    """Null stays null, which greatest and least alone would not grant."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def freshness(*names: str) -> Column:
    """The first of these cells that parses as a time, in UTC."""
    return F.coalesce(*(F.col(n).cast("string").try_cast("timestamp") for n in names))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def exclusive_quartiles(values: Column) -> tuple[Column, Column]:
    """First and third quartile of a sorted array by the exclusive method; for arrays of at least two."""
    n = F.size(values)

    def cut(i: int) -> Column:
        j = F.greatest(F.lit(1), F.least(n - 1, F.floor(F.lit(i) * (n + 1) / 4).cast("int")))
        delta = F.lit(i) * (n + 1) - j * 4
        return (F.get(values, j - 1) * (4 - delta) + F.get(values, j) * delta) / 4

    return cut(1), cut(3)


def decimal_round(c: Column, places: int) -> Column:
    """Rounds a double by its exact binary value, halves to even, as printing does: for export. A pandas UDF."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield x.map(lambda v: v if pd.isna(v) else round(v, places))

    return run(c)


def percent(c: Column, places: int = 1, signed: bool = False) -> Column:
    """A share as percent text. A pandas UDF, since the JVM rounds halves up."""
    spec = f"{'+' if signed else ''}.{places}%"

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield x.map(lambda v: None if pd.isna(v) else format(v, spec))

    return run(c)


def json_list(c: Column) -> Column:
    """A cell with an array of strings in JSON or as a Python literal; null if it is neither."""
    schema = "array<string>"
    return F.coalesce(F.from_json(c, schema), F.from_json(literal_json(c), schema))


def json_map(c: Column) -> Column:
    """A cell with an object in JSON or as a Python literal, its values as text; null if it is none."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.from_json(literal_json(c), "map<string,string>"))


def literal_json(c: Column) -> Column:
    """A Python literal of lists, tuples, dicts, strings, numbers, True, False and None as JSON text; other text comes out as some text that is no JSON.

    The text is taken apart into strings and what is between them; the patterns are possessive, so long cells need no stack."""
    parts = F.regexp_extract_all(c, F.lit(r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^'"]++|['"]"""), F.lit(0))

    def part(x: Column) -> Column:
        inner = F.substring(x, 2, F.length(x) - 2)
        quoted = F.concat(F.lit('"'), F.replace(F.replace(inner, F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        bare = F.translate(x, "()", "[]")
        for python, other in (("True", "true"), ("False", "false"), ("None", "null")):
            bare = F.regexp_replace(bare, rf"\b{python}\b", other)
        bare = F.regexp_replace(bare, r",\s*([\]}])", "$1")
        return F.when(x.startswith("'") & x.endswith("'") & (F.length(x) > 1), quoted).when(x.startswith('"'), x).otherwise(bare)

    return F.array_join(F.transform(parts, part), "")


def first_chars(c: Column, n: int = 200) -> Column:
    """At most the first n characters of a text, as for a log line."""
    return F.substring(c.cast("string"), 1, n)


def set_hash(items: Column) -> Column:
    """SHA-256 of a set of strings, whatever their order; null if empty."""
    return F.when(F.size(items) > 0, F.sha2(F.array_join(F.array_sort(items), "|"), 256))


def escaped(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
