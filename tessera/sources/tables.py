"""Reading listing files and states: CSV with header repair, JSON states, quarantine of broken ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import last_by

SEPARATORS = (",", ";", "\t")
DETAIL = [
    "id", "url", "title", "price", "price_m2_text", "price_m2", "rooms", "square_m2", "floor", "floor_total", "district", "city", "street", "house_num", "latitude", "longitude",
    "complex_id", "complex_alias", "complex_name", "furniture", "rent_renovation", "priv_dorm", "bathrooms_count", "kitchen_studio", "suited_for", "full_description", "photo_urls",
    "photo_count", "photo_set_hash", "seller_type", "owner_name", "is_identity_confirmed", "published_date", "created_at", "added_at", "storage", "scraped_at",
]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _header(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).limit(1).collect()
    return first[0][0].lstrip("\ufeff").rstrip("\r") if first else ""


def separator(header: str) -> str:
    """The first separator by which the header has an id and a price; else a comma."""
    names = lambda s: {x.strip().strip('"') for x in header.split(s)}
    return next((s for s in SEPARATORS if {"id", "price"} <= names(s)), ",")


def repaired(names: list[str]) -> tuple[list[str], bool]:
    """Header names with the first of several complex_id taken for a missing id."""
    if "id" in names or names.count("complex_id") < 2:
        return names, False
    at = names.index("complex_id")
    return [*names[:at], "id", *names[at + 1 :]], True


def csv(spark: SparkSession, path: str, columns: list[str] | None = None, repair: bool = False) -> DataFrame:
    """A CSV file or folder, all text: UTF-8 with or without BOM, quoted cells over several lines. A missing path is empty with columns.

    repair: finds the separator and repairs a header with two complex_id; raises if there is no id."""
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns or DETAIL]))
    reader = spark.read.option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    if not repair:
        return reader.option("header", True).csv(path)
    header = _header(spark, path)
    sep = separator(header)
    names, _ = repaired([x.strip().strip('"') for x in header.split(sep)])
    if "id" not in names:
        raise ValueError(f"{path} has no column id")
    seen: dict[str, int] = {}
    unique = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        unique.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in unique])
    return reader.option("sep", sep).option("header", True).option("enforceSchema", True).schema(schema).csv(path)


def details(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """The upsert table: empty if its header is not that of details; blank ids are left out; the last row of an id stays."""
    rows = csv(spark, path)
    if not {"id", "price"} <= set(rows.columns):
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in DETAIL]))
    return last_by(rows, "id", order)


def state(spark: SparkSession, path: str, value: str, quarantine: bool = False) -> DataFrame:
    """A JSON object {id: value} as rows (id, value); value: the type of the values. Missing: no rows.

    quarantine: a file that does not parse is renamed with .corrupted and counts as empty, so that the next run is a warm-up."""
    empty = spark.createDataFrame([], f"id string, value {value}")
    if not exists(spark, path):
        return empty
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", f"map<string,{value}>", {"mode": "PERMISSIVE"}).alias("m"))
    if quarantine and parsed.where("m is null").limit(1).count():
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).rename(fs_path, spark._jvm.org.apache.hadoop.fs.Path(f"{path}.corrupted"))
        return empty
    return parsed.select(F.explode("m").alias("id", "value"))
