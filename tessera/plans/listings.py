"""The driver's tables seen as listings, with gaps and odd cases put in by expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_tax", "l_discount"]

#: Runs alike in Spark SQL and DuckDB.
COLUMNS = [
    'CAST(l_orderkey AS STRING) AS id',
    'l_orderkey',
    'l_shipdate AS scraped_at',
    'CAST(NULL AS TIMESTAMP) AS added_at',
    'CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE l_extendedprice END AS price',
    'CASE WHEN l_partkey % 59 = 0 THEN -1.0 END AS price_m2',
    'nullif(l_quantity, 7) AS square_m2',
    'CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_linenumber AS STRING) END AS rooms',
    "CASE WHEN l_partkey % 7 = 0 THEN ' Archive ' WHEN l_partkey % 3 = 0 THEN '' ELSE 'live' END AS storage",
    "CASE WHEN l_returnflag = 'R' THEN 'черновая' WHEN l_returnflag = 'A' THEN ' Чистовая' WHEN l_partkey % 5 = 0 THEN 'предчистовая' END AS finish_type",
    "CASE l_suppkey % 5 WHEN 0 THEN 'Owner' WHEN 1 THEN 'агентство' WHEN 2 THEN 'other' END AS seller_type",
    "CASE l_suppkey % 3 WHEN 0 THEN 'Хозяин' WHEN 1 THEN 'Seller ' || CAST(l_suppkey AS STRING) ELSE '' END AS owner_name",
    "CASE WHEN l_suppkey % 2 = 0 THEN 'True' ELSE 'False' END AS is_identity_confirmed",
    "'Street ' || CAST(l_suppkey % 50 AS STRING) AS street",
    "CASE WHEN l_partkey % 17 = 0 THEN '' ELSE CAST(l_partkey % 4 AS STRING) END AS house_num",
    'l_partkey % 9 + 1 AS floor',
    'CASE WHEN l_partkey % 31 = 0 THEN 4 WHEN l_partkey % 29 = 0 THEN NULL ELSE 9 END AS floor_total',
    '51 + (l_suppkey % 97) * CAST(0.003 AS DOUBLE) AS latitude',
    'CAST(71.2 AS DOUBLE) + (l_partkey % 89) * CAST(0.004 AS DOUBLE) AS longitude',
    'CASE WHEN l_partkey % 10 = 0 THEN p_brand END AS complex_id',
    "CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'h' || CAST(l_partkey % 700 AS STRING) END AS photo_set_hash",
    'CAST(l_linenumber * 2 - 2 AS STRING) AS photo_count',
    "CASE l_linenumber % 4 WHEN 0 THEN 'нет' WHEN 1 THEN ' Полностью' WHEN 2 THEN 'частично' END AS furniture",
    '''CASE l_linenumber % 3 WHEN 0 THEN '[]' WHEN 1 THEN '["a","b"]' ELSE '["a","b","c","d"]' END AS premium_markers''',
    '''CASE l_partkey % 4 WHEN 0 THEN '{"parking":"да","view":"нет"}' WHEN 1 THEN '{"security":true,"balcony":""}' ELSE '{}' END AS extra_attributes''',
    "CASE WHEN l_partkey % 11 = 0 THEN '' ELSE p_name END AS full_description",
    "CASE WHEN l_partkey % 97 = 0 THEN 'True' ELSE 'False' END AS requires_manual_review",
    "'False' AS is_installment_segment",
    'p_name AS title',
    'l_partkey',
    'l_suppkey',
    'l_linenumber',
    'l_extendedprice',
    'l_quantity',
    'l_tax',
    'l_discount',
]
LISTINGS = f"SELECT {', '.join(COLUMNS)} FROM lineitem JOIN part ON l_partkey = p_partkey"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def listings(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.expr("l_partkey = p_partkey"))
    return joined.selectExpr(*COLUMNS)


def pool(rows: DataFrame) -> DataFrame:
    """All rows but the targets, as the frozen reference pool."""
    return rows.where("l_orderkey % 100 <> 0")


def targets(rows: DataFrame) -> DataFrame:
    """The rows that are scored: every id divisible by 100."""
    return rows.where("l_orderkey % 100 = 0")
