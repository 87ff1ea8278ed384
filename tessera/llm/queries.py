"""The ten operators as queries over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, licences, mixing, near_dedup, quality, secrets, substring_dedup, suffix_dedup, warc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """A sample of documents at the target weights."""
    drawn = mixing.mix(_table(spark, folder, "documents"))
    return drawn.select("doc_id", "topic", "n_tokens", F.round("probability", 6).alias("probability"), F.round("sample_weight", 6).alias("sample_weight"))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, folder, "documents")).drop("kept", "spans")


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, folder, "documents"))


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, folder, "documents")).drop("kept", "spans")


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Contaminated documents with the test items found in them."""
    return decontaminate.overlaps(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op7_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(_table(spark, folder, "documents")).select("doc_id", "line", "template", F.round("dice", 6).alias("dice"))


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, folder, "documents"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without an id are told as revisits of no page, as the SQL does, though the archive has the payload of one where no page holds it."""
    rows = warc.round_trip(_table(spark, folder, "pages"), nameless=True).drop("capture")
    named = F.col("page_id").isNotNull()
    return rows.withColumns({"record_type": F.when(named, F.col("record_type")).otherwise("revisit"), "refers_to": F.when(named, F.col("refers_to"))})


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(_table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_mix_sources, op2_suffix_dedup, op3_exact_dedup, op4_substring_dedup, op5_decontaminate, op6_quality, op7_licences, op8_near_dedup, op9_warc, op10_secrets)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = {
    "op1_mix_sources": mixing.sql(),
    "op2_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(0, n - 99)) AS s, h FROM d WHERE n >= 100),
k AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS k FROM w),
r AS (SELECT doc_id, s FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
i AS (SELECT doc_id, s, max(s) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100 AS before FROM r),
g AS (SELECT doc_id, s, count(*) FILTER (WHERE before IS NULL OR s > before) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM i),
m AS (SELECT doc_id, g, min(s) AS a, max(s) + 100 AS b FROM g GROUP BY ALL),
l AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM m),
p AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, string_agg(substr(h, (2 * e + 1)::BIGINT, (2 * (a - e))::BIGINT), '' ORDER BY a) AS head, max(b) AS last FROM l JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE head || substr(h, (2 * last + 1)::BIGINT) END)) AS kept_sha256 FROM d LEFT JOIN p USING (doc_id)""",
    "op3_exact_dedup": r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = first_value(doc_id) OVER best AS kept, sha256(t) AS text_sha256
FROM d WINDOW best AS (PARTITION BY t ORDER BY n DESC, doc_id)""",
    "op4_substring_dedup": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(generate_series(1, len(w) - 19)) AS i, w FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM s),
r AS (SELECT doc_id, i FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS j FROM r),
x AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS j FROM d),
y AS (SELECT x.doc_id, x.j, word, c.j IS NOT NULL AS gone FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.j = c.j),
z AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS gone, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM y GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN z USING (doc_id)""",
    "op7_licences": licences.sql(),
    "op8_near_dedup": r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS node FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.node),
m AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)""",
    "op9_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
b AS (SELECT page_id, strlen(t) AS n, sha1(t) AS h, (unhex(sha1(t))::BIT)::VARCHAR AS bits FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS head FROM b)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + list_sum(list_transform(range(0, 5), lambda j: CASE WHEN substr(bits, 5 * i + j + 1, 1) = '1' THEN 16 >> j::INT ELSE 0 END)))::INT, 1)), '') AS payload_digest,
  CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN head <> page_id THEN head END AS refers_to FROM m""",
}
