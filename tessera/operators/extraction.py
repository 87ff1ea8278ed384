"""Facts from free text: a cached extractor, its answers' validation, and the exclusion of flagged rows.

No model is bundled: an extractor is any function from a text to an answer in JSON. ``keyword_answer`` is a
deterministic one for tests and offline use."""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import truth
from ..functions.runtime import cut
from ..functions.vocabulary import FINISHED, PRE_FINISHED, RED_FLAGS, ROUGH
from .features import cache_key, prompt_text, severe, text_hash

RESULT = "struct<finish_type:string,red_flags:array<string>,premium_markers:array<string>,extra_attributes:string>"
EMPTY = {"finish_type": None, "red_flags": [], "premium_markers": [], "extra_attributes": "{}"}


def parse_answer(raw: str | None) -> dict | None:
    """The validated facts of an answer, or None if it breaks a rule. Thoughts and code fences around the JSON are dropped."""
    text = re.sub(r"(?s)<think>.*?</think>", "", raw or "").strip()
    fenced = re.fullmatch(r"(?is)```(?:json)?\s*(.*?)\s*```", text)
    try:
        found = json.loads(fenced[1] if fenced else text)
    except ValueError:
        return None
    if not isinstance(found, dict):
        return None
    finish = found.get("finish_type")
    lists = [found.get(k, []) for k in ("red_flags", "premium_markers")]
    extra = found.get("extra_attributes", {})
    strings = all(isinstance(x, list) and all(isinstance(y, str) for y in x) for x in lists)
    if finish not in (None, ROUGH, PRE_FINISHED, FINISHED) or not strings or not isinstance(extra, dict) or not set(lists[0]) <= set(RED_FLAGS):
        return None
    markers = dict.fromkeys(y for x in lists[1] if (y := x.strip()))
    return {"finish_type": finish, "red_flags": list(dict.fromkeys(lists[0])), "premium_markers": list(markers), "extra_attributes": json.dumps(extra, ensure_ascii=False)}


def keyword_answer(text: str) -> str:
    """An answer from plain words, for tests."""
    low = text.lower()
    finish = next((f for f in (ROUGH, PRE_FINISHED, FINISHED) if re.search(rf"\b{f}", low)), None)
    flags = [f for f in RED_FLAGS if f.replace("_", " ") in low and f"нет {f.replace('_', ' ')}" not in low]
    return json.dumps({"finish_type": finish, "red_flags": flags, "premium_markers": [], "extra_attributes": {}}, ensure_ascii=False)


def chat(url: str, model: str, instructions: str, max_tokens: int = 600, timeout: float = 120.0) -> Callable[[str], tuple[str, str]]:
    """An extractor that asks a chat endpoint over HTTP at temperature 0: the answer and why it ended."""

    def extractor(text: str) -> tuple[str, str]:
        body = {"model": model, "max_tokens": max_tokens, "temperature": 0, "messages": [{"role": "system", "content": instructions}, {"role": "user", "content": text}]}
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310  the caller names the endpoint
            choice = json.load(answer)["choices"][0]
        return choice["message"]["content"] or "", choice.get("finish_reason") or ""

    return extractor


def extract(rows: DataFrame, extractor: Callable[[str], str | tuple[str, str]], attempts: int = 5, backoff: float = 0.0, concurrency: int = 4) -> DataFrame:
    """(cache_key, text_hash, text) with result and failed. An empty text gets the empty result without a call; a failed one too, and is marked.

    An extractor gives an answer, or an answer and why it ended: one cut off ("length") is tried again. So many calls run at a time in a task."""
    schema = f"cache_key string, text_hash string, result {RESULT}, failed boolean"

    def one(text: str) -> tuple[dict, bool]:
        if not text:
            return EMPTY, False
        for i in range(attempts):
            try:
                answer = extractor(text)
                answer, ended = answer if isinstance(answer, tuple) else (answer, "")
                if ended != "length" and (found := parse_answer(answer)):
                    return found, False
            except Exception:  # noqa: BLE001, S110  the extractor's own failure counts as a failed attempt
                pass
            time.sleep(backoff * (i + 1))
        return EMPTY, True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                found = list(pool.map(one, batch["text"]))
                yield pd.DataFrame({"cache_key": batch["cache_key"], "text_hash": batch["text_hash"], "result": [x[0] for x in found], "failed": [x[1] for x in found]})

    return rows.select("cache_key", "text_hash", "text").mapInPandas(run, schema)


def analyse(rows: DataFrame, cache: DataFrame, extractor: Callable[[str], str], version: str = "1", instructions: str = "", attempts: int = 5) -> tuple[DataFrame, DataFrame]:
    """rows with the extracted columns, and the cache (cache_key, text_hash, result) after: hits need an equal key and hash, misses are computed once, failures are not cached."""
    text = prompt_text()
    keyed = rows.withColumn("_text", text).withColumns({"_key": cache_key(F.col("_text"), version, instructions), "_hash": text_hash(F.col("_text"), version, instructions)})
    known = cache.select(F.col("cache_key").alias("_key"), F.col("text_hash").alias("_hash"), F.col("result").alias("_hit"))
    misses = keyed.select("_key", "_hash", "_text").dropDuplicates(["_key", "_hash"]).join(known, ["_key", "_hash"], "left_anti")
    made = cut(extract(misses.select(F.col("_key").alias("cache_key"), F.col("_hash").alias("text_hash"), F.col("_text").alias("text")), extractor, attempts))
    new = made.select(F.col("cache_key").alias("_key"), F.col("text_hash").alias("_hash"), F.col("result").alias("_made"), "failed")
    joined = keyed.join(known, ["_key", "_hash"], "left").join(new, ["_key", "_hash"], "left").withColumn("_r", F.coalesce("_hit", "_made"))
    out = joined.withColumns(
        {
            "finish_type": F.col("_r.finish_type"), "red_flags": F.to_json("_r.red_flags"), "premium_markers": F.to_json("_r.premium_markers"), "extra_attributes": F.col("_r.extra_attributes"),
            "requires_manual_review": severe(F.col("_r.red_flags")), "llm_skipped_error": F.coalesce("failed", F.lit(False)),
        }
    ).drop("_key", "_hash", "_text", "_hit", "_made", "_r", "failed")
    fresh = made.where("not failed").select("cache_key", "text_hash", "result")
    kept = cache.join(fresh.select("cache_key"), "cache_key", "left_anti").select("cache_key", "text_hash", "result")
    return out, kept.unionByName(fresh)


def exclude_flagged(df: DataFrame) -> DataFrame:
    """Adds drop_stage and drop_reason for rows that need a review by hand or are sold by instalments."""
    review = F.when(truth(F.col("requires_manual_review")), F.concat(F.lit("requires_manual_review (red_flags="), F.replace(F.coalesce(F.col("red_flags").cast("string"), F.lit("[]")), F.lit('"'), F.lit("'")), F.lit(")")))
    paid = F.when(truth(F.col("is_installment_segment")), "is_installment_segment")
    reason = F.concat_ws("; ", review, paid)
    return df.withColumn("drop_reason", F.when(reason != "", reason)).withColumn("drop_stage", F.when(reason != "", "stage2_exclusion"))
