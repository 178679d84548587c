"""Evaluation of text recognition against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .quantiles import percentiles

KINDS = ("urls", "phone_numbers", "upi_ids", "amounts")


def evaluate(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Results (filename, folder, clean_text, execution_time_ms, fallback_used, error) with truth (filename, text): error rates and entity counts.

    Columns are null where a result failed or has no ground truth.
    """
    joined = results.join(truth.select("filename", F.col("text").alias("truth")), "filename", "left")
    usable = F.col("error").isNull() & F.col("truth").isNotNull()
    for name, column in (("_want", "truth"), ("_got", "clean_text")):
        joined = text.with_entities(joined, F.when(usable, F.col(column)), name)
    matched = lambda k: F.size(F.filter(f"_want.{k}", lambda e: F.array_contains(F.col(f"_got.{k}"), e)))
    counts = {f"{k}_{name}": F.when(usable, value) for k in KINDS for name, value in (("expected", F.size(f"_want.{k}")), ("matched", matched(k)))}
    out = joined.withColumns({
        "cer": F.when(usable, text.character_error_rate(F.col("truth"), F.col("clean_text"))),
        "wer": F.when(usable, text.word_error_rate(F.col("truth"), F.col("clean_text"))),
        **counts,
    })
    return out.withColumns({"expected_urls": F.col("_want.urls"), "extracted_urls": F.col("_got.urls")}).drop("_want", "_got")


def url_failures(evaluated: DataFrame) -> DataFrame:
    """Expected URLs that were not extracted, with whether the host's first eight characters occur, and a snippet."""
    missing = evaluated.withColumn("expected", F.explode(F.array_except("expected_urls", "extracted_urls")))
    host = F.regexp_extract(F.when(F.col("expected").contains("://"), F.col("expected")).otherwise(F.concat(F.lit("http://"), "expected")), r"^[^:/?#]+://([^/?#]*)", 1)
    present = F.lower("clean_text").contains(F.lower(F.substring(host, 1, 8)))
    return missing.select("filename", "expected", "extracted_urls", present.alias("fragment_present"), F.translate(F.substring("clean_text", 1, 250), "\n", " ").alias("snippet"))


def metrics(evaluated: DataFrame) -> DataFrame:
    """Per folder and over all (folder null): counts, latency, error rates and entity preservation in percent.

    Percentiles are exact; they are found by counted ranges, so a folder with most of the results is in no task whole.
    """
    ok = F.col("error").isNull()
    time = F.when(ok, F.col("execution_time_ms"))
    kept = lambda k: F.coalesce(F.when(F.sum(f"{k}_expected") > 0, 100 * F.sum(f"{k}_matched") / F.sum(f"{k}_expected")), F.lit(0.0)).alias(f"{k}_pct")
    sets = evaluated.rollup("folder").agg(
        F.grouping("folder").alias("_all"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        F.avg(time).alias("avg_latency_ms"),
        F.count_if(ok & F.col("fallback_used")).alias("fallbacks"),
        F.avg("cer").alias("avg_cer"),
        F.avg("wer").alias("avg_wer"),
        *(kept(k) for k in KINDS),
    )
    times = evaluated.select("folder", time.alias("_ms")).select(F.explode(F.array(F.struct(F.lit(0).alias("_all"), "folder"), F.struct(F.lit(1).alias("_all"), F.lit(None).cast(evaluated.schema["folder"].dataType).alias("folder")))).alias("g"), "_ms").select("g.*", "_ms")
    found = percentiles(times, ["_all", "folder"], "_ms", {"median_latency_ms": 0.5, "p95_latency_ms": 0.95})
    same = (F.col("a._all") == F.col("b._all")) & F.col("a.folder").eqNullSafe(F.col("b.folder"))
    joined = sets.alias("a").join(found.alias("b"), same, "left")
    first = ("folder", "total", "successful", "failed", "avg_latency_ms")
    rest = ("fallbacks", "avg_cer", "avg_wer", *(f"{k}_pct" for k in KINDS))
    return joined.select(*(F.col(f"a.{c}") for c in first), "median_latency_ms", "p95_latency_ms", *(F.col(f"a.{c}") for c in rest))
