"""End-to-end plans: messages or screenshots to scored, explained scans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, text
from ..operators import blocks, cache, corpus, intel, scoring
from ..scratch import Scratch


@dataclass
class Snapshots:
    """Tables that stand for live lookups: reputation, registrations, certificates and page results."""

    reputation: DataFrame
    whois: DataFrame
    certs: DataFrame
    pages: DataFrame


def detect(messages: DataFrame) -> DataFrame:
    """Adds normalized_text, urls and entities to messages (msg_id, text)."""
    return text.with_entities(messages, F.col("text"), normalized="normalized_text").withColumn("urls", F.col("entities.urls"))


#: What detection finds that no track, score or explanation reads.
_TEXTS = ("text", "normalized_text", "entities")


def score_messages(messages: DataFrame, intel_tables: Snapshots, as_of: Column, texts: bool = True) -> DataFrame:
    """Messages (msg_id, text) with all tracks, score and explanations.

    Only the URLs go through the snapshot joins; texts are shuffled once, by msg_id, in the fan-in.
    Four branches read what was detected and the text track, so these are written once in the shared folder.
    Without ``texts`` the columns of texts and entities are left out there and in the result, for callers that read none of them.
    """
    detected = labels.with_text_result(detect(messages), F.col("normalized_text"))
    if not texts:
        detected = detected.drop(*_TEXTS)
    detected = Scratch(messages.sparkSession, "scan").save(detected, "detected")
    urls = intel.explode_urls(detected.select("msg_id", "urls"))
    url_rows = intel.url_evidence(urls, intel_tables.reputation)
    domain_rows = intel.domain_evidence(urls, intel_tables.whois, intel_tables.certs, as_of)
    page_rows = intel.sandbox_evidence(detected.select("msg_id", "urls").filter(F.size("urls") > 0), intel_tables.pages)
    tracks = scoring.fan_in(detected, url_rows, domain_rows, page_rows)
    return scoring.explain(scoring.score_summary(scoring.score(tracks)))


def route(messages: DataFrame, records: DataFrame | None, ttl_hours: int = 24) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages to score, reused results, rejected messages) of messages (msg_id, text, ts).

    Earlier results are looked up before anything else, then excluded languages
    go; of the rest each message reuses the result of an equal one that came
    within the time to live before it and is scored itself.
    Messages are written once; what becomes of each is found by their keys, and
    their texts are read and shuffled again only by those who ask for them.
    """
    scratch = Scratch(messages.sparkSession, "route")
    keyed = messages.withColumns({"hash": cache.cache_key(F.col("text")), "scan_id": scoring.scan_id(F.col("msg_id"), F.col("ts"))})
    columns = keyed.columns
    keyed = scratch.save(keyed.withColumns({"_other": corpus.is_marathi(F.col("text")), "_row": F.monotonically_increasing_id()}), "keyed")
    fresh, reused = keyed.select("msg_id", "ts", "hash", "scan_id", "_other", "_row"), None
    if records is not None:
        looked = scratch.save(cache.lookup(fresh, records, ttl_hours), "looked")
        fresh, reused = looked.filter("hit_id IS NULL").drop("hit_id"), looked.filter("hit_id IS NOT NULL")
    judged = scratch.save(cache.reuse(fresh.filter("NOT _other"), ttl_hours), "judged")
    again = judged.filter("hit_id IS NOT NULL")
    reused = again if reused is None else reused.unionByName(again)
    rest = keyed.drop("msg_id", "ts", "hash", "scan_id", "_other")
    whole = lambda rows, *more: rows.join(rest, "_row").select(*columns, *more)
    return whole(judged.filter("hit_id IS NULL")), whole(reused, "hit_id"), whole(fresh.filter("_other"), F.lit("excluded_language").alias("reason"))


def scan(messages: DataFrame, intel_tables: Snapshots, records: DataFrame | None, as_of: Column, ttl_hours: int = 24) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(responses, reused results, rejected messages) of messages (msg_id, text, input_type, ts)."""
    wanted, reused, rejected = route(messages, records, ttl_hours)
    return scoring.to_response(score_messages(wanted, intel_tables, as_of, texts=False)), reused, rejected


def scan_screenshots(hindi: DataFrame, english: DataFrame, images: DataFrame, intel_tables: Snapshots, as_of: Column) -> DataFrame:
    """Scored images from recognisers' blocks; images without text are left out; the text is the masked one."""
    read = blocks.read_images(hindi, english, images).withColumn("text", F.col("entities.redacted_text")).filter("text <> ''")
    return score_messages(read.select(F.col("image_id").alias("msg_id"), "text", "quality", "threat_density"), intel_tables, as_of)


def to_records(responses: DataFrame, messages: DataFrame, key: str = "raw") -> DataFrame:
    """Rows to persist for later reuse."""
    own = messages.select("msg_id", cache.cache_key(F.col("text"), key).alias("hash"), F.col("ts").alias("created_at"))
    return responses.join(own, "msg_id").withColumns({"track_details": F.to_json("metadata")}).select("scan_id", "hash", "input_type", "risk_score", "risk_category", "explanations", "track_details", "created_at")


def read_details(records: DataFrame, schema: str) -> DataFrame:
    """Persisted rows with their details read back from JSON; details that are no JSON of that schema are null."""
    return records.withColumn("metadata", F.from_json("track_details", schema))
