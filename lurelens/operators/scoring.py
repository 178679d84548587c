"""Fan-in of the tracks, the weighted score, its summary, and the explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.labels import category
from ..functions.text import filled
from ..narrative_texts import EN, FACETS, HI


def fan_in(messages: DataFrame, url: DataFrame, domain: DataFrame, sandbox: DataFrame) -> DataFrame:
    """One row per message, which has its text_track, with the other tracks; a message with a URL but no row of a track gets the failure default.

    Evidence is aggregated per message before the joins; all three join on msg_id, so messages are shuffled once.
    """
    url_rows = url.groupBy("msg_id").agg(
        F.max("risk_score").alias("url_score"),
        F.array_sort(F.collect_list(F.struct("pos", "url", "domain", "typosquatting", "reputation", "risk_score", "verdict"))).alias("urls_analyzed"),
    )
    domain_rows = domain.groupBy("msg_id").agg(
        F.max("risk_score").alias("domain_score"),
        F.array_sort(F.collect_list(F.struct("pos", "domain", "age_days", "is_recent_domain", "whois_status", "tls_status", "is_free_tls", "risk_score", "intelligence_quality"))).alias("domains_analyzed"),
    )
    page = sandbox.select("msg_id", "sandbox_status", "risk_weight", "page_asks", F.lit(True).alias("_page"))
    has_url = F.size("urls") > 0
    joined = messages.withColumn("has_url", has_url).join(url_rows, "msg_id", "left").join(domain_rows, "msg_id", "left").join(page, "msg_id", "left")
    lost = F.col("has_url") & F.col("_page").isNull()
    return joined.withColumns({
        "url_score": F.when(F.col("has_url"), F.coalesce("url_score", F.lit(50))).otherwise(0),
        # A URL whose only hosts are local has no domain rows and scores 0.
        "domain_score": F.when(F.col("has_url"), F.coalesce("domain_score", F.lit(0))).otherwise(0),
        "sandbox_status": F.when(lost, "failed").when(F.col("has_url"), F.col("sandbox_status")).otherwise("skipped"),
        "risk_weight": F.when(lost, 40).otherwise(F.coalesce("risk_weight", F.lit(0))),
        "page_asks": F.coalesce("page_asks", F.lit(False)),
    }).drop("_page")


def weighted_score(text: Column, url: Column, domain: Column, has_url: Column, sandbox: Column, page_asks: Column, risk_weight: Column) -> Column:
    """Struct of risk_score, risk_category, sandbox_score, timeout_penalty and redistributed."""
    down = sandbox.isin(fixed.FAILED_SANDBOX)
    shared = (text * F.lit(40 / 85)) + (url * F.lit(25 / 85)) + (domain * F.lit(20 / 85))
    penalty = F.when(has_url & (sandbox == "hostile_timeout"), (F.lit(0.15) * risk_weight).cast("int")).otherwise(0)
    page = F.when(has_url & ~down & page_asks, 100).otherwise(0)
    full = (text * F.lit(0.40)) + (url * F.lit(0.25)) + (domain * F.lit(0.20)) + (page * F.lit(0.15))
    raw = F.when(~has_url, text).when(down, shared.cast("int") + penalty).otherwise(full.cast("int"))
    score = F.least(F.lit(100), F.greatest(F.lit(0), raw))
    return F.struct(
        score.alias("risk_score"),
        category(score).alias("risk_category"),
        F.when(~down, page).alias("sandbox_score"),
        penalty.alias("timeout_penalty"),
        (has_url & down).alias("redistributed"),
    )


def applied_weights(has_url: Column, redistributed: Column) -> Column:
    table = lambda *w: F.create_map(*(x for k, v in zip(fixed.WEIGHTS, w, strict=True) for x in (F.lit(k), F.lit(float(v)))))
    return F.when(~has_url, table(1, 0, 0, 0)).when(redistributed, table(round(40 / 85, 3), round(25 / 85, 3), round(20 / 85, 3), 0)).otherwise(table(*fixed.WEIGHTS.values()))


def score(tracks: DataFrame) -> DataFrame:
    """Adds the score's columns and the applied weights to fanned-in rows."""
    own = weighted_score(F.col("text_track.risk_score"), F.col("url_score"), F.col("domain_score"), F.col("has_url"), F.col("sandbox_status"), F.col("page_asks"), F.col("risk_weight"))
    out = tracks.withColumn("_s", own)
    out = out.withColumns({k: F.col(f"_s.{k}") for k in ("risk_score", "risk_category", "sandbox_score", "timeout_penalty", "redistributed")})
    return out.withColumn("applied_weights", applied_weights(F.col("has_url"), F.col("redistributed"))).drop("_s")


def score_summary(scored: DataFrame) -> DataFrame:
    """Adds the struct of the scores that went in."""
    return scored.withColumn("scores_summary", F.struct(F.col("text_track.risk_score").alias("ml_score"), "url_score", "domain_score", "sandbox_score", "timeout_penalty"))


def evidence_flags(scored: DataFrame) -> DataFrame:
    """Adds what the explanation asks of the evidence: brand, malicious, recent, free and recent, bad certificate."""
    urls, domains = F.coalesce("urls_analyzed", F.array()), F.coalesce("domains_analyzed", F.array())
    some = lambda rows, test: F.coalesce(F.exists(rows, test), F.lit(False))
    recent = lambda d: F.coalesce(d["is_recent_domain"], F.lit(False))
    return scored.withColumns({
        "typosquatted_brand": F.get(F.filter(urls, lambda u: u["typosquatting"]["is_typosquatted"]), F.lit(0))["typosquatting"]["target_brand"],
        "any_malicious": some(urls, lambda u: u["reputation"] == "malicious"),
        "any_recent": some(domains, recent),
        "any_free_recent": some(domains, lambda d: d["is_free_tls"] & recent(d)),
        "any_bad_tls": some(domains, lambda d: d["tls_status"].isin(fixed.BAD_TLS)),
    })


def category_name(name: Column, language: str) -> Column:
    if language != "hi":
        return name
    table = F.create_map(*(F.lit(x) for pair in fixed.CATEGORY_HI.items() for x in pair))
    return F.coalesce(F.try_element_at(table, name), name)


def narrative(language: str, by: str = "") -> Column:
    """The explanation in ``en`` or ``hi`` from scored rows with evidence flags; ``by`` names who recommends."""
    say = HI if language == "hi" else EN
    facets = F.col("text_track.social_engineering")
    intent = F.col("text_track.detected_intent")
    bullets = [F.when(F.element_at(facets, f) >= 0.5, say[f]) for f in FACETS]
    bullets += [F.when(intent == i, say[i]) for i in fixed.INTENT_WORDS]
    bullets += [
        F.when(F.col("typosquatted_brand").isNotNull(), filled(say["typosquatting"], brand=F.upper("typosquatted_brand"))),
        F.when(F.col("any_malicious"), say["virustotal"]),
        F.when(F.col("any_recent"), say["recent_domain"]),
        F.when(F.col("any_free_recent"), say["ssl_free"]),
        F.when(F.col("any_bad_tls"), say["ssl_invalid"]),
        F.when(F.col("sandbox_status") == "hostile_timeout", say["sandbox_timeout"]).when((F.col("sandbox_status") == "completed") & F.col("page_asks"), say["sandbox_dom"]),
    ]
    body = F.array_join(F.array_compact(F.array(*bullets)), "\n")
    body = F.when(body == "", say["none"]).otherwise(body)
    intro = filled(say["intro"], category=category_name(F.col("risk_category"), language), score=F.col("risk_score").cast("string"))
    end = F.when(F.col("risk_category") == "Safe", say["Safe"].format(by=by)).when(F.col("risk_category") == "Suspicious", say["Suspicious"].format(by=by)).otherwise(say["High Risk"].format(by=by))
    return F.concat(intro, F.lit(f"\n\n{say['findings']}\n"), body, F.lit("\n\n"), end)


def explain(scored: DataFrame, by: str = "") -> DataFrame:
    """Adds the map of explanations by language."""
    flagged = evidence_flags(scored)
    return flagged.withColumn("explanations", F.create_map(F.lit("en"), narrative("en", by), F.lit("hi"), narrative("hi", by)))


def to_response(explained: DataFrame) -> DataFrame:
    """The response's shape: id, scores, explanations and the details as nested structs."""
    details = F.struct("urls_analyzed", "domains_analyzed", F.struct("sandbox_status", "risk_weight", "page_asks").alias("sandbox"), F.col("text_track").alias("text"), "applied_weights", "redistributed", "scores_summary")
    return explained.select("msg_id", "scan_id", "input_type", "risk_score", "risk_category", "explanations", details.alias("metadata"))


def diagnostics(explained: DataFrame) -> DataFrame:
    """A summary row per message: level, status of each track, reputation hits, triggers and confidence."""
    status = lambda score: F.when(~F.col("has_url"), "skipped").when(score > 50, "warn").otherwise("nominal")
    hits = F.size(F.filter(F.coalesce("urls_analyzed", F.array()), lambda u: u["reputation"] == "malicious"))
    return explained.select(
        "msg_id",
        F.when(F.col("risk_score") > 60, "HIGH").when(F.col("risk_score") > 30, "SUSPICIOUS").otherwise("LOW").alias("level"),
        status(F.col("url_score")).alias("url_status"),
        status(F.col("domain_score")).alias("domain_status"),
        hits.alias("reputation_hits"),
        F.col("typosquatted_brand").isNotNull().alias("any_typosquat"),
        F.col("text_track.confidence").alias("confidence"),
        F.array_join("text_track.triggers", "|").alias("triggers"),
    )


def real_screenshot(encoded: Column) -> Column:
    """The screenshot, or null for a placeholder."""
    return F.when(F.length(encoded) >= 150, encoded)


def scan_id(msg_id: Column, at: Column) -> Column:
    """``scam_<year>_`` and twelve hex digits that depend on the message alone."""
    return F.concat(F.lit("scam_"), F.year(at).cast("string"), F.lit("_"), F.substring(F.sha2(msg_id.cast("string"), 256), 1, 12))
