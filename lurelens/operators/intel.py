"""Joins of messages' URLs and hosts with snapshots of reputation, registration, certificates, pages and DNS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import hosts, text
from .joins import dealt_join

#: Columns of the registration snapshot.
WHOIS = "host string, http_status int, created_date string, registry_created_date string, created_normalized string, registry_created_normalized string, estimated_age double, outcome string"


def explode_urls(messages: DataFrame, urls: str = "urls") -> DataFrame:
    """A row per message and URL: msg_id, pos, url, domain."""
    rows = messages.select("msg_id", F.posexplode(urls).alias("pos", "url"))
    return rows.withColumn("domain", hosts.canonical_host(F.col("url")))


def url_evidence(urls: DataFrame, reputation: DataFrame) -> DataFrame:
    """Adds typosquatting, vendor counts, risk_score and verdict to rows with url and domain.

    ``reputation`` has url_key, malicious, suspicious, harmless and outcome
    (``ok`` or an error); for URLs without a row nothing is known: counts are null.
    """
    known = reputation.select(F.col("url_key").alias("_key"), F.struct("malicious", "suspicious", "harmless", "outcome").alias("_rep"))
    joined = dealt_join(urls.withColumn("_key", text.url_key(F.col("url"))), known, ["_key"])
    failed = F.col("_rep").isNotNull() & (F.coalesce(F.col("_rep.outcome"), F.lit("ok")) != "ok")
    pick = lambda k: F.when(~failed & F.col("_rep").isNotNull(), F.coalesce(F.col(f"_rep.{k}").cast("int"), F.lit(0)))
    out = joined.withColumns({"typosquatting": hosts.typosquat(F.col("domain")), **{k: pick(k) for k in ("malicious", "suspicious", "harmless")}})
    measured = hosts.reputation_verdict(F.col("malicious"), F.col("suspicious"))
    out = out.withColumn("reputation", F.when(failed | F.col("_rep").isNull(), "unknown").otherwise(measured))
    squat = F.col("typosquatting.is_typosquatted")
    points = F.when(squat, 60).otherwise(0) + F.least(F.lit(40), F.coalesce(F.col("malicious"), F.lit(0)) * 15)
    out = out.withColumn("risk_score", F.least(F.lit(100), points))
    return out.withColumn("verdict", F.when(squat | (F.col("reputation") == "malicious"), "hostile").otherwise("clean")).drop("_key", "_rep")


def _deletions(word: Column) -> Column:
    """The word with one character left out, in every place."""
    places = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
    return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def _neighbours(word: Column) -> Column:
    """The word and what is left of it without one or two characters: words at distance 2 or less have one in common."""
    once = _deletions(word)
    return F.array_distinct(F.flatten(F.array(F.array(word), once, F.flatten(F.transform(once, _deletions)))))


def brand_matches(domains: DataFrame, brands: DataFrame) -> DataFrame:
    """Hosts that imitate an entry of a table of brands (ord, brand): domain, brand, stage and distance; others are left out.

    The first brand that the first label contains counts, else the first at edit
    distance 1 or 2, else one that its look-alike skeleton equals.  Nothing is
    compared with every brand: parts of labels, their neighbours by deletion and
    their skeletons are joined with those of the brands, whose number and
    lengths bound what a label has of them.
    """
    brands = brands.filter("brand <> ''").groupBy("brand").agg(F.min("ord").alias("ord"))
    sizes = brands.agg(F.coalesce(F.min(F.length("brand")), F.lit(1)), F.coalesce(F.max(F.length("brand")), F.lit(0))).first()
    own = domains.select("domain").filter("domain <> ''").distinct().withColumn("label", F.split("domain", r"\.")[0])
    words = own.select("label").filter("label <> ''").distinct()
    size = F.length("label")
    starts = F.sequence(F.lit(1), size)
    lengths = lambda i: F.transform(F.filter(F.sequence(F.lit(sizes[0]), F.lit(max(sizes))), lambda n: n <= size - i + 1), lambda n: F.substring(F.col("label"), i, n))
    parts = words.select("label", F.explode(F.array_distinct(F.flatten(F.transform(starts, lengths)))).alias("brand"))
    inside = parts.filter("brand <> label").join(brands, "brand").select("label", F.lit(0).alias("step"), "ord", "brand", F.lit(None).cast("int").alias("distance"))
    around = words.filter(size.between(sizes[0] - 2, sizes[1] + 2)).select("label", F.explode(_neighbours(F.col("label"))).alias("near"))
    met = around.join(brands.select("brand", "ord", F.explode(_neighbours(F.col("brand"))).alias("near")), "near").select("label", "brand", "ord").distinct()
    near = met.withColumn("distance", F.levenshtein("label", "brand")).filter("distance BETWEEN 1 AND 2").select("label", F.lit(1).alias("step"), "ord", "brand", "distance")
    like = words.withColumn("brand", text.look_alike_skeleton(F.col("label"))).filter("brand <> label").join(brands, "brand").select("label", F.lit(2).alias("step"), "ord", "brand", F.lit(None).cast("int").alias("distance"))
    best = inside.union(near).union(like).groupBy("label").agg(F.min(F.struct("step", "ord", "brand", "distance")).alias("m"))
    stage = F.element_at(F.array(*map(F.lit, ("inside", "near", "like"))), F.col("m.step") + 1)
    return own.join(best, "label").select("domain", "m.brand", stage.alias("stage"), "m.distance")


def domain_age(domains: DataFrame, whois: DataFrame, as_of: Column) -> DataFrame:
    """Adds whois_status, whois_reason, created, age_days and is_recent_domain to rows with domain and ``check``."""
    fields = ("created_date", "registry_created_date", "created_normalized", "registry_created_normalized")
    raw = F.coalesce(*(F.when(F.trim(f) != "", F.col(f)) for f in fields))
    rows = whois.select(F.col("host").alias("domain"), F.lit(True).alias("_there"), "http_status", "outcome", "estimated_age", hosts.parse_created(raw).alias("created"))
    joined = domains.join(rows, "domain", "left")
    ok, check = F.col("http_status") == 200, F.col("check")
    age = F.when(check["is_valid"] & ok, hosts.domain_age_days(F.col("created"), F.col("estimated_age"), as_of))
    status = (
        F.when(~check["is_valid"] & (check["domain_type"] == "ip"), "not_applicable")
        .when(~check["is_valid"], "invalid_domain")
        .when(F.col("_there").isNull(), "unknown")
        .when(F.col("outcome") == "timeout", "timeout")
        .when(F.coalesce(F.col("outcome"), F.lit("ok")) == "error", "unknown")
        .when(ok & F.col("age_days").isNotNull(), "valid")
        .when(ok, "created_date_missing")
        .when(F.col("http_status") == 404, "not_found")
        .otherwise("api_error")
    )
    reason = (
        F.when(F.col("whois_status") == "not_applicable", F.concat(F.lit("ip_address_"), check["reason"]))
        .when(F.col("whois_status") == "invalid_domain", check["reason"])
        .when(F.col("_there").isNull(), "whois_api_not_configured")
        .when(F.col("whois_status") == "timeout", "whois_timeout")
        .when(F.col("whois_status") == "unknown", "whois_exception")
        .when((F.col("whois_status") == "valid") & F.col("created").isNotNull(), "createdDate_retrieved")
        .when(F.col("whois_status") == "valid", "estimatedDomainAge_retrieved")
        .when(F.col("whois_status") == "created_date_missing", "createdDate_missing")
        .when(F.col("whois_status") == "not_found", "domain_not_found")
        .otherwise("whois_http_error")
    )
    out = joined.withColumn("age_days", age).withColumn("whois_status", status).withColumn("whois_reason", reason)
    out = out.withColumn("is_recent_domain", F.when(F.col("whois_status") == "valid", F.col("age_days") < 30))
    return out.drop("_there", "http_status", "outcome", "estimated_age")


def tls_status(domains: DataFrame, certs: DataFrame, as_of: Column) -> DataFrame:
    """Adds tls_status, tls_valid (null: unknown), issuer flags and is_free_tls to rows with domain and ``check``.

    ``certs`` has host, issuer_org, issuer_cn, not_after and outcome: ``ok``, or
    the status that the handshake ended with.
    """
    rows = certs.select(F.col("host").alias("domain"), "issuer_org", "issuer_cn", "not_after", F.coalesce("outcome", F.lit("ok")).alias("_outcome"))
    joined = domains.join(rows, "domain", "left")
    done = F.col("_outcome") == "ok"
    names = F.concat_ws(" ", "issuer_org", "issuer_cn")
    seen = lambda name: F.coalesce(done & names.contains(name), F.lit(False)) & F.col("check.is_valid")
    status = F.when(~F.col("check.is_valid"), "invalid_domain").when(F.col("_outcome").isNull(), "unknown").when(done & hosts.certificate_expired(F.col("not_after"), as_of), "expired").when(done, "valid").otherwise(F.col("_outcome"))
    out = joined.withColumns({"tls_status": status, "is_lets_encrypt": seen("Let's Encrypt"), "is_cloudflare": seen("Cloudflare")})
    valid = F.when(F.col("tls_status") == "valid", True).when(F.col("tls_status").isin(fixed.BAD_TLS), False)
    out = out.withColumns({"tls_valid": valid, "is_free_tls": F.col("is_lets_encrypt") | F.col("is_cloudflare")})
    return out.drop("issuer_org", "issuer_cn", "not_after", "_outcome")


def domain_evidence(urls: DataFrame, whois: DataFrame, certs: DataFrame, as_of: Column) -> DataFrame:
    """A row per message and distinct host, with age, certificate, risk_score and intelligence_quality.

    Snapshots are joined to the distinct hosts, not to the messages, so a host
    that is in a third of the messages is looked up once; what is known of it
    meets its messages in parts.
    """
    places = urls.filter((F.col("domain") != "") & ~F.col("domain").isin(fixed.LOCAL_HOSTS)).groupBy("msg_id", "domain").agg(F.min("pos").alias("pos"))
    distinct = places.select("domain").distinct().withColumn("check", hosts.validate_domain(F.col("domain")))
    looked = tls_status(domain_age(distinct, whois, as_of), certs, as_of)
    age = F.when(F.col("whois_status") != "valid", 0).when(F.col("age_days") < 30, 60).when(F.col("age_days") < 90, 30).otherwise(0)
    bad = F.when(F.col("tls_status").isin(fixed.BAD_TLS), 20).otherwise(0)
    looked = looked.withColumns({
        "domain_type": F.col("check.domain_type"),
        "validation_status": F.when(F.col("check.is_valid"), "valid").otherwise(F.col("check.reason")),
        "risk_score": F.least(F.lit(100), age + bad),
        "intelligence_quality": hosts.intelligence_quality(F.col("whois_status"), F.col("tls_status"), F.col("check.is_valid")),
    })
    return dealt_join(places, looked.drop("check"), ["domain"], "inner")


def sandbox_evidence(messages: DataFrame, results: DataFrame) -> DataFrame:
    """Page evidence of each message's first URL: a result, a time-out of weight 40, or skipped without a URL."""
    first = messages.withColumn("_url", F.get("urls", F.lit(0)))
    rows = results.select(F.col("url").alias("_url"), "sandbox_status", "risk_weight", "dom_signals", "final_redirect_url")
    joined = dealt_join(first, rows, ["_url"])
    status = F.when(F.col("_url").isNull(), "skipped").when(F.col("sandbox_status").isNull() | (F.col("sandbox_status") == "failed"), "hostile_timeout").otherwise(F.col("sandbox_status"))
    weight = F.when(status == "hostile_timeout", F.coalesce(F.when(F.col("sandbox_status") == "hostile_timeout", F.col("risk_weight")), F.lit(40))).otherwise(F.lit(0))
    out = joined.select("msg_id", status.alias("sandbox_status"), weight.cast("int").alias("risk_weight"), "dom_signals")
    auth = F.coalesce(F.col("dom_signals.has_auth_inputs") | F.col("dom_signals.has_payment_forms"), F.lit(False))
    return out.withColumn("page_asks", auth)


def preflight(urls: DataFrame, answers: DataFrame) -> DataFrame:
    """Adds allowed, reason, normalized_url, hostname and resolved_ips to rows with url.

    ``answers`` has hostname, ord, ip and outcome (``ok``, ``timeout`` or ``failed``).
    Answers of a host are a few rows; they are grouped by host before the join.
    """
    ok = answers.filter((F.coalesce("outcome", F.lit("ok")) == "ok") & F.col("ip").isNotNull())
    first = ok.groupBy("hostname", "ip").agg(F.min("ord").alias("ord")).withColumn("safe", hosts.is_safe_key(hosts.ip_key(F.col("ip"))))
    lists = first.groupBy("hostname").agg(F.array_sort(F.collect_list(F.struct("ord", "ip", "safe"))).alias("_ips"))
    bad = answers.groupBy("hostname").agg(F.max(F.coalesce("outcome", F.lit("ok")) == "timeout").alias("_late"))
    known = bad.join(lists, "hostname", "left")
    joined = dealt_join(urls.withColumn("_p", hosts.parse_url(F.col("url"))).withColumn("hostname", F.col("_p.hostname")), known, ["hostname"])
    unsafe = F.get(F.filter("_ips", lambda x: ~x["safe"]), F.lit(0))["ip"]
    reason = (
        F.when(F.col("_p.reason").isNotNull(), F.col("_p.reason"))
        .when(F.col("_late"), fixed.DNS_LATE)
        .when(F.col("_ips").isNull() & F.col("_late").isNotNull(), fixed.DNS_EMPTY)
        .when(F.col("_ips").isNull(), fixed.DNS_FAILED)
        .when(unsafe.isNotNull(), text.filled(fixed.DNS_UNSAFE, ip=unsafe))
        .otherwise(fixed.URL_SAFE)
    )
    out = joined.withColumns({"reason": reason, "normalized_url": F.col("_p.normalized_url"), "resolved_ips": F.transform("_ips", lambda x: x["ip"])})
    return out.withColumn("allowed", F.col("reason") == fixed.URL_SAFE).drop("_p", "_ips", "_late")


def egress_audit(connections: DataFrame, pins: DataFrame) -> DataFrame:
    """Adds an error code (null: allowed) to connections (host, peer_ip), held against the approved address of each host (host, pinned_ip)."""
    pinned = pins.select("host", "pinned_ip", hosts.ip_key(F.col("pinned_ip")).alias("_pin"))
    joined = dealt_join(connections.drop("pinned_ip"), pinned, ["host"]).withColumn("_peer", hosts.ip_key(F.col("peer_ip")))
    peer, pin = F.col("_peer"), F.col("_pin")
    error = (
        F.when(F.col("pinned_ip").isNull(), "not_pinned")
        .when(F.coalesce(F.col("peer_ip"), F.lit("")) == "", "missing_peer")
        .when(peer.isNull(), "malformed_peer")
        .when(~hosts.is_safe_key(peer), "unsafe_peer")
        .when(~peer.eqNullSafe(pin), "peer_mismatch")
    )
    return joined.withColumn("error", error).drop("_peer", "_pin")
