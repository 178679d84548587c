"""Column builders for hosts, URLs, IP addresses and domain dates."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import filled, look_alike_skeleton, once, trimmed, words_array

_V4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"


def canonical_host(url: Column) -> Column:
    """Lower-case host without user, port, trailing dots and one leading ``www.``; empty for an empty URL."""
    clean = trimmed(url)
    whole = F.when(clean.rlike(r"^[a-zA-Z][a-zA-Z0-9+\-.]*://"), clean).otherwise(F.concat(F.lit("http://"), clean))
    place = F.regexp_extract(whole, r"^[a-zA-Z][a-zA-Z0-9+\-.]*://([^/?#]*)", 1)
    bare = F.regexp_replace(place, r"^.*@", "")
    host = F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(bare, r":.*$", ""))
    low = F.regexp_replace(trimmed(F.lower(host)), r"\.+$", "")
    return F.when(clean == "", "").otherwise(F.regexp_replace(low, r"^www\.", ""))


def v4_number(text: Column) -> Column:
    """The 32-bit number of a dotted address, null for anything else."""
    part = lambda k: F.split(text, r"\.")[k].cast("long")
    return F.when(text.rlike(_V4), part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3))


def _within(number: Column, networks: list[str]) -> Column:
    ranges = [ipaddress.ip_network(n) for n in networks]
    tests = [number.between(int(r.network_address), int(r.broadcast_address)) for r in ranges]
    out = tests[0]
    for t in tests[1:]:
        out |= t
    return out


def validate_domain(host: Column) -> Column:
    """Struct of is_valid, domain_type (domain, ip or invalid) and reason; the first rule that applies decides."""

    def judge(clean: Column) -> Column:
        number, labels = v4_number(clean), F.split(clean, r"\.", -1)
        tld = F.element_at(labels, -1)
        # Of the labels the first bad one decides, and within it the first rule.
        fault = lambda x: F.when(x == "", "empty_label").when(F.length(x) > 63, "label_too_long").when(x.startswith("-") | x.endswith("-"), "label_hyphen_boundary").when(~x.rlike(r"^[a-z0-9\-]+$"), "label_invalid_characters")
        first = F.get(F.filter(F.transform(labels, fault), lambda r: r.isNotNull()), F.lit(0))
        reason = (
            F.when(F.coalesce(clean, F.lit("")) == "", "empty_domain")
            .when(clean.rlike(r"[ \t\n\r/\\?#@:]"), "contains_invalid_characters")
            .when(_within(number, ["127.0.0.0/8"]), "loopback_ip")
            .when(_within(number, fixed.PRIVATE_V4), "private_ip")
            .when(_within(number, ["240.0.0.0/4", "169.254.0.0/16", "224.0.0.0/4"]), "reserved_ip")
            .when(number.isNotNull(), "public_ip")
            .when(clean.isin("localhost", "local", "broadcasthost"), "localhost")
            .when(clean.startswith("-") | clean.endswith("-"), "hyphen_at_boundary")
            .when(F.size(labels) < 2, "missing_tld")
            .when(first.isNotNull(), first)
            .when(~tld.rlike(r"^[a-z]{2,}$"), "invalid_tld")
            .when(F.length(clean) > 253, "domain_too_long")
            .otherwise("valid")
        )
        kind = lambda r: F.when(r.endswith("_ip"), "ip").when(r == "valid", "domain").otherwise("invalid")
        return once(reason, lambda r: F.struct(r.isin("valid", "public_ip").alias("is_valid"), kind(r).alias("domain_type"), r.alias("reason")))

    return once(F.regexp_replace(trimmed(F.lower(host)), r"\.+$", ""), judge)


def typosquat(host: Column) -> Column:
    """Struct of is_typosquatted, target_brand and reason.

    Over the brands in order: the first contained in the first label, else the
    first at edit distance 1 or 2, else one that the look-alike skeleton equals.
    """

    def judge(label: Column) -> Column:
        brands = words_array(fixed.BRANDS)
        inside = F.get(F.filter(brands, lambda b: label.contains(b) & (label != b)), F.lit(0))
        near = F.get(F.filter(F.transform(brands, lambda b: F.struct(b.alias("b"), F.levenshtein(label, b).alias("d"))), lambda x: x["d"].between(1, 2)), F.lit(0))
        like = F.get(F.filter(brands, lambda b: (look_alike_skeleton(label) == b) & (label != b)), F.lit(0))
        found = F.struct(inside.alias("inside"), near.alias("near"), like.alias("like"))
        return once(
            found,
            lambda f: F.struct(
                F.coalesce(f["inside"], f["near"]["b"], f["like"]).isNotNull().alias("is_typosquatted"),
                F.coalesce(f["inside"], f["near"]["b"], f["like"]).alias("target_brand"),
                F.when(f["inside"].isNotNull(), filled(fixed.SQUAT_INSIDE, brand=f["inside"]))
                .when(f["near"].isNotNull(), filled(fixed.SQUAT_NEAR, label=label, brand=f["near"]["b"], distance=f["near"]["d"].cast("string")))
                .when(f["like"].isNotNull(), filled(fixed.SQUAT_LIKE, label=label, brand=f["like"]))
                .otherwise(fixed.SQUAT_NONE)
                .alias("reason"),
            ),
        )

    return once(F.split(host, r"\.")[0], judge)


def _v6_key(text: Column) -> Column:
    """32 hex digits of a v6 address, whose groups may be left out once and may end in a dotted address; null for anything else."""
    low = F.regexp_replace(F.lower(text), r"%[^%]+$", "")
    none = F.array().cast("array<string>")

    def undotted(low: Column) -> Column:
        number = F.lpad(F.lower(F.hex(v4_number(F.regexp_extract(low, r"([0-9.]+)$", 1)))), 8, "0")
        return F.when(~low.contains("."), low).otherwise(F.concat(F.regexp_replace(low, r"[0-9.]+$", ""), once(number, lambda n: F.concat(F.substring(n, 1, 4), F.lit(":"), F.substring(n, 5, 4)))))

    def groups(side: Column) -> Column:
        return F.when(side == "", none).otherwise(F.split(side, ":", -1))

    def padded(own: Column) -> Column:
        n = F.size(own["left"]) + F.size(own["right"])
        every = F.concat(own["left"], F.when(own["short"], F.array_repeat(F.lit("0"), 8 - n)).otherwise(none), own["right"])
        good = F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$")) & F.when(own["short"], n <= 7).otherwise(n == 8)
        return F.when(good, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    def key(sides: Column) -> Column:
        own = F.struct(groups(sides[0]).alias("left"), F.when(F.size(sides) == 2, groups(F.get(sides, F.lit(1)))).otherwise(none).alias("right"), (F.size(sides) == 2).alias("short"))
        return F.when(F.size(sides) <= 2, once(own, padded))

    return once(F.split(once(low, undotted), "::", -1), key)


def ip_key(text: Column) -> Column:
    """32 hex digits of an address, v4 as mapped v6; null for anything else."""
    four = F.lpad(F.lower(F.hex(v4_number(text))), 8, "0")
    return F.when(text.contains(":"), _v6_key(text)).otherwise(F.concat(F.lit("0" * 20 + "ffff"), four))


def is_safe_key(key: Column) -> Column:
    """Whether an address key lies outside all unsafe networks; null keys are unsafe."""

    def judge(key: Column) -> Column:
        unsafe = F.lit(False)
        for name in fixed.UNSAFE_V4 + fixed.UNSAFE_V6:
            net = ipaddress.ip_network(name)
            shift = (0xFFFF << 32) if net.version == 4 else 0
            low, high = (f"{int(a) + shift:032x}" for a in (net.network_address, net.broadcast_address))
            # Mapped v4 addresses lie inside ::/8, so v6 networks leave them out.
            unsafe |= key.between(low, high) & (F.lit(True) if net.version == 4 else ~key.startswith("0" * 20 + "ffff"))
        return key.isNotNull() & ~unsafe

    return once(key, judge)


def parse_url(url: Column) -> Column:
    """Struct of reason (null if the URL is well formed), normalized_url and hostname, for inspection by a browser."""
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+\-.]*):", 1))
    place = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+\-.]*://([^/?#]*)", 1)
    bare = F.regexp_replace(place, r"^.*@", "")
    six = bare.startswith("[")
    host = F.lower(F.when(six, F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(bare, r":.*$", "")))
    host = F.regexp_replace(host, r"\.+$", "")
    port = F.when(six, F.regexp_extract(bare, r"\]:(.*)$", 1)).otherwise(F.regexp_extract(bare, r"^[^:]*:(.*)$", 1))
    bad_port = (port != "") & (~port.rlike(r"^[0-9]+$") | (F.coalesce(port.try_cast("long"), F.lit(99999)) > 65535))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+\-.]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    number = port.try_cast("long")
    whole = F.concat(scheme, F.lit("://"), host, F.when((port != "") & (number != 0), F.concat(F.lit(":"), number.cast("string"))).otherwise(""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    reason = (
        F.when(F.coalesce(url, F.lit("")) == "", fixed.URL_EMPTY)
        .when(scheme == "", fixed.URL_NO_SCHEME)
        .when(~scheme.isin("http", "https"), filled(fixed.URL_BAD_SCHEME, scheme=scheme))
        .when(host == "", fixed.URL_NO_HOST)
        .when(bad_port, fixed.URL_BAD_PORT)
    )
    return once(reason, lambda r: F.struct(r.alias("reason"), F.when(r.isNull(), whole).alias("normalized_url"), F.when(r.isNull(), host).alias("hostname")))


def parse_created(text: Column) -> Column:
    """Creation date in UTC from a number of seconds, an ISO form, a leading date, or one of a few formats; else null."""
    clean = trimmed(text)
    iso = F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.regexp_replace(clean, "Z$", "+00:00")))
    lead = F.when(clean.rlike(r"^\d{4}[/-]\d{1,2}[/-]\d{1,2}"), F.try_to_timestamp(F.regexp_replace(F.regexp_extract(clean, r"^(\d{4}[/-]\d{1,2}[/-]\d{1,2})", 1), "/", "-"), F.lit("yyyy-M-d")))
    others = [F.try_to_timestamp(clean, F.lit(f)) for f in fixed.DATE_FORMATS]
    seconds = F.when(clean.rlike(r"^\d{1,11}(?:\.\d+)?$") & ~clean.rlike(r"^\d{8}$"), F.timestamp_seconds(clean.try_cast("double")))
    return F.coalesce(iso, lead, *others, seconds)


def domain_age_days(created: Column, estimated: Column, as_of: Column) -> Column:
    """Whole days since creation, at least 0; else a known estimate; else null."""
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(created)) / 86400)
    # greatest() skips nulls, so an unknown date has to be kept unknown.
    return F.coalesce(F.when(days.isNotNull(), F.greatest(F.lit(0), days)), F.when(estimated >= 0, F.floor(estimated))).cast("int")


def certificate_expired(not_after: Column, as_of: Column) -> Column:
    """Whether the end of validity, as certificates print it, has passed; unreadable ends have not."""
    clean = F.regexp_replace(not_after, " +", " ")
    return F.coalesce(F.try_to_timestamp(clean, F.lit("MMM d HH:mm:ss yyyy z")) < as_of, F.lit(False))


def intelligence_quality(whois: Column, tls: Column, valid: Column) -> Column:
    age, cert = whois == "valid", tls == "valid"
    return F.when(~valid, "unavailable").when(age & cert, "high").when(age, "medium").when(cert, "partial").otherwise("unavailable")


def reputation_verdict(malicious: Column, suspicious: Column) -> Column:
    return F.when(malicious >= 2, "malicious").when((malicious == 1) | (suspicious >= 2), "suspicious").otherwise("clean")


def html_page_signals(html: Column) -> Column:
    """Form evidence of stored HTML."""
    count = lambda tag: F.regexp_count(html, F.lit(rf"(?i)<{tag}\b"))
    auth = html.rlike(r"(?is)<input[^>]*(?:type\s*=\s*[\"']?password|(?:name|id|placeholder)\s*=\s*[\"']?[^\"'>]*(?:otp|passcode|\bpin\b))")
    pay = html.rlike(r"(?is)<(?:input|form)[^>]*(?:card[-_ ]?number|cvv|cvc|expiry|upi|payment|checkout)")
    return F.struct(auth.alias("has_auth_inputs"), pay.alias("has_payment_forms"), count("input").cast("int").alias("input_tags_count"), count("iframe").cast("int").alias("iframe_count"))
