"""Registered queries over the given tables, and the SQL each is held against.

Messages are documents behind a phrase that exercises the lexicons, with a page's
URL where one has the document's number. Snapshots of registrations, certificates,
reputation and DNS are derived from orders, suppliers and hosts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed
from .functions import hosts, labels, text
from .operators import audit, blocks, cache, corpus, intel, ocr_eval, scoring
from .plans import scan, training
from .sources import readers

PHRASES = [
    "URGENT: your SBI account is suspended, update KYC today",
    "Congratulations! You won a lottery, claim Rs 25,000",
    "Your OTP is 482913, do not share. Call 9876543210",
    "Pay Rs.149 to courier.desk@okbank for parcel delivery",
    "Hey, are we on for dinner at 8?",
    "Aapka bijli connection turant band ho jayega",
    "ओटीपी 1234 किसी को न दें",
    "आपका बैंक खाता ब्लॉक है, तुरंत अपडेट करें",
    "Aadhaar 1234 5678 9012 verified",
    "Work from home, earn money, part time salary 50000",
    "Loan pre-approved, pay processing fee now",
    "Court notice: pay fine ₹1,250.50 to the police",
]
AS_OF = "2000-01-01 00:00:00"


def _rows(values: list[str]) -> str:
    return ", ".join(f"({i}, '{v}')" for i, v in enumerate(values))


def _sentence(sentence: str, **parts: str) -> str:
    """A sentence with SQL expressions in the places named in braces."""
    pieces = [parts[x] if x in parts else "'" + x.replace("'", "''") + "'" for x in sentence.replace("}", "{").split("{")]
    return f"concat({', '.join(pieces)})"


#: The same text runs in both engines.
MESSAGES = f"""SELECT d.doc_id AS msg_id, d.source, d.lang, p.k,
    concat(p.phrase, ' ', coalesce(d.text, '')) AS text, g.url
    FROM documents d JOIN (VALUES {_rows(PHRASES)}) AS p(k, phrase) ON d.doc_id % {len(PHRASES)} = p.k
    LEFT JOIN pages g ON g.page_id = d.doc_id"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return readers.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"documents": _table(spark, sf_dir, "documents"), "pages": _table(spark, sf_dir, "pages").select("page_id", "url")}
    return spark.sql(MESSAGES.replace("FROM documents d", "FROM {documents} d").replace("JOIN pages g", "JOIN {pages} g"), **names)


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as labelled training rows; a message is a scam where its document is toxic or its phrase is."""
    marked = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("msg_id"), "toxic")
    own = _messages(spark, sf_dir).join(marked, "msg_id", "left")
    scam = ((F.coalesce("toxic", F.lit(0)) == 1) | ~F.col("k").isin(4, 8)).cast("int")
    return own.select("text", scam.alias("is_scam"), F.col("msg_id").alias("row_ord"), F.col("source").alias("source_dataset"))


_CORPUS = f"""m AS ({MESSAGES}),
    corpus AS (SELECT m.msg_id, m.text, m.source, CASE WHEN coalesce(l.toxic, 0) = 1 OR m.k NOT IN (4, 8) THEN 1 ELSE 0 END AS is_scam
        FROM m LEFT JOIN labels l ON l.doc_id = m.msg_id)"""


def _sum(words: list[str], col: str = "low") -> str:
    return "(" + " + ".join(f"CAST(contains({col}, '{w}') AS INT)" for w in words) + ")"


def _any(words: list[str], col: str = "low") -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


# --- lexicon classifiers -----------------------------------------------------


def lexicon_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels.with_text_result(_messages(spark, sf_dir), F.col("text"), "r")
    facets = [F.round(F.element_at("r.social_engineering", f), 4).alias(f) for f in fixed.SOCIAL_WORDS]
    return out.select("msg_id", *facets, F.col("r.detected_intent").alias("intent"), F.round("r.confidence", 4).alias("confidence"), F.col("r.risk_score").alias("risk"), F.col("r.is_scam").cast("int").alias("is_scam"), F.array_join("r.triggers", "|").alias("triggers"))


_FACET = {f: f"CASE WHEN n_{f} > 0 THEN least(0.95::DOUBLE, n_{f} * 0.45::DOUBLE) ELSE 0.05::DOUBLE END" for f in fixed.SOCIAL_WORDS}
_COUNTS = ", ".join([f"{_sum(w)} AS n_{f}" for f, w in fixed.SOCIAL_WORDS.items()] + [f"{_sum(w)} AS i_{i}" for i, w in fixed.INTENT_WORDS.items()])
_INTENT_TOTAL = "(" + " + ".join(f"i_{i}" for i in fixed.INTENT_WORDS) + ")"
_INTENT_MOST = "greatest(" + ", ".join(f"i_{i}" for i in fixed.INTENT_WORDS) + ")"
_COUNTED = f"""c AS (SELECT msg_id, source, {_COUNTS} FROM l),
    s AS (SELECT *, {", ".join(f"{v} AS s_{f}" for f, v in _FACET.items())}, {_INTENT_MOST} AS most, {_INTENT_TOTAL} AS total FROM c),
    t AS (SELECT *, CASE WHEN most > 0 THEN round_even(1.0::DOUBLE / (total + 1), 3) ELSE 0.9::DOUBLE END AS benign,
        CASE WHEN most = 0 THEN '{fixed.BENIGN}' {" ".join(f"WHEN i_{i} = most THEN '{i}'" for i in fixed.INTENT_WORDS)} END AS intent FROM s),
    r AS (SELECT *, CAST(trunc(greatest({", ".join(f"s_{f}" for f in _FACET)}, 1.0::DOUBLE - benign) * 100) AS INT) AS risk,
        CASE WHEN most = 0 THEN benign ELSE round_even(most::DOUBLE / (total + 1), 3) END AS confidence FROM t)"""
_LEXICON = f"m AS ({MESSAGES}), l AS (SELECT msg_id, source, lower(text) AS low FROM m), {_COUNTED}"
_TRIGGERS = "concat_ws('|', " + ", ".join(f"CASE WHEN s_{f} >= 0.5 THEN '{f}' END" for f in _FACET) + ")"


def risk_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by source and category, scored by text alone."""
    out = labels.with_text_result(_messages(spark, sf_dir), F.col("text"), "r").select("source", F.col("r.risk_score").alias("risk"))
    return out.groupBy("source", labels.category(F.col("risk")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum("risk").alias("total_risk"), F.max("risk").alias("max_risk"))


def weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("text"), F.col("is_scam"), F.col("low")
    out = _corpus(spark, sf_dir).withColumn("low", F.lower("text")).withColumn("s", labels.weak_social(*own))
    return out.select(F.col("row_ord").alias("msg_id"), "is_scam", "s.*", labels.weak_intent(*own).alias("intent"), labels.truth_label(own[0], own[2]).alias("truth"))


_WEAK_INTENT = f"CASE WHEN is_scam <> 1 THEN '{fixed.BENIGN}' " + " ".join(f"WHEN {_any(w)} THEN '{i}'" for i, w in fixed.WEAK_INTENT_WORDS.items()) + f" ELSE '{fixed.OTHER_INTENT}' END"
_WEAK_FACETS = {f: f"CASE WHEN is_scam = 1 AND {_any(w)} THEN 1 ELSE 0 END" for f, w in fixed.WEAK_SOCIAL_WORDS.items()}


def rank_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("low")
    return _messages(spark, sf_dir).withColumn("low", F.lower("text")).select("msg_id", (2 * text.count_of(low, fixed.RANK_URGENCY) + 2 * text.count_of(low, fixed.RANK_AUTHORITY)).alias("points"), labels.is_threat(F.col("text")).cast("int").alias("threat"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("text"), F.col("words")
    out = _messages(spark, sf_dir).withColumn("words", text.tokens(F.col("text")))
    return out.select("msg_id", text.detect_language(*own).alias("language"), text.indic_kind(*own).alias("kind"), text.purity(*own).alias("purity"), text.marathi(own[0]).cast("int").alias("marathi"))


def _in(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_EDGE_CHARS = fixed.TOKEN_EDGE.replace("'", "''")
_TOKENS = f"[lower(trim(x, '{_EDGE_CHARS}')) FOR x IN regexp_split_to_array(text, '\\s+') IF x <> '']"


def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = text.redacted(F.col("text"))
    return _messages(spark, sf_dir).select("msg_id", F.sha2(masked, 256).alias("masked_hash"), masked.contains(fixed.NATIONAL_ID_MASK).cast("int").alias("masked"), text.content_hash(masked).alias("content_hash"))


def entity_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.with_entities(_messages(spark, sf_dir), F.concat_ws(" ", "text", "url"), "e")
    return found.select("msg_id", *(F.array_join(f"e.{k}", "|").alias(k) for k in ("urls", "domains", "upi_ids", "phone_numbers", "otp_candidates", "amounts", "bank_names")))


def _dialect(pattern: str) -> str:
    """A pattern for SQL, whose engine knows no look-arounds and no flag for Unicode: edges are its own word borders, which differ only beside letters beyond ASCII."""
    return pattern.replace("(?iu)", "(?i)").replace(fixed.EDGE, r"\b").replace("'", "''")


def _healed(col: str) -> str:
    """The healing steps one inside another, in the same order."""
    out = col
    for pattern, new in (pair for rounds, pairs in fixed.STITCH_STEPS + fixed.HEAL_STEPS for _ in range(rounds) for pair in pairs):
        if "(?=" in pattern:
            # What a look-ahead leaves in place is put back.
            pattern, new = pattern.replace("(?=", "("), f"{new}$1"
        out = f"regexp_replace({out}, '{_dialect(pattern)}', '{re.sub(r'[$]([0-9])', lambda m: chr(92) + m[1], new)}', 'g')"
    return out


def _found(col: str, pattern: str, group: int = 0) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({col}, '{_dialect(pattern)}', {group})))"


_REPAIRED = reduce(lambda u, pair: f"replace({u}, '{pair[0]}', '{pair[1]}')", fixed.URL_REPAIRS, "u")
#: Healed texts.
_HEALED = f"""m AS ({MESSAGES}), e1 AS (SELECT msg_id, {_healed("concat_ws(' ', text, url)")} AS h FROM m)"""
#: Masked texts, URLs of which none is part of a longer or earlier one, and entities.
_FROM_HEALED = f"""e2 AS (SELECT msg_id, h, regexp_replace(h, '{_dialect(fixed.NATIONAL_ID)}', '{fixed.NATIONAL_ID_MASK}', 'g') AS k FROM e1),
    e3 AS (SELECT msg_id, h, k, {_healed("k")} AS w, upper(k) AS up FROM e2), u0 AS (SELECT msg_id, regexp_extract_all(w, '{_dialect(fixed.URL)}') AS l FROM e3),
    u1 AS (SELECT msg_id, i, regexp_replace({_REPAIRED}, '{_dialect(fixed.URL_TAIL)}', '') AS u FROM (SELECT msg_id, unnest(l) AS u, generate_subscripts(l, 1) AS i FROM u0)), u2 AS (SELECT * FROM u1 WHERE u <> ''),
    u3 AS (SELECT *, regexp_extract(CASE WHEN starts_with(u, 'http') THEN u ELSE concat('http://', u) END, '^[^:/?#]+://([^/?#]*)', 1) AS d FROM u2 a
        WHERE NOT EXISTS (SELECT 1 FROM u2 b WHERE b.msg_id = a.msg_id AND contains(b.u, a.u) AND (length(b.u) > length(a.u) OR (length(b.u) = length(a.u) AND b.i < a.i)))),
    u4 AS (SELECT msg_id, string_agg(u, '|' ORDER BY -length(u), i) AS urls, string_agg(DISTINCT nullif(d, ''), '|' ORDER BY nullif(d, '')) AS domains FROM u3 GROUP BY msg_id),
    e4 AS (SELECT *, {_found("k", fixed.UPI_ID)} AS upi, {_found("k", fixed.PHONE)} AS phones, {_found("k", fixed.CODE)} AS codes, {_found("k", fixed.AMOUNT, 1)} AS amounts FROM e3)"""


def threat_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for urgency and authority words and for each entity of a message."""
    found = text.with_entities(_messages(spark, sf_dir), F.concat_ws(" ", "text", "url"), "e")
    return found.select("msg_id", labels.threat_density(F.concat_ws(" ", "text", "url"), F.col("e")).alias("density"))


def shorthand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with chat shorthand written out; a word of it is put behind each, so that there is some."""
    turns = _table(spark, sf_dir, "conversations")
    told = F.concat_ws(" ", "text", F.element_at(text.words_array(list(fixed.SHORTHAND)), (F.col("turn") % len(fixed.SHORTHAND) + 1).cast("int")))
    return turns.select("conv_id", "turn", F.sha2(text.expand_shorthand(told), 256).alias("expanded"))


# --- hosts, reputation, registration, certificates, pages --------------------


def host_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _table(spark, sf_dir, "pages").select("page_id", hosts.canonical_host(F.col("url")).alias("host"))
    out = out.withColumns({"v": hosts.validate_domain(F.col("host")), "t": hosts.typosquat(F.col("host"))})
    return out.select("page_id", "host", F.col("v.is_valid").cast("int").alias("is_valid"), "v.domain_type", F.col("v.reason").alias("validation"), F.col("t.is_typosquatted").cast("int").alias("squat"), F.coalesce("t.target_brand", F.lit("")).alias("brand"), F.col("t.reason").alias("squat_reason"))


_HOST = "regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1)), '[.]+$', ''), '^www[.]', '')"
_BRANDS = ", ".join(f"({i}, '{b}')" for i, b in enumerate(fixed.BRANDS))
_SKELETON = reduce(lambda t, pair: f"replace({t}, '{pair[0]}', '{pair[1]}')", fixed.LOOK_ALIKES, "sld")
#: Brand matches of each host of a table h, best first.
_SQUATTED = f"""hl AS (SELECT host, split_part(host, '.', 1) AS sld FROM h),
    sq AS (SELECT host, arg_min(b, ord) AS brand, arg_min(stage, ord) AS stage, arg_min(dist, ord) AS dist FROM (
        SELECT host, b, 1 AS stage, 0 AS dist, i AS ord FROM hl, (VALUES {_BRANDS}) v(i, b) WHERE contains(sld, b) AND sld <> b
        UNION ALL SELECT host, b, 2, levenshtein(sld, b), 1000 + i FROM hl, (VALUES {_BRANDS}) v(i, b) WHERE levenshtein(sld, b) BETWEEN 1 AND 2
        UNION ALL SELECT host, b, 3, 0, 2000 + i FROM hl, (VALUES {_BRANDS}) v(i, b) WHERE {_SKELETON} = b AND sld <> b) GROUP BY host)"""
_SQUAT = f"h AS (SELECT DISTINCT {_HOST} AS host FROM pages), {_SQUATTED}"
_FAULT = "CASE WHEN x = '' THEN 'empty_label' WHEN length(x) > 63 THEN 'label_too_long' WHEN starts_with(x, '-') OR ends_with(x, '-') THEN 'label_hyphen_boundary' WHEN NOT regexp_full_match(x, '[a-z0-9-]+') THEN 'label_invalid_characters' END"
_VALID = f"""CASE WHEN host = '' THEN 'empty_domain' WHEN host IN ('localhost', 'local', 'broadcasthost') THEN 'localhost'
    WHEN starts_with(host, '-') OR ends_with(host, '-') THEN 'hyphen_at_boundary' WHEN NOT contains(host, '.') THEN 'missing_tld'
    WHEN len([x FOR x IN string_split(host, '.') IF {_FAULT} IS NOT NULL]) > 0 THEN [{_FAULT} FOR x IN string_split(host, '.') IF {_FAULT} IS NOT NULL][1]
    WHEN NOT regexp_full_match(string_split(host, '.')[-1], '[a-z]{{2,}}') THEN 'invalid_tld' WHEN length(host) > 253 THEN 'domain_too_long' ELSE 'valid' END"""


def _reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reputation row for two of three pages' URLs."""
    pages = _table(spark, sf_dir, "pages").filter("page_id % 3 <> 2")
    n = F.col("page_id")
    rows = pages.select("url", (n % 5).cast("int").alias("malicious"), (n % 4).cast("int").alias("suspicious"), F.lit(60).alias("harmless"), F.when(n % 11 == 0, "error").otherwise("ok").alias("outcome"), n)
    first = rows.groupBy("url").agg(F.min_by(F.struct("malicious", "suspicious", "harmless", "outcome"), "page_id").alias("r"))
    return first.select(text.url_key(F.col("url")).alias("url_key"), "r.*")


_REPUTATION = "rep AS (SELECT url, arg_min(page_id, page_id) AS n FROM pages WHERE page_id % 3 <> 2 GROUP BY url)"


def url_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("msg_id"), F.array("url").alias("urls"))
    out = intel.url_evidence(intel.explode_urls(pages), _reputation(spark, sf_dir))
    return out.select("msg_id", "url", "domain", F.coalesce("malicious", F.lit(-1)).alias("malicious"), "reputation", "risk_score", "verdict")


_URL_EVIDENCE = f"""{_SQUAT}, {_REPUTATION},
    j AS (SELECT p.page_id AS msg_id, p.url, {_HOST.replace("(url,", "(p.url,")} AS host, rep.n FROM pages p LEFT JOIN rep ON rep.url = p.url),
    k AS (SELECT j.*, sq.brand, CASE WHEN n % 11 <> 0 THEN n % 5 END AS mal, n % 4 AS sus FROM j LEFT JOIN sq ON sq.host = j.host),
    ue AS (SELECT msg_id, url, host AS domain, CAST(coalesce(mal, -1) AS INT) AS malicious,
        CASE WHEN mal IS NULL THEN 'unknown' WHEN mal >= 2 THEN 'malicious' WHEN mal = 1 OR sus >= 2 THEN 'suspicious' ELSE 'clean' END AS reputation,
        CAST(least(100, CASE WHEN brand IS NOT NULL THEN 60 ELSE 0 END + least(40, coalesce(mal, 0) * 15)) AS INT) AS risk_score, brand FROM k)"""


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct hosts with a number that depends on the name."""
    pages = _table(spark, sf_dir, "pages")
    return pages.select(hosts.canonical_host(F.col("url")).alias("host")).distinct().withColumn("n", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int"))


_HOST_ROWS = f"hn AS (SELECT host, CAST(concat('0x', substr(md5(host), 1, 6)) AS INT) AS n FROM (SELECT DISTINCT {_HOST} AS host FROM pages))"


def _whois(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    created = F.date_format(F.date_sub(F.lit(AS_OF).cast("date"), n % 400), "yyyy-MM-dd")
    return _hosts(spark, sf_dir).filter("n % 7 <> 6").select(
        "host",
        F.when(n % 7 == 5, 404).otherwise(200).alias("http_status"),
        F.when(n % 5 != 4, created).alias("created_date"),
        *(F.lit(None).cast("string").alias(c) for c in ("registry_created_date", "created_normalized", "registry_created_normalized")),
        F.when(n % 5 == 4, F.lit(45.0)).alias("estimated_age"),
        F.when(n % 13 == 0, "timeout").otherwise("ok").alias("outcome"),
    )


def _certs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    issuer = F.when(n % 3 == 0, "Let's Encrypt").when(n % 3 == 1, "Cloudflare, Inc.").otherwise("DigiCert Inc")
    outcome = F.when(n % 10 == 7, "self_signed").when(n % 10 == 8, "dns_failure").otherwise("ok")
    end = F.when(n % 10 == 6, "Jan  5 10:00:00 1999 GMT").otherwise("Jan 15 10:00:00 2001 GMT")
    return _hosts(spark, sf_dir).filter("n % 10 <> 9").select("host", issuer.alias("issuer_org"), F.lit("CA").alias("issuer_cn"), end.alias("not_after"), outcome.alias("outcome"))


def domain_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("msg_id"), F.array("url").alias("urls"))
    out = intel.domain_evidence(intel.explode_urls(pages), _whois(spark, sf_dir), _certs(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))
    return out.select("msg_id", "domain", "validation_status", F.coalesce("age_days", F.lit(-1)).alias("age_days"), "whois_status", "tls_status", F.col("is_free_tls").cast("int").alias("is_free_tls"), "risk_score", "intelligence_quality")


_DOMAIN_EVIDENCE = f"""{_HOST_ROWS},
    w AS (SELECT host, n, n % 7 <> 6 AS w_there, CASE WHEN n % 5 = 4 THEN 45 ELSE n % 400 END AS days, CASE n % 10 WHEN 9 THEN 'unknown' WHEN 7 THEN 'self_signed' WHEN 8 THEN 'dns_failure' WHEN 6 THEN 'expired' ELSE 'valid' END AS tls FROM hn),
    x AS (SELECT *, CASE WHEN NOT w_there THEN 'unknown' WHEN n % 13 = 0 THEN 'timeout' WHEN n % 7 = 5 THEN 'not_found' ELSE 'valid' END AS whois FROM w),
    de AS (SELECT *, CASE WHEN whois IN ('valid', 'timeout') AND n % 7 <> 5 THEN days ELSE -1 END AS age,
        CASE WHEN n % 10 IN (7, 8, 9) THEN 0 WHEN n % 3 < 2 THEN 1 ELSE 0 END AS free,
        CASE WHEN whois <> 'valid' THEN 0 WHEN days < 30 THEN 60 WHEN days < 90 THEN 30 ELSE 0 END + CASE WHEN tls IN ('expired', 'self_signed') THEN 20 ELSE 0 END AS risk FROM x)"""


def _page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page evidence for five of six pages' URLs, of which one in six has a form if its URL asks for something."""
    n = F.col("page_id")
    asks = text.any_of(F.col("url"), fixed.PAGE_LURES)
    form = F.struct(asks.alias("has_auth_inputs"), asks.alias("has_payment_forms"), F.when(asks, 3).otherwise(0).alias("input_tags_count"), F.when(asks, 1).otherwise(0).alias("iframe_count"))
    signals = F.when(n % 6 == 4, form).otherwise(hosts.html_page_signals(F.col("html")))
    rows = _table(spark, sf_dir, "pages").filter("page_id % 6 <> 5").select(
        "url", n,
        F.when(n % 6 == 3, "initiated").otherwise("completed").alias("sandbox_status"),
        F.lit(0).alias("risk_weight"), signals.alias("dom_signals"), F.col("url").alias("final_redirect_url"),
    )
    first = rows.groupBy("url").agg(F.min_by(F.struct("sandbox_status", "risk_weight", "dom_signals", "final_redirect_url"), "page_id").alias("r"))
    return first.select("url", "r.*")


def html_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", hosts.html_page_signals(F.col("html")).alias("s"), F.regexp_count("html", F.lit(r"(?i)<a\b")).alias("anchors")).select("page_id", F.col("s.has_auth_inputs").cast("int").alias("auth"), F.col("s.has_payment_forms").cast("int").alias("payment"), F.col("s.input_tags_count").alias("inputs"), F.col("s.iframe_count").alias("iframes"), "anchors")


def _snapshots(spark: SparkSession, sf_dir: str) -> scan.Snapshots:
    return scan.Snapshots(_reputation(spark, sf_dir), _whois(spark, sf_dir), _certs(spark, sf_dir), _page_results(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages scored with their page's URL as evidence."""
    own = _messages(spark, sf_dir).withColumn("urls", F.when(F.col("url").isNotNull(), F.array("url")).otherwise(F.array().cast("array<string>")))
    tables = _snapshots(spark, sf_dir)
    urls = intel.explode_urls(own.select("msg_id", "urls"))
    url_rows = intel.url_evidence(urls, tables.reputation)
    domain_rows = intel.domain_evidence(urls, tables.whois, tables.certs, F.lit(AS_OF).cast("timestamp"))
    page_rows = intel.sandbox_evidence(own.select("msg_id", "urls").filter(F.size("urls") > 0), tables.pages)
    return scoring.score(scoring.fan_in(labels.with_text_result(own, F.col("text")), url_rows, domain_rows, page_rows))


def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("msg_id", F.col("text_track.risk_score").alias("text_score"), "url_score", "domain_score", "sandbox_status", "timeout_penalty", "risk_score", "risk_category", F.col("redistributed").cast("int").alias("redistributed"))


_PAGE_LURE = _any(fixed.PAGE_LURES, "url")
_FANNED = f"""{_LEXICON}, {_URL_EVIDENCE}, {_DOMAIN_EVIDENCE},
    pg AS (SELECT url, min(page_id) AS pn FROM pages WHERE page_id % 6 <> 5 GROUP BY url),
    f AS (SELECT r.*, mm.url, ue.msg_id IS NOT NULL AS has_url, coalesce(ue.risk_score, 0) AS url_score, CAST(coalesce(de.risk, 0) AS INT) AS domain_score, ue.brand AS squat_brand, ue.reputation,
        de.whois, de.age AS host_age, de.tls AS host_tls, de.free AS host_free,
        CASE WHEN ue.msg_id IS NULL THEN 'skipped' WHEN pg.pn IS NULL THEN 'hostile_timeout' WHEN pg.pn % 6 = 3 THEN 'initiated' ELSE 'completed' END AS sandbox_status,
        coalesce(pg.pn % 6 = 4 AND {_PAGE_LURE.replace("url", "mm.url")}, false) AS page_asks
        FROM r JOIN m mm ON mm.msg_id = r.msg_id LEFT JOIN ue ON ue.msg_id = r.msg_id LEFT JOIN de ON de.host = ue.domain LEFT JOIN pg ON pg.url = mm.url)"""
_TOTAL = f"""g AS (SELECT *, CASE WHEN NOT has_url THEN risk
        WHEN sandbox_status = 'hostile_timeout' THEN CAST(trunc(risk * (40.0::DOUBLE / 85) + url_score * (25.0::DOUBLE / 85) + domain_score * (20.0::DOUBLE / 85)) AS INT) + 6
        ELSE CAST(trunc(risk * 0.4::DOUBLE + url_score * 0.25::DOUBLE + domain_score * 0.2::DOUBLE + (CASE WHEN page_asks THEN 100 ELSE 0 END) * 0.15::DOUBLE) AS INT) END AS raw FROM f),
    o AS (SELECT *, CAST(least(100, greatest(0, raw)) AS INT) AS final, CASE WHEN raw <= 30 THEN 'Safe' WHEN raw <= 60 THEN 'Suspicious' ELSE 'High Risk' END AS category FROM g)"""
_RISK = f"{_FANNED}, {_TOTAL}"


def narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = scoring.explain(_scored(spark, sf_dir))
    return told.select("msg_id", F.col("explanations.en").alias("en"), F.col("explanations.hi").alias("hi"))


def _say(lang: dict[str, str], key: str) -> str:
    return "'" + lang[key].replace("{by}", "").replace("'", "''") + "'"


def _narrative_sql(language: str) -> str:
    from .narrative_texts import EN, FACETS, HI

    say = HI if language == "hi" else EN
    bullets = [f"CASE WHEN s_{f} >= 0.5 THEN {_say(say, f)} END" for f in FACETS]
    bullets += [f"CASE WHEN intent = '{i}' THEN {_say(say, i)} END" for i in fixed.INTENT_WORDS]
    recent = "(whois = 'valid' AND host_age < 30)"
    bullets += [
        f"CASE WHEN squat_brand IS NOT NULL THEN replace({_say(say, 'typosquatting')}, '{{brand}}', upper(squat_brand)) END",
        f"CASE WHEN reputation = 'malicious' THEN {_say(say, 'virustotal')} END",
        f"CASE WHEN {recent} THEN {_say(say, 'recent_domain')} END",
        f"CASE WHEN {recent} AND host_free = 1 THEN {_say(say, 'ssl_free')} END",
        f"CASE WHEN host_tls IN ('expired', 'self_signed') THEN {_say(say, 'ssl_invalid')} END",
        f"CASE WHEN sandbox_status = 'hostile_timeout' THEN {_say(say, 'sandbox_timeout')} WHEN sandbox_status = 'completed' AND page_asks THEN {_say(say, 'sandbox_dom')} END",
    ]
    body = f"coalesce(nullif(concat_ws(chr(10), {', '.join(bullets)}), ''), {_say(say, 'none')})"
    name = "category" if language == "en" else "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.CATEGORY_HI.items()) + " END"
    intro = f"replace(replace({_say(say, 'intro')}, '{{category}}', {name}), '{{score}}', CAST(final AS VARCHAR))"
    end = f"CASE category WHEN 'Safe' THEN {_say(say, 'Safe')} WHEN 'Suspicious' THEN {_say(say, 'Suspicious')} ELSE {_say(say, 'High Risk')} END"
    return f"concat({intro}, chr(10), chr(10), {_say(say, 'findings')}, chr(10), {body}, chr(10), chr(10), {end})"


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.diagnostics(scoring.explain(_scored(spark, sf_dir))).withColumns({"any_typosquat": F.col("any_typosquat").cast("int"), "confidence": F.round("confidence", 4)})


def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan from raw messages: healing, entities, all tracks, score."""
    own = _messages(spark, sf_dir).select("msg_id", F.concat_ws(" ", "text", "url").alias("text"))
    out = scan.score_messages(own, _snapshots(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), texts=False)
    return out.select("msg_id", F.size("urls").alias("n_urls"), "risk_score", "risk_category", F.sha2("explanations.en", 256).alias("narrative"))


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Messages over eight days, some in an excluded language, and a quarter's results of up to 35 hours before."""
    n = F.col("msg_id")
    own = _messages(spark, sf_dir).select("msg_id", F.concat(F.concat_ws(" ", "text", "url"), F.when(n % 13 == 5, " आहे").otherwise("")).alias("text"), F.lit("text").alias("input_type"), F.timestamp_seconds(F.unix_timestamp(F.lit(AS_OF)) + n * 7919 % 200 * 3600 + n % 60 * 60).alias("ts"))
    known = own.filter("msg_id % 4 = 1").select(cache.cache_key(F.col("text")).alias("hash"), F.concat(F.lit("before-"), "msg_id").alias("scan_id"), F.timestamp_seconds(F.unix_timestamp("ts") - n % 36 * 3600).alias("created_at"))
    return own, known


def scan_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan with its three outputs: what is scored, what reuses a result (and which), and what is rejected."""
    own, known = _asked(spark, sf_dir)
    done, reused, rejected = scan.scan(own, _snapshots(spark, sf_dir), known, F.lit(AS_OF).cast("timestamp"))
    blank = lambda kind: F.lit(None).cast(kind)
    scored = done.select("msg_id", F.lit("scored").alias("outcome"), "scan_id", "risk_score", "risk_category")
    reused = reused.select("msg_id", F.lit("reused").alias("outcome"), F.col("hit_id").alias("scan_id"), blank("int").alias("risk_score"), blank("string").alias("risk_category"))
    rejected = rejected.select("msg_id", F.col("reason").alias("outcome"), blank("string").alias("scan_id"), blank("int").alias("risk_score"), blank("string").alias("risk_category"))
    return scored.unionByName(reused).unionByName(rejected)


#: Messages with their times, the result that each finds from before, and which of the rest are scored.
_OUTCOMES = f"""q0 AS (SELECT msg_id, md5(concat(concat_ws(' ', text, url), CASE WHEN msg_id % 13 = 5 THEN ' आहे' ELSE '' END)) AS key, msg_id % 13 = 5 AS other, msg_id * 7919 % 200 * 3600 + msg_id % 60 * 60 AS s FROM m),
    kn AS (SELECT key, msg_id, s - msg_id % 36 * 3600 AS s FROM q0 WHERE msg_id % 4 = 1),
    hits AS (SELECT q0.msg_id, arg_max(concat('before-', kn.msg_id), (kn.s, concat('before-', kn.msg_id))) AS hit FROM q0 JOIN kn ON kn.key = q0.key AND kn.s <= q0.s AND kn.s >= q0.s - 86400 GROUP BY q0.msg_id),
    q1 AS (SELECT * FROM q0 WHERE NOT other AND msg_id NOT IN (SELECT msg_id FROM hits)), qd AS (SELECT DISTINCT key, s FROM q1),
    nx AS (SELECT a.key, a.s, (SELECT min(b.s) FROM qd b WHERE b.key = a.key AND b.s > a.s + 86400) AS nxt FROM qd a),
    ch(key, s) AS (SELECT key, min(s) FROM qd GROUP BY key UNION ALL SELECT nx.key, nx.nxt FROM ch JOIN nx ON nx.key = ch.key AND nx.s = ch.s WHERE nx.nxt IS NOT NULL),
    scored AS (SELECT q1.key, q1.s, min(q1.msg_id) AS msg_id FROM q1 JOIN ch ON ch.key = q1.key AND ch.s = q1.s GROUP BY ALL),
    out AS (SELECT q0.msg_id, CASE WHEN hits.hit IS NOT NULL THEN 'reused' WHEN other THEN 'excluded_language' WHEN scored.msg_id IS NOT NULL THEN 'scored' ELSE 'reused' END AS outcome, hits.hit,
        (SELECT arg_max(z.msg_id, z.s) FROM scored z WHERE z.key = q0.key AND z.s <= q0.s) AS own
        FROM q0 LEFT JOIN hits USING (msg_id) LEFT JOIN scored ON scored.msg_id = q0.msg_id)"""
_SCAN_NAME = "concat('scam_', year(TIMESTAMP '{0}' + to_seconds({1} * 7919 % 200 * 3600 + {1} % 60 * 60)), '_', substr(sha256(CAST({1} AS VARCHAR)), 1, 12))"
_WITH_SCHEME = "CASE WHEN regexp_matches(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN u ELSE concat('http://', u) END"
#: All URLs that healed texts hold, with their evidence, and what of it each message's score and explanation ask for.
_SCANNED = f"""{_HEALED.replace("e1 AS", "e0 AS")}, e1 AS (SELECT msg_id, trim(regexp_replace(h, '{_dialect(fixed.SPACE)}+', ' ', 'g')) AS normalized, {_healed("h")} AS h FROM e0), {_FROM_HEALED},
    l AS (SELECT msg_id, '' AS source, lower(normalized) AS low FROM e1), {_COUNTED}, {_REPUTATION}, {_DOMAIN_EVIDENCE},
    u5 AS (SELECT msg_id, u, row_number() OVER (PARTITION BY msg_id ORDER BY -length(u), i) AS pos, {_HOST.replace("(url,", f"({_WITH_SCHEME},")} AS host FROM u3), h AS (SELECT DISTINCT host FROM u5), {_SQUATTED},
    u6 AS (SELECT u5.*, sq.brand, CASE WHEN n % 11 <> 0 THEN n % 5 END AS mal, n % 4 AS sus FROM u5 LEFT JOIN rep ON rep.url = u5.u LEFT JOIN sq ON sq.host = u5.host),
    by_url AS (SELECT msg_id, count(*) AS n_urls, max(least(100, CASE WHEN brand IS NOT NULL THEN 60 ELSE 0 END + least(40, coalesce(mal, 0) * 15))) AS url_score, arg_min(brand, pos) FILTER (brand IS NOT NULL) AS squat_brand, max(CASE WHEN mal >= 2 THEN 'malicious' END) AS reputation, arg_min(u, pos) AS url FROM u6 GROUP BY msg_id),
    by_host AS (SELECT msg_id, max(risk) AS domain_score, bool_or(whois = 'valid' AND age < 30) AS recent, bool_or(whois = 'valid' AND age < 30 AND free = 1) AS free, bool_or(tls IN ('expired', 'self_signed')) AS bad FROM (SELECT DISTINCT msg_id, host FROM u5) d JOIN de USING (host) GROUP BY msg_id),
    pg AS (SELECT url, min(page_id) AS pn FROM pages WHERE page_id % 6 <> 5 GROUP BY url),
    f AS (SELECT r.*, coalesce(by_url.n_urls, 0) AS n_urls, by_url.url, by_url.url IS NOT NULL AS has_url, coalesce(by_url.url_score, 0) AS url_score, CAST(coalesce(by_host.domain_score, 0) AS INT) AS domain_score, squat_brand, reputation,
        CASE WHEN recent THEN 'valid' END AS whois, CASE WHEN recent THEN 0 END AS host_age, CASE WHEN bad THEN 'expired' END AS host_tls, CASE WHEN free THEN 1 ELSE 0 END AS host_free,
        CASE WHEN by_url.url IS NULL THEN 'skipped' WHEN pg.pn IS NULL THEN 'hostile_timeout' WHEN pg.pn % 6 = 3 THEN 'initiated' ELSE 'completed' END AS sandbox_status, coalesce(pg.pn % 6 = 4 AND {_PAGE_LURE.replace("url", "pg.url")}, false) AS page_asks
        FROM r LEFT JOIN by_url ON by_url.msg_id = r.msg_id LEFT JOIN by_host ON by_host.msg_id = r.msg_id LEFT JOIN pg ON pg.url = by_url.url), {_TOTAL}"""


# --- addresses ----------------------------------------------------------------


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    four = F.concat_ws(".", (n * 7 % 256).cast("string"), (n * 13 % 256).cast("string"), (n % 256).cast("string"), (n * 3 % 256).cast("string"))
    return _table(spark, sf_dir, "events").select("event_id", "user_id", four.alias("ip"))


_ADDRESS = "concat_ws('.', event_id * 7 % 256, event_id * 13 % 256, event_id % 256, event_id * 3 % 256)"


def _unsafe_sql(number: str) -> str:
    import ipaddress

    nets = [ipaddress.ip_network(n) for n in fixed.UNSAFE_V4]
    return "(" + " OR ".join(f"{number} BETWEEN {int(n.network_address)} AND {int(n.broadcast_address)}" for n in nets) + ")"


_NUMBER = "(event_id * 7 % 256 * 16777216 + event_id * 13 % 256 * 65536 + event_id % 256 * 256 + event_id * 3 % 256)"


def ip_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _addresses(spark, sf_dir).withColumn("key", hosts.ip_key(F.col("ip")))
    return out.select("event_id", "ip", "key", hosts.is_safe_key(F.col("key")).cast("int").alias("safe"))


def egress_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a connection of its user; the first address a user was seen with is approved."""
    seen = _addresses(spark, sf_dir).withColumn("host", F.col("user_id").cast("string"))
    pins = seen.groupBy("host").agg(F.min_by("ip", "event_id").alias("pinned_ip"))
    peer = F.when(F.col("event_id") % 17 == 0, "").when(F.col("event_id") % 19 == 0, "not-an-address").otherwise(F.col("ip"))
    out = intel.egress_audit(seen.select("event_id", "host", peer.alias("peer_ip")), pins)
    return out.groupBy(F.coalesce("error", F.lit("allowed")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    own = _hosts(spark, sf_dir).filter("n % 9 <> 8").withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(1))))
    n = F.col("n")
    ip = F.when((n % 5 == 0) & (F.col("ord") == 1), F.concat(F.lit("10.0.0."), (n % 200).cast("string"))).otherwise(F.concat(F.lit("93.184.216."), ((n + F.col("ord")) % 200).cast("string")))
    answers = own.select(F.col("host").alias("hostname"), "ord", ip.alias("ip"), F.when(n % 9 == 7, "timeout").otherwise("ok").alias("outcome"))
    urls = pages.select("page_id", F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("ftp://"), hosts.canonical_host(F.col("url")))).otherwise(F.concat(F.lit("http://"), hosts.canonical_host(F.col("url")), F.lit("/p?q=1#f"))).alias("url"))
    out = intel.preflight(urls, answers)
    return out.select("page_id", F.col("allowed").cast("int").alias("allowed"), "reason", F.coalesce("normalized_url", F.lit("")).alias("normalized_url"), F.coalesce(F.array_join("resolved_ips", "|"), F.lit("")).alias("ips"))


# --- corpus ---------------------------------------------------------------------


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_by_hash(corpus.min_text(_corpus(spark, sf_dir)), ["row_ord"])


_UNIQUE = f"""{_CORPUS}, un AS (SELECT * FROM (SELECT msg_id, trim(text, ' \t\n\r') AS text, source, is_scam, row_number() OVER (PARTITION BY lower(trim(text, ' \t\n\r')) ORDER BY msg_id) AS rn
        FROM corpus WHERE length(trim(text, ' \t\n\r')) >= 4) WHERE rn = 1)"""


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unique(spark, sf_dir).select(F.col("row_ord").alias("msg_id"), "is_scam", F.sha2(F.lower("text"), 256).alias("hash"))


def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sequential_ids(_unique(spark, sf_dir), ["row_ord"], "real_").select(F.col("row_ord").alias("msg_id"), "id")


def _records(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    """Split records with their strata and the named columns; the split writes them, so no query computes what it does not read."""
    numbered = _unique(spark, sf_dir).withColumn("id", F.col("row_ord").cast("string"))
    return corpus.stratified_split(corpus.build_records(numbered).select("id", "language", "is_scam", *columns), ["language", "is_scam"])


#: Rows with language and split, from the same hash order.
_AFTER = f"""tk AS (SELECT msg_id, regexp_replace(text, '\\b[0-9]{{4}}\\s[0-9]{{4}}\\s[0-9]{{4}}\\b', '{fixed.NATIONAL_ID_MASK}', 'g') AS text, source, is_scam FROM un),
    tg AS (SELECT *, {_TOKENS} AS tok FROM tk),
    lg AS (SELECT *, CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'Hindi' WHEN list_has_any(tok, {_in(fixed.STRONG_INDIC_WORDS)}) OR len(list_intersect(list_distinct(tok), {_in(fixed.INDIC_PARTICLES)})) >= 2 THEN 'Hinglish' ELSE 'English' END AS language FROM tg),
    rk AS (SELECT *, row_number() OVER (PARTITION BY language, is_scam ORDER BY sha256(concat('42:', msg_id)), CAST(msg_id AS VARCHAR)) - 1 AS rank, count(*) OVER (PARTITION BY language, is_scam) AS n FROM lg),
    sp AS (SELECT *, lower(text) AS low, CASE WHEN rank < floor(n * 0.8::DOUBLE) THEN 'train' WHEN rank < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM rk)"""
_SPLIT = f"{_UNIQUE}, {_AFTER}"


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select(F.col("id").cast("long").alias("msg_id"), "language", "is_scam", "split")


def training_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus built from two sources: messages come before turns of conversations, of which a user's count as scams."""
    turns = _table(spark, sf_dir, "conversations")
    turns = turns.select("text", (F.col("role") == "user").cast("int").alias("is_scam"), (F.col("conv_id") * 10000 + F.col("turn")).alias("row_ord"))
    built = training.build_corpus([("messages", _corpus(spark, sf_dir)), ("Turns/all", turns)])
    return built.select("id", "source_dataset", "split_group", "language", "is_scam", F.col("head2_scam_intent").alias("intent"), "split", F.sha2("text", 256).alias("text_hash"))


_BUILT = f"""{_CORPUS}, both_ AS (SELECT 0 AS src, msg_id AS ord, text, 'messages' AS source, is_scam FROM corpus UNION ALL SELECT 1, conv_id * 10000 + turn, text, 'Turns/all', CASE WHEN role = 'user' THEN 1 ELSE 0 END FROM conversations),
    first_ AS (SELECT * FROM (SELECT src, ord, trim(text, ' \t\n\r') AS text, source, is_scam, row_number() OVER (PARTITION BY lower(trim(text, ' \t\n\r')) ORDER BY src, ord) AS rn FROM both_ WHERE length(trim(text, ' \t\n\r')) >= 4) WHERE rn = 1),
    un AS (SELECT concat('real_', lpad(CAST(row_number() OVER (ORDER BY src, ord) AS VARCHAR), 6, '0')) AS msg_id, text, source, is_scam FROM first_)"""


def group_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of fifty messages of a class in the order of their ids."""
    return corpus.group_label(_corpus(spark, sf_dir), "is_scam", ["row_ord"], "group_").select(F.col("row_ord").alias("msg_id"), "is_scam", "split_group")


def class_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven messages of each source in a reproducible random order."""
    return corpus.seeded_sample(_corpus(spark, sf_dir).select("row_ord", "source_dataset"), "source_dataset", 7, "row_ord").select(F.col("row_ord").alias("msg_id"), F.col("source_dataset").alias("source"))


def usable_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by role whose text is long enough and not the name of a missing value."""
    turns = _table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 9 == 0, " NaN ").otherwise(F.col("text")))
    return corpus.drop_null_like(turns, 3).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("characters"))


def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.integrity(_records(spark, sf_dir, "text", "source_dataset"), 50.0).withColumn("passed", F.col("passed").cast("int"))


def split_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.split_matrix(_records(spark, sf_dir, "source_dataset"))


def intent_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.intent_distribution(_records(spark, sf_dir, "head2_scam_intent"))


def facet_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.facet_rates(_records(spark, sf_dir, "head1_social_engineering"))


def privacy_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.privacy(_records(spark, sf_dir, "text"))


def exact_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that splits share when copies are left in."""
    raw = _corpus(spark, sf_dir).withColumn("split", F.when(F.col("row_ord") % 10 < 8, "train").when(F.col("row_ord") % 10 == 8, "val").otherwise("test"))
    return audit.exact_overlaps(raw.withColumn("text", F.regexp_replace("text", r"^[^ ]+ ", "")))


def benign_defence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.benign_defence(_records(spark, sf_dir))


def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.source_profile(_corpus(spark, sf_dir))


def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.corpus_summary(_records(spark, sf_dir, "head2_scam_intent", F.struct("metadata.has_url").alias("metadata")))


def hinglish_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.hinglish_purity(_records(spark, sf_dir, "text"))


def template_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of Indic test rows whose masked template is in train."""
    return audit.template_overlap(_records(spark, sf_dir, "text"))


def content_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of content flags by language."""
    flags = [F.count_if(f"metadata.{k}").alias(k) for k in fixed.FLAGS]
    return _records(spark, sf_dir, "metadata").groupBy("language").agg(*flags, F.count(F.lit(1)).alias("n"))


def threat_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.ingestion_funnel(corpus.threat_filter(corpus.devanagari_only(_unique(spark, sf_dir))))


def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.top_values(_table(spark, sf_dir, "documents"), "source")


# --- screenshots ------------------------------------------------------------------


def _blocks(spark: SparkSession, sf_dir: str, script: str) -> DataFrame:
    """Turns of a conversation as blocks of a screenshot, one recogniser's view of it.

    Each recogniser sees every block, but some where the other sees none, so merging meets both cases.
    """
    n, shift = F.col("turn"), 0 if script == "en" else 3
    apart = F.when(n % 5 == 4, 2000).otherwise(0) if script == "en" else F.when(n % 4 == 3, 4000).otherwise(0)
    x, y = (n * 37 % 200).cast("int") + shift, (n * 11 % 97 * 10).cast("int") + apart + shift
    corner = lambda a, b: F.array(a, b)
    box = F.array(corner(x, y), corner(x + 90, y), corner(x + 90, y + 12), corner(x, y + 12))
    word = F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z0-9]+", 0)
    word = F.concat(F.when(word == "", "t").otherwise(word), n.cast("string"))
    words = F.when((F.lit(script) == "hi") & (n % 3 == 0), "सूचना").otherwise(word)
    rows = _table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("image_id"), n.cast("int").alias("block_idx"), box.alias("bbox"), words.alias("text"), F.lit(0.5) + (n % 10) / 20.0, F.lit(script).alias("script")).toDF("image_id", "block_idx", "bbox", "text", "confidence", "script")


_WORD = "concat(coalesce(nullif(regexp_extract(coalesce(text, ''), '[A-Za-z0-9]+'), ''), 't'), turn)"


def block_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = blocks.min_confidence(blocks.merge_scripts(_blocks(spark, sf_dir, "hi"), _blocks(spark, sf_dir, "en")))
    return out.select("image_id", "block_idx", "text", "script", F.round("confidence", 4).alias("confidence"))


#: Boxes of both recognisers, the best partner of each Hindi block, and the blocks that stay.
_MERGE = f"""c AS (SELECT conv_id, turn, {_WORD} AS word, turn * 37 % 200 AS x, turn * 11 % 97 * 10 AS y, 0.5::DOUBLE + (turn % 10) / 20.0::DOUBLE AS confidence FROM conversations),
    en AS (SELECT conv_id, turn, word AS text, confidence, x, y + CASE WHEN turn % 5 = 4 THEN 2000 ELSE 0 END AS y FROM c),
    hi AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'सूचना' ELSE word END AS text, confidence, turn % 3 = 0 AS own, x + 3 AS x, y + 3 + CASE WHEN turn % 4 = 3 THEN 4000 ELSE 0 END AS y FROM c),
    pairs AS (SELECT hi.conv_id, hi.turn AS hi, en.turn AS en, greatest(0, least(hi.x, en.x) + 90 - greatest(hi.x, en.x)) * greatest(0, least(hi.y, en.y) + 12 - greatest(hi.y, en.y)) AS common FROM hi JOIN en USING (conv_id)),
    best AS (SELECT conv_id, hi, arg_min(en, (-common, en)) AS en, max(common) AS common FROM pairs WHERE common > 0 GROUP BY ALL HAVING max(common)::DOUBLE / (2160 - max(common)) > 0.5),
    merged AS (SELECT hi.conv_id, hi.turn, hi.text, 'hi' AS script, hi.confidence FROM hi WHERE own
        UNION ALL SELECT en.conv_id, en.turn, en.text, 'en', en.confidence FROM en JOIN best ON best.conv_id = en.conv_id AND best.en = en.turn JOIN hi ON hi.conv_id = best.conv_id AND hi.turn = best.hi AND NOT hi.own
        UNION ALL SELECT conv_id, turn, text, 'en', confidence FROM en WHERE (conv_id, turn) NOT IN (SELECT (conv_id, en) FROM best))"""


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.reading_order(_blocks(spark, sf_dir, "en"))


_ORDER = f"""b AS (SELECT conv_id, turn, {_WORD} AS word, (turn * 37 % 200) AS x, (turn * 11 % 97 * 10) + CASE WHEN turn % 5 = 4 THEN 2000 ELSE 0 END AS y FROM conversations),
    g AS (SELECT *, CASE WHEN y - lag(y) OVER w >= 15 THEN 1 ELSE 0 END AS fresh, row_number() OVER w AS ord FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY y, x, turn)),
    l AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY ord) AS line FROM g),
    t AS (SELECT conv_id, line, string_agg(word, ' ' ORDER BY x, ord) AS txt FROM l GROUP BY ALL)"""


def block_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = blocks.statistics(_blocks(spark, sf_dir, "hi"))
    return out.select("image_id", "blocks", F.round("min_confidence", 4).alias("min_confidence"), F.round("mean_confidence", 6).alias("mean_confidence"), "characters", F.col("devanagari").cast("int").alias("devanagari"))


def _read_without_e(rows: DataFrame) -> DataFrame:
    """Texts (filename, role, text, n) as ground truth, read with every e lost and each seventh one failed."""
    n = F.col("n")
    seen = rows.select("filename", F.col("role").alias("folder"), F.replace("text", F.lit("e"), F.lit("")).alias("clean_text"), (n % 50 + 10).cast("double").alias("execution_time_ms"), (n % 3 == 0).alias("fallback_used"), F.when(n % 7 == 0, "unreadable").alias("error"))
    return ocr_eval.evaluate(seen, rows.select("filename", "text"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("filename"), "role", "text", (F.col("conv_id") + F.col("turn")).alias("n"))


def recognition_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ocr_eval.metrics(_read_without_e(_turns(spark, sf_dir)))
    return out.select(F.coalesce("folder", F.lit("all")).alias("folder"), "total", "successful", "failed", *(F.round(c, 6).alias(c) for c in ("avg_latency_ms", "median_latency_ms", "p95_latency_ms", "avg_cer")), "fallbacks")


def recognition_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rate of each turn."""
    return _read_without_e(_turns(spark, sf_dir)).select("filename", F.round("wer", 6).alias("wer"), "urls_expected", "urls_matched", "amounts_expected", "amounts_matched")


def phrased_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns behind a phrase and before a link."""
    phrase = F.get(F.array(*map(F.lit, PHRASES)), (F.col("n") % len(PHRASES)).cast("int"))
    link = F.concat(F.when(F.col("n") % 2 == 0, " at http://pay").otherwise(" at http://secure"), (F.col("n") % 9).cast("string"), F.lit(".com/x"))
    return _turns(spark, sf_dir).withColumn("text", F.concat(phrase, F.lit(" "), F.coalesce("text", F.lit("")), link))


def recognition_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean word error rate and the share of entities that survive, of phrased turns."""
    out = ocr_eval.metrics(_read_without_e(phrased_turns(spark, sf_dir)))
    return out.select(F.coalesce("folder", F.lit("all")).alias("folder"), F.round("avg_wer", 6).alias("avg_wer"), *(F.round(f"{k}_pct", 4).alias(f"{k}_pct") for k in ocr_eval.KINDS))


def _word_distance(a: str, b: str) -> str:
    """Edit distance of two lists of words: p is the row of the table for the words of a so far, t the next one as it grows."""
    places = lambda x: f"[[CAST(i AS BIGINT)] FOR i IN range(1, len({x}) + 1)]"
    cell = f"least(t[len(t)] + 1, p[j[1] + 1] + 1, p[j[1]] + CASE WHEN {a}[k[1]] = {b}[j[1]] THEN 0 ELSE 1 END)"
    row = f"list_reduce([k] || {places(b)}, lambda t, j: list_append(t, {cell}))"
    return f"list_reduce([range(0, len({b}) + 1)] || {places(a)}, lambda p, k: {row})[len({b}) + 1]"


#: Word error rates of texts t with the words that were read.
_WORDS_READ = f"""z AS (SELECT *, [x FOR x IN string_split_regex(text, '[ \t\n\r]+') IF x <> ''] AS a, [x FOR x IN string_split_regex(replace(text, 'e', ''), '[ \t\n\r]+') IF x <> ''] AS b FROM t),
    wr AS (SELECT *, CASE WHEN n % 7 = 0 OR text IS NULL THEN NULL WHEN len(a) = 0 THEN CASE WHEN len(b) = 0 THEN 0.0 ELSE 1.0 END ELSE {_word_distance("a", "b")}::DOUBLE / len(a) END AS wer FROM z)"""
#: Entities of texts t as they are and as they were read, and how many of each kind survive.
_SURVIVING = f"""e1 AS (SELECT filename AS msg_id, {_healed("text")} AS h FROM t UNION ALL SELECT concat(filename, ' read'), {_healed("replace(text, 'e', '')")} FROM t), {_FROM_HEALED},
    ul AS (SELECT msg_id, list(u) AS urls FROM u3 GROUP BY msg_id), en AS (SELECT e4.msg_id, coalesce(urls, []) AS urls, phones AS phone_numbers, upi AS upi_ids, amounts FROM e4 LEFT JOIN ul ON ul.msg_id = e4.msg_id),
    sv AS (SELECT t.filename, t.role, t.n, {", ".join(f"len(x.{k}) AS {k}_expected, len([v FOR v IN x.{k} IF list_contains(y.{k}, v)]) AS {k}_matched" for k in ocr_eval.KINDS)}
        FROM t JOIN en x ON x.msg_id = t.filename JOIN en y ON y.msg_id = concat(t.filename, ' read') WHERE n % 7 <> 0)"""
_TURN_TEXTS = "t AS (SELECT concat(conv_id, '-', turn) AS filename, role, text, conv_id + turn AS n FROM conversations)"
_PHRASE_OF_TURN = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(PHRASES))
_PHRASED = f"""t AS (SELECT concat(conv_id, '-', turn) AS filename, role, conv_id + turn AS n, concat(CASE (conv_id + turn) % {len(PHRASES)} {_PHRASE_OF_TURN} END, ' ', coalesce(text, ''),
        CASE WHEN (conv_id + turn) % 2 = 0 THEN ' at http://pay' ELSE ' at http://secure' END, (conv_id + turn) % 9, '.com/x') AS text FROM conversations)"""


# --- reuse of results, two heads ------------------------------------------------------


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks look up the latest earlier purchase of the same user within a day."""
    events = _table(spark, sf_dir, "events").withColumn("hash", F.sha2(F.col("user_id").cast("string"), 256))
    asked = events.filter("event_id % 3 = 0").select(F.col("event_id").alias("msg_id"), "hash", "ts")
    kept = events.filter("event_id % 3 <> 0").select("hash", F.col("event_id").alias("scan_id"), F.col("ts").alias("created_at"))
    return cache.lookup(asked, kept).select("msg_id", F.coalesce("hit_id", F.lit(-1)).alias("hit_id"))


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("hash"), F.col("event_id").alias("request_id"), F.date_trunc("second", "ts").alias("ts"))
    return cache.misses(events).select("request_id", F.col("hit").cast("int").alias("hit"))


_MISSES = """e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), d AS (SELECT DISTINCT user_id, s FROM e),
    nx AS (SELECT a.user_id, a.s, (SELECT min(b.s) FROM d b WHERE b.user_id = a.user_id AND b.s > a.s + 86400) AS nxt FROM d a),
    r(user_id, s) AS (SELECT user_id, min(s) FROM d GROUP BY user_id UNION ALL SELECT nx.user_id, nx.nxt FROM r JOIN nx ON nx.user_id = r.user_id AND nx.s = r.s WHERE nx.nxt IS NOT NULL),
    f AS (SELECT e.user_id, e.s, min(e.event_id) AS event_id FROM e JOIN r ON r.user_id = e.user_id AND r.s = e.s GROUP BY ALL)"""


def scan_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id that a scan of each event would have."""
    return _table(spark, sf_dir, "events").select("event_id", scoring.scan_id(F.col("event_id"), F.col("ts")).alias("scan_id"))


def two_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as logits of two heads: five facets and six intents."""
    facets, intents = list(fixed.SOCIAL_WORDS), [*fixed.INTENT_WORDS, fixed.BENIGN]
    v = F.transform("embedding", lambda x: x.cast("double") * 4)
    out = _table(spark, sf_dir, "embeddings").select("vec_id", labels.two_heads(F.slice(v, 1, 5), F.slice(v, 6, 6), facets, intents, fixed.BENIGN, {"urgency": 0.6}).alias("d"))
    return out.select("vec_id", F.col("d.is_scam").cast("int").alias("is_scam"), F.col("d.predicted_intent").alias("intent"), F.array_join("d.triggers", "|").alias("triggers"))


_FACET_NAMES = list(fixed.SOCIAL_WORDS)
_INTENT_NAMES = [*fixed.INTENT_WORDS, fixed.BENIGN]
_HEADS = "e AS (SELECT vec_id, [x::DOUBLE * 4 FOR x IN embedding] AS v FROM embeddings), h AS (SELECT vec_id, v, v[6:11] AS w FROM e)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        lexicon_risk, risk_by_category, weak_labels, rank_words, language_id, redaction, entity_packet, threat_density, shorthand, host_checks, url_evidence,
        domain_evidence, html_signals, risk_score, narrative, diagnostics, full_scan, scan_outcomes, ip_safety, egress_audit, preflight, dedup,
        record_ids, group_labels, class_sample, usable_turns, integrity_report, stratified_split, training_corpus, split_matrix, intent_distribution, facet_rates, privacy_audit, exact_overlaps, benign_defence,
        source_profile, corpus_summary, hinglish_purity, template_overlap, content_flags, threat_funnel, top_sources, block_merge,
        reading_order, block_statistics, recognition_metrics, recognition_words, recognition_entities, cache_lookup, cache_misses, scan_ids, two_heads,
    )
}

_FLAG = {k: f"regexp_matches(text, '{_dialect(p)}')" for k, p in fixed.FLAGS.items()}
_HAS_URL = _FLAG["has_url"]
_TEMPLATE = reduce(lambda t, step: f"regexp_replace({t}, '{_dialect(step[0])}', '{step[1]}', 'g')", fixed.TEMPLATE_STEPS, "lower(text)")
_PERCENT = "CAST(round_even(100.0::DOUBLE * n / sum(n) OVER (), 2) AS DOUBLE) AS percent"
_PAIRS = reduce(lambda a, b: f"{a} UNION ALL {b}", (f"SELECT '{a}_{b}' AS pair, count(*) FILTER (list_contains(s, '{a}') AND list_contains(s, '{b}')) AS shared FROM x" for a, b in (("train", "test"), ("val", "test"), ("train", "val"))))
_CERT = "CASE whois WHEN 'valid' THEN CASE tls WHEN 'valid' THEN 'high' ELSE 'medium' END ELSE CASE tls WHEN 'valid' THEN 'partial' ELSE 'unavailable' END END"

SQL: dict[str, str] = {
    "lexicon_risk": f"WITH {_LEXICON} SELECT msg_id, {', '.join(f'round(s_{f}, 4) AS {f}' for f in _FACET)}, intent, confidence, risk, CAST(most > 0 AS INT) AS is_scam, {_TRIGGERS} AS triggers FROM r",
    "risk_by_category": f"WITH {_LEXICON} SELECT source, CASE WHEN risk <= 30 THEN 'Safe' WHEN risk <= 60 THEN 'Suspicious' ELSE 'High Risk' END AS category, count(*) AS n, CAST(sum(risk) AS BIGINT) AS total_risk, max(risk) AS max_risk FROM r GROUP BY ALL",
    "weak_labels": f"WITH {_CORPUS}, l AS (SELECT *, lower(text) AS low FROM corpus) SELECT msg_id, is_scam, {', '.join(f'{v} AS {f}' for f, v in _WEAK_FACETS.items())}, {_WEAK_INTENT} AS intent, CAST({_any(fixed.TRUTH_WORDS)} AS INT) AS truth FROM l",
    "rank_words": f"WITH m AS ({MESSAGES}), l AS (SELECT msg_id, text, lower(text) AS low FROM m) SELECT msg_id, 2 * {_sum(fixed.RANK_URGENCY)} + 2 * {_sum(fixed.RANK_AUTHORITY)} AS points, CAST({_any(fixed.THREAT_WORDS_HI, 'text')} AS INT) AS threat FROM l",
    "language_id": f"""WITH m AS ({MESSAGES}), t AS (SELECT msg_id, text, {_TOKENS} AS tok FROM m), h AS (SELECT *, len([x FOR x IN tok IF list_contains({_in(fixed.HINGLISH_MARKERS)}, x)]) AS hits FROM t)
        SELECT msg_id, CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'Hindi' WHEN list_has_any(tok, {_in(fixed.STRONG_INDIC_WORDS)}) OR len(list_intersect(list_distinct(tok), {_in(fixed.INDIC_PARTICLES)})) >= 2 THEN 'Hinglish' ELSE 'English' END AS language,
        CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'Hindi' WHEN hits >= 2 OR (hits >= 1 AND (hits::DOUBLE / len(tok) >= 0.05 OR list_has_any(tok, {_in(fixed.HINGLISH_STRONG)}))) THEN 'Hinglish' ELSE 'English' END AS kind,
        CASE WHEN list_has_any(tok, {_in(fixed.INDIC_CORE_WORDS)}) THEN 'true_indic' WHEN list_has_any(tok, {_in(fixed.AMBIGUOUS_WORDS)}) THEN 'ambiguous' ELSE 'none' END AS purity,
        CAST(contains(text, 'ळ') OR list_has_any(regexp_split_to_array(text, '\\s+'), {_in(fixed.MARATHI_WORDS)}) AS INT) AS marathi FROM h""",
    "redaction": f"""WITH m AS ({MESSAGES}), r AS (SELECT msg_id, regexp_replace(text, '\\b[0-9]{{4}}\\s[0-9]{{4}}\\s[0-9]{{4}}\\b', '{fixed.NATIONAL_ID_MASK}', 'g') AS t FROM m)
        SELECT msg_id, sha256(t) AS masked_hash, CAST(contains(t, '{fixed.NATIONAL_ID_MASK}') AS INT) AS masked, sha256(lower(trim(t, ' \t\n\r'))) AS content_hash FROM r""",
    "entity_packet": f"""WITH {_HEALED}, {_FROM_HEALED} SELECT e4.msg_id, coalesce(urls, '') AS urls, coalesce(domains, '') AS domains, array_to_string(upi, '|') AS upi_ids, array_to_string(phones, '|') AS phone_numbers,
        array_to_string([c FOR c IN codes IF len([p FOR p IN phones IF contains(p, c)]) = 0], '|') AS otp_candidates, array_to_string(amounts, '|') AS amounts, array_to_string([b FOR b IN {_in(fixed.BANK_NAMES)} IF regexp_matches(up, concat('\\b', b, '\\b'))], '|') AS bank_names FROM e4 LEFT JOIN u4 ON u4.msg_id = e4.msg_id""",
    "threat_density": f"""WITH {_HEALED}, {_FROM_HEALED}, n AS (SELECT msg_id, count(*) AS n FROM u3 GROUP BY msg_id), low AS (SELECT msg_id, lower(concat_ws(' ', text, url)) AS low FROM m)
        SELECT e4.msg_id, CAST(2 * {_sum(fixed.RANK_URGENCY)} + 2 * {_sum(fixed.RANK_AUTHORITY)} + 3 * coalesce(n.n, 0) + 3 * len(upi) + 2 * len(phones) + 2 * len(amounts) AS INT) AS density FROM e4 JOIN low ON low.msg_id = e4.msg_id LEFT JOIN n ON n.msg_id = e4.msg_id""",
    "shorthand": f"""WITH w AS (SELECT conv_id, turn, [x FOR x IN regexp_split_to_array(concat_ws(' ', text, {_in(list(fixed.SHORTHAND))}[turn % {len(fixed.SHORTHAND)} + 1]), '\\s+') IF x <> ''] AS words FROM conversations)
        SELECT conv_id, turn, sha256(array_to_string([coalesce({_in(list(fixed.SHORTHAND.values()))}[list_position({_in(list(fixed.SHORTHAND))}, lower(x))], x) FOR x IN words], ' ')) AS expanded FROM w""",
    "group_labels": f"WITH {_CORPUS} SELECT msg_id, is_scam, concat('group_', is_scam, '_', CAST(floor((row_number() OVER (PARTITION BY is_scam ORDER BY msg_id) - 1) / 50) AS BIGINT)) AS split_group FROM corpus",
    "class_sample": f"WITH {_CORPUS} SELECT msg_id, source FROM corpus QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256(concat('42:', msg_id))) <= 7",
    "usable_turns": """WITH t AS (SELECT role, trim(CASE WHEN turn % 9 = 0 THEN ' NaN ' ELSE text END, ' \t\n\r') AS text FROM conversations)
        SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS characters FROM t WHERE length(text) >= 3 AND lower(text) <> 'nan' GROUP BY role""",
    "integrity_report": f"""WITH {_SPLIT}, k AS (SELECT split, trim({_TEMPLATE}) AS t FROM sp WHERE language IN ('Hindi', 'Hinglish')), x AS (SELECT list(DISTINCT split) AS s FROM sp GROUP BY trim(text, ' \t\n\r')),
        v AS (SELECT 'synthetic_outside_train' AS "check", 0.0::DOUBLE AS value, 0.0::DOUBLE AS lim UNION ALL SELECT 'unmasked_ids', coalesce(sum(len(regexp_extract_all(text, '\\b[0-9]{{4}}\\s[0-9]{{4}}\\s[0-9]{{4}}\\b'))), 0)::DOUBLE, 0 FROM sp
        UNION ALL SELECT concat('shared_texts_', pair), shared::DOUBLE, 0 FROM ({_PAIRS})
        UNION ALL SELECT 'template_percent', CASE WHEN count(*) > 0 THEN round_even(100.0::DOUBLE * count(*) FILTER (t IN (SELECT t FROM k WHERE split = 'train')) / count(*), 2) ELSE 0.0 END, 50 FROM k WHERE split = 'test')
        SELECT "check", value, lim AS "limit", CAST(value <= lim AS INT) AS passed FROM v""",
    "host_checks": f"""WITH {_SQUAT}, p AS (SELECT page_id, {_HOST} AS host FROM pages), v AS (SELECT p.*, {_VALID} AS validation FROM p)
        SELECT v.page_id, v.host, CAST(validation = 'valid' AS INT) AS is_valid, CASE WHEN validation = 'valid' THEN 'domain' ELSE 'invalid' END AS domain_type, validation, CAST(sq.brand IS NOT NULL AS INT) AS squat, coalesce(sq.brand, '') AS brand,
        CASE stage WHEN 1 THEN {_sentence(fixed.SQUAT_INSIDE, brand="brand")} WHEN 2 THEN {_sentence(fixed.SQUAT_NEAR, label="split_part(v.host, '.', 1)", brand="brand", distance="dist")} ELSE '{fixed.SQUAT_NONE}' END AS squat_reason
        FROM v LEFT JOIN sq ON sq.host = v.host""",
    "url_evidence": f"WITH {_URL_EVIDENCE} SELECT msg_id, url, domain, malicious, reputation, risk_score, CASE WHEN brand IS NOT NULL OR reputation = 'malicious' THEN 'hostile' ELSE 'clean' END AS verdict FROM ue",
    "domain_evidence": f"""WITH {_DOMAIN_EVIDENCE} SELECT p.page_id AS msg_id, de.host AS domain, 'valid' AS validation_status, CAST(age AS INT) AS age_days, whois AS whois_status, tls AS tls_status, free AS is_free_tls, CAST(risk AS INT) AS risk_score, {_CERT} AS intelligence_quality
        FROM pages p JOIN de ON de.host = {_HOST.replace("(url,", "(p.url,")}""",
    "html_signals": """SELECT page_id, CAST(regexp_matches(html, '(?is)<input[^>]*(type\\s*=\\s*["'']?password)') AS INT) AS auth, CAST(regexp_matches(html, '(?is)<(input|form)[^>]*(cvv|upi|payment|checkout)') AS INT) AS payment,
        CAST(len(regexp_extract_all(html, '(?i)<input\\b')) AS INT) AS inputs, CAST(len(regexp_extract_all(html, '(?i)<iframe\\b')) AS INT) AS iframes, CAST(len(regexp_extract_all(html, '(?i)<a\\b')) AS INT) AS anchors FROM pages""",
    "risk_score": f"WITH {_RISK} SELECT msg_id, risk AS text_score, url_score, domain_score, sandbox_status, CASE WHEN sandbox_status = 'hostile_timeout' THEN 6 ELSE 0 END AS timeout_penalty, final AS risk_score, category AS risk_category, CAST(sandbox_status = 'hostile_timeout' AS INT) AS redistributed FROM o",
    "narrative": f"WITH {_RISK} SELECT msg_id, {_narrative_sql('en')} AS en, {_narrative_sql('hi')} AS hi FROM o",
    "diagnostics": f"""WITH {_RISK} SELECT msg_id, CASE WHEN final > 60 THEN 'HIGH' WHEN final > 30 THEN 'SUSPICIOUS' ELSE 'LOW' END AS level,
        CASE WHEN NOT has_url THEN 'skipped' WHEN url_score > 50 THEN 'warn' ELSE 'nominal' END AS url_status, CASE WHEN NOT has_url THEN 'skipped' WHEN domain_score > 50 THEN 'warn' ELSE 'nominal' END AS domain_status,
        CAST(coalesce(reputation = 'malicious', false) AS INT) AS reputation_hits, CAST(squat_brand IS NOT NULL AS INT) AS any_typosquat, confidence, {_TRIGGERS} AS triggers FROM o""",
    "full_scan": f"WITH {_SCANNED} SELECT msg_id, CAST(n_urls AS INT) AS n_urls, final AS risk_score, category AS risk_category, sha256({_narrative_sql('en')}) AS narrative FROM o",
    "scan_outcomes": f"""WITH RECURSIVE {_SCANNED}, {_OUTCOMES} SELECT out.msg_id, outcome, CASE WHEN outcome <> 'excluded_language' THEN coalesce(hit, {_SCAN_NAME.format(AS_OF, "own")}) END AS scan_id,
        CASE WHEN outcome = 'scored' THEN final END AS risk_score, CASE WHEN outcome = 'scored' THEN category END AS risk_category FROM out JOIN o USING (msg_id)""",
    "ip_safety": f"SELECT event_id, {_ADDRESS} AS ip, concat('00000000000000000000ffff', printf('%08x', {_NUMBER})) AS key, CAST(NOT {_unsafe_sql(_NUMBER)} AS INT) AS safe FROM events",
    "egress_audit": f"""WITH e AS (SELECT event_id, user_id, {_ADDRESS} AS ip, {_unsafe_sql(_NUMBER)} AS unsafe FROM events), p AS (SELECT user_id, arg_min(ip, event_id) AS pin FROM e GROUP BY user_id)
        SELECT CASE WHEN event_id % 17 = 0 THEN 'missing_peer' WHEN event_id % 19 = 0 THEN 'malformed_peer' WHEN unsafe THEN 'unsafe_peer' WHEN ip <> pin THEN 'peer_mismatch' ELSE 'allowed' END AS outcome, count(*) AS n, min(event_id) AS first_event FROM e JOIN p USING (user_id) GROUP BY ALL""",
    "preflight": f"""WITH {_HOST_ROWS}, p AS (SELECT page_id, {_HOST} AS host FROM pages), j AS (SELECT p.page_id, p.host, hn.n, page_id % 10 = 0 AS ftp, concat('93.184.216.', n % 200) AS one, CASE WHEN n % 5 = 0 THEN concat('10.0.0.', n % 200) ELSE concat('93.184.216.', (n + 1) % 200) END AS two FROM p JOIN hn USING (host)),
        r AS (SELECT *, CASE WHEN ftp THEN {_sentence(fixed.URL_BAD_SCHEME, scheme="'ftp'")} WHEN n % 9 = 8 THEN '{fixed.DNS_FAILED}' WHEN n % 9 = 7 THEN '{fixed.DNS_LATE}' WHEN n % 5 = 0 THEN {_sentence(fixed.DNS_UNSAFE, ip='two')} ELSE '{fixed.URL_SAFE}' END AS reason FROM j)
        SELECT page_id, CAST(reason = '{fixed.URL_SAFE}' AS INT) AS allowed, reason, CASE WHEN ftp THEN '' ELSE concat('http://', host, '/p?q=1') END AS normalized_url, CASE WHEN ftp OR n % 9 IN (7, 8) THEN '' ELSE concat(one, '|', two) END AS ips FROM r""",
    "dedup": f"WITH {_UNIQUE} SELECT msg_id, is_scam, sha256(lower(text)) AS hash FROM un",
    "record_ids": f"WITH {_UNIQUE} SELECT msg_id, concat('real_', lpad(CAST(row_number() OVER (ORDER BY msg_id) AS VARCHAR), 6, '0')) AS id FROM un",
    "stratified_split": f"WITH {_SPLIT} SELECT msg_id, language, is_scam, split FROM sp",
    "training_corpus": f"WITH {_BUILT}, {_AFTER} SELECT msg_id AS id, source AS source_dataset, concat('real_', replace(lower(source), '/', '_')) AS split_group, language, is_scam, {_WEAK_INTENT} AS intent, split, sha256(text) AS text_hash FROM sp",
    "split_matrix": f"WITH {_SPLIT} SELECT split, {', '.join(f'''count(*) FILTER (language = '{x}' AND is_scam = {i}) AS {x.lower()}_{y}''' for x in ('English', 'Hindi', 'Hinglish') for i, y in ((0, 'ham'), (1, 'scam')))}, CAST(0 AS BIGINT) AS synthetic, count(*) AS real, count(*) AS total FROM sp GROUP BY split",
    "intent_distribution": f"WITH {_SPLIT}, i AS (SELECT {_WEAK_INTENT} AS intent, count(*) AS n FROM sp WHERE is_scam = 1 GROUP BY ALL) SELECT intent, n, {_PERCENT} FROM i",
    "facet_rates": f"WITH {_SPLIT}, " + "x AS (" + " UNION ALL ".join(f"SELECT '{f}' AS facet, CAST(sum({v}) AS BIGINT) AS positives, count(*) AS rows FROM sp WHERE is_scam = 1" for f, v in _WEAK_FACETS.items()) + ") SELECT facet, positives, rows, round_even(100.0::DOUBLE * positives / rows, 2) AS percent FROM x",
    "privacy_audit": f"WITH {_SPLIT} SELECT coalesce(split, 'all') AS split, CAST(sum(len(regexp_extract_all(text, '\\b[0-9]{{4}}\\s[0-9]{{4}}\\s[0-9]{{4}}\\b'))) AS BIGINT) AS unmasked, CAST(sum((length(text) - length(replace(text, '{fixed.NATIONAL_ID_MASK}', ''))) / {len(fixed.NATIONAL_ID_MASK)}) AS BIGINT) AS masked FROM sp GROUP BY ROLLUP (split)",
    "exact_overlaps": f"""WITH {_CORPUS}, x AS (SELECT list(DISTINCT CASE WHEN msg_id % 10 < 8 THEN 'train' WHEN msg_id % 10 = 8 THEN 'val' ELSE 'test' END) AS s FROM corpus GROUP BY trim(regexp_replace(text, '^[^ ]+ ', ''), ' \t\n\r')) {_PAIRS}""",
    "benign_defence": f"WITH {_SPLIT} SELECT split, language, count(*) AS n FROM sp WHERE is_scam = 0 AND language <> 'English' GROUP BY ALL",
    "source_profile": f"WITH {_CORPUS} SELECT source AS source_dataset, count(*) AS rows, CAST(sum(is_scam) AS BIGINT) AS scams, round_even(100 * avg(is_scam), 2) AS percent, round_even(avg(length(text)), 2) AS mean_length, CAST(max(length(text)) AS INT) AS max_length FROM corpus GROUP BY source",
    "corpus_summary": f"WITH {_SPLIT} SELECT coalesce({_WEAK_INTENT}, 'TOTAL') AS head2_scam_intent, count(*) FILTER (language = 'Hindi') AS hindi, count(*) FILTER (language = 'Hinglish') AS hinglish, count(*) AS total, round_even(100 * avg(CAST({_HAS_URL} AS INT)), 1) AS url_percent FROM sp GROUP BY ROLLUP ({_WEAK_INTENT})",
    "hinglish_purity": f"""WITH {_SPLIT}, p AS (SELECT CASE WHEN list_has_any(tok, {_in(fixed.INDIC_CORE_WORDS)}) THEN 'true_indic' WHEN list_has_any(tok, {_in(fixed.AMBIGUOUS_WORDS)}) THEN 'ambiguous' ELSE 'none' END AS purity, count(*) AS n FROM sp WHERE language = 'Hinglish' GROUP BY ALL) SELECT purity, n, {_PERCENT} FROM p""",
    "template_overlap": f"""WITH {_SPLIT}, k AS (SELECT split, trim({_TEMPLATE}) AS t FROM sp WHERE language IN ('Hindi', 'Hinglish')), o AS (SELECT count(*) AS rows, count(*) FILTER (t IN (SELECT t FROM k WHERE split = 'train')) AS overlapping FROM k WHERE split = 'test')
        SELECT rows, overlapping, CASE WHEN rows > 0 THEN round_even(100.0::DOUBLE * overlapping / rows, 2) ELSE 0.0 END AS percent FROM o""",
    "content_flags": f"WITH {_SPLIT} SELECT language, {', '.join(f'count(*) FILTER ({v}) AS {k}' for k, v in _FLAG.items())}, count(*) AS n FROM sp GROUP BY language",
    "threat_funnel": f"""WITH {_UNIQUE}, f AS (SELECT CASE WHEN is_scam = 0 THEN 'ham' WHEN {_any(fixed.THREAT_WORDS_HI, 'text')} THEN 'scam' ELSE 'discarded_marketing' END AS decision, count(*) AS n FROM un WHERE regexp_matches(text, '[ऀ-ॿ]') GROUP BY ALL) SELECT decision, n, {_PERCENT} FROM f""",
    "top_sources": "SELECT source AS value, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, value LIMIT 5",
    "reading_order": f"WITH {_ORDER} SELECT conv_id AS image_id, string_agg(txt, chr(10) ORDER BY line) AS clean_text FROM t GROUP BY conv_id",
    "block_merge": f"WITH {_MERGE} SELECT conv_id AS image_id, turn AS block_idx, text, script, round(confidence, 4) AS confidence FROM merged WHERE confidence >= 0.55",
    "block_statistics": f"""WITH b AS (SELECT conv_id, CASE WHEN turn % 3 = 0 THEN 'सूचना' ELSE {_WORD} END AS w, 0.5::DOUBLE + (turn % 10) / 20.0::DOUBLE AS c FROM conversations)
        SELECT conv_id AS image_id, count(*) AS blocks, round(min(c), 4) AS min_confidence, round(avg(c), 6) AS mean_confidence, CAST(sum(length(w)) AS BIGINT) AS characters, CAST(bool_or(regexp_matches(w, '[ऀ-ॿ]')) AS INT) AS devanagari FROM b GROUP BY conv_id""",
    "recognition_metrics": """WITH t AS (SELECT role, text, replace(text, 'e', '') AS seen, conv_id + turn AS n FROM conversations), u AS (SELECT *, n % 7 <> 0 AS ok, (n % 50 + 10)::DOUBLE AS ms FROM t)
        SELECT coalesce(role, 'all') AS folder, count(*) AS total, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, round(avg(ms) FILTER (ok), 6) AS avg_latency_ms, round(quantile_cont(ms, 0.5) FILTER (ok), 6) AS median_latency_ms, round(quantile_cont(ms, 0.95) FILTER (ok), 6) AS p95_latency_ms,
        round(avg(CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) - length(seen))::DOUBLE / length(text) END) FILTER (ok), 6) AS avg_cer, count(*) FILTER (ok AND n % 3 = 0) AS fallbacks FROM u GROUP BY ROLLUP (role)""",
    "recognition_words": f"""WITH {_TURN_TEXTS}, {_WORDS_READ}, {_SURVIVING} SELECT wr.filename, round(wer, 6) AS wer, urls_expected, urls_matched, amounts_expected, amounts_matched FROM wr LEFT JOIN sv ON sv.filename = wr.filename""",
    "recognition_entities": f"""WITH {_PHRASED}, {_WORDS_READ}, {_SURVIVING} SELECT coalesce(wr.role, 'all') AS folder, round(avg(wer), 6) AS avg_wer,
        {", ".join(f"round(CASE WHEN sum({k}_expected) > 0 THEN 100.0::DOUBLE * sum({k}_matched) / sum({k}_expected) ELSE 0.0 END, 4) AS {k}_pct" for k in ocr_eval.KINDS)} FROM wr LEFT JOIN sv ON sv.filename = wr.filename GROUP BY ROLLUP (wr.role)""",
    "cache_lookup": """SELECT a.event_id AS msg_id, coalesce(arg_max(b.event_id, (b.ts, b.event_id)), -1) AS hit_id FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.event_id % 3 <> 0 AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 24 HOUR
        WHERE a.event_id % 3 = 0 GROUP BY a.event_id""",
    "cache_misses": f"WITH RECURSIVE {_MISSES} SELECT e.event_id AS request_id, CASE WHEN f.event_id IS NULL THEN 1 ELSE 0 END AS hit FROM e LEFT JOIN f ON f.event_id = e.event_id",
    "scan_ids": "SELECT event_id, concat('scam_', year(ts), '_', substr(sha256(CAST(event_id AS VARCHAR)), 1, 12)) AS scan_id FROM events",
    "two_heads": f"""WITH {_HEADS} SELECT vec_id, CAST(list_position(w, list_max(w)) <> {len(_INTENT_NAMES)} AS INT) AS is_scam, {_in(_INTENT_NAMES)}[list_position(w, list_max(w))] AS intent,
        concat_ws('|', {", ".join(f"CASE WHEN 1 / (1 + exp(-v[{i + 1}])) >= {0.6 if f == 'urgency' else 0.5} THEN '{f}' END" for i, f in enumerate(_FACET_NAMES))}) AS triggers FROM h""",
}
