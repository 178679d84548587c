"""Hot keys in joins, lookups and reuse, against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lurelens.operators import cache, intel, joins

START = dt.datetime(2026, 1, 1)


@pytest.fixture
def no_replanning(spark):
    """What Spark would mend at run time is left as planned."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(old, ("false", "-1", "16"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def largest_share(frame):
    """The part of all rows that the fullest task holds."""
    sizes = [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_hot_key_is_dealt(spark, no_replanning):
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 997)).alias("host"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    known = spark.range(500).select(F.concat(F.lit("k"), "id").alias("host"), "id").union(spark.sql("SELECT 'hot', -1")).withColumnRenamed("id", "value")
    want = {(r.host, r.value): r.n for r in rows.join(known, "host", "left").groupBy("host", "value").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = joins.dealt_join(rows, known, ["host"], least_rows=1000)
    assert got.columns == ["host", "id", "m", "value"] and got.count() == 60_000
    assert {(r.host, r.value): r.n for r in got.groupBy("host", "value").agg(F.count(F.lit(1)).alias("n")).collect()} == want
    # Both the hot host and the rows without one make up a third.
    assert largest_share(rows.join(known, "host", "left")) > 0.3 > 0.2 > largest_share(got)
    assert {h for h, _ in joins.hot_keys(rows, ["host"], 1000)} == {r[0] for r in spark.sql("SELECT xxhash64('hot') UNION ALL SELECT xxhash64(CAST(NULL AS STRING))").collect()}
    inner = joins.dealt_join(rows, known, ["host"], "inner", 1000)
    assert inner.count() == rows.join(known, "host").count()


def test_hot_host_in_snapshots(spark, no_replanning, monkeypatch):
    monkeypatch.setattr(joins.dealt_join, "__defaults__", ("left", 500))
    n = 6000
    urls = spark.range(n).select(F.col("id").alias("msg_id"), F.lit(0).alias("pos"), F.when(F.col("id") % 3 == 0, "http://hot.com/x").otherwise(F.concat(F.lit("http://h"), F.col("id") % 700, F.lit(".com/"))).alias("url"))
    urls = urls.withColumn("domain", intel.hosts.canonical_host(F.col("url")))
    whois = spark.createDataFrame([("hot.com", 200, "2026-06-01", None, None, None, None, "ok")], intel.WHOIS)
    certs = spark.createDataFrame([("hot.com", None, None, None, "self_signed")], "host string, issuer_org string, issuer_cn string, not_after string, outcome string")
    found = intel.domain_evidence(urls, whois, certs, F.lit("2026-06-13").cast("timestamp"))
    assert {(r.domain == "hot.com", r.risk_score): r["count"] for r in found.groupBy("domain", "risk_score").count().groupBy((F.col("domain") == "hot.com").alias("h"), "risk_score").agg(F.sum("count").alias("count"), F.first("domain").alias("domain")).collect()} == {(True, 80): n // 3, (False, 0): n - n // 3}
    assert largest_share(found) < 0.2
    reputation = spark.createDataFrame([(r[0], 2, 0, 0, "ok") for r in urls.filter("domain = 'hot.com'").limit(1).select(intel.text.url_key(F.col("url"))).collect()], "url_key string, malicious int, suspicious int, harmless int, outcome string")
    told = intel.url_evidence(urls, reputation)
    assert told.filter("reputation = 'malicious'").count() == n // 3 and largest_share(told) < 0.2


def brute_misses(rows, life):
    last, out = {}, {}
    for key, i, at in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: (r[2], r[1])):
        second = int((at - START).total_seconds() // 1)
        out[i] = key in last and second - last[key] <= life
        if not out[i]:
            last[key] = second
    return out | {i: False for key, i, at in rows if key is None or at is None}


@pytest.mark.parametrize("hours", [1, 24])
def test_misses_match_brute_force(spark, hours):
    rng = random.Random(hours)
    rows = []
    for i in range(900):
        key = rng.choice(["hot", "hot", "b", "c", f"k{i}", None])
        at = START + dt.timedelta(seconds=rng.choice([rng.randrange(40 * 3600 * hours), 3600 * hours * rng.randrange(60), 3600 * hours * rng.randrange(60) + 1]), milliseconds=rng.choice([0, 0, 400]))
        rows.append((key, i, at if rng.random() < 0.99 else None))
    frame = spark.createDataFrame(rows, "hash string, request_id long, ts timestamp")
    assert {r.request_id: r.hit for r in cache.misses(frame, hours).collect()} == brute_misses(rows, hours * 3600)


def test_misses_of_a_long_hot_chain(spark, no_replanning):
    """A third of all requests are one hash, over 400 lives: nothing of it is in one row or task."""
    hot = spark.range(40_000).select(F.lit("hot").alias("hash"), F.col("id").alias("request_id"), (F.col("id") * 36 + 7).alias("s"))
    rest = spark.range(80_000).select(F.concat(F.lit("k"), F.col("id") % 9000).alias("hash"), (F.col("id") + 10**6).alias("request_id"), F.col("id").alias("s"))
    frame = hot.union(rest).select("hash", "request_id", F.timestamp_seconds(F.col("s") + 1_767_225_600).alias("ts"))
    got = cache.misses(frame, 1)
    life, want, last = 3600, 0, None
    for i in range(40_000):
        if last is None or i * 36 - last > life:
            last, want = i * 36, want + 1
    assert got.filter("hash = 'hot' AND NOT hit").count() == want > 390
    assert got.count() == 120_000


def test_reuse_names_the_result(spark):
    rows = [("a", "k", 0, "s0"), ("b", "k", 3600, "s1"), ("c", "k", 86_401, "s2"), ("d", "k", 86_402, "s3"), ("e", None, 5, "s4"), ("f", "j", 3600, "s5"), ("g", "k", 0, "s6")]
    frame = spark.createDataFrame([(m, h, START + dt.timedelta(seconds=s), i, "x") for m, h, s, i in rows], "msg_id string, hash string, ts timestamp, scan_id string, other string")
    got = {r.msg_id: r.hit_id for r in cache.reuse(frame).collect()}
    assert got == {"a": None, "b": "s0", "c": None, "d": "s2", "e": None, "f": None, "g": "s0"}


def test_lookup_of_a_hot_hour(spark, no_replanning):
    """Most requests ask for one hash within one hour; many at the very same moment."""
    n = 30_000
    asked = spark.range(n).select(F.col("id").alias("msg_id"), F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("hash"), F.timestamp_seconds(1_767_225_600 + F.when(F.col("id") % 2 == 0, 1800).otherwise(F.col("id") % 3600)).alias("ts"))
    known = spark.range(360).select(F.lit("hot").alias("hash"), F.col("id").alias("scan_id"), F.timestamp_seconds(1_767_225_600 + F.col("id") * 10).alias("created_at"))
    got = cache.lookup(asked, known)
    wrong = got.filter(~F.col("hit_id").eqNullSafe(F.when(F.col("hash") == "hot", F.floor((F.unix_timestamp("ts") - 1_767_225_600) / 10))))
    assert got.count() == n and wrong.isEmpty()
