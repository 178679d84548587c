"""Operators on small tables: intel, scoring, blocks, corpus, audits, reuse, streams, sources."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lurelens import fixed
from lurelens.functions import labels
from lurelens.operators import audit, blocks, cache, corpus, intel, ocr_eval, scoring
from lurelens.plans import scan, training
from lurelens.sources import readers, writers
from lurelens.streaming import scans


def score(spark, text, url, domain, has_url, sandbox, asks, weight=40):
    s = scoring.weighted_score(*map(F.lit, (text, url, domain, has_url, sandbox, asks, weight)))
    return spark.range(1).select(s.alias("s")).first()["s"]


def test_weighted_score(spark):
    assert score(spark, 100, 100, 100, True, "completed", True).risk_score == 100
    assert score(spark, 9, 60, 0, True, "completed", True).risk_score == 33
    for s in (50, 60, 85, 100):
        assert score(spark, s, s, s, True, "failed", False).risk_score == s
    late = score(spark, 0, 0, 0, True, "hostile_timeout", False)
    assert (late.risk_score, late.timeout_penalty, late.sandbox_score, late.redistributed) == (6, 6, None, True)
    assert score(spark, 45, 99, 99, False, "skipped", False).risk_score == 45
    assert score(spark, 0, 0, 0, True, "initiated", False).sandbox_score == 0


def snapshots(spark):
    whois = spark.createDataFrame([("new.com", 200, "2026-06-01", None, None, None, None, "ok"), ("gone.com", 404, None, None, None, None, None, "ok"), ("late.com", 200, None, None, None, None, None, "timeout")], intel.WHOIS)
    certs = spark.createDataFrame([("new.com", "Let's Encrypt", "R3", "Jan 15 10:00:00 2030 GMT", "ok"), ("gone.com", None, None, None, "self_signed")], "host string, issuer_org string, issuer_cn string, not_after string, outcome string")
    reputation = spark.createDataFrame([], "url_key string, malicious int, suspicious int, harmless int, outcome string")
    signals = "struct<has_auth_inputs boolean, has_payment_forms boolean, input_tags_count int, iframe_count int>".replace(" boolean", ": boolean").replace(" int", ": int")
    pages = spark.createDataFrame([("http://new.com/a", "completed", 0, (True, False, 2, 0), "http://new.com/a")], f"url string, sandbox_status string, risk_weight int, dom_signals {signals}, final_redirect_url string")
    return scan.Snapshots(reputation, whois, certs, pages)


def test_scan(spark):
    now = dt.datetime(2026, 6, 13)
    rows = [("a", "URGENT kyc http://new.com/a", "text", now), ("b", "dinner at 8?", "text", now), ("c", "see gone.com today", "text", now), ("d", "हे आहे", "text", now), ("e", None, "text", now), ("f", "open http://127.0.0.1/x", "text", now)]
    messages = spark.createDataFrame(rows, readers.MESSAGES)
    done, reused, rejected = scan.scan(messages, snapshots(spark), None, F.lit("2026-06-13").cast("timestamp"))
    got = {r.msg_id: r for r in done.collect()}
    assert set(got) == {"a", "b", "c", "e", "f"} and rejected.first().msg_id == "d" and reused.count() == 0
    assert got["b"].risk_score == 9 and got["b"].risk_category == "Safe"
    domain = got["a"].metadata.domains_analyzed[0]
    assert (domain.age_days, domain.risk_score, domain.intelligence_quality) == (12, 60, "high")
    assert "extremely new" in got["a"].explanations["en"] and "free/anonymous" in got["a"].explanations["en"]
    assert got["a"].metadata.sandbox.sandbox_status == "completed"
    assert got["c"].metadata.domains_analyzed[0].risk_score == 20 and got["c"].metadata.sandbox.sandbox_status == "hostile_timeout"
    assert got["f"].metadata.domains_analyzed is None
    records = scan.to_records(done, messages)
    again, hits, _ = scan.scan(messages.withColumn("ts", F.col("ts") + F.expr("interval 2 hours")), snapshots(spark), records, F.lit("2026-06-13").cast("timestamp"))
    assert hits.count() == 4 and {r.msg_id for r in again.collect()} == {"e"}
    details = scan.read_details(records, "applied_weights map<string,double>, redistributed boolean").filter("risk_score = 9").first()
    assert details.metadata.applied_weights["ML"] == 1.0 and not details.metadata.redistributed


def test_preflight_and_egress(spark):
    answers = spark.createDataFrame([("ok.com", 0, "93.184.216.34", "ok"), ("ok.com", 1, "93.184.216.34", "ok"), ("mix.com", 0, "93.184.216.34", "ok"), ("mix.com", 1, "10.0.0.1", "ok"), ("slow.com", 0, None, "timeout"), ("none.com", 0, None, "ok")], "hostname string, ord int, ip string, outcome string")
    urls = spark.createDataFrame([(f"http://{h}/x#f",) for h in ("ok.com", "mix.com", "slow.com", "none.com", "unknown.com")] + [("",)], "url string")
    got = {r.url: r for r in intel.preflight(urls, answers).collect()}
    assert got["http://ok.com/x#f"].allowed and got["http://ok.com/x#f"].resolved_ips == ["93.184.216.34"]
    assert got["http://mix.com/x#f"].reason.endswith("10.0.0.1")
    assert got["http://slow.com/x#f"].reason == "DNS resolution timed out"
    assert got["http://none.com/x#f"].reason == "DNS resolution returned no IP addresses"
    assert not got[""].allowed
    pins = spark.createDataFrame([("h", "93.184.216.34")], "host string, pinned_ip string")
    peers = spark.createDataFrame([(p, "h", p) for p in ("93.184.216.34", "::ffff:93.184.216.34", "93.184.216.35", "", "zz", "10.0.0.1")], "id string, host string, peer_ip string")
    errors = {r.id: r.error for r in intel.egress_audit(peers, pins).collect()}
    assert errors == {"93.184.216.34": None, "::ffff:93.184.216.34": None, "93.184.216.35": "peer_mismatch", "": "missing_peer", "zz": "malformed_peer", "10.0.0.1": "unsafe_peer"}


def box(x, y, w=50, h=10):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]


BLOCK = "image_id string, block_idx int, bbox array<array<int>>, text string, confidence double, script string"


def test_blocks(spark):
    en = spark.createDataFrame([("i", 0, box(10, 200), "world", 0.9, "en"), ("i", 1, box(0, 198), "hello", 0.9, "en"), ("i", 2, box(0, 300), "low", 0.3, "en"), ("i", 3, box(0, 400), "x", 0.9, "en"), ("i", 4, box(0, 5), "9:41", 0.9, "en")], BLOCK)
    hi = spark.createDataFrame([("i", 0, box(1, 401), "सूचना", 0.8, "hi"), ("i", 1, box(10, 201), "w0rld", 0.8, "hi"), ("i", 2, box(0, 600), "latin", 0.8, "hi")], BLOCK)
    merged = sorted((r.script, r.text) for r in blocks.merge_scripts(hi, en).collect())
    assert merged == [("en", "9:41"), ("en", "hello"), ("en", "low"), ("en", "world"), ("hi", "सूचना")]
    images = spark.createDataFrame([("i", 1000)], "image_id string, height int")
    read = blocks.read_images(hi, en, images).first()
    assert read.clean_text == "hello world\nसूचना"
    scored = scan.scan_screenshots(hi, en, images, snapshots(spark), F.lit("2026-06-13").cast("timestamp")).first()
    assert scored.risk_score == 9
    raw = spark.createDataFrame([("i", [box(0, 0), None], ["a", "b"], [0.9])], "image_id string, polys array<array<array<int>>>, texts array<string>, scores array<double>")
    assert [(r.text, r.confidence) for r in blocks.explode_recogniser(raw, "en").collect()] == [("a", 0.9)]
    iou = spark.createDataFrame([(box(0, 0), box(0, 0)), (box(0, 0, 0, 0), box(0, 0, 0, 0))], "a array<array<int>>, b array<array<int>>")
    assert [r[0] for r in iou.select(labels.box_overlap(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]


def labelled(spark, n=400):
    rows = [(f"message number {i % 350} free prize" if i % 3 else f"aapka khata {i}", i % 2, i) for i in range(n)]
    return spark.createDataFrame(rows, "text string, is_scam int, row_ord long")


def test_corpus(spark):
    other = spark.createDataFrame([("Message number 1 FREE prize ", 0, 0), ("abc", 1, 1), (None, 1, 2), ("Aadhaar 1234 5678 9012 ok", 1, 3)], "text string, is_scam int, row_ord long")
    templates = spark.createDataFrame([(0, "Aapka {bank} khata {digits:4} block", "Hinglish", "Fake KYC")], "template_id int, template string, language string, category string")
    made = corpus.generate(spark, templates, {"bank": ["SBI", "PNB"]}, 20)
    assert 2 < made.count() <= 20 and made.filter("text like '%{%'").count() == 0
    built = training.build_corpus([("A/b", labelled(spark)), ("C", other)]).cache()
    assert built.count() == built.select("text").distinct().count()
    assert built.filter("text like '%Aadhaar Redacted%'").first().split_group == "real_c"
    assert sorted(r.id for r in built.collect())[0] == "real_000001"
    sizes = {}
    for r in built.groupBy("language", "is_scam", "split").count().collect():
        sizes.setdefault((r.language, r.is_scam), {})[r.split] = r["count"]
    for own in sizes.values():
        n = sum(own.values())
        assert own.get("train", 0) == int(n * 0.8) and own.get("val", 0) == int(n * 0.1)
    synthetic = corpus.build_records(made.withColumn("id", F.monotonically_increasing_id().cast("string")), fixed.SYNTHETIC_FLAGS)
    full = corpus.with_synthetic(built, synthetic)
    assert audit.synthetic_leaks(full).filter("synthetic > 0").isEmpty()
    audit.gate(full)
    checks = {r.check: r.passed for r in audit.integrity(full).collect()}
    assert len(checks) == 6 and all(checks.values())
    failed = audit.integrity(full.withColumn("split", F.explode(F.array(F.lit("val"), F.lit("test"))))).filter("not passed")
    assert {r.check for r in failed.collect()} == {"synthetic_outside_train", "shared_texts_val_test"}
    with pytest.raises(ValueError, match="synthetic"):
        audit.gate(full.withColumn("split", F.lit("val")))
    assert {r.pair: r.shared for r in audit.exact_overlaps(built).collect()} == {"train_test": 0, "val_test": 0, "train_val": 0}
    assert set(audit.report(full)) >= {"privacy", "template_overlap"}
    assert corpus.language_slices(built)["Hindi"].count() == 0
    assert corpus.seeded_sample(built, "is_scam", 3).count() == 6
    groups = corpus.group_label(labelled(spark, 120), "is_scam", ["row_ord"], "g_").select("split_group").distinct().count()
    assert groups == 4
    assert corpus.drop_null_like(spark.createDataFrame([("NaN ",), ("good text",)], "text string")).count() == 1


def test_scan_reuses_within_a_batch(spark):
    now = dt.datetime(2026, 6, 13)
    hour = lambda h: now + dt.timedelta(hours=h)
    rows = [("a", "dinner at 8?", "text", hour(0)), ("b", "dinner at 8?", "text", hour(5)), ("c", "dinner at 8?", "text", hour(30)), ("d", "हे आहे", "text", hour(1)), ("e", "हे आहे", "text", hour(2)), ("f", "dinner at 8?", "text", hour(31)), ("g", None, "text", hour(1)), ("h", None, "text", hour(2))]
    done, reused, rejected = scan.scan(spark.createDataFrame(rows, readers.MESSAGES), snapshots(spark), None, F.lit("2026-06-13").cast("timestamp"))
    named = {r.msg_id: r.scan_id for r in done.collect()}
    assert set(named) == {"a", "c", "g", "h"} and {r.msg_id for r in rejected.collect()} == {"d", "e"}
    assert {r.msg_id: r.hit_id for r in reused.collect()} == {"b": named["a"], "f": named["c"]}


def test_reuse(spark):
    at = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    rows = [("k", 1, at(0)), ("k", 2, at(20)), ("k", 3, at(30)), ("k", 4, at(50)), ("k", 5, at(54.5)), ("j", 6, at(1))]
    requests = spark.createDataFrame(rows, "hash string, request_id long, ts timestamp")
    assert {r.request_id: r.hit for r in cache.misses(requests).collect()} == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False}


def test_lookup_carries_the_last_record_over_parts(spark):
    import random

    rng = random.Random(5)
    at = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    asked = [(i, rng.choice(["a", "b", None]), at(rng.randrange(0, 6000))) for i in range(120)] + [(900, "a", None)]
    known = [(rng.choice(["a", "b", "c", None]), i, at(rng.choice([rng.randrange(0, 6000), 60 * rng.randrange(0, 100)]))) for i in range(60)] + [("a", 901, None)]
    got = cache.lookup(spark.createDataFrame(asked, "msg_id long, hash string, ts timestamp"), spark.createDataFrame(known, "hash string, scan_id long, created_at timestamp"), 5).collect()
    assert len(got) == len(asked)
    for r in got:
        near = [(t, i) for h, i, t in known if h is not None and h == r.hash and t is not None and r.ts is not None and r.ts - dt.timedelta(hours=5) <= t <= r.ts]
        assert r.hit_id == (max(near)[1] if near else None)


def test_numbers_of_many_wide_rows(spark):
    n = 250_000
    wide = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("ord"), F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("class"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 6).alias("text")).repartition(7)
    got = corpus.sequential_ids(wide, ["ord"], "real_").select("ord", F.substring("id", 6, 9).cast("long").alias("n"))
    assert got.agg(F.count(F.lit(1)), F.countDistinct("n"), F.sum((F.col("n") == F.col("ord") + 1).cast("int"))).first()[:] == (n, n, n)
    groups = corpus.group_label(wide, "class", ["ord"], "g_", 1000).groupBy("class", "split_group").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("a"), F.max("ord").alias("z")).collect()
    assert sum(r.n for r in groups) == n and all(r.n <= 1000 for r in groups)
    for name in ("hot", None):
        own = sorted((r.a, r.z) for r in groups if r["class"] == name)
        assert len(own) == -(-(n * 2 // 3 if name else n - n * 2 // 3) // 1000) and all(a[1] < b[0] for a, b in zip(own, own[1:], strict=False))


def test_recognition(spark):
    truth = spark.createDataFrame([("a", "pay Rs 50 at x.com now"), ("b", "hello")], "filename string, text string")
    seen = spark.createDataFrame([("a", "f", "pay Rs 50 at x.co", 10.0, False, None), ("b", "f", "", 20.0, True, None), ("c", "g", None, None, None, "bad"), ("d", "g", "no truth", 30.0, False, None)], "filename string, folder string, clean_text string, execution_time_ms double, fallback_used boolean, error string")
    out = ocr_eval.evaluate(seen, truth)
    rows = {r.filename: r for r in out.collect()}
    assert (rows["a"].amounts_matched, rows["a"].urls_expected, rows["a"].urls_matched) == (1, 1, 0)
    assert rows["b"].wer == 1.0 and rows["d"].cer is None and rows["c"].cer is None
    fail = ocr_eval.url_failures(out).first()
    assert fail.expected == "x.com" and not fail.fragment_present
    all_ = {r.folder: r for r in ocr_eval.metrics(out).collect()}[None]
    assert (all_.total, all_.failed, all_.median_latency_ms, all_.p95_latency_ms, all_.amounts_pct) == (4, 1, 20.0, 29.0, 100.0)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("ham\tok then\nspam\tWIN\tnow\nbroken\n")
    assert [(r.text, r.is_scam) for r in readers.read_tsv(spark, str(tmp_path / "a.tsv")).collect()] == [("ok then", 0), ("WIN\tnow", 1)]
    (tmp_path / "a.csv").write_text('text,label\n"a, ""b""",Spam\nx,ham\n')
    assert [(r.text, r.is_scam) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [('a, "b"', 1), ("x", 0)]
    (tmp_path / "a.jsonl").write_text('{"text": "अ", "n": 1}\nbad\n')
    loose = readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "text string, n int", strict=False).collect()
    assert [(r.text, r._bad) for r in loose] == [("अ", None), (None, "bad")]
    with pytest.raises(Exception, match="."):
        readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "text string, n int").collect()
    (tmp_path / "m.json").write_text(json.dumps({"x.png": "one", "y.png": "two"}, indent=1))
    assert {tuple(r) for r in readers.read_text_map(spark, str(tmp_path / "m.json")).collect()} == {("x.png", "one"), ("y.png", "two")}
    assert readers.resolve_column(["Id", "SMS_text", "Target"], ["message"], ["text"], 0) == "SMS_text"
    (tmp_path / "dir").mkdir()
    (tmp_path / "dir" / "big.csv").write_text("message,label\n" + "hello there,spam\n" * 900)
    (tmp_path / "dir" / "small.csv").write_text("message,label\nx,ham\n")
    rows = readers.read_csv_dir(spark, str(tmp_path / "dir" / "*.csv"))
    assert rows.count() == 900 and rows.first().source_file == "big.csv"
    (tmp_path / "dir" / "other.csv").write_text("id,is_scam,sms\n" + "1,ham,see you\n" * 1200)
    by = {r.source_file: r for r in readers.read_csv_dir(spark, str(tmp_path / "dir" / "*.csv")).distinct().collect()}
    assert {k: (r.text, r.raw_label) for k, r in by.items()} == {"big.csv": ("hello there", "spam"), "other.csv": ("see you", "ham")}
    spark.createDataFrame([("hi", 1)], "Message string, Category int").write.parquet(str(tmp_path / "named"))
    assert readers.read_parquet_labelled(spark, str(tmp_path / "named")).first()[:] == ("hi", "1")
    assert readers.spread(spark.range(5).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert [r.id for r in corpus.preview(spark.range(30), 3, ["id"]).collect()] == [0, 1, 2]
    split = spark.createDataFrame([("a", "train", "Hindi"), ("b", "test", "English")], "text string, split string, language string")
    writers.write_splits(split, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    writers.write_language_slices(split, str(tmp_path / "slices"))
    assert spark.read.json(str(tmp_path / "slices")).first().language == "English"
    writers.write_report({"m": split}, str(tmp_path / "report"))
    writers.append_scans(split.withColumn("created_at", F.lit("2026-01-01").cast("timestamp")), str(tmp_path / "scans"))
    assert spark.read.parquet(str(tmp_path / "scans")).count() == 2
    bad = split.withColumn("created_at", F.lit("2026-01-01").cast("timestamp")).withColumn("text", F.raise_error(F.lit("no text")))
    assert "no text" in writers.append_scans(bad, str(tmp_path / "scans"), str(tmp_path / "failures"))
    assert list(writers.write_report({"m": split, "bad": bad}, str(tmp_path / "report"), str(tmp_path / "failures"))) == ["bad"]
    assert spark.read.json(str(tmp_path / "failures")).count() == 2 and spark.read.parquet(str(tmp_path / "scans")).count() == 2


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"msg_id": str(i), "text": t, "input_type": "text", "ts": "2026-01-01T00:00:00"} for i, t in enumerate(["urgent", "hello"])]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = scans.score_stream(readers.messages(spark, str(tmp_path / "in"), streaming=True))
    query = scans.append_stream(stream.select("msg_id", "risk_score"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert {(r.msg_id, r.risk_score) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("0", 45), ("1", 9)}


def test_reuse_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    day = lambda h: f"2026-01-0{1 + h // 24}T{h % 24:02d}:00:00"
    rows = [{"hash": "k", "request_id": i, "ts": day(h)} for i, h in enumerate([0, 20, 30, 50])]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("hash string, request_id long, ts timestamp").json(str(tmp_path / "in"))
    query = scans.append_stream(scans.reuse_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = {r.request_id: r.hit for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True}


def test_scan_stream_and_its_replay(spark, tmp_path):
    (tmp_path / "in").mkdir()
    at = F.lit("2026-06-13").cast("timestamp")

    def arrive(name, rows):
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("msg_id", "text", "input_type", "ts"), r, strict=True))) for r in rows))

    def run(out):
        stream = readers.messages(spark, str(tmp_path / "in"), streaming=True)
        query = scans.scan_stream(stream, snapshots(spark), str(tmp_path / out), str(tmp_path / f"{out}-state"), at)
        query.awaitTermination(300)
        return lambda table: spark.read.parquet(str(tmp_path / out / table))

    arrive("a", [("1", "URGENT kyc http://new.com/a", "text", "2026-06-13T00:00:00"), ("2", "हे आहे", "text", "2026-06-13T00:00:00"), ("3", "dinner at 8?", "text", "2026-06-13T00:00:00")])
    run("out")
    arrive("b", [("4", "dinner at 8?", "text", "2026-06-13T05:00:00"), ("5", "see gone.com today", "text", "2026-06-13T05:00:00"), ("6", "dinner at 8?", "text", "2026-06-15T05:00:00")])
    read = run("out")
    scores = {r.scan_id: r.risk_score for r in read("records").collect()}
    assert len(scores) == 4 and sorted(scores.values())[0] == 9
    assert [(r.msg_id, r.batch) for r in read("rejected").collect()] == [("2", 0)] and [r.msg_id for r in read("reused").collect()] == ["4"]
    # The same input once more, both files in one batch: results do not depend on when it runs.
    again = run("again")
    assert {r.scan_id: r.risk_score for r in again("records").collect()}.items() >= scores.items()
    broken = readers.messages(spark, str(tmp_path / "in"), streaming=True).withColumn("text", F.raise_error(F.lit("cannot read")))
    query = scans.append_stream(broken.select("text"), str(tmp_path / "bad"), str(tmp_path / "bad-state"))
    with pytest.raises(Exception, match="cannot read"):
        query.awaitTermination(300)
    assert "cannot read" in spark.read.json(str(tmp_path / "bad-log" / "failures")).first().error
