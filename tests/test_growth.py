"""Steps whose work must follow the size of their input."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from lurelens import fixed
from lurelens.functions import text
from lurelens.operators import audit, corpus
from lurelens.plans import scan
from lurelens.scratch import Scratch
from lurelens.sources import readers
from test_operators import snapshots


def test_split_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(n):
        seen.add(1)
        return n % 2

    rows = spark.range(200).select(F.col("id"), F.udf(count, "long")("id").alias("c"))
    got = corpus.stratified_split(rows, ["c"]).groupBy("c", "split").count().collect()
    assert {(r["c"], r["split"]): r["count"] for r in got} == {(c, s): n for c in (0, 1) for s, n in (("train", 80), ("val", 10), ("test", 10))}
    assert seen.value == 200


def test_split_sizes_hold_for_equal_ids(spark):
    rows = spark.range(50).select(F.lit(7).alias("id"), F.lit(None).cast("string").alias("c"))
    got = corpus.stratified_split(rows, ["c"]).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 40, "val": 5, "test": 5}


def test_templates_of_long_runs_take_linear_time(spark):
    rows = spark.createDataFrame([("क" * 150_000,), ("ab.comx " + "é" * 150_000 + ".com/x y",), (".com .a.com",), ("(see https://x.y z",)], "t string")
    began = time.time()
    got = [r[0] for r in rows.select(text.template_key(F.col("t"))).collect()]
    assert got == ["क" * 150_000, "URL URL y", "com URL", "see URL z"]
    assert time.time() - began < 20


def test_templates_and_texts_meet_by_their_hashes(spark):
    rows = spark.createDataFrame([("train", "नमस्ते 12"), ("test", "नमस्ते 34"), ("test", " नमस्ते 12 "), ("val", "बिल")], "split string, text string").withColumn("language", F.lit("Hindi"))
    plan = audit.exact_overlaps(rows)._jdf.queryExecution().executedPlan().toString()
    assert "sha2" in plan
    assert {r["pair"]: r["shared"] for r in audit.exact_overlaps(rows).collect()} == {"train_test": 1, "val_test": 0, "train_val": 0}
    assert audit.template_overlap(rows).collect() == [(2, 2, 100.0)]


def test_flags_of_long_runs_take_linear_time(spark):
    run = "a" * 200_000
    rows = spark.createDataFrame([(run,), (run + ".in",), (f"{run}@bank",), ("otp, 98765 43210",)], "t string")
    began = time.time()
    got = [[k for k in fixed.FLAGS if r["f"][k]] for r in rows.select(text.content_flags(F.col("t")).alias("f")).collect()]
    assert got == [[], ["has_url"], ["has_upi"], ["has_phone", "has_otp"]]
    assert time.time() - began < 20


def test_lost_characters_need_no_table(spark):
    whole = "reader 😀 é\n" * 4000
    pairs = [(whole, whole.replace("e", "")), (whole.replace("r", ""), whole), ("", "ab"), ("abc", "acb"), ("kitten", "sitting"), ("😀a", "a"), (None, "a")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    began = time.time()
    got = [r[0] for r in rows.select(text.character_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [8000, 8000, 2, 2, 3, 1, None]
    assert time.time() - began < 20


def _saved(monkeypatch):
    """The columns of each table that is saved from now on, by name."""
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, frame, name: saved.append((name, frame)) or save(self, frame, name))
    return saved


def test_scoring_keeps_no_texts_unless_asked(spark, monkeypatch):
    saved = _saved(monkeypatch)
    rows = spark.createDataFrame([(1, "URGENT kyc http://new.com/a SBI x@okbank"), (2, None)], "msg_id long, text string")
    lean, full = (scan.score_messages(rows, snapshots(spark), F.lit("2026-06-13").cast("timestamp"), texts=t) for t in (False, True))
    assert {"text", "normalized_text", "entities"} == set(full.columns) - set(lean.columns)
    columns = ("msg_id", "urls", "risk_score", "risk_category", "explanations")
    assert sorted(map(str, lean.select(*columns).collect())) == sorted(map(str, full.select(*columns).collect()))
    first, second = (f for n, f in saved if n == "detected")
    # Payment ids and amounts are asked for by nobody, so they are not looked for.
    assert "text" not in first.columns and "INR|" not in first._jdf.queryExecution().optimizedPlan().toString()
    assert "INR|" in second._jdf.queryExecution().optimizedPlan().toString()


def test_healing_skips_texts_it_cannot_change(spark):
    rng = random.Random(19)
    pieces = ["https://", "HTTP://", "httpſ://", "www.", "WWW.", "a", "b-", "in", ".com", ".in", "com", ".", "/", "/p", "-", " ", "\t", "\n", "\n\n", ":", "x1", "\u0915", "\u212a", ", ", "12:30 ", "host:ab.cd", "\u00a0"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(6000)]
    plain = F.col("t")
    for most, pairs in fixed.STITCH_STEPS + fixed.HEAL_STEPS:
        for _ in range(most):
            for pattern, new in pairs:
                plain = F.regexp_replace(plain, text.quick(pattern), new)
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    urls = F.regexp_extract_all("t", F.lit(fixed.URL), F.lit(0))
    clean = F.filter(F.transform(urls, lambda u: F.regexp_replace(text.repair_url(u), fixed.URL_TAIL, "")), lambda u: u != "")
    got = df.select("t", text.heal_urls(F.col("t")).alias("healed"), plain.alias("plain"), text.urls_in(F.col("t")).alias("urls"), clean.alias("all")).collect()
    assert [r for r in got if r.healed != r.plain] == []
    assert any(r.healed != r.t for r in got) and any(r.urls for r in got)
    for r in got:
        best = []
        for u in sorted(r["all"], key=lambda u: -len(u)):
            best += [] if any(u in b for b in best) else [u]
        assert r.urls == best, r.t
    # A URL at the end and lines before it give healing nothing to do.
    assert not spark.createDataFrame([("a line\nand https://x.org/a-b",)], "t string").select(text._hinted(F.col("t"), text._STITCH_HINTS + text._HEAL_HINTS)).first()[0]


def test_routing_saves_each_text_once(spark, monkeypatch):
    saved = _saved(monkeypatch)
    now = dt.datetime(2026, 6, 13)
    rows = [("a", "one", "text", now), ("b", "one", "text", now + dt.timedelta(hours=1)), ("b", "one", "text", now + dt.timedelta(hours=1)), ("c", "two", "text", now), ("d", "\u0906\u0939\u0947", "text", now), ("e", None, "text", now), ("f", "one", "text", None), ("g", None, "text", None)]
    records = spark.createDataFrame([("before", "two", now - dt.timedelta(hours=3))], "scan_id string, t string, created_at timestamp").withColumn("hash", F.sha2("t", 256)).drop("t")
    wanted, reused, rejected = scan.route(spark.createDataFrame(rows, readers.MESSAGES), records)
    assert sorted((r.msg_id, r.text) for r in wanted.collect()) == [("a", "one"), ("e", None), ("f", "one"), ("g", None)]
    named = wanted.filter("msg_id = 'a'").first().scan_id
    assert sorted((r.msg_id, r.text, r.hit_id) for r in reused.collect()) == [("b", "one", named)] * 2 + [("c", "two", "before")]
    assert [(r.msg_id, r.text, r.reason) for r in rejected.collect()] == [("d", "\u0906\u0939\u0947", "excluded_language")]
    assert [n for n, f in saved if "text" in f.columns] == ["keyed"]
