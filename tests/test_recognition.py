"""Exact percentiles by ranges and banded edit distances, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurelens.functions import text
from lurelens.operators import ocr_eval
from lurelens.operators.quantiles import percentiles


def test_percentiles_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.choice([rng.uniform(0, 9), 4.0, float(rng.randrange(5)), None])) for _ in range(900)] + [("one", 7.0), ("none", None)]
    frame = spark.createDataFrame(rows, "folder string, ms double").repartition(5)
    shares = {"low": 0.0, "mid": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.folder: [r[k] for k in shares] for r in percentiles(frame, ["folder"], "ms", shares).collect()}
    for folder in {f for f, _ in rows} - {"none"}:
        own = [v for f, v in rows if f == folder and v is not None]
        assert got.pop(folder) == pytest.approx([float(np.percentile(own, 100 * q)) for q in shares.values()])
    assert got == {}
    assert percentiles(frame.limit(0), ["folder"], "ms", shares).count() == 0


def test_percentiles_share_a_folder_over_tasks(spark):
    """One folder with all times: its distinct values are dealt over ranges."""
    frame = spark.range(40_000).select(F.lit("f").alias("folder"), (F.col("id") * 7919 % 40_000).cast("double").alias("ms"))
    counted = frame.groupBy("folder", "ms").count()
    sizes = [r["count"] for r in counted.repartitionByRange(8, "folder", "ms").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.3 * 40_000
    assert percentiles(frame, ["folder"], "ms", {"p": 0.25}).first().p == pytest.approx(0.25 * 39_999)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distances_match_brute_force(spark):
    rng = random.Random(6)
    pairs = []
    for n in (0, 1, 5, 40, 300, 700):
        for edits in (0, 1, 15, 16, 17, 250, 300):
            a = [rng.choice("abcé ") for _ in range(n)]
            b = list(a)
            for _ in range(min(edits, 2 * n + 3)):
                k = rng.randrange(len(b) + 1)
                b[k : k + rng.randrange(2)] = [rng.choice("abxyz ")] * rng.randrange(2)
            pairs.append(("".join(a), "".join(b)))
    pairs += [("w" * 300, "v" * 300), ("", "x" * 20)]
    frame = spark.createDataFrame(pairs, "a string, b string")
    got = frame.select("a", "b", text.character_distance(F.col("a"), F.col("b")).alias("c"), text.word_distance(F.col("a"), F.col("b")).alias("w")).collect()
    for r in got:
        assert r.c == distance(r.a, r.b)
        assert r.w == distance(r.a.split(), r.b.split())


def test_failures_and_entity_counts(spark):
    """Entities of each kind against sets, over null, failed and unmatched results."""
    truth = [("a", "call 9876543210 or pay x@okbank Rs 50 at http://a.com/x"), ("b", "see http://b.com and http://c.com"), ("d", None)]
    seen = [("a", "f", "call 9876543210 or pay xokbank Rs 50 at http://a.com/x"), ("b", "f", "see http://b.com and c"), ("c", "g", "no truth"), ("d", None, "null truth")]
    frame = spark.createDataFrame([(*r, 10.0 * i, False, None) for i, r in enumerate(seen)], "filename string, folder string, clean_text string, execution_time_ms double, fallback_used boolean, error string")
    out = ocr_eval.evaluate(frame, spark.createDataFrame(truth, "filename string, text string"))
    rows = {r.filename: r for r in out.collect()}
    a = rows["a"]
    assert [(a[f"{k}_expected"], a[f"{k}_matched"]) for k in ocr_eval.KINDS] == [(1, 1), (1, 1), (1, 0), (1, 1)]
    assert (rows["b"].urls_expected, rows["b"].urls_matched) == (2, 1) and rows["c"].wer is None and rows["d"].urls_expected is None
    missing = {(r.filename, r.expected): r.fragment_present for r in ocr_eval.url_failures(out).collect()}
    assert missing == {("b", "http://c.com"): False}
    table = {r.folder: r for r in ocr_eval.metrics(out).collect() if r.folder != "f"}
    assert len(ocr_eval.metrics(out).collect()) == 4 and table["g"].urls_pct == 0.0
