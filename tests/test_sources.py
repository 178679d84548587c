"""Bad lines with their place, one file a split, committed appends, brand tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lurelens import fixed
from lurelens.functions import hosts
from lurelens.operators import intel, scoring
from lurelens.sources import readers, writers


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    rng = random.Random(1)
    lines = {n: [f"{n}-{i}" + "x" * rng.randrange(300) for i in range(4000)] for n in ("a", "b")}
    for n, own in lines.items():
        (tmp_path / f"{n}.txt").write_text("\n".join(own) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        found = readers.numbered_lines(spark, str(tmp_path / "*.txt"))
        assert spark.read.text(str(tmp_path / "*.txt")).rdd.getNumPartitions() > 8
        got = {(r.file[-5:-4], r.line): r.value for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(n, i + 1): v for n, own in lines.items() for i, v in enumerate(own)}


def test_bad_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "अ", "n": 1}\nbad\n\n{"text": "b", "n": "no number"}\n{"text": "c"}\n')
    rows, bad = readers.read_jsonl_apart(spark, str(tmp_path / "a.jsonl"), "text string, n int")
    assert sorted(tuple(r) for r in rows.collect()) == sorted([("अ", 1), ("c", None)], key=str)
    assert sorted((r.line, r.value) for r in bad.collect()) == [(2, "bad"), (4, '{"text": "b", "n": "no number"}')]
    assert all(r.file.endswith("a.jsonl") for r in bad.collect())
    (tmp_path / "a.tsv").write_text("ham\tok then\n\nspam\tWIN\tnow\nbroken\n")
    rows, bad = readers.read_tsv_apart(spark, str(tmp_path / "a.tsv"))
    assert [(r.text, r.is_scam, r.row_ord.line) for r in rows.orderBy("row_ord").collect()] == [("ok then", 0, 1), ("WIN\tnow", 1, 3)]
    assert [(r.line, r.value) for r in bad.collect()] == [(4, "broken")]
    (tmp_path / "csv").mkdir()
    body = ["hello there,spam", '"two\nlines",ham', "too,many,cells"] * 400
    (tmp_path / "csv" / "big.csv").write_text("message,label\n" + "\n".join([*body, "alone"]) + "\n")
    (tmp_path / "csv" / "other.csv").write_text("message,label\n" + "fine,ham\n" * 2000)
    rows, bad = readers.read_csv_dir_apart(spark, str(tmp_path / "csv" / "*.csv"))
    counts = {(r.source_file, r.text): r["count"] for r in rows.groupBy("source_file", "text").count().collect()}
    assert counts == {("big.csv", "hello there"): 400, ("big.csv", "two\nlines"): 400, ("other.csv", "fine"): 2000}
    assert [(r.source_file, r.record, r.value.strip()) for r in bad.orderBy("record").collect()] == [("big.csv", 3 * i + 3, "too,many,cells") for i in range(400)] + [("big.csv", 1201, "alone")]
    assert readers.read_csv_dir_apart(spark, str(tmp_path / "csv" / "*.csv"), 10**9)[1].count() == 0


def test_one_file_a_split(spark, tmp_path):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 < 8, "train").otherwise("test").alias("split"), F.lit("ü").alias("text")).repartition(9)
    writers.write_splits(rows, str(tmp_path / "out"), files=1)
    names = {d.name: [f for f in d.iterdir() if f.suffix == ".json"] for d in (tmp_path / "out").iterdir() if d.is_dir()}
    assert {k: len(v) for k, v in names.items()} == {"split=train": 1, "split=test": 1}
    lines = [json.loads(x) for x in names["split=test"][0].read_text().splitlines()]
    assert len(lines) == 600 and lines[0]["text"] == "ü" and "ü" in names["split=test"][0].read_text()
    writers.write_splits(rows, str(tmp_path / "more"), files=4)
    assert spark.read.json(str(tmp_path / "more")).count() == 3000


def test_a_repeated_append_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "scans")
    rows = lambda a, z: spark.range(a, z).select(F.col("id").cast("string").alias("scan_id"), F.timestamp_seconds(F.col("id") * 40_000).alias("created_at"))
    writers.append_scans(rows(0, 5), path, batch="7")
    writers.append_scans(rows(5, 9), path, batch="8")
    # The same batch again, whatever it holds, adds nothing.
    writers.append_scans(rows(0, 5), path, batch="7")
    writers.append_scans(rows(50, 60), path, batch="8")
    assert sorted(int(r.scan_id) for r in writers.read_scans(spark, path).collect()) == list(range(9))
    # A batch that breaks off leaves nothing that is read, and is written anew.
    broken = rows(20, 30).withColumn("scan_id", F.when(F.col("scan_id") == "29", F.raise_error(F.lit("lost"))).otherwise(F.col("scan_id")))
    assert "lost" in writers.append_scans(broken, path, str(tmp_path / "failures"), batch="9")
    system, mark = writers._place(spark, f"{path}/batches/8")
    system.delete(mark, False)
    assert writers.committed(spark, path) == {"7"} and writers.read_scans(spark, path).count() == 5
    writers.append_scans(rows(5, 9), path, batch="8")
    writers.append_scans(rows(20, 30), path, batch="9")
    assert writers.read_scans(spark, path).groupBy("batch").count().orderBy("batch").collect() == [("7", 5), ("8", 4), ("9", 10)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_brand_table_matches_brute_force(spark):
    rng = random.Random(4)
    brands = [*fixed.BRANDS, "a", "größe", "longbrandname"]
    names = set(brands) | {"", "x", "hdfcc0m"}
    for b in brands * 6:
        x = list(b)
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(len(x) + 1)
            x[k : k + rng.randrange(2)] = [rng.choice("abilo01rnvw-")] * rng.randrange(2)
        names |= {"".join(x), f"my{b}", b.replace("o", "0").replace("l", "1")}
    domains = spark.createDataFrame([(f"{n}.com",) for n in sorted(names)] + [("",), (None,)], "domain string")
    table = spark.createDataFrame([(i, b) for i, b in enumerate(brands)] + [(99, brands[0]), (5, "")], "ord int, brand string")
    got = {r.domain: (r.stage, r.brand, r.distance) for r in intel.brand_matches(domains, table).collect()}
    for n in names:
        inside = next((b for b in brands if b in n and b != n), None)
        near = next((b for b in brands if n and 1 <= distance(n, b) <= 2), None)
        skeleton = n
        for seen, meant in fixed.LOOK_ALIKES:
            skeleton = skeleton.replace(seen, meant)
        like = next((b for b in brands if b == skeleton and b != n), None)
        want = ("inside", inside, None) if inside else ("near", near, distance(n, near)) if near else ("like", like, None) if like else None
        assert got.get(f"{n}.com") == want, n
    # With the fixed brands it says what the expression over them says.
    own = domains.filter("domain <> '' AND domain NOT LIKE '.%'").withColumn("t", hosts.typosquat(F.col("domain")))
    fixed_table = spark.createDataFrame(list(enumerate(fixed.BRANDS)), "ord int, brand string")
    found = own.join(intel.brand_matches(domains, fixed_table), "domain", "left")
    assert found.filter(~F.col("brand").eqNullSafe(F.col("t.target_brand"))).isEmpty()


@pytest.mark.parametrize(("encoded", "kept"), [(None, False), ("", False), ("x" * 149, False), ("x" * 150, True)])
def test_placeholder_screenshots(spark, encoded, kept):
    row = spark.createDataFrame([(encoded,)], "shot string").select(scoring.real_screenshot(F.col("shot")).alias("s")).first()
    assert (row.s is not None) == kept
