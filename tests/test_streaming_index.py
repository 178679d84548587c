"""The index of earlier results over many batches, and streams that go on."""

import datetime as dt
import json
import time

from pyspark.sql import functions as F

from lurelens.sources import readers
from lurelens.streaming import scans
from lurelens.streaming.index import RecordIndex
from tests.test_operators import snapshots

START = dt.datetime(2026, 6, 13)


def test_fifty_batches_cost_the_same(spark, tmp_path):
    """A batch every two hours: what is read follows the time to live, and what is old is deleted."""
    index = RecordIndex(spark, str(tmp_path / "index"), hours=6, lateness_hours=2, buckets=4)
    folders, rows, kept = [], [], []
    for k in range(50):
        at = START + dt.timedelta(hours=2 * k)
        index.expire(k)
        batch = spark.createDataFrame([(f"h{i}", at + dt.timedelta(minutes=i)) for i in range(8)], "hash string, ts timestamp")
        folders.append(len(index.folders(batch)))
        near = index.near(batch, k)
        rows.append(0 if near is None else near.count())
        index.add(batch.select("hash", F.concat(F.lit(f"{k}-"), "hash").alias("scan_id"), F.col("ts").alias("created_at")), k)
        index.mark(batch, k)
        kept.append(len(list((tmp_path / "index" / "hours").iterdir())))
    assert len({*folders[10:]}) == len({*rows[10:]}) == len({*kept[10:]}) == 1
    assert rows[10] == 3 * 8 and kept[10] <= 6 and folders[10] <= 4 * 8
    # A batch that runs again reads what it read before, and replaces what it stored.
    last = spark.createDataFrame([(f"h{i}", START + dt.timedelta(hours=98, minutes=i)) for i in range(8)], "hash string, ts timestamp")
    assert index.near(last, 49).count() == rows[49]
    index.add(last.select("hash", F.lit("again").alias("scan_id"), F.col("ts").alias("created_at")), 49)
    assert index.near(last, 50).filter("scan_id LIKE '49-%'").isEmpty() and index.near(last, 50).count() == rows[49] + 8
    # One bucket is read for one hash, and nothing for messages without a time or a hash.
    assert len(index.folders(last.limit(1))) < folders[49]
    assert index.near(last.select(F.lit(None).cast("string").alias("hash"), "ts"), 50) is None
    assert index.near(last.select("hash", F.lit(None).cast("timestamp").alias("ts")), 50) is None


def test_stream_goes_on(spark, tmp_path):
    """With a processing-time trigger batches follow each other in one query, and reuse each other's results and their own."""
    (tmp_path / "in").mkdir()

    def arrive(name, rows):
        part = tmp_path / f"{name}.tmp"
        part.write_text("\n".join(json.dumps(dict(zip(("msg_id", "text", "input_type", "ts"), r, strict=True))) for r in rows))
        part.rename(tmp_path / "in" / f"{name}.json")

    def waited(n):
        for _ in range(600):
            if (tmp_path / "out" / "index" / "marks" / f"batch={n}" / "_SUCCESS").exists():
                return
            time.sleep(0.5)
        raise AssertionError(query.exception())

    arrive("a", [("1", "dinner at 8?", "text", "2026-06-13T00:00:00"), ("2", "dinner at 8?", "text", "2026-06-13T01:00:00"), ("3", "हे आहे", "text", "2026-06-13T00:00:00")])
    stream = readers.messages(spark, str(tmp_path / "in"), streaming=True)
    query = scans.scan_stream(stream, snapshots(spark), str(tmp_path / "out"), str(tmp_path / "state"), F.lit("2026-06-13").cast("timestamp"), trigger={"processingTime": "1 second"})
    try:
        waited(0)
        arrive("b", [("4", "dinner at 8?", "text", "2026-06-13T20:00:00"), ("5", "dinner at 8?", "text", "2026-06-14T20:00:00"), ("6", "dinner at 8?", "text", "2026-06-14T21:00:00")])
        waited(1)
    finally:
        query.stop()
    read = lambda table: spark.read.parquet(str(tmp_path / "out" / table))
    records = {(r.batch, r.created_at.isoformat()): r.scan_id for r in read("records").collect()}
    assert set(records) == {(0, "2026-06-13T00:00:00"), (1, "2026-06-14T20:00:00")}
    first, second = records[0, "2026-06-13T00:00:00"], records[1, "2026-06-14T20:00:00"]
    assert {(r.batch, r.msg_id): r.hit_id for r in read("reused").collect()} == {(0, "2"): first, (1, "4"): first, (1, "6"): second}
    assert [(r.batch, r.msg_id) for r in read("rejected").collect()] == [(0, "3")]
