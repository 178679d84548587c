"""Structured Streaming: continuous scans, reuse of results within a time to live, durable appends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import labels, text
from ..operators import cache
from ..operators.scoring import weighted_score
from ..plans import scan
from .index import RecordIndex


def score_stream(messages: DataFrame) -> DataFrame:
    """Stateless scoring of a stream of messages by text alone: what needs no snapshot is computed as rows arrive."""
    result = labels.with_text_result(messages, text.collapsed(text.heal_urls(F.col("text"))))
    s = weighted_score(F.col("text_track.risk_score"), F.lit(0), F.lit(0), F.lit(False), F.lit("skipped"), F.lit(False), F.lit(0))
    return result.withColumn("_s", s).withColumns({"risk_score": F.col("_s.risk_score"), "risk_category": F.col("_s.risk_category")}).drop("_s")


def scan_stream(messages: DataFrame, tables: scan.Snapshots, path: str, checkpoint: str, as_of: Column | None = None, hours: int = 24, lateness_hours: int = 24, trigger: dict | None = None) -> StreamingQuery:
    """The whole scan over a stream of messages (msg_id, text, input_type, ts).

    Each micro-batch looks up the results of earlier ones and of its own earlier
    messages, leaves excluded languages out, joins the snapshots and is scored
    and explained.  Under ``path`` it writes ``records`` (new results),
    ``reused`` and ``rejected``, a folder for each batch that a repeated run
    writes anew, and ``index``, of which a batch reads only hours and buckets that it
    can reuse, whatever its number.  One that fails is recorded in ``failures`` and
    ends the query.  ``trigger`` is that of the writer: ``{"processingTime": "10
    seconds"}`` goes on, and without one what is there is read and the query ends.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        index = RecordIndex(spark, f"{path}/index", hours, lateness_hours)
        index.expire(batch_id)
        batch = batch.persist()
        try:
            keyed = batch.select(cache.cache_key(F.col("text")).alias("hash"), "ts")
            responses, reused, rejected = scan.scan(batch, tables, index.near(keyed, batch_id), F.current_timestamp() if as_of is None else as_of, hours)
            scan.to_records(responses, batch).write.mode("overwrite").parquet(f"{path}/records/batch={batch_id}")
            reused.select("msg_id", "hash", "ts", "hit_id").write.mode("overwrite").parquet(f"{path}/reused/batch={batch_id}")
            rejected.select("msg_id", "reason").write.mode("overwrite").parquet(f"{path}/rejected/batch={batch_id}")
            index.add(spark.read.parquet(f"{path}/records/batch={batch_id}"), batch_id)
            index.mark(batch, batch_id)
        finally:
            batch.unpersist()

    writer = messages.writeStream.foreachBatch(_guarded(write, path)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _guarded(write: Callable[[DataFrame, int], None], path: str) -> Callable[[DataFrame, int], None]:
    """The same work for each batch; a failure is recorded under ``path`` before it goes on and ends the query."""

    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            write(batch, batch_id)
        except Exception as error:
            row = batch.sparkSession.range(1).select(F.lit(batch_id).alias("batch_id"), F.lit(f"{type(error).__name__}: {error}"[:2000]).alias("error"), F.current_timestamp().alias("failed_at"))
            row.coalesce(1).write.mode("append").json(f"{path}/failures")
            raise

    return run


class _LastMiss(StatefulProcessor):
    """Keeps the time of the last miss of a hash; a hit leaves it as it is. Event time alone decides when it goes."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last_miss", "at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # Two columns of the key's rows in one micro-batch, which its trigger bounds.
        requests = pd.concat(x[["request_id", "ts"]] for x in rows).sort_values(["ts", "request_id"], kind="stable")
        last = pd.Timestamp(self.state.get()[0]) if self.state.exists() else None
        hits = []
        for at in requests["ts"]:
            hit = last is not None and (at - last).total_seconds() <= self.seconds
            hits.append(hit)
            if not hit:
                last = at
        self.state.update((last.to_pydatetime(),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(last.timestamp() * 1000) + self.seconds * 1000 + 1)
        yield pd.DataFrame({"hash": key[0], "request_id": requests["request_id"].to_numpy(), "ts": requests["ts"].to_numpy(), "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def reuse_stream(requests: DataFrame, hours: int = 24, lateness: str = "1 hour") -> DataFrame:
    """A stream of requests (hash, request_id, ts) with hit: whether the last miss of the hash is at most ``hours`` old.

    Needs the RocksDB state store.  A hash's state ends when the watermark has
    passed its life, so a replay of old requests has the same results; requests
    that come more than ``lateness`` behind the newest are dropped.
    """
    grouped = requests.select("hash", "request_id", "ts").withWatermark("ts", lateness).groupBy("hash")
    return grouped.transformWithStateInPandas(_LastMiss(hours * 3600), "hash string, request_id long, ts timestamp, hit boolean", "Append", "EventTime")


def reuse_approximately(requests: DataFrame, hours: int = 24) -> DataFrame:
    """The first request of each hash within a watermark: cheaper, and exact while no hash comes again near the limit."""
    return requests.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark(["hash"])


def append_stream(scans: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch once: a batch that runs again writes to the same folder anew; one that fails is recorded under ``path`` with ``-log`` behind it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return scans.writeStream.foreachBatch(_guarded(write, f"{path}-log")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
