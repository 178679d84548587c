"""An index of earlier results that a batch reads in a bounded part."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "hash string, scan_id string, created_at timestamp, batch long"


class RecordIndex:
    """Hashes of results under ``path``, in folders by hour of creation, hash bucket and batch.

    A batch reads the folders of the hours that can still be reused by its
    messages and of the buckets that its hashes fall into; results of the batch
    itself and of later ones are left out, so a batch that runs again reads
    what it read before.  Hours that no message can reuse are deleted before a
    batch reads, by the times of the batches before it, and ``lateness_hours`` later
    than would do for messages in order.  So the cost of a batch follows the results
    of the last hours, whatever the batches before were.
    """

    def __init__(self, spark: SparkSession, path: str, hours: int = 24, lateness_hours: int = 24, buckets: int = 16):
        self.spark, self.path, self.hours, self.lateness_hours, self.buckets = spark, path.rstrip("/"), hours, lateness_hours, buckets

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, folder: str) -> dict[int, str]:
        """The folders ``name=number`` in a folder, by number: one listing, no deeper."""
        system, path = self._folder(folder)
        names = [x.getPath().getName() for x in system.listStatus(path)] if system.exists(path) else []
        return {int(n.rpartition("=")[2]): f"{folder}/{n}" for n in names if "=" in n}

    def _bucket(self):
        return F.pmod(F.xxhash64("hash"), F.lit(self.buckets)).cast("int")

    @staticmethod
    def _hour(at: dt.datetime | None) -> int | None:
        return None if at is None else int(at.timestamp() // 3600)

    def add(self, records: DataFrame, batch: int) -> None:
        """Stores hash, scan_id and created_at of results; a batch that is stored again replaces what it stored."""
        own = records.filter("hash IS NOT NULL AND created_at IS NOT NULL").select("hash", "scan_id", "created_at")
        own = own.withColumns({"hour": F.floor(F.unix_timestamp("created_at") / 3600), "bucket": self._bucket(), "batch": F.lit(batch).cast("long")})
        own.repartition("hour", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "bucket", "batch").parquet(f"{self.path}/hours")

    def mark(self, messages: DataFrame, batch: int) -> None:
        """Keeps the newest time up to a batch, by which later batches delete."""
        newest = messages.agg(F.max("ts").alias("newest"))
        before = self._marked(batch)
        newest.select(F.greatest("newest", F.lit(before).cast("timestamp")).alias("newest")).coalesce(1).write.mode("overwrite").json(f"{self.path}/marks/batch={batch}")
        for number, folder in self._numbers(f"{self.path}/marks").items():
            if number < batch - 1:
                system, path = self._folder(folder)
                system.delete(path, True)

    def _marked(self, batch: int) -> dt.datetime | None:
        """The newest time of the batches before."""
        system, path = self._folder(f"{self.path}/marks/batch={batch - 1}")
        if not system.exists(path):
            return None
        return self.spark.read.schema("newest timestamp").json(f"{self.path}/marks/batch={batch - 1}").first()["newest"]

    def expire(self, batch: int) -> list[int]:
        """Deletes the hours that no message reuses, and returns them."""
        newest = self._hour(self._marked(batch))
        gone = [] if newest is None else [h for h in self._numbers(f"{self.path}/hours") if h < newest - self.hours - self.lateness_hours]
        for hour in gone:
            system, path = self._folder(f"{self.path}/hours/hour={hour}")
            system.delete(path, True)
        return gone

    def folders(self, messages: DataFrame) -> list[str]:
        """The folders that messages (hash, ts) may find results in."""
        asked = messages.filter("hash IS NOT NULL AND ts IS NOT NULL")
        span = asked.agg(F.min("ts").alias("a"), F.max("ts").alias("z"), F.collect_set(self._bucket()).alias("buckets")).first()
        if span["a"] is None:
            return []
        first, last = self._hour(span["a"]) - self.hours, self._hour(span["z"])
        near = [folder for hour, folder in sorted(self._numbers(f"{self.path}/hours").items()) if first <= hour <= last]
        # A folder for each hour and bucket at most.
        return [inner for folder in near for bucket, inner in sorted(self._numbers(folder).items()) if bucket in span["buckets"]]

    def near(self, messages: DataFrame, batch: int) -> DataFrame | None:
        """Results of earlier batches that messages (hash, ts) may reuse; none if there are no folders to read."""
        folders = self.folders(messages)
        if not folders:
            return None
        return self.spark.read.schema(COLUMNS).option("basePath", f"{self.path}/hours").parquet(*folders).filter(F.col("batch") < batch).select("hash", "scan_id", "created_at")
