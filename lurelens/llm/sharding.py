"""Size-tiered compaction of immutable shards under a versioned manifest, with DataFrame functions only.

A shard is one file.  Arrivals are appended as small shards, more of them as
the input grows.  Compaction groups the live shards into tiers whose sizes
differ by less than ``fanout`` times; a tier with at least ``fanout`` shards is
merged into files of about ``target_bytes`` and its shards retire.  Shards of
half the target and more are done; fewer than ``fanout`` of a tier stay small.
Every change is a new manifest, written under a name of its own.  What commits
it is one small file per version, which names the manifest: it is written
elsewhere first and put in place by a single step that fails if the version is
there already (a hard link in a local or mounted folder, else a rename).  So of
two writers one wins, and readers see all of a change or none of it.  Stores
whose rename can replace a file need one writer at a time.  A shard is never
rewritten in place, and a failed or repeated write leaves at most an unnamed
folder.

The manifest is a table, a row per shard, that is planned with, filtered and
extended by Spark.  A tier with more than ``run_files`` shards is cut by a hash of
their paths into runs of about so many, and only the paths of one run at a time
pass through the driver, whatever the number of shards; one commit ends the round.
A reader names the files of its version to Spark, whose scans list their
files in the driver, so a store is read best after compaction.

Nulls and edge cases: nulls in any column are stored as they are; repeated rows
stay repeated; a file without rows makes no shard; an empty table makes an
empty store; rows are dealt to arrivals by input partition and a hash of
``key_cols``, nulls included; extra columns are stored too, whatever their
names: ``shard_id`` and ``version``, which the reader adds, get underscores in
front where the names are taken.
"""

from __future__ import annotations

import math
import os
import uuid
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "path string, rows long, bytes long"
#: The column by which arrivals are told apart while they are written; it is not stored.
ARRIVAL = "__arrival__"


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int


class ShardStore:
    """Shards and manifests under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fanout: int = 4, run_files: int = 4096):
        self.spark, self.path, self.target_bytes, self.fanout, self.run_files = spark, path.rstrip("/"), target_bytes, fanout, run_files

    def _files(self, pattern: str) -> list:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        return list(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or [])

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return max((int(f.getPath().getName()[1:]) for f in self._files("versions/v*")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version as a table (path, rows, bytes)."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        name = self.spark.read.text(f"{self.path}/versions/v{version:08d}").first()[0]
        return self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifests/{name}")

    def shards(self, version: int | None = None) -> list[Shard]:
        """The shards of a version, gathered for a look at a small store."""
        return sorted((Shard(*r) for r in self.manifest(version).collect()), key=lambda s: s.path)

    def _table(self, shards: list[Shard] | DataFrame) -> DataFrame:
        return shards if isinstance(shards, DataFrame) else self.spark.createDataFrame([(s.path, s.rows, s.bytes) for s in shards], _MANIFEST)

    def commit(self, shards: list[Shard] | DataFrame, base: int, written: tuple[str, ...] = ()) -> int:
        """Makes these shards, and the files of folders just written, version base + 1; raises FileExistsError if another writer has made it."""
        name = uuid.uuid4().hex
        self._table(shards).write.json(f"{self.path}/manifests/{name}")
        for folder in written:
            self._stored(folder).write.mode("append").json(f"{self.path}/manifests/{name}")
        jvm, final = self.spark._jvm, f"{self.path}/versions/v{base + 1:08d}"
        made, wanted = (jvm.org.apache.hadoop.fs.Path(x) for x in (f"{self.path}/claims/{name}", final))
        store = made.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = store.create(made, False)
        out.write(bytearray(name.encode()))
        out.close()
        store.mkdirs(wanted.getParent())
        if store.getScheme() == "file":
            os.link(*(urlparse(str(x.toUri().toString())).path for x in (made, wanted)))
        elif not store.rename(made, wanted):
            raise FileExistsError(f"version {base + 1} exists: {final}")
        return base + 1

    def _stored(self, folder: str) -> DataFrame:
        """The files with rows under a folder that has just been written; only their ends are read."""
        files = self.spark.read.parquet(f"{self.path}/{folder}").groupBy("_metadata.file_path", "_metadata.file_size").agg(F.count(F.lit(1)).alias("rows"))
        place = F.url_decode(F.regexp_replace("file_path", r"\+", "%2B"))
        return files.select(F.concat(F.lit(folder), F.substring_index(place, folder, -1)).alias("path"), "rows", F.col("file_size").alias("bytes"))

    def append(self, arrivals: DataFrame, batch_col: str = ARRIVAL) -> int:
        """Stores the files of each value of ``batch_col`` as shards and commits them together."""
        base, folder = self.version(), f"arrivals/{uuid.uuid4().hex[:12]}"
        arrivals.write.partitionBy(batch_col).parquet(f"{self.path}/{folder}")
        return self.commit(self.manifest(base), base, (folder,))

    def tier(self) -> Column:
        """Shards of one tier differ in size by less than ``fanout`` times; those of half the target and more are done."""
        return F.when(2 * F.col("bytes") >= self.target_bytes, -1).otherwise(F.floor(F.log(float(self.fanout), F.greatest("bytes", F.lit(1)))).cast("int"))

    def plan(self, shards: list[Shard] | DataFrame) -> list[tuple[int, int]]:
        """The tiers to merge now with their number of shards, smallest first; there are few tiers."""
        tiers = self._table(shards).groupBy(self.tier().alias("tier")).agg(F.count(F.lit(1)).alias("n")).collect()
        return sorted((r["tier"], r["n"]) for r in tiers if r["tier"] >= 0 and r["n"] >= self.fanout)

    def compact(self) -> int:
        """One round: merges every tier that is full, run by run, and commits; returns the number of merges."""
        base = self.version()
        live = self.manifest(base)
        retired, written = F.lit(False), []
        for tier, n in self.plan(live):
            runs = max(1, n // self.run_files)
            of = F.pmod(F.xxhash64("path"), F.lit(runs))
            done = []
            for k in range(runs):
                run = live.filter((self.tier() == tier) & (of == k)).orderBy("bytes", "path").collect()
                if len(run) < 2:
                    continue
                written.append(f"merged/{uuid.uuid4().hex}")
                self._packed([r["path"] for r in run]).write.parquet(f"{self.path}/{written[-1]}")
                done.append(k)
            retired |= (self.tier() == tier) & of.isin(done)
        if written:
            self.commit(live.filter(~retired), base, tuple(written))
        return len(written)

    def compact_fully(self) -> int:
        """Rounds until no tier is full; returns the version."""
        while self.compact():
            pass
        return self.version()

    def _packed(self, paths: list[str]) -> DataFrame:
        """The rows of a run, in partitions of whole files of ``target_bytes`` together, so that no row is shuffled.

        Two shards of a run fit a partition.  At most half as many partitions are left in any case, so merging comes to an end.
        """
        own = SparkSession(self.spark.sparkContext, self.spark._jsparkSession.cloneSession())
        for key, value in (("maxPartitionBytes", self.target_bytes), ("openCostInBytes", 0), ("minPartitionNum", 1)):
            own.conf.set(f"spark.sql.files.{key}", str(value))
        return own.read.parquet(*(f"{self.path}/{p}" for p in paths)).coalesce(max(1, len(paths) // 2))

    def read(self, schema, version: int | None = None) -> DataFrame:
        """All rows of a version with the columns of ``schema``, ``shard_id`` and ``version``."""
        version = self.version() if version is None else version
        shards, names = self.shards(version), []
        for name in ("shard_id", "version"):
            while name.lower() in (n.lower() for n in schema.names):
                name = f"_{name}"
            names.append(name)
        if not shards:
            return self.spark.createDataFrame([], schema).withColumns(dict(zip(names, (F.lit(""), F.lit(version)), strict=True)))
        frame = self.spark.read.schema(schema).parquet(*(f"{self.path}/{s.path}" for s in shards))
        # A shard is named by its file, so no list of shards has to be joined.
        shard = F.regexp_extract(F.regexp_replace(F.col("_metadata.file_path"), "%3D", "="), r"((?:arrivals/[^/]+|merged)/[^/]+/[^/]+)$", 1)
        return frame.withColumns(dict(zip(names, (shard, F.lit(version)), strict=True)))


def arrivals(docs: DataFrame, key_cols: tuple[str, ...], batches: int, most_bytes: int = 8 << 20) -> DataFrame:
    """Deals the rows of each input partition to arrivals of their own, by a hash; each is about half as large as the one before, down to a sixteenth, and over again.

    There are about ``batches`` at least, and as many more as it takes for the largest to have about ``most_bytes`` of values.
    """
    width = sum((F.coalesce(F.octet_length(docs[f"`{c}`"].cast("string")), F.lit(0)) for c in docs.columns), F.lit(0).cast("long"))
    sizes = docs.select(F.spark_partition_id().alias("part"), width.alias("width")).groupBy("part").agg(F.sum("width").alias("bytes"))
    parts, largest = sizes.agg(F.count(F.lit(1)), F.max("bytes")).first()
    groups = max(1, math.ceil(batches // 5 / max(1, parts)), math.ceil((largest or 0) * 16 / 31 / most_bytes))
    turn = F.pmod(F.xxhash64(*key_cols), F.lit(31))
    size = F.when(turn < 16, 0).when(turn < 24, 1).when(turn < 28, 2).when(turn < 30, 3).otherwise(4)
    group = F.spark_partition_id() * groups + F.pmod(F.xxhash64(F.lit(7), *key_cols), F.lit(groups))
    return docs.withColumn(ARRIVAL, (group * 5 + size).cast("int"))
