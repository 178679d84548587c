"""Writers of splits, scan records and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_splits(split: DataFrame, path: str, files: int | None = None) -> None:
    """JSON lines, a folder for each split.

    ``files`` is the number of files of each split, as far as it has rows: 1 gives
    the one file that a reader of a small corpus expects.  Without it each task
    writes its own, as a large corpus needs.
    """
    if files:
        # Rows of a split are dealt over so many parts, whatever the split's size.
        split = split.withColumn("__part", F.pmod(F.xxhash64(*(F.col(f"`{f.name}`") for f in split.schema.fields if f.dataType.typeName() not in ("map", "variant"))), F.lit(files)))
        split = split.repartition("split", "__part").sortWithinPartitions("split").drop("__part")
    split.write.mode("overwrite").partitionBy("split").json(path)


def write_language_slices(split: DataFrame, path: str) -> None:
    """The test split as JSON lines, a folder for each language."""
    split.filter("split = 'test'").drop("split").write.mode("overwrite").partitionBy("language").json(path)


def _recorded(spark: SparkSession, failures: str, what: str, error: Exception) -> str:
    """Keeps a row about a write that failed, and returns its message."""
    message = f"{type(error).__name__}: {error}"
    row = spark.range(1).select(F.lit(what).alias("what"), F.lit(message[:2000]).alias("error"), F.current_timestamp().alias("failed_at"))
    row.coalesce(1).write.mode("append").json(failures)
    return message


def append_scans(scans: DataFrame, path: str, failures: str | None = None, batch: str | None = None) -> str | None:
    """Appends scan records, partitioned by day.

    With the name of a ``batch`` the append is committed: its rows are written into
    folders of that name, then a mark of that name is made, which fails if it is
    there.  A batch with a mark is not written again, one that was
    broken off is written anew, and ``read_scans`` sees rows with a mark only.
    With a ``failures`` folder, an append that fails is recorded there and its
    message returned, so that the results that were to be stored are not lost
    with it; without one the error goes on.
    """
    dated = scans.withColumn("day", F.to_date("created_at"))
    try:
        if batch is None:
            dated.write.mode("append").partitionBy("day").parquet(path)
        elif batch not in committed(scans.sparkSession, path):
            dated = dated.withColumn("batch", F.lit(f"named-{batch}"))
            dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{path}/rows")
            system, mark = _place(scans.sparkSession, f"{path}/batches/{batch}")
            # Of two writers of one batch, both with the same rows, one makes the mark.
            system.createNewFile(mark)
    except Exception as error:
        if failures is None:
            raise
        return _recorded(scans.sparkSession, failures, path, error)
    return None


def _place(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def committed(spark: SparkSession, path: str) -> set[str]:
    """The names of the batches that have a mark."""
    system, folder = _place(spark, f"{path}/batches")
    return {x.getPath().getName() for x in system.listStatus(folder)} if system.exists(folder) else set()


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """The rows of committed batches, with ``day`` and ``batch``."""
    marks = spark.createDataFrame([(f"named-{x}",) for x in sorted(committed(spark, path))], "batch string")
    # The batch is a folder: rows without a mark are not read.
    rows = spark.read.parquet(f"{path}/rows").join(F.broadcast(marks), "batch", "left_semi")
    return rows.withColumn("batch", F.substring("batch", 7, 1 << 20))


def write_report(modules: dict[str, DataFrame], path: str, failures: str | None = None) -> dict[str, str]:
    """Each module of a report, a few rows, as one JSON file; with a ``failures`` folder one that fails is recorded and the others are written."""
    failed = {}
    for name, rows in modules.items():
        try:
            rows.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")
        except Exception as error:
            if failures is None:
                raise
            failed[name] = _recorded(rows.sparkSession, failures, name, error)
    return failed
