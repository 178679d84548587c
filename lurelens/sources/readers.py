"""Readers of labelled messages, recogniser output and message tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..scratch import Scratch

MESSAGES = T.StructType([T.StructField("msg_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("input_type", T.StringType()), T.StructField("ts", T.TimestampType())])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a position that follows the order within a file."""
    return spark.read.text(path).withColumns({"row_ord": F.monotonically_increasing_id(), "file": F.col("_metadata.file_name")})


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``label<TAB>text`` lines, split at the first tab; lines without one are dropped; spam is 1, all else 0."""
    parts = F.split(F.trim("value"), "\t", 2)
    rows = _lines(spark, path).withColumn("p", parts).filter(F.size("p") == 2)
    return rows.select(F.col("p")[1].alias("text"), (F.lower(F.trim(F.col("p")[0])) == "spam").cast("int").alias("is_scam"), "row_ord")


def label_contains_spam(label: Column) -> Column:
    return F.lower(F.trim(label)).contains("spam").cast("int")


def label_is_smishing(label: Column) -> Column:
    clean = F.trim(label)
    return ((clean == "1") | F.lower(clean).contains("smish")).cast("int")


def read_csv(spark: SparkSession, path: str, label_rule=label_contains_spam) -> DataFrame:
    """The first two columns of a CSV with a header, text and label; rows with fewer are dropped."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    text, label = rows.columns[:2]
    out = rows.select(F.trim(F.col(f"`{text}`")).alias("text"), label_rule(F.col(f"`{label}`")).alias("is_scam")).filter("text IS NOT NULL AND is_scam IS NOT NULL")
    return out.withColumn("row_ord", F.monotonically_increasing_id())


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines; strict reading fails on a bad line, the other keeps it in ``_bad`` with null fields."""
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    return spark.read.schema(schema.add("_bad", "string")).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as value, with file and line, counted from 1 within the file.

    A large file is read by many tasks; each block of it counts its own lines and
    is shifted by the blocks before it, a row for each block.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def read_jsonl_apart(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): rows of the schema, and file, line and value of lines that are no JSON of it; blank lines are neither."""
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    parsed = F.from_json("value", schema.add("_bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    lines = numbered_lines(spark, path).filter(F.trim("value") != "").withColumn("row", parsed)
    own = [F.col(f"row.`{f.name}`").alias(f.name) for f in schema.fields if f.name != "_bad"]
    good = F.col("row._bad").isNull()
    return lines.filter(good).select(*own), lines.filter(~good).select("file", "line", "value")


def read_tsv_apart(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): ``label<TAB>text`` rows in order of file and line, and the lines without a tab; blank lines are neither."""
    parts = F.split(F.trim("value"), "\t", 2)
    lines = numbered_lines(spark, path).filter(F.trim("value") != "").withColumn("p", parts)
    rows = lines.filter(F.size("p") == 2)
    good = rows.select(F.col("p")[1].alias("text"), (F.lower(F.trim(F.col("p")[0])) == "spam").cast("int").alias("is_scam"), F.struct("file", "line").alias("row_ord"))
    return good, lines.filter(F.size("p") < 2).select("file", "line", "value")


def read_text_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of file names and texts as rows (filename, text)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("filename", "text"))


def resolve_column(names: list[str], candidates: list[str] = (), contains: list[str] = (), position: int | None = None) -> str | None:
    """The first candidate that is a column, else the first column with one of the parts in its name, else that at the position."""
    low = {n.lower(): n for n in reversed(names)}
    for c in candidates:
        if c.lower() in low:
            return low[c.lower()]
    for n in names:
        if any(part in n.lower() for part in contains):
            return n
    return names[position] if position is not None and position < len(names) else None


def resolve_columns(df: DataFrame, text: list[str] = ("text", "message", "sms"), label: list[str] = ("label", "is_scam", "category"), keep: dict[str, str] | None = None) -> DataFrame:
    """Text and raw label of a table whose column names are not known in advance, and the columns to keep under their new names."""
    own = [c for c in df.columns if c not in (keep or {})]
    t = resolve_column(own, text, ["text", "message", "msg"], 0)
    y = resolve_column([c for c in own if c != t], label, ["label", "class", "target"])
    raw = F.col(f"`{y}`").cast("string") if y else F.lit("ham")
    return df.select(F.col(f"`{t}`").cast("string").alias("text"), raw.alias("raw_label"), *(F.col(a).alias(b) for a, b in (keep or {}).items()))


def read_parquet_labelled(spark: SparkSession, path: str) -> DataFrame:
    return resolve_columns(spark.read.parquet(path))


def read_csv_dir(spark: SparkSession, pattern: str, least_bytes: int = 10_000) -> DataFrame:
    """All CSV files of a pattern above a size, bad records dropped, with source_file."""
    return read_csv_dir_apart(spark, pattern, least_bytes)[0]


def read_csv_dir_apart(spark: SparkSession, pattern: str, least_bytes: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(rows, bad records) of all CSV files of a pattern above a size.

    Text and label are found in each file's own header; files with equal headers are read together.
    A record with more or fewer cells than its header is bad; it comes with its file and its number among the file's records, from 1.
    """
    lines = spark.read.text(pattern).select("value", "_metadata.file_path", "_metadata.file_size", F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    heads = lines.filter(F.col("file_size") > least_bytes).groupBy("file_path").agg(F.min_by("value", "at").alias("head"))
    found, bad = [], []
    # A row for each different header, with its files.
    for row in heads.groupBy("head").agg(F.sort_array(F.collect_list("file_path")).alias("files")).orderBy("head").collect():
        names = spark.read.csv(row["files"][0], header=True, multiLine=True, escape='"').columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, "__bad")])
        rows = spark.read.schema(schema).option("columnPruning", "false").csv(row["files"], header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="__bad", multiLine=True, escape='"')
        # A file with quoted line breaks is read by one task, so its records have consecutive numbers.
        rows = rows.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_path").alias("__path"), F.monotonically_increasing_id().alias("__id"))
        # Written once: both results read it, and a query of bad records alone may not read the files themselves.
        rows = Scratch(spark, "csv").save(rows, "rows")
        good = rows.filter("__bad IS NULL").drop("__bad", "__path", "__id")
        found.append(resolve_columns(good, keep={"__file": "source_file"}))
        firsts = rows.groupBy(F.col("__path").alias("p")).agg(F.min("__id").alias("first"))
        lost = rows.filter("__bad IS NOT NULL").join(firsts, F.col("__path") == F.col("p"))
        bad.append(lost.select(F.col("__file").alias("source_file"), (F.col("__id") - F.col("first") + 1).alias("record"), F.col("__bad").alias("value")))
    empty = [spark.createDataFrame([], x) for x in ("text string, raw_label string, source_file string", "source_file string, record long, value string")]
    return tuple(reduce(DataFrame.unionByName, frames) if frames else none for frames, none in zip((found, bad), empty, strict=True))


def spread(df: DataFrame) -> DataFrame:
    """A table that is stored in fewer pieces than there are cores, dealt over these; others as they are.

    Work on texts costs more than one shuffle of a small table; a large one has pieces enough.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def messages(spark: SparkSession, path: str, streaming: bool = False, fmt: str = "json") -> DataFrame:
    """A table or a stream of messages."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(MESSAGES).format(fmt).load(path)
