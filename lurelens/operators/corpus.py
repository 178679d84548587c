"""Building a labelled corpus: sources, deduplication, records, splits and generated messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed
from ..functions import labels, text
from ..scratch import Scratch

SYNTHETIC = "Synthetic_Tier_C"


def union_sources(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows (text, is_scam, row_ord) of named sources, with source_dataset and src_ord."""
    tagged = [df.select("text", "is_scam", "row_ord").withColumns({"source_dataset": F.lit(name), "src_ord": F.lit(i)}) for i, (name, df) in enumerate(sources)]
    return reduce(DataFrame.unionByName, tagged)


def min_text(df: DataFrame, least: int = 4) -> DataFrame:
    """Texts that have at least ``least`` characters once trimmed."""
    return df.withColumn("text", text.trimmed(F.col("text"))).filter(F.length("text") >= least)


def drop_null_like(df: DataFrame, least: int = 4) -> DataFrame:
    return min_text(df, least).filter(F.lower("text") != "nan")


def devanagari_only(df: DataFrame) -> DataFrame:
    return df.filter(text.has_devanagari(F.col("text")))


def threat_filter(df: DataFrame) -> DataFrame:
    """Adds decision: ham is kept, spam only with a threat word."""
    return df.withColumn("decision", F.when(F.col("is_scam") == 0, "ham").when(labels.is_threat(F.col("text")), "scam").otherwise("discarded_marketing"))


def first_by_hash(df: DataFrame, order: list[str]) -> DataFrame:
    """The first row, in the given order, for each content hash.

    An aggregation with partial results, so copies are dropped before the shuffle and a text with very many copies is no hot key.
    """
    rest = [c for c in df.columns if c not in order]
    keyed = df.withColumn("_hash", text.content_hash(F.col("text")))
    first = keyed.groupBy("_hash").agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_row"))
    return first.select("_row.*").select(*df.columns)


def numbered(df: DataFrame, order: list[str], by: list[str] = (), name: str = "number") -> DataFrame:
    """Adds a running number from 0 in the given order within each class of ``by``, without gathering a class in one task.

    Rows are range-partitioned by class and order and written with the number of
    their partition, so that every later step sees the same ranges.  Each range is numbered by
    itself and shifted by the sizes of those before it, a row for each class and range.
    """
    keys = [*by, "__range"]
    ranged = df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id())
    ranged = Scratch(df.sparkSession, "numbered").save(ranged, "ranged")
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    sizes = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*keys, F.coalesce(before, F.lit(0)).alias("__start"))
    same = reduce(lambda a, b: a & b, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys))
    joined = ranged.withColumn("__own", own).alias("a").join(starts.alias("b"), same)
    return joined.select(*(F.col(f"a.{c}") for c in df.columns), (F.col("__own") + F.col("__start")).alias(name))


def sequential_ids(df: DataFrame, order: list[str], prefix: str, width: int = 6) -> DataFrame:
    """``prefix`` and a running number from 1 in the given order, as ``id``."""
    number = (F.col("__number") + 1).cast("string")
    shown = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)
    return numbered(df, order, name="__number").withColumn("id", F.concat(F.lit(prefix), shown)).drop("__number")


def build_records(df: DataFrame, flags: dict[str, str] | None = None) -> DataFrame:
    """Training records of rows (id, text, is_scam, source_dataset): masked text, language, weak labels, flags."""
    masked = df.withColumn("text", text.redacted(text.trimmed(F.col("text"))))
    group = F.concat(F.lit("real_"), F.replace(F.lower("source_dataset"), F.lit("/"), F.lit("_")))
    group = F.coalesce(F.col("split_group"), group) if "split_group" in df.columns else group
    # Lowered and cut into words once; all labels read these columns.
    masked = masked.withColumns({"__low": F.lower("text"), "__words": text.tokens(F.col("text"))})
    return masked.select(
        "id",
        "text",
        text.detect_language(F.col("text"), F.col("__words")).alias("language"),
        "source_dataset",
        F.col("is_scam").cast("int").alias("is_scam"),
        labels.weak_social(F.col("text"), F.col("is_scam"), F.col("__low")).alias("head1_social_engineering"),
        labels.weak_intent(F.col("text"), F.col("is_scam"), F.col("__low")).alias("head2_scam_intent"),
        group.alias("split_group"),
        text.content_flags(F.col("text"), flags).alias("metadata"),
    )


def group_label(df: DataFrame, by: str, order: list[str], prefix: str, size: int = 50) -> DataFrame:
    """``split_group`` for every ``size`` rows of a class in the given order."""
    group = F.concat(F.lit(prefix), F.coalesce(F.col(by).cast("string"), F.lit("null")), F.lit("_"), F.floor(F.col("__number") / size).cast("string"))
    return numbered(df, order, [by], "__number").withColumn("split_group", group).drop("__number")


def shuffle_key(seed: int, key: Column) -> Column:
    """A reproducible random order."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def stratified_split(df: DataFrame, strata: list[str], key: str = "id", seed: int = 42, salts: int = 64) -> DataFrame:
    """Adds split: of each stratum of n rows, int(0.8 n) train, int(0.1 n) val and the rest test, in a random order.

    Rows are written once, with their place, so that nothing they hold is computed again
    and their order is total.  A stratum can hold a third of all rows, so ranks are taken
    in ranges of the random key: rows are numbered within a range and shifted by the sizes
    of the ranges before it.  Only keys go through that; it yields the first rows of val and
    test of each stratum, which tell a row's split by its key, so texts are not shuffled.
    """
    scratch = Scratch(df.sparkSession, "split")
    salt = F.pmod(F.conv(F.substring("_k", 1, 4), 16, 10).cast("int"), F.lit(65536)) * salts / 65536
    keyed = df.withColumn("_k", shuffle_key(seed, F.col(key))).withColumns({"_range": F.floor(salt).cast("int"), "_row": F.monotonically_increasing_id()})
    keyed = scratch.save(keyed, "keyed")
    at = F.struct("_k", F.col(key).alias("_key"), "_row")
    sizes = keyed.groupBy(*strata, "_range").agg(F.count(F.lit(1)).alias("_size"))
    window = Window.partitionBy(*strata)
    before = F.sum("_size").over(window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*strata, "_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(window).alias("_n"))
    own = F.row_number().over(Window.partitionBy(*strata, "_range").orderBy("_at")) - 1
    numbered = keyed.select(*strata, "_range", at.alias("_at")).withColumn("_own", own)
    same = lambda names: reduce(lambda a, b: a & b, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names))
    rank, n = F.col("_own") + F.col("_before"), F.col("_n")
    train, val = F.floor(n * 0.8), F.floor(n * 0.1)
    ranked = numbered.alias("a").join(sizes.alias("b"), same([*strata, "_range"]))
    ranked = ranked.filter(rank.isin(train, train + val)).select(*(F.col(f"a.{c}") for c in strata), "_at", (rank == train).alias("_val"), (rank == train + val).alias("_test"))
    firsts = ranked.groupBy(*strata).agg(F.max(F.when(F.col("_val"), F.col("_at"))).alias("_val"), F.max(F.when(F.col("_test"), F.col("_at"))).alias("_test"))
    joined = keyed.withColumn("_at", at).alias("a").join(scratch.save(firsts, "firsts").alias("b"), same(strata))
    split = F.when(F.col("_at") < F.col("_val"), "train").when(F.col("_at") < F.col("_test"), "val").otherwise("test")
    return joined.withColumn("split", split).select(*(F.col(f"a.{c}") for c in df.columns), "split")


def with_synthetic(split: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Generated records join the training split only."""
    return split.unionByName(synthetic.withColumn("split", F.lit("train")))


def language_slices(split: DataFrame) -> dict[str, DataFrame]:
    test = split.filter("split = 'test'")
    return {name: test.filter(F.col("language") == name) for name in ("Hindi", "Hinglish", "English")}


def generate(spark: SparkSession, templates: DataFrame, slots: dict[str, list[str]], variants: int, seed: int = 42) -> DataFrame:
    """Messages from templates (template_id, template, language, category) and slot lists, a number of variants each.

    A slot ``{name}`` takes the entry that a hash of seed, template, variant and
    name picks, ``{digits:n}`` a random number of n digits. Masked and deduplicated by content.
    """
    pick = lambda name, n: F.pmod(F.xxhash64(F.lit(seed), "template_id", "variant", F.lit(name)), F.lit(n)).cast("int")
    rows = templates.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    body = F.col("template")
    for name, values in slots.items():
        body = F.replace(body, F.lit("{" + name + "}"), F.element_at(text.words_array(values), pick(name, len(values)) + 1))
    for n in (4, 6, 8):
        number = F.lpad(F.pmod(F.xxhash64(F.lit(seed), "template_id", "variant", F.lit(n)), F.lit(10**n)).cast("string"), n, "1")
        body = F.replace(body, F.lit("{digits:%d}" % n), number)
    made = rows.withColumn("text", text.redacted(body)).withColumns({"is_scam": F.lit(1), "source_dataset": F.lit(SYNTHETIC), "row_ord": F.struct("template_id", "variant")})
    return first_by_hash(made.select("text", "language", "category", "is_scam", "source_dataset", "row_ord"), ["row_ord"])


def seeded_sample(df: DataFrame, by: str, k: int, key: str = "id", seed: int = 42) -> DataFrame:
    """k rows of each class in a reproducible random order; the classes are few and each task keeps only its first k."""
    ranked = df.withColumn("_k", shuffle_key(seed, F.col(key)))
    part = Window.partitionBy(by, F.pmod(F.xxhash64(key), F.lit(64))).orderBy("_k")
    local = ranked.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k)
    final = Window.partitionBy(by).orderBy("_k")
    return local.withColumn("_r", F.row_number().over(final)).filter(F.col("_r") <= k).select(*df.columns)


def ingestion_funnel(df: DataFrame, decision: str = "decision") -> DataFrame:
    """Rows inspected, discarded and retained, and each decision's share."""
    counts = df.groupBy(decision).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(decision, "n", F.bround(100 * F.col("n") / total, 2).alias("percent"))


def is_marathi(value: Column) -> Column:
    """Whether a text is in the excluded language; one that is missing is not."""
    return F.coalesce(text.marathi(value), F.lit(False))


def preview(df: DataFrame, n: int = 10, order: list[str] = ()) -> DataFrame:
    """The first n rows, in the given order if there is one."""
    return (df.orderBy(*order) if order else df).limit(n)
