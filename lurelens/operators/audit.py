"""Integrity audits of a split corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed
from ..functions import text
from .corpus import SYNTHETIC


def split_matrix(splits: DataFrame) -> DataFrame:
    """Per split: counts by language and label, and of synthetic and real rows."""
    cell = lambda lang, scam: F.count_if((F.col("language") == lang) & (F.col("is_scam") == scam))
    cells = [cell(lang, scam).alias(f"{lang.lower()}_{name}") for lang in ("English", "Hindi", "Hinglish") for scam, name in ((0, "ham"), (1, "scam"))]
    made = F.count_if(F.col("source_dataset") == SYNTHETIC)
    return splits.groupBy("split").agg(*cells, made.alias("synthetic"), (F.count(F.lit(1)) - made).alias("real"), F.count(F.lit(1)).alias("total"))


def hinglish_purity(splits: DataFrame) -> DataFrame:
    """Classes of Hinglish rows with counts and shares."""
    classes = splits.filter("language = 'Hinglish'").groupBy(text.purity(F.col("text")).alias("purity")).agg(F.count(F.lit(1)).alias("n"))
    return classes.withColumn("percent", F.bround(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def intent_distribution(splits: DataFrame, language: str | None = None) -> DataFrame:
    """Intents of scam rows with counts and shares."""
    scams = splits.filter("is_scam = 1")
    scams = scams.filter(F.col("language") == language) if language else scams
    counts = scams.groupBy(F.col("head2_scam_intent").alias("intent")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.bround(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def facet_rates(splits: DataFrame) -> DataFrame:
    """Share of scam rows that have each facet."""
    facets = list(fixed.WEAK_SOCIAL_WORDS)
    sums = splits.filter("is_scam = 1").agg(*(F.sum(f"head1_social_engineering.{f}").alias(f) for f in facets), F.count(F.lit(1)).alias("rows"))
    return sums.unpivot(["rows"], facets, "facet", "positives").select("facet", F.coalesce("positives", F.lit(0)).alias("positives"), "rows", F.when(F.col("rows") > 0, F.bround(100 * F.col("positives") / F.col("rows"), 2)).otherwise(0.0).alias("percent"))


def privacy(splits: DataFrame) -> DataFrame:
    """Per split and in all: national ids left unmasked, and masks."""
    masked = F.length("text") - F.length(F.replace("text", F.lit(fixed.NATIONAL_ID_MASK), F.lit("")))
    left = F.sum(text.national_ids(F.col("text")))
    masks = F.sum(masked / len(fixed.NATIONAL_ID_MASK))
    return splits.rollup("split").agg(left.cast("long").alias("unmasked"), masks.cast("long").alias("masked")).withColumn("split", F.coalesce("split", F.lit("all")))


def synthetic_leaks(splits: DataFrame) -> DataFrame:
    """Synthetic rows outside the training split; all counts must be 0."""
    return splits.filter("split <> 'train'").groupBy("split").agg(F.count_if(F.col("source_dataset") == SYNTHETIC).alias("synthetic"))


def exact_overlaps(splits: DataFrame) -> DataFrame:
    """Distinct texts that two splits share, for each pair of splits.

    One aggregation finds each text's splits, by its hash, so that texts are not shuffled; no split is joined with another.
    """
    sets = splits.groupBy(F.sha2(text.trimmed(F.col("text")), 256).alias("t")).agg(F.collect_set("split").alias("s"))
    pairs = [("train", "test"), ("val", "test"), ("train", "val")]
    both = sets.agg(*(F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"{a}_{b}") for a, b in pairs))
    return both.unpivot([], [f"{a}_{b}" for a, b in pairs], "pair", "shared")


def template_overlap(splits: DataFrame) -> DataFrame:
    """Indic test rows, those whose template is in train, and their share; templates are met by their hashes."""
    indic = splits.filter(F.col("language").isin("Hindi", "Hinglish")).withColumn("_t", F.sha2(text.template_key(F.col("text")), 256))
    train = indic.filter("split = 'train'").select("_t").distinct().withColumn("_seen", F.lit(True))
    test = indic.filter("split = 'test'").join(train, "_t", "left")
    counts = test.agg(F.count(F.lit(1)).alias("rows"), F.count("_seen").alias("overlapping"))
    return counts.withColumn("percent", F.when(F.col("rows") > 0, F.bround(100 * F.col("overlapping") / F.col("rows"), 2)).otherwise(0.0))


def benign_defence(splits: DataFrame) -> DataFrame:
    """Benign rows in languages other than English, per split."""
    return splits.filter("is_scam = 0 AND language <> 'English'").groupBy("split", "language").agg(F.count(F.lit(1)).alias("n"))


def source_profile(df: DataFrame) -> DataFrame:
    """Per source: rows, scams, their share, and mean and largest length."""
    return df.groupBy("source_dataset").agg(F.count(F.lit(1)).alias("rows"), F.sum("is_scam").alias("scams"), F.bround(100 * F.avg("is_scam"), 2).alias("percent"), F.bround(F.avg(F.length("text")), 2).alias("mean_length"), F.max(F.length("text")).alias("max_length"))


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k most frequent values; ties by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def corpus_summary(records: DataFrame) -> DataFrame:
    """Per category and in all: rows by language and the share with a URL."""
    return records.rollup("head2_scam_intent").agg(
        F.count_if(F.col("language") == "Hindi").alias("hindi"),
        F.count_if(F.col("language") == "Hinglish").alias("hinglish"),
        F.count(F.lit(1)).alias("total"),
        F.bround(100 * F.avg(F.col("metadata.has_url").cast("int")), 1).alias("url_percent"),
    ).withColumn("head2_scam_intent", F.coalesce("head2_scam_intent", F.lit("TOTAL")))


def report(splits: DataFrame) -> dict[str, DataFrame]:
    """All modules of the audit by name."""
    return {
        "split_matrix": split_matrix(splits),
        "hinglish_purity": hinglish_purity(splits),
        "hindi_intents": intent_distribution(splits, "Hindi"),
        "exact_overlaps": exact_overlaps(splits),
        "template_overlap": template_overlap(splits),
        "synthetic_leaks": synthetic_leaks(splits),
        "privacy": privacy(splits),
    }


def leak_check(splits: DataFrame) -> DataFrame:
    """The check that synthetic rows stay in the training split: check, value, limit and passed."""
    return _judged(synthetic_leaks(splits).agg(F.coalesce(F.sum("synthetic"), F.lit(0)).alias("value")).select(F.lit("synthetic_outside_train").alias("check"), "value", F.lit(0.0).alias("limit")))


def _judged(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", F.col("value").cast("double")).withColumn("passed", F.col("value") <= F.col("limit"))


def integrity(splits: DataFrame, most_template_percent: float = 100.0) -> DataFrame:
    """One table of the checks that decide whether a corpus may be used: check, value, limit and passed.

    Synthetic rows outside the training split, unmasked ids, and texts that two
    splits share must be none; templates of Indic test rows in train may have a share.
    """
    ids = privacy(splits).filter("split = 'all'").select(F.lit("unmasked_ids").alias("check"), F.coalesce("unmasked", F.lit(0)).alias("value"), F.lit(0.0).alias("limit"))
    shared = exact_overlaps(splits).select(F.concat(F.lit("shared_texts_"), "pair").alias("check"), F.col("shared").alias("value"), F.lit(0.0).alias("limit"))
    templates = template_overlap(splits).select(F.lit("template_percent").alias("check"), F.col("percent").alias("value"), F.lit(most_template_percent).alias("limit"))
    return reduce(DataFrame.unionByName, (leak_check(splits), *map(_judged, (ids, shared, templates))))


def gate(splits: DataFrame) -> None:
    """Raises if synthetic rows left the training split or an id is unmasked."""
    if not synthetic_leaks(splits).filter("synthetic > 0").isEmpty():
        raise ValueError("synthetic rows outside the training split")
    if not privacy(splits).filter("split = 'all' AND unmasked > 0").isEmpty():
        raise ValueError("unmasked national ids")
