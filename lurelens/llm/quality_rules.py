"""Quality rules and robust outliers, with DataFrame functions only.

Base rules look at one document.  The method then fits a minimum covariance
determinant estimate for each language and source.  Four starts stand for the
search: the coordinate-wise medians with the least scales, and with the
quartiles' distance as scale the medians, the lower and the upper quartiles.
From each, concentration steps keep the ``alpha`` share of rows nearest to the
current centre and estimate centre and covariance from them anew.  After the
first few of them a group goes on with the start whose determinant is the
least, until it no longer falls.  A document is rejected when its squared
Mahalanobis distance exceeds ``cutoff``.  All groups take a step together.
Distances are counted in narrow logarithmic bins to find the share, so that no
group is sorted or collected, however large.

Nulls and edge cases: a null text has no words and fails the base rules; null
languages and sources form groups of their own; groups with fewer than
``least_rows`` rows are fitted together with the other small ones of their
language; repeated rows and repeated ids are judged row by row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import quoted

_SPACE = r"[\x20\x09-\x0D]+"
#: Statistics and the least standard deviation each is given.
STATS = {"x_word": 0.06, "x_symbols": 0.5, "x_lines": 0.1, "x_repeats": 0.12}
#: Columns of a fit: the centre and the lower triangle of the Cholesky factor.
_CELLS = [*(f"m_{i}" for i in range(len(STATS))), *(f"l_{i}_{j}" for i in range(len(STATS)) for j in range(i + 1))]


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice."""

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
        twice = _bound(pairs, lambda s: F.filter(F.transform(s, lambda x, k: F.when(F.coalesce(same(s, k, k - 1), F.lit(False)) | F.coalesce(same(s, k, k + 1), F.lit(False)), x["i"])), lambda i: i.isNotNull()))
        steps = _bound(F.array_sort(twice), lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def count(w: Column) -> Column:
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(_bound(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))

    return _bound(words, count)


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    return (
        docs.withColumn("_words", F.filter(F.split(text, _SPACE), lambda w: w != ""))
        .withColumn("_lines", lines)
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
                "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
                "n_lines": F.size("_lines").cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": _repeated_words(F.col("_words")).cast("long"),
            }
        )
        .drop("_words", "_lines")
    )


def _vector(n: Column) -> dict[str, Column]:
    """The transformed statistics; rates, so that length alone does not make an outlier."""
    return {
        "x_word": F.log((F.col("word_chars") + 1) / (n + 1)),
        "x_symbols": F.log1p(100 * F.col("n_symbols") / n),
        "x_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(10)),
        "x_repeats": F.col("n_repeat_words") / n,
    }


def _consistency(alpha: float) -> float:
    """Factor that makes the trimmed covariance of four normal variables unbiased."""
    low, high = 0.0, 60.0
    tail = lambda q, terms: math.exp(-q / 2) * sum((q / 2) ** k / math.factorial(k) for k in range(terms))
    for _ in range(80):
        q = (low + high) / 2
        low, high = (q, high) if 1 - tail(q, 2) < alpha else (low, q)
    return alpha / (1 - tail(low, 3))


def _distance(frame: DataFrame, fit: DataFrame) -> DataFrame:
    """Adds the squared Mahalanobis distance by forward substitution with the fit's Cholesky factor; a row for each fit of its group."""
    names = list(STATS)
    out = frame.join(fit, "_group", "left")
    for i, name in enumerate(names):
        known = [F.col(f"l_{i}_{j}") * F.col(f"z_{j}") for j in range(i)]
        out = out.withColumn(f"z_{i}", (F.col(name) - F.col(f"m_{i}") - sum(known, F.lit(0.0))) / F.col(f"l_{i}_{i}"))
    return out.withColumn("d2", sum((F.col(f"z_{i}") ** 2 for i in range(1, len(names))), F.col("z_0") ** 2))


def _factor(moments: DataFrame, scale: float) -> DataFrame:
    """Centres and Cholesky factors of the scaled covariances, each with the least variances added, and the logarithm of their determinants' root."""
    names, floors = list(STATS), list(STATS.values())
    for i in range(len(names)):
        for j in range(i + 1):
            cell = scale * F.col(f"c_{i}_{j}") + (F.lit(floors[i] ** 2) if i == j else 0)
            cell = cell - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            moments = moments.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(cell, F.lit(floors[i] ** 2 / 4))) if i == j else cell / F.col(f"l_{j}_{j}"))
    spread = sum((F.log(f"l_{i}_{i}") for i in range(len(names))), F.lit(0.0))
    return moments.select("_group", "_start", *_CELLS, spread.alias("_spread"))


def _share_reached(bins: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """Per group the first bin at which the cumulated count reaches the share ``alpha``; bins has a row for each group and bin."""
    groups = bins.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("b"), F.sum("n").alias("total"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin"))
    step = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["bin"].isNotNull(), a["bin"]).when(a["seen"] + x["n"] >= F.ceil(alpha * F.col("total")), x["bin"]).alias("bin"))
    return groups.select(*keys, F.aggregate("b", start, step)["bin"].alias("limit"))


def _starts(stats: DataFrame, scratch: Scratch) -> DataFrame:
    """Four centres with scales for each group, from the quartiles of each statistic."""
    names, floors = list(STATS), list(STATS.values())
    long = stats.select("_group", F.posexplode(F.array(*names)).alias("stat", "x"))
    bins = scratch.save(long.groupBy("_group", "stat", F.floor(F.col("x") * 128).alias("bin")).agg(F.count(F.lit(1)).alias("n")), "bins")
    found = None
    for k, share in enumerate((0.25, 0.5, 0.75)):
        reached = _share_reached(bins, ["_group", "stat"], share)
        pick = [F.max(F.when(F.col("stat") == i, (F.col("limit") + 0.5) / 128)).alias(f"q{k}_{i}") for i in range(len(names))]
        own = reached.groupBy("_group").agg(*pick)
        found = own if found is None else found.join(own, "_group")
    # For a normal variable the quartiles are 1.349 standard deviations apart.
    wide = [F.greatest(F.lit(floors[i]), (F.col(f"q2_{i}") - F.col(f"q0_{i}")) / 1.349) for i in range(len(names))]
    tight = [F.lit(floor) for floor in floors]

    def start(number: int, quartile: int, scales: list[Column]) -> Column:
        cells = [F.col(f"q{quartile}_{i}").alias(f"m_{i}") for i in range(len(names))]
        cells += [(scales[i] if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i in range(len(names)) for j in range(i + 1)]
        return F.struct(F.lit(number).alias("_start"), *cells)

    four = F.array(start(0, 1, tight), start(1, 1, wide), start(2, 0, wide), start(3, 2, wide))
    return found.select("_group", F.explode(four).alias("s")).select("_group", "s.*", F.lit(float("inf")).alias("_spread"))


def _step(stats: DataFrame, fit: DataFrame, alpha: float) -> DataFrame:
    """A concentration step of each group and start."""
    names = list(STATS)
    near = _distance(stats, fit).withColumn("bin", F.floor(F.log1p("d2") * 64)).select("_group", "_start", "bin", *names)
    counted = near.groupBy("_group", "_start", "bin").agg(F.count(F.lit(1)).alias("n"))
    inside = near.join(_share_reached(counted, ["_group", "_start"], alpha), ["_group", "_start"]).filter(F.col("bin") <= F.col("limit"))
    means = [F.avg(x).alias(f"m_{i}") for i, x in enumerate(names)]
    covs = [F.covar_pop(names[i], names[j]).alias(f"c_{i}_{j}") for i in range(len(names)) for j in range(i + 1)]
    return _factor(inside.groupBy("_group", "_start").agg(*means, *covs), _consistency(alpha))


def robust_fit(stats: DataFrame, scratch: Scratch, alpha: float = 0.6, first_steps: int = 2, most_steps: int = 8, least_fall: float = 0.01) -> DataFrame:
    """Per ``_group`` the centre and Cholesky factor of the minimum covariance determinant estimate.

    ``stats`` holds ``_group`` and the four statistics.  Bins per group are few:
    distances and values are binned logarithmically or by 1/128.  All starts take
    ``first_steps``, the best of each group up to ``most_steps`` more, until no
    group's determinant falls by ``least_fall`` of itself.
    """
    fit = scratch.save(_starts(stats, scratch), "fit0")
    for k in range(1, first_steps + 1):
        fit = scratch.save(_step(stats, fit, alpha), f"fit{k}")
    best = fit.groupBy("_group").agg(F.min(F.struct("_spread", "_start", *_CELLS)).alias("f"))
    fit = scratch.save(best.select("_group", "f.*"), "best")
    for k in range(most_steps):
        before, fit = fit, scratch.save(_step(stats, fit, alpha), f"best{k}")
        both = fit.join(before.select("_group", F.col("_spread").alias("_before")), "_group")
        # One number for all groups: the logarithm of a determinant is twice that of its root.
        if (both.agg(F.max(2 * (F.col("_before") - F.col("_spread")))).first()[0] or 0.0) <= least_fall:
            break
    return fit.select("_group", *_CELLS)


def _judged(docs: DataFrame, carry: tuple[str, ...], least_words: int = 50, cutoff: float = 36.0, least_rows: int = 40, alpha: float = 0.6, text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The carried columns as ``_row`` with statistics, ``base_failed``, ``distance2`` and ``kept``."""
    scratch = Scratch(docs.sparkSession, "quality")
    # Only what is needed goes on, under names of its own, so other columns cannot clash.
    by = [F.col(quoted(c)).cast("string").alias(f"by{k}") for k, c in enumerate(group_cols)]
    own = docs.select(F.struct(*map(quoted, carry)).alias("_row"), F.struct(*by).alias("_by"), F.col(quoted(text_col)).alias("_text"))
    stats = text_statistics(own, "_text").drop("_text")
    n = F.col("n_words")
    stats = stats.withColumn("base_failed", (n < least_words) | (100 * F.col("n_repeat_words") > 50 * n))
    label = lambda n: F.concat_ws("\x1f", *(F.coalesce(F.col(f"_by.by{k}"), F.lit("\x1e")) for k in range(n)))
    values = {k: F.when(n > 0, v) for k, v in _vector(F.greatest(n, F.lit(1))).items()}
    stats = scratch.save(stats.withColumns(values).withColumn("_group", label(len(by))).withColumn("_wide", label(1)).drop("_by"), "stats")
    sizes = stats.filter(~F.col("base_failed")).groupBy("_group").agg(F.count(F.lit(1)).alias("_size"))
    sizes = scratch.save(sizes, "sizes")
    small = F.coalesce(F.col("_size"), F.lit(0)) < least_rows
    stats = stats.join(sizes, "_group", "left").withColumn("_group", F.when(small, F.concat(F.col("_wide"), F.lit("\x1fsmall groups"))).otherwise(F.col("_group")))
    # Each step reads these few columns again.
    vectors = scratch.save(stats.filter(~F.col("base_failed")).select("_group", *STATS), "vectors")
    fit = robust_fit(vectors, scratch, alpha)
    judged = _distance(stats, fit).withColumn("distance2", F.when(~F.col("base_failed"), F.col("d2")))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= cutoff)
    return judged.select("_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", kept.alias("kept"))


def judge(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """A row per document: its id, the statistics, ``base_failed``, ``distance2`` and ``kept``."""
    judged = _judged(docs, (id_col,), **options)
    return judged.select("_row.*", *judged.columns[1:])


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    return _judged(docs, tuple(docs.columns), **options).filter("kept").select("_row.*")
