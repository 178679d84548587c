"""Exact percentiles of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import Scratch


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``by`` and a column for each named share: the interpolated percentile of ``value`` in each group; nulls do not count.

    Equal values are counted first.  The counts are dealt by ranges of group and value
    and written with the number of their range; within a range they are summed up in
    order, and shifted by the ranges before it, a row for each group and range.
    So no group's values meet in one task, and two passes find every share.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    ranged = counted.repartitionByRange(*by, "__value").withColumn("__range", F.spark_partition_id())
    ranged = Scratch(rows.sparkSession, "percentiles").save(ranged, "ranged")
    own = F.sum("__n").over(Window.partitionBy(*by, "__range").orderBy("__value"))
    sizes = ranged.groupBy(*by, "__range").agg(F.sum("__n").alias("__size"))
    group = Window.partitionBy(*by)
    before = F.sum("__size").over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*by, "__range", F.coalesce(before, F.lit(0)).alias("__start"), F.sum("__size").over(group).alias("__total"))
    same = reduce(lambda a, b: a & b, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "__range")))
    placed = ranged.withColumn("__own", own).alias("a").join(starts.alias("b"), same)
    placed = placed.select(*(F.col(f"a.{c}").alias(c) for c in by), "__value", "__n", "__total", (F.col("__own") + F.col("__start")).alias("__end"))

    def at(place: Column) -> Column:
        """The value at a place of the group in order, from 0."""
        return F.max(F.when((F.col("__end") > place) & (F.col("__end") - F.col("__n") <= place), F.col("__value")))

    found = {}
    for name, share in shares.items():
        place = F.lit(share) * (F.col("__total") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        rest = F.max(place - F.floor(place))
        found[name] = low + (high - low) * rest
    return placed.groupBy(*by).agg(*(v.alias(k) for k, v in found.items()))
