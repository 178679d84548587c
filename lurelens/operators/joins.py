"""Joins with lookup tables whose keys may be in a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a key up to which it is left to one task, however few rows there are in all.
LEAST_ROWS = 100_000
_OPAQUE = (T.MapType, T.VariantType)


def _spread(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed, the same whenever a row is computed again."""
    own = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, _OPAQUE)]
    return F.xxhash64(*own)


def hot_keys(left: DataFrame, on: list[str], least_rows: int = LEAST_ROWS, parts: int | None = None) -> list[tuple[int, int]]:
    """Hashes of keys with more than a task's share of rows, and in how many parts each is to be dealt.

    A share is the rows over the number of tasks, so there are fewer such keys than tasks, whatever the input.
    """
    parts = parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = left.groupBy(F.xxhash64(*on).alias("__key")).agg(F.count(F.lit(1)).alias("n"))
    # The share is known with the total; no key with less than the least is hot.
    found = counts.filter(F.col("n") > least_rows).agg(F.sum("n")).first()[0]
    if found is None:
        return []
    total = left.count()
    share = max(total // parts, least_rows)
    rows = counts.filter(F.col("n") > share).orderBy(F.desc("n"), "__key").limit(parts).collect()
    # Pieces are a quarter of a share, so that tasks that get one more differ little.
    return [(r["__key"], min(4 * parts, -(-4 * r["n"] // share))) for r in rows]


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", least_rows: int = LEAST_ROWS) -> DataFrame:
    """``left`` joined with a lookup table that has a row, or a few, for each key.

    Rows of a hot key are dealt over parts by a hash of the whole row, and the
    lookup's rows of that key are repeated for each part; other keys are joined as
    they are.  Null keys, which find nothing, are dealt out like any other.  The
    table of hot keys has fewer rows than there are tasks, so it alone is broadcast.
    """
    hot = hot_keys(left, on, least_rows)
    if not hot:
        return left.join(right, on, how)
    table = F.broadcast(left.sparkSession.createDataFrame(hot, "__key long, __parts int"))
    key = F.xxhash64(*on)
    dealt = left.withColumns({"__key": key, "__row": _spread(left)}).join(table, "__key", "left")
    dealt = dealt.withColumn("__part", F.coalesce(F.pmod("__row", F.col("__parts")).cast("int"), F.lit(0))).drop("__key", "__row", "__parts")
    known = right.withColumn("__key", key).join(table, "__key", "left")
    known = known.withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__key", "__parts")
    return dealt.join(known, [*on, "__part"], how).drop("__part")
