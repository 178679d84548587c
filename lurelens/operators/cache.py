"""Reuse of earlier results within a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..scratch import Scratch
from .joins import dealt_join


def cache_key(value: Column, kind: str = "raw") -> Column:
    """Hash that results are stored and looked up by: of the raw text, or ``normalised``."""
    return text.content_hash(value, normalised=False) if kind == "raw" else F.sha2(text.collapsed(text.heal_urls(value)), 256)


def within_ttl(created: Column, now: Column, hours: int = 24) -> Column:
    return created >= now - F.make_interval(hours=F.lit(hours))


def _last_known(rows: DataFrame) -> DataFrame:
    """Adds ``_last``, the value that is the last non-null one of its hash up to each time; rows (hash, _at, _value), one for each hash and time.

    The last value is handed on within seconds, from second to second within
    hours, and from hour to hour, so no task sees more of a hash than the moments of
    a second, the seconds of an hour, or its hours.
    """
    levels = [F.floor(F.unix_timestamp("_at") / n) for n in (1, 3600)]
    rows = rows.withColumns({"_second": levels[0], "_hour": levels[1]})
    up_to = lambda keys, order, end: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    last = lambda value, window: F.last(value, ignorenulls=True).over(window)
    seconds = rows.groupBy("hash", "_hour", "_second").agg(F.max("_value").alias("_end"))
    hours = seconds.groupBy("hash", "_hour").agg(F.max("_end").alias("_end"))
    hours = hours.select("hash", "_hour", last("_end", up_to(["hash"], "_hour", -1)).alias("_hours_before"))
    seconds = seconds.select("hash", "_hour", "_second", last("_end", up_to(["hash", "_hour"], "_second", -1)).alias("_seconds_before"))
    before = seconds.join(hours, ["hash", "_hour"]).select("hash", "_second", F.coalesce("_seconds_before", "_hours_before").alias("_before"))
    own = rows.withColumn("_own", last("_value", up_to(["hash", "_second"], "_at", Window.currentRow)))
    return own.join(before, ["hash", "_second"]).withColumn("_last", F.coalesce("_own", "_before")).drop("_second", "_hour", "_own", "_before")


def lookup(messages: DataFrame, records: DataFrame, hours: int = 24) -> DataFrame:
    """Messages (msg_id, hash, ts) with the latest record of the same hash from the ``hours`` before them, as hit_id; null without one.

    Messages and records of a hash are put in order of time, one row for each
    moment, and each moment takes the last record up to it, so no message meets all
    records.  Of records of one moment the greatest id counts.
    """
    known = records.filter("hash IS NOT NULL AND created_at IS NOT NULL").select("hash", F.col("created_at").alias("_at"), F.struct(F.col("created_at").alias("at"), F.col("scan_id").alias("id")).alias("_value"))
    asked = messages.filter("hash IS NOT NULL AND ts IS NOT NULL").select("hash", F.col("ts").alias("_at"))
    moments = asked.unionByName(known, allowMissingColumns=True).groupBy("hash", "_at").agg(F.max("_value").alias("_value"))
    found = _last_known(moments).select("hash", F.col("_at").alias("ts"), F.when(within_ttl(F.col("_last.at"), F.col("_at"), hours), F.col("_last.id")).alias("hit_id"))
    return dealt_join(messages, found.filter("hit_id IS NOT NULL"), ["hash", "ts"])


def _next_after(times: DataFrame, life: int) -> DataFrame:
    """For each second of a hash the first one more than a life later, as ``_next``; seconds without one are left out.

    It lies in the part after the second's own, parts being one life long, or is
    the first of the parts after that.
    """
    part = F.floor(F.col("_second") / life)
    asks = times.select("hash", (F.col("_second") + life).alias("_at"), F.lit(0).alias("_kind"), F.col("_second").alias("_from"))
    rows = times.select("hash", F.col("_second").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_from")).union(asks).withColumn("_part", F.floor(F.col("_at") / life))
    back = Window.partitionBy("hash", "_part").orderBy(F.desc("_at"), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("_near", F.last(F.when(F.col("_kind") == 1, F.col("_at")), ignorenulls=True).over(back)).filter("_kind = 0")
    firsts = times.groupBy("hash", part.alias("_part")).agg(F.min("_second").alias("_first"))
    parts = firsts.unionByName(firsts.select("hash", (F.col("_part") + 1).alias("_part")), allowMissingColumns=True).groupBy("hash", "_part").agg(F.min("_first").alias("_first"))
    later = Window.partitionBy("hash").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    far = parts.select("hash", "_part", F.last("_first", ignorenulls=True).over(later).alias("_far"))
    found = near.join(far, ["hash", "_part"]).select("hash", F.col("_from").alias("_second"), F.coalesce("_near", "_far").alias("_next"))
    return found.filter("_next IS NOT NULL")


def misses(requests: DataFrame, hours: int = 24) -> DataFrame:
    """Adds hit to requests (hash, request_id, ts): a hit reuses the last miss of its hash and does not lengthen its life.

    Requests are first thinned to one a second, as later ones of the same second
    share its fate.  The second after which a miss at each second would be
    followed by the next miss depends on nothing else, so the misses of a hash
    are the chain of these from its first second.  It is followed by doubling:
    each round joins every second's jump with the jump from where it leads, so there
    are as many rounds as the chain's length has binary digits, and no task holds a
    hash.  Requests without a hash or a time never hit.
    """
    life = hours * 3600
    scratch = Scratch(requests.sparkSession, "misses")
    times = requests.select("hash", F.unix_timestamp("ts").alias("_second")).filter("hash IS NOT NULL AND _second IS NOT NULL").distinct()
    starts = times.groupBy("hash").agg(F.min("_second").alias("_second"), F.max("_second").alias("_end"))
    # A hash whose seconds all lie within a life has one miss.
    long = starts.filter(F.col("_end") - F.col("_second") > life).select("hash")
    jumps = scratch.save(_next_after(times.join(long, "hash", "left_semi"), life), "jumps-0")
    doubled = []
    while not jumps.isEmpty():
        doubled.append(jumps)
        further = jumps.select("hash", F.col("_second").alias("_next"), F.col("_next").alias("_then"))
        jumps = scratch.save(jumps.join(further, ["hash", "_next"]).select("hash", "_second", F.col("_then").alias("_next")), f"jumps-{len(doubled)}")
    # Every place of a chain is a sum of powers of two, so one pass over them reaches all.
    reached = starts.select("hash", "_second")
    for jumps in reversed(doubled):
        both = F.explode(F.array_compact(F.array("_second", "_next")))
        reached = reached.join(jumps, ["hash", "_second"], "left").select("hash", both.alias("_second"))
    first = F.min(F.struct("ts", "request_id"))
    missed = requests.withColumn("_second", F.unix_timestamp("ts")).groupBy("hash", "_second").agg(first.alias("_f")).join(reached, ["hash", "_second"])
    missed = missed.select("hash", F.col("_f.ts").alias("ts"), F.col("_f.request_id").alias("request_id"), F.lit(True).alias("_miss"))
    joined = dealt_join(requests, missed, ["hash", "ts", "request_id"])
    timeless = F.col("hash").isNull() | F.col("ts").isNull()
    return joined.withColumn("hit", ~timeless & F.col("_miss").isNull()).drop("_miss")


def reuse(messages: DataFrame, hours: int = 24) -> DataFrame:
    """Messages (msg_id, hash, ts, scan_id) with the scan_id of the earlier one of the same hash that each would reuse, as hit_id.

    They are taken in order of time: one that comes within ``hours`` of the last that was not reused takes that one's result.
    """
    judged = misses(messages.withColumn("request_id", F.col("msg_id")), hours).drop("request_id")
    judged = Scratch(messages.sparkSession, "reuse").save(judged, "judged")
    fresh = judged.filter("NOT hit")
    # Whether a message hits was decided by whole seconds, so the last result before it is the right one whatever the fractions.
    again = lookup(judged.filter("hit"), fresh.select("hash", "scan_id", F.col("ts").alias("created_at")), hours + 1)
    return fresh.withColumn("hit_id", F.lit(None).cast(judged.schema["scan_id"].dataType)).unionByName(again).drop("hit")
