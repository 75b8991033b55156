"""Throughput over trailing windows, running counters and time to completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curata.functions.text import eta_seconds, eta_text
from curata.plans.scratch import Scratch

MINUTE = 60_000_000


def trailing(events: DataFrame, spans: list[int], key: str = "event_id", ts: str = "ts") -> DataFrame:
    """(key, micros, n<span> for each span of minutes): for each event the events of the minutes before it, itself and those
    of its instant included; an event just so many minutes old is not. Events without a time have no row.

    Exact, and no task holds an hour's rows, however hot the hour: events are counted per instant, an instant adds its count
    at its time and takes it away a span later, and the running sum of these steps is the count. Steps are dealt out by
    range, so a crowded stretch is spread over as many partitions as its instants need; each partition is summed alone and
    starts from the sums of those before it, one row a partition.
    """
    at = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("micros")).filter("micros is not null")
    per = at.groupBy("micros").agg(F.count(F.lit(1)).alias("c"))
    changes = [f"d{m}" for m in spans]

    def step(pos: Column, own: bool, over: list[int]) -> Column:
        sign = 1 if own else -1
        return F.struct(pos.alias("pos"), F.lit(own).alias("own"), *[(F.col("c") * (sign if m in over else 0)).alias(f"d{m}") for m in spans])

    steps = per.select(F.inline(F.array(step(F.col("micros"), True, spans), *[step(F.col("micros") + m * MINUTE, False, [m]) for m in spans])))
    dealt = steps.repartitionByRange("pos").withColumn("part", F.spark_partition_id())
    placed = Scratch(events.sparkSession, "trailing").table(dealt, "steps")
    sums = placed.groupBy("part").agg(*[F.sum(d).alias(d) for d in changes])
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("part", *[F.coalesce(F.sum(d).over(earlier), F.lit(0)).alias(f"before_{d}") for d in changes])
    upto = W.partitionBy("part").orderBy("pos").rangeBetween(W.unboundedPreceding, 0)
    summed = placed.select("part", "pos", "own", *[F.sum(d).over(upto).alias(d) for d in changes]).filter("own")
    counted = summed.join(F.broadcast(before), "part").select(F.col("pos").alias("micros"), *[(F.col(f"d{m}") + F.col(f"before_d{m}")).alias(f"n{m}") for m in spans])
    return at.join(counted, "micros").select(key, "micros", *[f"n{m}" for m in spans])


def trailing_counts(events: DataFrame, minutes: int, key: str = "event_id", ts: str = "ts") -> DataFrame:
    """(key, micros, n) of one span: see `trailing`."""
    return trailing(events, [minutes], key, ts).withColumnRenamed(f"n{minutes}", "n")


def with_per_minute(counts: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, n5, n60, per_minute_5, per_minute_60, per_hour) of rows with n5 and n60."""
    return counts.select(key, "n5", "n60", (F.col("n5") / F.lit(5.0)).alias("per_minute_5"), (F.col("n60") / F.lit(60.0)).alias("per_minute_60"), F.col("n60").alias("per_hour"))


def rates(events: DataFrame, key: str = "event_id", ts: str = "ts") -> DataFrame:
    """(key, n5, n60, per_minute_5, per_minute_60, per_hour) at each event."""
    return with_per_minute(trailing(events, [5, 60], key, ts), key)


def counters(results: DataFrame, error: Column) -> DataFrame:
    """(successes, errors): every result that is no error is a success."""
    return results.agg(F.count_if(~error).alias("successes"), F.count_if(error).alias("errors"))


def with_eta(rows: DataFrame, queue: str = "queue", rate: str = "per_minute") -> DataFrame:
    return rows.withColumn("eta_seconds", eta_seconds(F.col(queue), F.col(rate))).withColumn("eta", eta_text(F.col("eta_seconds")))


def gauges(open_requests: DataFrame, results: DataFrame, error: Column, now: Column, ts: str = "ts") -> DataFrame:
    """(queue, successes, errors, per_minute_5) at one instant."""
    recent = results.filter((F.col(ts) > now - F.expr("INTERVAL 5 MINUTES")) & (F.col(ts) <= now)).agg((F.count(F.lit(1)) / F.lit(5.0)).alias("per_minute_5"))
    return open_requests.agg(F.count(F.lit(1)).alias("queue")).crossJoin(counters(results, error)).crossJoin(recent)  # one row each
