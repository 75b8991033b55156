"""Streams of results: sliding throughput, running counters and ordered consumers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curata.operators.throughput import with_eta
from curata.plans.scratch import Scratch

#: How long results may still matter: state older than this is dropped.
RETENTION = "2 hours"


def read_results(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream; each new file is queued work."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sliding_counts(events: DataFrame, ts: str = "ts", length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """(window_start, n) of a stream or table, with a watermark that bounds its state."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, RETENTION)
    return timed.groupBy(F.window(ts, length, slide)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "n")


def run_to_table(stream: DataFrame, work: Scratch, keys: list[str]) -> DataFrame:
    """Everything that is there now, through the streaming engine in update mode, as a written table with the last row of each key.

    Unlike complete mode, update mode lets the watermark evict state, and nothing is held on the driver. Each batch writes
    a folder of its own, so a repeated batch replaces its rows.
    """
    out = f"{work.root}/updates"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/{batch_id}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{work.root}/mark").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, batch_id bigint").option("recursiveFileLookup", True).parquet(out)
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, "v.*")


def with_rates(counts: DataFrame, queue: int, minutes: int) -> DataFrame:
    """Sliding counts of windows of so many minutes with their rate per minute and the time that a queue of open requests needs."""
    return with_eta(counts.withColumn("queue", F.lit(queue)).withColumn("per_minute", F.col("n") / F.lit(float(minutes))))


class Consumer(Protocol):
    """priority: smaller ones go first. consume returns the rows that it leaves to the others."""

    priority: int

    def consume(self, batch: DataFrame, batch_id: int) -> DataFrame: ...


@dataclass
class Handler:
    """A consumer made of a predicate's column and a function of the rows that it takes."""

    takes: Callable[[DataFrame], object]
    act: Callable[[DataFrame, int], None]
    priority: int = 100_000

    def consume(self, batch: DataFrame, batch_id: int) -> DataFrame:
        mine = F.coalesce(self.takes(batch), F.lit(False))
        self.act(batch.filter(mine), batch_id)
        return batch.filter(~mine)


@dataclass
class Chain:
    """Consumers in the order of their priority. The first that takes a row ends its way; one that fails is noted and skipped."""

    consumers: list[Consumer]
    failures: list[str] = field(default_factory=list)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            left = batch
            for c in sorted(self.consumers, key=lambda c: c.priority):
                try:
                    left = c.consume(left, batch_id)
                except Exception as e:  # noqa: BLE001  one consumer's failure must not stop the others
                    self.failures.append(f"{type(c).__name__}: {e}")
        finally:
            batch.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, interval: str | None = "1 second") -> StreamingQuery:
        """Runs until stopped, or with interval None over what is there now."""
        trigger = {"processingTime": interval} if interval else {"availableNow": True}
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**trigger).start()
