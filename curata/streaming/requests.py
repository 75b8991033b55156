"""A request queue as a stream with bounded retries.

Requests are files in a folder. Each micro-batch calls the connector once for every request in it; what has no result yet
goes back to the folder's end with its attempt counted, so a crash loses nothing that the checkpoint doesn't know.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curata.operators.classify import ATTEMPTS, REQUEST, parse_answer, process
from curata.sources.connectors import ERROR, OK, Connector

QUEUED = f"{REQUEST}, attempt int"


def exists(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def enqueue(requests: DataFrame, queue: str, attempt: int = 0) -> None:
    requests.withColumn("attempt", F.lit(attempt)).select([c.split()[0] for c in QUEUED.split(", ")]).write.mode("append").parquet(queue)


def start_worker(spark: SparkSession, queue: str, results: str, checkpoint: str, connector: Connector, interval: str | None = None, partitions: int | None = None) -> StreamingQuery:
    """Processes a queue folder into a results folder (Parquet: the request, attempts, status, raw).

    partitions bounds the calls at a time. With interval None it ends when the queue is drained for now; start it again for
    what was sent back meanwhile. Results are keyed by batch, so a repeated batch replaces its own files.
    """
    stream = spark.readStream.schema(QUEUED).option("maxFilesPerTrigger", 100).option("recursiveFileLookup", True).parquet(queue)
    tag = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def work(batch: DataFrame, batch_id: int) -> None:
        rows = batch.repartition(partitions) if partitions else batch
        called = process(rows, connector)
        judged = called.withColumn("ok", (F.col("status") == OK) & ((F.col("kind") != "image") | parse_answer(F.col("raw")).isNotNull()))
        state = F.when(F.col("status") == ERROR, "error").when(F.col("ok"), "classified").when(F.col("attempt") >= ATTEMPTS - 1, "exhausted").otherwise("again")
        out = f"{results}/batch={batch_id}"
        judged.withColumn("state", state).write.mode("overwrite").parquet(out)
        # a batch that is repeated after a crash must not queue its requests twice: its folder is written once
        sent = f"{queue}/again-{tag}-{batch_id}"
        if not exists(spark, f"{sent}/_SUCCESS"):
            again = spark.read.parquet(out).filter("state = 'again'")
            again.withColumn("attempt", F.col("attempt") + 1).select([c.split()[0] for c in QUEUED.split(", ")]).write.mode("overwrite").parquet(sent)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def finished(spark: SparkSession, results: str) -> DataFrame:
    """Requests that have ended: classified, error or exhausted."""
    return spark.read.parquet(results).filter("state != 'again'")
