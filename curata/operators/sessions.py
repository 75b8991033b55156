"""Sessions: their state, categories, requests and results as tables, and an append-only prompt log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# States of a session.
STATES = ("IDLE", "DISCOVERING", "CLASSIFYING", "COMPLETED", "FAILED")
SESSION = "session_id string, work_directory string, output_directory string, seq bigint, state string"


class SessionStore:
    """Append-only Parquet tables in a folder of any store. The newest state of a session counts; unknown ids raise KeyError."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").partitionBy("session_id").parquet(f"{self.root}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def create(self, session_id: str, work_directory: str, output_directory: str | None, base: DataFrame, compound: DataFrame) -> None:
        self._append("state", self.spark.createDataFrame([(session_id, work_directory, output_directory, 0, "DISCOVERING")], SESSION))
        self._append("base", base.select(F.lit(session_id).alias("session_id"), "pos", "name", "priority", "description"))
        self._append("compound", compound.select(F.lit(session_id).alias("session_id"), "name", "members", "description"))

    def session(self, session_id: str) -> dict:
        found = self._read("state", SESSION).filter(F.col("session_id") == session_id).orderBy(F.desc("seq")).first()
        if found is None:
            raise KeyError(session_id)
        return found.asDict()

    def set_state(self, session_id: str, state: str) -> None:
        if state not in STATES:
            raise ValueError(state)
        now = self.session(session_id)
        self._append("state", self.spark.createDataFrame([(session_id, now["work_directory"], now["output_directory"], now["seq"] + 1, state)], SESSION))

    def categories(self, session_id: str) -> tuple[DataFrame, DataFrame]:
        self.session(session_id)
        mine = F.col("session_id") == session_id
        return self._read("base", "session_id string, pos int, name string, priority int, description string").filter(mine), self._read("compound", "session_id string, name string, members array<string>, description string").filter(mine)

    def add_requests(self, session_id: str, requests: DataFrame) -> None:
        self.session(session_id)
        self._append("requests", requests.select(F.lit(session_id).alias("session_id"), "image_path", "prompt_type"))

    def add_results(self, session_id: str, results: DataFrame) -> None:
        self.session(session_id)
        self._append("results", results.select(F.lit(session_id).alias("session_id"), "image_path", "status", "attempts", "raw"))

    def summary(self) -> DataFrame:
        requests = self._read("requests", "session_id string, image_path string, prompt_type string")
        results = self._read("results", "session_id string, image_path string, status string, attempts int, raw string")
        return session_summary(requests.select("session_id"), results.select("session_id", "status"))


def session_summary(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(session_id, requests, results, classified, errors, exhausted, state): completed when each request has a result."""
    counts = [F.count_if(F.col("status") == s).alias(n) for s, n in (("classified", "classified"), ("error", "errors"), ("exhausted", "exhausted"))]
    done = results.groupBy("session_id").agg(F.count(F.lit(1)).alias("results"), *counts)
    asked = requests.groupBy("session_id").agg(F.count(F.lit(1)).alias("requests"))
    out = asked.join(done, "session_id", "full").fillna(0, ["requests", "results", "classified", "errors", "exhausted"])
    state = F.when(F.col("requests") == 0, "IDLE").when(F.col("results") >= F.col("requests"), "COMPLETED").otherwise("CLASSIFYING")
    return out.select("session_id", "requests", "results", "classified", "errors", "exhausted", state.alias("state"))


def append_prompt_log(results: DataFrame, root: str) -> None:
    """Appends prompts and answers as JSON lines, in a folder for each session and prompt type."""
    rows = results.select("session_id", "prompt_type", "image_path", "attempts", "status", "prompt", "raw", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSS").alias("logged_at"))
    rows.write.mode("append").partitionBy("session_id", "prompt_type").json(root)
