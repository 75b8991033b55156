"""Stateful streams: requests with their retries as keyed state, completion as a join of two streams, counters counted once,
exact trailing counts as state of time slices."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ListState

from curata.operators.classify import ATTEMPTS, SYSTEM_PROMPT, TEXT_PROMPT
from curata.operators.throughput import MINUTE, counters
from curata.sources.connectors import ERROR, OK, RETRY, Connector

#: The state store that keyed state with timers needs.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
RESULT = "request_id string, session_id string, image_path string, state string, attempts int, raw string"
ASKED = ["request_id", "session_id", "kind", "image_path", "prompt"]


def valid_answer(raw: str | None) -> bool:
    """Whether an answer, code fences cut, is one JSON object that names a tag at least and none that is null."""
    try:
        answer = json.loads(re.sub(r"```(?:json)?\s*", "", raw or "").strip())
    except ValueError:
        return False
    tags = answer.get("detectedTags") if isinstance(answer, dict) else None
    return isinstance(tags, list) and bool(tags) and all(t is not None for t in tags)


def _stored(state: ListState) -> list:
    return [v for row in state.get() for v in json.loads(row[0])]


class Retries(StatefulProcessor):
    """The requests of one bucket a key: their attempts are state, and timers make the next ones.

    A request that comes again while it is open, or within keep_ms after its end, is the same request. State has a row for
    each batch of a bucket, with its requests as JSON, as each row costs far more than its length.
    """

    def __init__(self, connector: Connector, attempts: int, backoff_ms: int, keep_ms: int):
        self.connector, self.attempts, self.backoff_ms, self.keep_ms = connector, attempts, backoff_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "requests string")
        self.ended = handle.getListState("ended", "names string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = {}
        for pdf in rows:
            for request in zip(*(pdf[c].tolist() for c in ASKED), strict=True):
                request = tuple(None if pd.isna(v) else v for v in request)
                came.setdefault(request[0], request)
        for name, *_ in _stored(self.open):
            came.pop(name, None)
        for name in _stored(self.ended):
            came.pop(name, None)
        yield from self._attempt([(*request, 0) for request in came.values()], timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        waiting = _stored(self.open)
        due, later = [r[:-1] for r in waiting if r[-1] <= now], [r for r in waiting if r[-1] > now]
        if due:
            self.open.put([(json.dumps(later),)]) if later else self.open.clear()
            yield from self._attempt(due, now)

    def _attempt(self, requests: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        ends, again = [], []
        for name, session, kind, path, prompt, attempt in requests:
            state, raw = self._called(session, kind, path, prompt, attempt)
            if state is None:
                again.append((name, session, kind, path, prompt, attempt + 1, now + (self.backoff_ms << attempt)))
            else:
                ends.append((name, session, path, state, attempt + 1, raw))
        if again:
            self.open.appendValue((json.dumps(again),))
            for due in {r[-1] for r in again}:
                self.handle.registerTimer(due)
        if ends:
            self.ended.appendValue((json.dumps([end[0] for end in ends]),))
            yield pd.DataFrame(ends, columns=["request_id", "session_id", "image_path", "state", "attempts", "raw"])

    def _called(self, session: str | None, kind: str | None, path: str | None, prompt: str | None, attempt: int) -> tuple[str | None, str | None]:
        """The state in which an attempt ends its request, or null if it is to be made again, and the answer."""
        image = kind == "image"
        try:
            asked = {"session_id": session, "kind": kind, "image_path": path, "prompt": prompt, "attempt": attempt, "system_prompt": SYSTEM_PROMPT if image else TEXT_PROMPT}
            status, raw = (RETRY, None) if image and not path else self.connector.process(asked)
        except Exception:  # noqa: BLE001  a connector's own failure is a failed attempt
            status, raw = RETRY, None
        if status == ERROR:
            return "error", raw
        if status == OK and (valid_answer(raw) if image else raw is not None):
            return "classified" if image else "string", raw
        return ("exhausted" if attempt + 1 >= self.attempts else None), raw

    def close(self) -> None:
        pass


def retried(requests: DataFrame, connector: Connector, attempts: int = ATTEMPTS, backoff_ms: int = 100, keep_ms: int = 7_200_000, buckets: int = 4096) -> DataFrame:
    """A stream of the ends (RESULT) of a stream of requests: classified, string, error or exhausted, each request once.

    requests has request_id, session_id, kind, image_path and prompt. A failed attempt waits in the state store, backoff_ms
    and twice as long each time after, so nothing is written back to the source and a restart goes on where it was. The
    calls of a batch that is repeated after a crash are made again; its ends are not counted twice. Requests are dealt by
    their id to so many buckets, each of which a task reads whole: their number must stay the same over a restart.
    """
    slim = requests.select(*[F.col(c).cast("string").alias(c) for c in ASKED])
    dealt = slim.withColumn("bucket", F.pmod(F.xxhash64("request_id"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(Retries(connector, attempts, backoff_ms, keep_ms), RESULT, "Update", "ProcessingTime")


def write_batches(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", interval: str | None = "200 milliseconds") -> StreamingQuery:
    """Writes each batch to a folder of its own, so that a repeated batch replaces its rows. Keyed state gets its store."""
    spark = stream.sparkSession
    for name, value in PROVIDER.items():
        spark.conf.set(name, value)

    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{out}/none")  # the folder can be read at once

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{batch_id}")

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_batches(stream: DataFrame, out: str) -> DataFrame:
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)


def await_rows(query: StreamingQuery, stream: DataFrame, out: str, rows: int, seconds: float = 600.0) -> DataFrame:
    """The written rows once there are so many; the query is stopped. Its own failure, and so long a time without a new row, are errors.

    Rows are counted when a batch has ended, not all the time.
    """
    end, found, mark = time.monotonic() + seconds, -1, ""
    try:
        while True:
            last = query.lastProgress
            if (now := last and (last["batchId"], last["timestamp"])) != mark:
                mark, before = now, found
                found = read_batches(stream, out).count()
                if found >= rows:
                    break
                if found > before:
                    end = time.monotonic() + seconds
            if query.exception() is not None:
                raise query.exception()
            if time.monotonic() > end:
                raise TimeoutError(f"fewer than {rows} rows, and no new one in {seconds} s")
            time.sleep(0.3)
    finally:
        query.stop()
    return read_batches(stream, out)


def completed(requests: DataFrame, results: DataFrame, wait: str = "2 hours") -> DataFrame:
    """(request_id, session_id, asked_at, status, done_at): each request with its result, or with nulls once the wait is over.

    requests has request_id, session_id and asked_at, results request_id, status and done_at. A result that comes twice
    within the wait counts once; one that is later than the wait has no effect. Both sides are state for the wait only.
    """
    asked = requests.select("request_id", "session_id", "asked_at").withWatermark("asked_at", wait)
    told = results.select(F.col("request_id").alias("of"), "status", "done_at").withWatermark("done_at", wait).dropDuplicatesWithinWatermark(["of"])
    near = (F.col("request_id") == F.col("of")) & (F.col("done_at") >= F.col("asked_at")) & (F.col("done_at") <= F.col("asked_at") + F.expr(f"INTERVAL {wait}"))
    return asked.join(told, near, "left_outer").drop("of")


def counted_once(results: DataFrame, key: str, error: Column, ts: str = "ts", delay: str = "2 hours") -> DataFrame:
    """(successes, errors) so far of a stream in which results may come again, up to the delay after the first time."""
    return counters(results.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key]), error)


def _per_instant(pos: np.ndarray, own: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, row = np.unique(pos, return_inverse=True)
    out = np.zeros((2, len(at)), dtype=np.int64)
    np.add.at(out[0], row, own)
    np.add.at(out[1], row, change)
    return at, out[0], out[1]


class Slices(StatefulProcessor):
    """One slice of one span a key: its steps are state until the watermark has passed the slice, then its counts are told."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getListState("steps", "pos bigint, own bigint, change bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            step = _per_instant(*(pdf[c].to_numpy() for c in ("pos", "own", "change")))
            self.steps.appendList(list(zip(*(v.tolist() for v in step), strict=True)))
        self.handle.registerTimer((int(key[1]) + 1) * self.width // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pos, own, change = _per_instant(*np.array(list(self.steps.get()), dtype=np.int64).T)
        n, mine = change.cumsum(), own > 0
        self.steps.clear()
        if mine.any():
            yield pd.DataFrame({"minutes": np.full(mine.sum(), key[0], dtype=np.int32), "micros": pos[mine], "n": n[mine]})

    def close(self) -> None:
        pass


def trailing_stream(events: DataFrame, spans: list[int], ts: str = "ts", delay: str = "2 hours", slice_minutes: int = 5) -> DataFrame:
    """(minutes, micros, n): for each instant that has events, and each span of minutes, the events of that time up to it.

    Exact as `trailing` is, for all events that are not later than the delay; later ones have no effect. An instant's counts
    come once, when the watermark has passed its slice, of which a span has a whole number. An event goes to its slice and
    the one a span later by its time, to those between as a mere addition, so a slice needs its own state only. That is one
    row an instant and batch, and goes when the slice is told: shorter slices make tasks smaller and rows more.
    """
    if any(m % slice_minutes for m in spans):
        raise ValueError(f"{slice_minutes} minutes don't divide each span of {spans}")
    width = slice_minutes * MINUTE
    home = F.floor(F.col("micros") / width)

    def steps(m: int) -> Column:
        def row(at: Column, pos: Column, own: int, change: int) -> Column:
            return F.struct(F.lit(m).alias("minutes"), at.alias("home"), pos.alias("pos"), F.lit(own).alias("own"), F.lit(change).alias("change"))

        beyond = home + m // slice_minutes
        whole = F.transform(F.sequence(home + 1, beyond), lambda at: row(at, at * width, 0, 1))
        return F.concat(F.array(row(home, F.col("micros"), 1, 1), row(beyond, F.col("micros") + m * MINUTE, 0, -1)), whole)

    timed = events.select(F.col(ts).cast("timestamp").alias("ts")).filter("ts is not null").withWatermark("ts", delay).withColumn("micros", F.unix_micros("ts"))
    dealt = timed.select("ts", F.explode(F.concat(*[steps(m) for m in spans])).alias("s")).select("ts", "s.*")
    return dealt.groupBy("minutes", "home").transformWithStateInPandas(Slices(width), "minutes int, micros bigint, n bigint", "Append", "EventTime")
