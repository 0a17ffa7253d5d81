"""Streams of events: an append-only trace, windows of requests, and a token budget per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gradeloom.operators import budget
from gradeloom.session import prepare

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Events of a folder or pattern of parquet files as a stream; times are zoned, as watermarks need them."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def trace_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n_events, sum_value: closed windows of a trace; rows later than `late` are dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("sum_value"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n_events", "sum_value")


class TokenWindow(StatefulProcessor):
    """Requests of a key against its token window, in order of time within a batch; state is one row a key, in the state store."""

    def __init__(self, limit: int, window_ms: int) -> None:
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "remaining bigint, opened bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        remaining, opened = self.window.get() if self.window.exists() else (self.limit, -1)
        out = []
        for event, now, value in in_order(rows, ["event_id", "ms", "value"]):
            if opened < 0 or now >= opened + self.window_ms:
                remaining, opened = self.limit, now
            cost = max(1, int(value) if value == value and value is not None else 0)
            granted = cost <= remaining
            remaining -= cost if granted else 0
            out.append((key[0], event, cost, granted, remaining))
        self.window.update((remaining, opened))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "cost", "granted", "remaining"])

    def close(self) -> None:
        """Nothing to give back."""


class KeyStates(StatefulProcessor):
    """What is known of each key after every event, by budget.after: the state of a key is its fields, in the state store."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.key_state = handle.getValueState("key", KEY_FIELDS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = budget.KeyState(*self.key_state.get()) if self.key_state.exists() else budget.KeyState()
        out = []
        for event, now, kind, cost, status in in_order(rows, ["event_id", "ms", "kind", "cost", "status"]):
            state = budget.after(state, budget.KeyEvent(kind, int(now), int(cost), int(status)))
            out.append((key[0], event, budget.room(state), state.reserved, state.in_flight, state.dead))
        self.key_state.update(tuple(state))
        yield pd.DataFrame(out, columns=["key_id", "event_id", "available", "reserved", "in_flight", "dead"])

    def close(self) -> None:
        """Nothing to give back."""


KEY_FIELDS = "token_limit bigint, remaining bigint, reset_at bigint, reserved bigint, in_flight bigint, calls bigint, refusals bigint, dead boolean"


def in_order(frames: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """The rows of a key in a batch by time, then event: the columns asked for, no more."""
    rows = [row for frame in frames for row in frame[["ms", "event_id", *columns]].itertuples(index=False, name=None)]
    return [row[2:] for row in sorted(rows, key=lambda row: row[:2])]


def _by_key(events: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    spark = prepare(events.sparkSession)
    # State of this kind lives in the embedded key-value store, not on the heap.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = events.withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


def budget_stream(events: DataFrame, limit: int = 8000, window_ms: int = 60_000) -> DataFrame:
    """user_id, event_id, cost, granted, remaining: each request against its key's token window, in order of time.

    The cost of a request is its value, at least 1. A key's window opens with
    its first request and refills when it is over. State is carried over
    batches and restarts.
    """
    return _by_key(events, "user_id", TokenWindow(limit, window_ms), "user_id bigint, event_id bigint, cost bigint, granted boolean, remaining bigint")


def key_state_stream(events: DataFrame) -> DataFrame:
    """key_id, event_id, available, reserved, in_flight, dead: what a key has after each of its events.

    events: key_id, event_id, ts, kind (reserve, reply or look), cost, status.
    """
    return _by_key(events, "key_id", KeyStates(), "key_id bigint, event_id bigint, available bigint, reserved bigint, in_flight bigint, dead boolean")


def run_to_files(stream: DataFrame, path: str) -> DataFrame:
    """The rows of a stream over all input there is now, kept as parquet files under path, and read back."""
    query = write_progress(stream, f"{path}/rows", f"{path}/progress", once=True)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def write_progress(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """A running query that appends a stream to parquet files; progress and state live in the checkpoint folder. once: it ends when it has read what there is."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
