"""Structured Streaming over landed trace lines.

Lines arrive as text files of JSON. State is bounded by the number of kernels and sessions;
where a watermark is given, it is on the time of ingestion, as the events' own times are opaque.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tracequarry.functions.text import is_benchmark, session_id
from tracequarry.functions.values import field, stack_of, text_or_null


def lines(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path).select(F.col("value").alias("raw"), F.current_timestamp().alias("seen"))


def parsed(stream: DataFrame) -> DataFrame:
    v = F.col("v")
    out = stream.withColumn("v", F.try_parse_json("raw")).where("v is not null").withColumn("event_type", field(v, "event_type"))
    hash_ = F.when(F.col("event_type") == "compilation", field(v, "payload.metadata.hash")).otherwise(field(v, "compilation_metadata.hash"))
    name = F.coalesce(text_or_null(field(v, "compilation_metadata.name")), text_or_null(field(v, "payload.metadata.name")), text_or_null(field(v, "name")), F.lit("unknown"))
    stack = stack_of(v)
    return out.withColumn("hash", hash_).withColumn("name", name).withColumn("session_id", session_id(stack)).withColumn("is_benchmark", is_benchmark(stack))


def first_compilations(stream: DataFrame, late: str | None = None) -> DataFrame:
    """Each hash's compilation once."""
    own = parsed(stream).where("event_type = 'compilation' and hash is not null").select("hash", "name", "raw", "seen")
    return own.withWatermark("seen", late).dropDuplicatesWithinWatermark(["hash"]) if late else own.dropDuplicates(["hash"])


def launch_counts(stream: DataFrame) -> DataFrame:
    """Launches per kernel so far (update or complete mode)."""
    return parsed(stream).where("event_type = 'launch'").groupBy("name").agg(F.count("*").alias("launches"))


def windowed_counts(stream: DataFrame, width: str, late: str) -> DataFrame:
    """Launches per kernel and window of ingestion time."""
    own = parsed(stream).where("event_type = 'launch'").withWatermark("seen", late)
    return own.groupBy(F.window("seen", width), "name").agg(F.count("*").alias("launches"))


def launch_types(stream: DataFrame) -> DataFrame:
    """``benchmark``, ``winner`` or ``cached_winner`` for each launch of a session: one flag of
    state says whether the session has had a benchmark."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        had = state.get[0] if state.exists else False
        for batch in batches:
            kinds = []
            for bench in batch["is_benchmark"]:
                kinds.append("benchmark" if bench else "winner" if had else "cached_winner")
                had = had or bool(bench)
            yield pd.DataFrame({"session_id": key[0], "hash": batch["hash"], "launch_type": kinds})
        state.update((had,))

    own = parsed(stream).where("event_type = 'launch' and session_id is not null").select("session_id", "hash", "is_benchmark")
    return own.groupBy("session_id").applyInPandasWithState(step, "session_id string, hash string, launch_type string", "had boolean", "append", GroupStateTimeout.NoTimeout)


def run_gate(stream: DataFrame, skip: int, most: int) -> DataFrame:
    """Launches that a per-hash gate lets through: after the first ``skip``, ``most`` of them;
    benchmarks neither pass nor count."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for batch in batches:
            runs = batch[~batch["is_benchmark"]]
            place = range(n, n + len(runs))
            n += len(runs)
            yield pd.DataFrame({"hash": key[0], "run": [p for p in place if skip <= p < skip + most]})
        state.update((n,))

    own = parsed(stream).where("event_type = 'launch' and hash is not null").select("hash", "is_benchmark")
    return own.groupBy("hash").applyInPandasWithState(step, "hash string, run long", "n long", "append", GroupStateTimeout.NoTimeout)


class _PhaseGate(StatefulProcessor):
    """Steps that came before their turn wait by number; a timer lets a key go on without steps
    that don't come."""

    def __init__(self, first: int, patience_ms: int | None):
        self.first, self.patience_ms = first, patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, inside boolean, timer long")
        self.waiting = handle.getMapState("waiting", "step long", "inside boolean")

    def _edges(self, key: tuple, following: int, had: bool) -> Iterator[pd.DataFrame]:
        steps, edges = [], []
        while self.waiting.containsKey((following,)):
            (now,) = self.waiting.getValue((following,))
            self.waiting.removeKey((following,))
            if now != had:
                steps.append(following)
                edges.append("enable" if now else "disable")
            following, had = following + 1, now
        timer = self.at.get()[2] if self.at.exists() else None
        gap = any(True for _ in self.waiting.keys())
        if timer is not None and (steps or not gap):
            self.handle.deleteTimer(timer)
            timer = None
        if gap and timer is None and self.patience_ms is not None:
            timer = self.now + self.patience_ms
            self.handle.registerTimer(timer)
        self.at.update((following, had, timer))
        if steps:
            yield pd.DataFrame({"key": key[0], "step": steps, "edge": edges})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.now = timerValues.getCurrentProcessingTimeInMs() if self.patience_ms is not None else 0
        following, had = self.at.get()[:2] if self.at.exists() else (self.first, False)
        for batch in rows:
            for step, inside in zip(batch["step"], batch["inside"], strict=True):
                if step >= following and not self.waiting.containsKey((int(step),)):  # a step that comes again counts once
                    self.waiting.updateValue((int(step),), (bool(inside),))
        yield from self._edges(key, following, had)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.now = timerValues.getCurrentProcessingTimeInMs()
        following, had, _ = self.at.get()
        self.at.update((following, had, None))
        least = min((k[0] for k in self.waiting.keys()), default=following)
        yield from self._edges(key, least, had)

    def close(self) -> None:
        pass


def phase_edges(steps: DataFrame, first: int = 0, patience_ms: int | None = None) -> DataFrame:
    """``key``, ``step`` and ``edge`` (``enable``, ``disable``) where recording begins and ends, of a
    stream of ``key``, ``step`` and ``inside``; ``ordering.phase_edges`` on the same rows. Steps of a
    key count up from ``first`` and may come in any order: state holds those ahead of a gap. With
    ``patience_ms`` of processing time a gap is given up, and steps that come later are left out;
    without it a key waits; timers run batches on, so such a query doesn't end by itself under
    ``availableNow``. Needs the RocksDB state store."""
    mode = "none" if patience_ms is None else "processingTime"
    own = steps.select("key", F.col("step").cast("long").alias("step"), F.coalesce("inside", F.lit(False)).alias("inside"))
    return own.groupBy("key").transformWithStateInPandas(_PhaseGate(first, patience_ms), "key string, step long, edge string", "append", mode)


def keep_merged(stream: DataFrame, path: str, checkpoint: str):
    """Append each batch's lines to a bronze Parquet table; a batch that runs twice is written
    once, as its folder is its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
