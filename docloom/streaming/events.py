"""Streams of events: duplicates, windows, sessions and their revisions, with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The state store that keeps much state on disk; to be set as spark.sql.streaming.stateStore.providerClass.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, path: str, schema, ts: str = "ts") -> DataFrame:
    """Parquet files of a folder (or matching a pattern) as a stream. Event times are of the session's time zone."""
    return spark.readStream.schema(schema).parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def distinct_events(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Each key once; keys are remembered for as long as the watermark says."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, ts: str, by: list[str], size: str, value: str, late: str = "1 hour") -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.window(ts, size), *by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions that end when nothing comes for the gap."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n_events"))
    return out.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Takes what there is, appends results to the folder, and ends. Windows that the watermark has not passed stay in the checkpoint for the next run."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def rebuild_sessions(stream: DataFrame, session: str, checkpoint: str, rebuild) -> None:
    """For each batch, calls rebuild(sessions, epoch) with the distinct sessions that got events, late ones included."""
    call = lambda batch, epoch: rebuild(batch.select(session).distinct(), epoch)
    stream.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _revise(by: str, gap: int):
    """State of a key: its open sessions (first, last, n) as integers, and a count of revisions. It comes and goes with the key's events, in the same
    batches: no call is made for a session. One timer, for the first gap that the watermark passes."""

    def kept(state: GroupState, held: np.ndarray, revision: int) -> None:
        state.update((held.tobytes(), revision))
        state.setTimeoutTimestamp(max((int(held[:, 1].min()) + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    def run(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, revision = (np.frombuffer(state.get[0], np.int64).reshape(-1, 3), state.get[1]) if state.exists else (np.zeros((0, 3), np.int64), 0)
        if state.hasTimedOut:
            open_ = before[before[:, 1] + gap > state.getCurrentWatermarkMs() * 1000]
            # a session with an earlier revision's start cannot come again: its events would be dropped as late
            if len(open_):
                kept(state, open_, revision)
            else:
                state.remove()
            return
        now = before
        for pdf in rows:
            at, n = np.unique(pdf["us"].to_numpy(np.int64), return_counts=True)
            first, last, n = np.concatenate((now, np.stack((at, at, n), axis=1))).T
            order = np.argsort(first, kind="stable")
            first, last, n = first[order], np.maximum.accumulate(last[order]), n[order]
            starts = np.flatnonzero(np.concatenate(([True], first[1:] >= last[:-1] + gap)))
            now = np.stack((first[starts], np.append(last[starts[1:] - 1], last[-1]), np.add.reduceat(n, starts)), axis=1)
        kept(state, now, revision + 1)
        held = {tuple(x) for x in before.tolist()}
        out = [x for x in map(tuple, now.tolist()) if x not in held]
        still = set(now[:, 0].tolist())
        out += [(first, first, 0) for first in before[:, 0].tolist() if first not in still]
        if out:
            first, last, n = zip(*sorted(out), strict=True)
            yield pd.DataFrame({by: pd.Series([None if pd.isna(key[0]) else key[0]] * len(out), dtype=object), "first_us": first, "last_us": last, "n_events": n, "revision": revision + 1})

    return run


def revised_sessions(events: DataFrame, ts: str, by: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions as they grow: (by, start, last, n_events, revision) for each session that a batch changed. A late event, up to `late` behind the
    newest, extends a session or joins two: the joined one comes with a higher revision, and the one that it took in with n_events = 0.
    :func:`latest_sessions` keeps what holds. State is that of sessions whose gap the watermark has not passed; the events of a batch are taken in
    as they stream by, so a key with many is never held whole. Events without a time are left out. :data:`STATE_STORE` keeps the state of many keys out of memory."""
    kind = events.schema[by].dataType.simpleString()
    gap_us = events.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {gap})").head()[0]
    asked = events.where(F.col(ts).isNotNull()).select(F.col(by).alias("k"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("us")).withWatermark("ts", late)
    schema = f"`{by}` {kind}, first_us bigint, last_us bigint, n_events bigint, revision bigint"
    found = asked.groupBy("k").applyInPandasWithState(_revise(by, gap_us), schema, "open binary, revision bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(by, F.timestamp_micros("first_us").alias("start"), F.timestamp_micros("last_us").alias("last"), "n_events", "revision")


def latest_sessions(revisions: DataFrame, by: str) -> DataFrame:
    """(by, start, last, n_events): of each session the last revision; those that were taken in by others are gone."""
    newest = revisions.groupBy(by, "start").agg(F.max_by(F.struct("last", "n_events"), "revision").alias("x"))
    return newest.select(by, "start", "x.*").where("n_events > 0")
