"""A machine of job states over a stream of events that may come late and more than once: an extension of the status updates.

Events of a job wait until the watermark has passed them and are then applied in the order of their time and number, so the history is that of the sorted
events. A repeat of a waiting event takes its place; a repeat of an applied one is older than the watermark and dropped by Spark. A job that is
in process and hears nothing for LEASE fails by a timer. What a job keeps is its state and the events of the time that the watermark lags.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState

#: What may follow what; a job without events is new. Fixed values.
ALLOWED = {"new": ("pending",), "pending": ("processing", "failed"), "processing": ("extracted", "failed"), "extracted": ("verified",), "failed": ("pending",), "verified": ()}
LATENESS, LEASE = "2 hours", 6 * 3600
HISTORY = "job long, event_id long, at timestamp, before string, after string, applied boolean"
#: What is kept of a job, which comes with its rows and goes back with its history: calls to the JVM for each event or job would take far longer than the work.
KEPT = "status string, since double, event_id array<long>, at array<double>, wanted array<string>"

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def follow(status: str, since: float, events: list[tuple[float, int, str]], until: float | None) -> tuple[str, float, list[tuple]]:
    """The state after events (seconds, number, wanted state) in order, when it was reached, and the history: (number, seconds, before, after, applied). until: up to when leases are known to have run out; None for ever."""
    out = []

    def expire(now: float | None) -> None:
        nonlocal status, since
        if status == "processing" and (now is None or since + LEASE <= now):
            out.append((None, since + LEASE, status, "failed", True))
            status, since = "failed", since + LEASE

    for at, number, wanted in events:
        expire(at)
        good = wanted in ALLOWED[status]
        out.append((number, at, status, wanted, good))
        if good:
            status, since = wanted, at
    expire(until)
    return status, since, out


def advance(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Takes in the new events of a job and applies at once all that is due. Kept are (status, since) and the waiting events, in the order they came; the job is called on again when the earliest of them, or its lease, is due."""
    until = state.getCurrentWatermarkMs()
    status, since, *waiting = state.get if state.exists else ("new", 0.0, [], [], [])
    # a repeat takes the place of the event that waits
    events = {number: (at, number, wanted) for number, at, wanted in zip(*waiting, strict=True)}
    for part in () if state.hasTimedOut else rows:
        for number, at, wanted in zip(part["event_id"].tolist(), part["at"].tolist(), part["wanted"].tolist(), strict=True):
            events[number] = (at.timestamp(), number, wanted)
    status, since, history = follow(status, since, sorted(e for e in events.values() if e[0] <= until / 1000), until / 1000)
    later = [e for e in events.values() if e[0] > until / 1000]
    state.update((status, since, [e[1] for e in later], [e[0] for e in later], [e[2] for e in later]))
    due = [e[0] for e in later] + ([since + LEASE] if status == "processing" else [])
    if due:
        state.setTimeoutTimestamp(max(int(min(due) * 1000), until + 1))
    if history:
        made = [(key[0], number, pd.Timestamp(round(at * 1e6), unit="us"), before, after, good) for number, at, before, after, good in history]
        yield pd.DataFrame(made, columns=["job", "event_id", "at", "before", "after", "applied"]).astype({"event_id": "Int64"})


def histories(events: DataFrame) -> DataFrame:
    """HISTORY of a stream of events (job, event_id, at, wanted)."""
    known = events.where(F.col("job").isNotNull() & F.col("event_id").isNotNull() & F.col("at").isNotNull() & F.col("wanted").isNotNull())
    return known.withWatermark("at", LATENESS).groupBy("job").applyInPandasWithState(advance, HISTORY, KEPT, "append", "EventTimeTimeout")


@contextmanager
def _timers(spark: SparkSession) -> Iterator[None]:
    """State that is kept on disk instead of in memory; the session has its own again afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def maintain(events: DataFrame, target: str, checkpoint: str) -> None:
    """Takes in the files that there are now and appends what is settled to the history at the target; runs again from where it stopped."""
    with _timers(events.sparkSession):
        histories(events).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
