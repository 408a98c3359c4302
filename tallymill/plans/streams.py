"""What streams hold once all events have come in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.plans.base import query
from tallymill.sources.files import new_path
from tallymill.sources.relations import read
from tallymill.streaming import status_machine
from tallymill.streaming.counters import counts, event_stream


@query("k1_event_counters", "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, coalesce(event_type, 'unknown') AS event_type, count(*) AS n FROM events GROUP BY 1, 2")
def k1(spark, sf_dir):
    return counts(read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")).select("start", "event_type", "n")


def job_events(spark, sf_dir):
    """Events of the table as wishes for a job's next state: (job, event_id, at, wanted)."""
    wanted = F.element_at(F.array(*map(F.lit, ["pending", "processing", "extracted", "verified", "failed"])), (F.hash("event_type", "event_id") % 5 + 5).cast("int") % 5 + 1)
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("job"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("at"), wanted.alias("wanted"))


@query("k2_status_machine")
def k2(spark, sf_dir):
    """The history of all jobs, from a stream over files of events, each of which has a tenth of the one before once more."""
    events, path = job_events(spark, sf_dir), new_path(spark, "job-events")
    for part in range(3):
        events.where((F.col("event_id") % 3 == part) | ((F.col("event_id") % 3 == part - 1) & (F.col("event_id") % 10 == 0))).write.mode("append").parquet(path)
    target = new_path(spark, "history")
    status_machine.maintain(event_stream(spark, path, events.schema, 1000), target, new_path(spark, "progress"))
    return spark.read.schema(status_machine.HISTORY).parquet(target)
