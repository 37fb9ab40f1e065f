"""Streaming hosts of the session and alert rules.

Event time is the timestamp column `at`; rows later than the watermark are kept apart (session_events) and left
to the batch rebuild, which owns history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import session_id
from ..operators.sessions import AlertPolicy, SessionPolicy
from ..sources.files import OBSERVATION, Record, decode, iso
from . import stateful

LATENESS = "2 minutes"


def timed(readings: DataFrame, beats: DataFrame | None = None) -> DataFrame:
    """readings with `at`, the event time that watermarks need. beats (t) tell the time and nothing else: their
    rows, null but for t and at, move the watermark while no reading comes, and no rule hears them. A beat
    must not run ahead of what may still be read, so it is to carry the time up to which its log is complete."""
    if beats is not None:
        readings = readings.unionByName(beats.select("t"), allowMissingColumns=True)
    return readings.withColumn("at", F.timestamp_millis("t")).withWatermark("at", LATENESS)


def heard(timed: DataFrame, rule: str) -> DataFrame:
    """The rows of timed() that a rule holds for. The condition names the event time, or Spark would apply it
    before the watermark, which would then not see the beats."""
    return timed.where(F.when(F.col("at").isNotNull(), F.expr(rule)))


def session_events(readings: DataFrame, policy: SessionPolicy = SessionPolicy(), beats: DataFrame | None = None) -> DataFrame:
    """A row whenever a session is opened, grows or is closed, and one for each BLOCKED reading that came too
    late by the query's own watermark (kind late): every such reading is in a session or among these.

    A reading past the gap closes the old session and opens the next; silence closes it once the
    watermark is a gap and a millisecond past its last reading. A reading out of order widens an open session
    at its end only. The counts are observed as `session_events` (see StreamingQueryListener)."""
    rows = heard(timed(readings, beats), "state = 'BLOCKED'").select("crossing_id", "t", "event_id", "confidence", "version")
    found = stateful.run(rows, stateful.Sessions(policy), stateful.SESSION_ROWS)
    return found.observe("session_events", F.count_if(F.col("kind").isin("open", "grown")).alias("heard"), F.count_if(F.col("kind") == "late").alias("late"), F.count_if(F.col("kind") == "closed").alias("closed"))


def as_sessions(events: DataFrame) -> DataFrame:
    """The emissions among session_events(), under the session's id."""
    rows = events.where("kind <> 'late'").select("crossing_id", "started", "ended", "readings", "peak", "version", (F.col("kind") != "closed").alias("is_open"))
    return rows.withColumns({"session_id": session_id("crossing_id", "started"), "seconds": F.floor((F.col("ended") - F.col("started")) / 1000)})


def quarantine(events: DataFrame) -> DataFrame:
    """The readings among session_events() that came too late: crossing_id, t, event_id, confidence, version."""
    return events.where("kind = 'late'").select("crossing_id", "t", "event_id", F.col("peak").alias("confidence"), "version")


def growing_sessions(readings: DataFrame, policy: SessionPolicy = SessionPolicy(), beats: DataFrame | None = None) -> DataFrame:
    """A row whenever a session opens or grows (is_open) and one when it closes, under the same id."""
    return as_sessions(session_events(readings, policy, beats))


def kept_apart(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes session_events() below `path` in folders by kind: one query, one watermark, each row once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("kind").trigger(availableNow=True).start()


def closed_sessions(readings: DataFrame, gap: str = "15 minutes", beats: DataFrame | None = None) -> DataFrame:
    """Sessions once they can grow no more, by Spark's own session windows; the gap is inclusive."""
    blocked = heard(timed(readings, beats), "state = 'BLOCKED'")
    return blocked.groupBy("crossing_id", F.session_window("at", gap)).agg(F.min("t").alias("started"), F.max("t").alias("ended"), F.count("*").alias("readings"), F.max("confidence").alias("peak")).select("crossing_id", "started", "ended", "readings", "peak")


def live_alerts(readings: DataFrame, policy: AlertPolicy = AlertPolicy(), beats: DataFrame | None = None) -> DataFrame:
    """One alert per blockage as it is confirmed: the machine of operators.sessions.rising_edges, its state
    kept for each crossing until a silence has reset it."""
    rows = heard(timed(readings, beats), "state <> 'UNKNOWN'").select("crossing_id", "t", "event_id", "camera_id", "state", "confidence")
    return stateful.run(rows, stateful.Alerts(policy), stateful.ALERT_ROWS).where("kind = 'alert'").select("crossing_id", "t", "camera_id", "confidence")


def stream_lines(spark: SparkSession, path: str, glob: str = "*.jsonl*") -> DataFrame:
    """A stream of the lines of files below `path`, from the earliest on."""
    return spark.readStream.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path).where(F.length(F.trim("value")) > 0)


def topic(spark: SparkSession, servers: str, name: str) -> DataFrame:
    """The same of a topic of a message log; null values (tombstones) are left out."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", name).option("startingOffsets", "earliest").load()
    return rows.select(F.col("key").cast("string"), F.col("value").cast("string")).where("value IS NOT NULL")


def keyed_lines(lines: DataFrame, kind: Record, key: str) -> DataFrame:
    """key, value of the lines that are records of a kind: the line itself, to the byte."""
    return decode(lines, kind).where("problem IS NULL").select(F.col(f"record.{key}").alias("key"), "value")


def alert_payloads(alerts: DataFrame) -> DataFrame:
    """key, value of alerts (crossing_id, t, confidence, reason), to be sent."""
    return alerts.select(F.col("crossing_id").alias("key"), F.to_json(F.struct("crossing_id", iso("t").alias("started_at"), "confidence", "reason")).alias("value"))


def observation_payloads(observations: DataFrame) -> DataFrame:
    """key, value of observations, by their crossing: the fields of files.OBSERVATION that they have, as JSON."""
    names = [f.name for f in OBSERVATION.schema if f.name in observations.columns]
    return observations.select(F.col("crossing_id").alias("key"), F.to_json(F.struct(*names)).alias("value"))


def to_topic(rows: DataFrame, servers: str, name: str, checkpoint: str, format: str = "kafka") -> StreamingQuery:
    """Sends a stream's key and value to a topic, at least once. Another format gets the same rows and options."""
    sent = rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    return sent.writeStream.format(format).option("kafka.bootstrap.servers", servers).option("topic", name).option("path", name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def record_sink(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream's rows below `path` until what is there has been read; each once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
