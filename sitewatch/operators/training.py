"""Assembling training sets from session files, sweeps, hand-saved positives and frame files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000


def session_windows(records: DataFrame, open_end: DataFrame) -> DataFrame:
    """crossing_id, started, ended, closed: of each session_id the last record by `seq`. An open one reaches
    to its crossing's open_end (crossing_id, t), or is left out if that is before its start."""
    last = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    rows = records.withColumn("_r", F.row_number().over(last)).where("_r = 1")
    ends = open_end.groupBy(F.col("crossing_id").alias("_x")).agg(F.max("t").alias("_end"))
    rows = rows.join(ends, F.col("crossing_id") == F.col("_x"), "left").withColumn("closed", F.col("ended").isNotNull())
    return rows.select("session_id", "crossing_id", "started", F.coalesce("ended", "_end").alias("ended"), "closed").where("ended IS NOT NULL AND ended >= started")


def base_name(key: str) -> Column:
    return F.element_at(F.split(F.col(key), "/"), -1)


def with_files(examples: DataFrame, files: DataFrame) -> DataFrame:
    """examples (object_key, camera_id, ...) with `path`: the first file (path) of the same name that lies in a
    folder of the camera's name; examples without one go."""
    named = files.withColumn("_n", base_name("path"))
    rows = examples.join(named, (base_name("object_key") == F.col("_n")) & F.array_contains(F.split("path", "/"), F.col("camera_id")))
    first = Window.partitionBy("object_key").orderBy("path")
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_n")


def overlapping(sessions: DataFrame, seen: DataFrame) -> DataFrame:
    """session_id, seen_id, overlap_ms of sessions and human-observed ones (seen_id, crossing_id, seen_start,
    seen_end, precision_ms) that overlap when the latter are widened by their precision."""
    wide = seen.select("seen_id", F.col("crossing_id").alias("_x"), (F.col("seen_start") - F.col("precision_ms")).alias("_a"), (F.col("seen_end") + F.col("precision_ms")).alias("_b"))
    hours = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / HOUR), F.floor(F.col(b) / HOUR)))
    wide, rows = wide.withColumn("_h", hours("_a", "_b")), sessions.withColumn("_g", hours("started", "ended"))
    met = rows.join(wide, (F.col("crossing_id") == F.col("_x")) & (F.col("_g") == F.col("_h")) & (F.col("started") <= F.col("_b")) & (F.col("ended") >= F.col("_a")))
    # they share several hours, but are one pair
    return met.groupBy("session_id", "seen_id").agg(F.first(F.least("ended", "_b") - F.greatest("started", "_a")).alias("overlap_ms"))


def with_positives(manifest: DataFrame, saved: DataFrame, exam: DataFrame) -> DataFrame:
    """A manifest and the hand-saved positives (object_key, camera_id) it lacks, without what the exam holds."""
    more = saved.dropDuplicates(["object_key"]).join(manifest.select("object_key"), "object_key", "left_anti")
    more = more.select("object_key", "camera_id", F.lit("BLOCKED").alias("label"), F.lit("saved").alias("source"), F.lit("train").alias("split"))
    return manifest.select(*more.columns).unionByName(more).join(exam.select("object_key"), "object_key", "left_anti")


def concatenated(*scans: DataFrame) -> DataFrame:
    """Scans of several cameras as one, for a rebuild."""
    out = scans[0]
    for more in scans[1:]:
        out = out.unionByName(more)
    return out
