"""Queries that run as streams over files of the given tables, or load versioned tables; and all other registries'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import history
from .registry import DAY, NEXT, ORACLE_SQL, QUERIES, SESSIONS_SQL, derived, query, roster
from .registry_more import emissions, pictured, poll_frames
from .sources import files, tables, versioned
from .sources.tables import READINGS_SQL
from .streaming import board, live

__all__ = ["ORACLE_SQL", "QUERIES"]
#: Instants at which the files of a replayed stream part, UTC.
CUTS = (DAY, 1_706_000_000_000)


def replayed(rows: DataFrame, part: str, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """A stream of rows from files, one micro-batch for each part: `part` is SQL for its number, from 0 on."""
    spark, path = rows.sparkSession, files.scratch(rows.sparkSession, "replay")
    for i in range(len(cuts) + 1):  # one after another, for a stream takes files by age
        rows.where(F.expr(part) == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def part_of(time: str) -> str:
    return " + ".join(f"cast({time} >= {c} AS int)" for c in CUTS)


def run_through(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives, once all there is has been read."""
    spark = stream.sparkSession
    path = files.scratch(spark, name)
    live.record_sink(stream, path, files.scratch(spark, f"{name}-checkpoint")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("streamed_sessions", f"WITH {SESSIONS_SQL} SELECT session_id, crossing_id, started, ended, seconds, readings, round(peak, 6) AS peak FROM sessions")
def _(spark, sf_dir):
    """Sessions as the stream closes them; a last file, two days on, closes those that are open."""
    rows = tables.readings(spark, sf_dir)
    end = rows.agg((F.max("t") + 172_800_000).alias("t")).where("t IS NOT NULL")
    late = end.selectExpr("-1L AS event_id", "'none' AS crossing_id", "'none' AS camera_id", "t", "'CLEAR' AS state", "0D AS confidence", "'' AS digest", "'v1' AS version")
    stream = replayed(rows.unionByName(late), f"CASE WHEN event_id = -1 THEN {len(CUTS) + 1} ELSE {part_of('t')} END", (*CUTS, 0))
    return run_through(live.growing_sessions(stream), "sessions").where("NOT is_open").select("session_id", "crossing_id", "started", "ended", "seconds", "readings", F.round("peak", 6).alias("peak"))


@query("streamed_alerts", ORACLE_SQL["rising_edge_alerts"])
def _(spark, sf_dir):
    stream = replayed(tables.readings(spark, sf_dir), part_of("t"))
    return run_through(live.live_alerts(stream), "alerts").withColumn("confidence", F.round("confidence", 6))


@query("late_readings", f"""WITH {READINGS_SQL}, p AS (SELECT *, {part_of('t')} AS part FROM readings), d AS (SELECT *, part + (event_id % 20 = 0 AND part < {len(CUTS)})::INT AS sent FROM p),
 w AS (SELECT sent, max(t) AS high FROM d GROUP BY 1) SELECT crossing_id, t, event_id, round(confidence, 6) AS confidence FROM d WHERE state = 'BLOCKED' AND t < (SELECT max(high) - 120000 FROM w WHERE w.sent < d.sent)""")
def _(spark, sf_dir):
    """Every twentieth reading comes a file late; those behind the watermark by then are kept apart."""
    rows = tables.readings(spark, sf_dir)
    part = f"{part_of('t')} + cast(event_id % 20 = 0 AND t < {CUTS[-1]} AS int)"
    events = run_through(live.session_events(replayed(rows, part)), "events")
    return live.quarantine(events).select("crossing_id", "t", "event_id", F.round("confidence", 6).alias("confidence"))


@query("streamed_board", ORACLE_SQL["live_board"])
def _(spark, sf_dir):
    """The board that runs over all events up to an instant, in two batches."""
    at = F.col("t") <= NEXT
    rows = board.events(pictured(spark, sf_dir), poll_frames(spark, sf_dir), emissions(spark, sf_dir), spark.range(1).select(F.lit(NEXT).alias("t"))).where(at)
    cuts = (NEXT - 86_400_000 * 3,)
    stream = replayed(files.held(rows, "events"), f"cast(t >= {cuts[0]} AS int)", cuts)
    running = board.RunningBoard(files.scratch(spark, "board"), roster(spark, sf_dir), lambda changes, number: None)
    board.running(stream, running, files.scratch(spark, "board-checkpoint"), None).awaitTermination()
    return running.board(spark).withColumn("cameras", F.array_join(F.transform("cameras", lambda c: F.concat(c["camera_id"], F.lit("="), F.coalesce(c["object_key"], F.lit("-")))), " "))


@query("loaded_rebuild", ORACLE_SQL["window_rebuild"])
def _(spark, sf_dir):
    """The rebuild of a window as one commit of a versioned table."""
    path, old = files.scratch(spark, "rebuild"), derived(spark, sf_dir)
    versioned.merge(path, old, ["session_id", "version"], ["started"])
    fresh = old.where(F.col("started").between(DAY, NEXT))
    windows = fresh.groupBy("crossing_id").agg(F.min("started").alias("low"), F.lit(NEXT).alias("high"))
    history.load_rebuild(path, fresh.withColumn("seconds", F.col("seconds") + 1), windows)
    return versioned.current(spark, path).select("session_id", "crossing_id", "started", "seconds")


@query("merged_sessions", f"WITH {SESSIONS_SQL} SELECT session_id, version, crossing_id, CASE WHEN (started // 1000) % 3 = 0 THEN readings + 1000 ELSE readings END AS readings FROM sessions")
def _(spark, sf_dir):
    """Sessions merged in three batches: the second is newer for every third, the third repeats the second and is ignored."""
    path, s = files.scratch(spark, "merged"), derived(spark, sf_dir).select("session_id", "version", "crossing_id", "started", "readings").withColumn("ingested", F.lit(1))
    newer = s.where("(started div 1000) % 3 = 0").withColumns({"readings": F.col("readings") + 1000, "ingested": F.lit(2)})
    sink = versioned.merge_sink(path, ["session_id", "version"], ["ingested"])
    for number, batch in enumerate((s, newer)):
        sink(batch, number)
    sink(s, 1)
    versioned.merge(path, s.withColumn("readings", F.lit(0).cast("long")), ["session_id", "version"], ["ingested"], ignore=True)
    return versioned.current(spark, path).select("session_id", "version", "crossing_id", "readings")
