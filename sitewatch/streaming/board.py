"""The live board as it runs: a micro-batch of events changes what is kept, and what then looks different is told.

What is kept is a row for each camera or crossing: the last vote, the last picture, the feed's counts, the session
opened last and its end, the last change, and the board as it was told. It is written anew for every batch, beside
that of the batch before, from which a batch that runs again starts; so nothing is counted twice. Events have `t`
(ms) and come in its order, but for what a feed delays by less than a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import live_board, polling, sessions
from ..sources.versioned import hadoop

EVENT = "kind string, t long, event_id long, crossing_id string, camera_id string, state string, version string, object_key string, status string, session_id string, is_open boolean"
PICTURES = "array<struct<camera_id: string, object_key: string, t: long>>"
KEPT = f"{EVENT}, polled long, imaged long, answered long, errors long, stale boolean, since long, witness string, witness_t long, open_session string, cameras {PICTURES}, feed string, feed_since long"
#: Batches whose state is kept, for those that run again.
STATES = 3


def shaped(rows: DataFrame, kind: str, fields: str) -> DataFrame:
    """rows as a kind of the rows of `fields`; what they lack is null."""
    names = [f.strip().split(" ", 1) for f in fields.replace(f"cameras {PICTURES}", "cameras @").split(",")]
    return rows.select(F.lit(kind).alias("kind"), *[(F.col(n) if n in rows.columns else F.lit(None)).cast(t.replace("@", PICTURES)).alias(n) for n, t in names if n != "kind"])


def events(readings: DataFrame | None = None, frames: DataFrame | None = None, emissions: DataFrame | None = None, ticks: DataFrame | None = None) -> DataFrame:
    """One table of EVENT from readings, frames (polls, by `fetched`), session emissions (by `seq`) and ticks (t), of
    batches or of streams. Ticks only tell the time, so that what goes stale in silence is seen."""
    parts = [("reading", readings), ("poll", frames and frames.withColumn("t", F.col("fetched"))), ("session", emissions and emissions.withColumn("t", F.col("seq"))), ("tick", ticks)]
    found = [shaped(rows, kind, EVENT) for kind, rows in parts if rows is not None]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clock(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """A stream of ticks."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.unix_millis("timestamp").alias("t"))


def of_kind(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("kind") == kind)


def newest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each key the row of the largest (t, event_id)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("t", "event_id")).alias("_x")).select(*keys, "_x.*").select(*rows.columns)


def fed(old: DataFrame, frames: DataFrame) -> DataFrame:
    """FEED of the cameras after some more polls: counts of errors go on unless a poll was none."""
    more = polling.feed_parts(frames).select(F.col("camera_id").alias("_c"), *[F.col(c).alias(f"_{c}") for c in ("polled", "imaged", "answered", "errors")])
    both = old.select("camera_id", "polled", "imaged", "answered", "errors").join(more, F.col("camera_id") == F.col("_c"), "full")
    errors = F.coalesce("_errors", F.lit(0)) + F.when(F.col("_answered").isNull(), F.coalesce("errors", F.lit(0))).otherwise(0)
    return both.select(F.coalesce("camera_id", "_c").alias("camera_id"), *[F.greatest(c, f"_{c}").alias(c) for c in ("polled", "imaged", "answered")], errors.alias("errors"))


class RunningBoard:
    """For foreachBatch over EVENT rows. publish(changes, number) gets a batch's changed board rows; it may get
    them again after a failure, so it should write under the number."""

    def __init__(self, path: str, roster: DataFrame, publish: Callable[[DataFrame, int], None], stale_ms: int = 15 * 60_000):
        self.path, self.roster, self.publish, self.stale_ms = path, roster, publish, stale_ms

    def states(self, spark: SparkSession) -> list[int]:
        """The batches whose state there is, ascending. A state counts once its files are all there."""
        fs, p = hadoop(spark, self.path)
        if not fs.exists(p):
            return []
        made = [x.getPath() for x in fs.listStatus(p)]
        return sorted(int(x.getName()) for x in made if x.getName().isdigit() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))

    def kept(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """What is kept now, or was before a batch."""
        found = [n for n in self.states(spark) if before is None or n < before]
        return spark.read.schema(KEPT).parquet(f"{self.path}/{found[-1]}") if found else spark.createDataFrame([], KEPT)

    def board(self, spark: SparkSession) -> DataFrame:
        """The board as it was told last."""
        rows = of_kind(self.kept(spark), "board")
        return rows.select("crossing_id", "state", "stale", "since", "witness", "witness_t", "open_session", "cameras", "feed", "feed_since")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, roster = batch.sparkSession, self.roster
        batch = batch.persist()
        try:
            old = self.kept(spark, number).persist()
            at = batch.select("t").union(of_kind(old, "clock").select("t")).agg(F.max("t")).first()[0]
            if at is None:
                return
            names = [c.strip().split(" ")[0] for c in EVENT.split(",")]
            readings = of_kind(batch, "reading").select(*names)
            before = of_kind(old, "vote").select(*names)
            votes = before.unionByName(live_board.voting(readings, roster).select(*names))
            last = newest(votes, "crossing_id", "camera_id")
            # what changed after the last vote that was known; up to it the votes kept give the state, not its history
            known = before.groupBy(F.col("crossing_id").alias("_k")).agg(F.max("t").alias("_t"))
            fresh = sessions.transitions(votes, self.stale_ms).join(known, F.col("crossing_id") == F.col("_k"), "left").where("_t IS NULL OR t > _t").select("crossing_id", "t")
            since = of_kind(old, "since").select("crossing_id", F.col("since").alias("t")).unionByName(fresh).groupBy("crossing_id").agg(F.max("t").alias("since"))
            pictures = newest(of_kind(old, "picture").select(*names).unionByName(readings.where("object_key IS NOT NULL")), "crossing_id", "camera_id")
            told = of_kind(old, "session").select(*names).unionByName(of_kind(batch, "session").select(*names))
            emissions = told.select("session_id", "crossing_id", "is_open", F.col("t").alias("seq"))
            opened = live_board.open_sessions(emissions)
            # of a crossing only the session opened last can still be open: it and its end are kept
            top = emissions.where("is_open").groupBy("crossing_id").agg(F.max(F.struct("seq", "session_id")).alias("x")).select("crossing_id", "x.session_id", F.lit(True).alias("is_open"), F.col("x.seq").alias("t"))
            ends = emissions.where("NOT is_open").groupBy("session_id", "crossing_id").agg(F.max("seq").alias("t")).join(top.select("session_id"), "session_id", "left_semi").withColumn("is_open", F.lit(False))
            polls = of_kind(batch, "poll").withColumn("fetched", F.col("t"))
            feeds = fed(of_kind(old, "feed"), live_board.on_roster(polls, roster))
            now = live_board.assembled(sessions.board(last, at, self.stale_ms), since, pictures.select("crossing_id", "camera_id", "object_key", "t"), opened, polling.feed_verdict(feeds, at), roster)
            clock_ = spark.range(1).select(F.lit(at).alias("t"))
            rows = [("vote", last), ("since", since), ("picture", pictures), ("session", top.unionByName(ends)), ("feed", feeds), ("board", now), ("clock", clock_)]
            out = shaped(rows[0][1], rows[0][0], KEPT)
            for kind, more in rows[1:]:
                out = out.unionByName(shaped(more, kind, KEPT))
            out.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{number}")
            self.publish(live_board.board_changes(of_kind(old, "board"), of_kind(spark.read.schema(KEPT).parquet(f"{self.path}/{number}"), "board").select(*now.columns), list(live_board.VISIBLE)), number)
            for n in self.states(spark)[:-STATES]:
                fs, p = hadoop(spark, f"{self.path}/{n}")
                fs.delete(p, True)
            old.unpersist()
        finally:
            batch.unpersist()


def changes_to(path: str) -> Callable[[DataFrame, int], None]:
    """A publisher that writes each batch's changes as JSON lines in a folder of its number; a batch that runs
    again writes them anew. Batches without changes write nothing."""

    def publish(changes: DataFrame, number: int) -> None:
        changes = changes.persist()
        if not changes.isEmpty():
            changes.coalesce(1).write.mode("overwrite").json(f"{path}/batch={number}")
        changes.unpersist()

    return publish


def board_payloads(changes: DataFrame) -> DataFrame:
    """key, value of changed board rows, for a topic."""
    return changes.select(F.col("crossing_id").alias("key"), F.to_json(F.struct(*changes.columns)).alias("value"))


def running(rows: DataFrame, board: RunningBoard, checkpoint: str, every: str | None = "10 seconds") -> StreamingQuery:
    """Runs a board over a stream of EVENT rows, a batch each `every`; with None until what is there is read."""
    writer = rows.writeStream.foreachBatch(board).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
