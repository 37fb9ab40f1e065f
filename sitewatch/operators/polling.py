"""Poll records: what each poll brought, streaks of errors, refresh cadence, feed health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import with_last, with_previous, with_running

ORDER = ["fetched", "event_id"]
#: Characters of an error's message that are kept.
MESSAGE = 500


def error_text() -> Column:
    return F.when(F.col("http").isNull(), "no answer").when(F.col("http") != 200, F.concat(F.lit("HTTP "), F.col("http").cast("string"))).otherwise("empty body")


def frames(polls: DataFrame) -> DataFrame:
    """The frame record of each poll (camera_id, fetched, http, hash, modified).

    304 is not_modified; 200 with the camera's last stored hash is a duplicate; both point to the
    frame first stored for those bytes. The event time is Last-Modified unless it is absent or later
    than the poll. What is neither 304 nor 200 with a body is an error: its event time is the poll's, its
    message is cut, and it has no key."""
    polls = with_last(polls, ["camera_id"], ORDER, {"_stored": "hash"}, before=True)
    status = F.when(F.col("http") == 304, "not_modified").when(F.col("http").isNull() | (F.col("http") != 200) | F.col("hash").isNull(), "error").when(F.col("hash").eqNullSafe(F.col("_stored")), "duplicate").otherwise("ok")
    usable = (F.col("status") != "error") & F.col("modified").isNotNull() & (F.col("modified") <= F.col("fetched"))
    message = F.when(F.col("status") == "error", F.substring(F.coalesce(F.col("error"), error_text()), 1, MESSAGE)) if "error" in polls.columns else F.when(F.col("status") == "error", F.substring(error_text(), 1, MESSAGE))
    rows = polls.withColumn("status", status).withColumn("message", message).withColumns({"t": F.when(usable, F.col("modified")).otherwise(F.col("fetched")), "t_source": F.when(usable, "last_modified").otherwise("fetched_at")})
    stored = F.when(F.col("status") == "ok", F.concat(F.col("camera_id"), F.lit("/"), F.col("t"), F.lit("-"), F.substring("hash", 1, 8)))
    rows = with_last(rows.withColumn("_k", stored), ["camera_id"], ORDER, {"object_key": "_k"})
    return rows.withColumn("object_key", F.when(F.col("status") != "error", F.col("object_key"))).drop("_k", "_stored")


def counters(frames: DataFrame) -> DataFrame:
    """Polls by camera and outcome, the last of them, the bytes stored and the last new picture."""
    size = F.col("size") if "size" in frames.columns else F.lit(None).cast("long")
    stored = F.col("status") == "ok"
    return frames.groupBy("camera_id", "status").agg(F.count("*").alias("polls"), F.max("fetched").alias("last_fetched"), F.coalesce(F.sum(F.when(stored, size)), F.lit(0)).alias("bytes"), F.max(F.when(stored, F.col("fetched"))).alias("last_new"))


def streaks(frames: DataFrame, longest_wait: int = 300) -> DataFrame:
    """Each error with its number in the row of errors it ends, and the advised wait in seconds."""
    rows = runs(frames).where("status = 'error'")
    rows = with_running(rows.withColumn("_one", F.lit(1)), ["camera_id", "_g"], ORDER, {"streak": "_one"})
    return rows.withColumn("wait_s", F.least(F.pow(F.lit(2.0), F.least("streak", F.lit(30))), F.lit(float(longest_wait))).cast("long")).drop("_g", "_one", "_good")


def runs(frames: DataFrame) -> DataFrame:
    """frames with `_g`, how many of the camera's were no errors up to each: errors in a row share it."""
    return with_running(frames.withColumn("_good", (F.col("status") != "error").cast("int")), ["camera_id"], ORDER, {"_g": "_good"})


def refresh_cadence(frames: DataFrame) -> DataFrame:
    """Per camera, between the times at which its distinct pictures were last seen: upper median, the
    gap at nine tenths of the sorted list, and how many gaps."""
    last = frames.where("hash IS NOT NULL").groupBy("camera_id", "hash").agg(F.max("t").alias("t"))
    gaps = with_previous(last, ["camera_id"], ["t", "hash"], ["t"]).withColumn("gap", F.col("t") - F.col("before.t")).where("gap IS NOT NULL")
    ranked = gaps.withColumns({"r": F.row_number().over(Window.partitionBy("camera_id").orderBy("gap")), "n": F.count("*").over(Window.partitionBy("camera_id"))})
    return ranked.groupBy("camera_id").agg(F.max(F.expr("CASE WHEN r = floor(n / 2) + 1 THEN gap END")).alias("median_ms"), F.max(F.expr("CASE WHEN r = floor(n * 0.9D) + 1 THEN gap END")).alias("p90_ms"), F.max("n").alias("gaps"))


FEED = "camera_id string, polled long, imaged long, answered long, errors long"


def feed_parts(frames: DataFrame) -> DataFrame:
    """FEED: of each camera the last poll, the last new picture, the last poll that was no error, and the errors since."""
    rows = runs(frames)
    last = rows.groupBy("camera_id").agg(F.max("_g").alias("_last"), F.max("fetched").alias("polled"), F.max(F.when(F.col("status") == "ok", F.col("fetched"))).alias("imaged"), F.max(F.when(F.col("status") != "error", F.col("fetched"))).alias("answered"))
    errors = rows.where("status = 'error'").groupBy(F.col("camera_id").alias("_c"), "_g").agg(F.count("*").alias("errors"))
    per = last.join(errors, (F.col("camera_id") == F.col("_c")) & (F.col("_last") == F.col("_g")), "left")
    return per.select("camera_id", "polled", "imaged", "answered", F.coalesce("errors", F.lit(0)).cast("long").alias("errors"))


def feed_verdict(parts: DataFrame, at: int, streak: int = 3, poll_ms: int = 5 * 60_000, image_ms: int = 15 * 60_000) -> DataFrame:
    """One row: the verdict on all feeds at an instant (ok, capture_stale, upstream_down or upstream_stale) and since
    when: the last poll, the last that was no error, the last new picture."""
    all_ = parts.agg(F.count("*").alias("cameras"), F.max("polled").alias("polled"), F.max("imaged").alias("imaged"), F.max("answered").alias("answered"), F.min("errors").alias("least"))
    verdict = F.when(F.col("cameras") == 0, "ok").when(F.col("polled") < at - poll_ms, "capture_stale").when(F.col("least") >= streak, "upstream_down").when(F.col("imaged") < at - image_ms, "upstream_stale").otherwise("ok")
    since = F.when(F.col("verdict") == "capture_stale", F.col("polled")).when(F.col("verdict") == "upstream_down", F.col("answered")).when(F.col("verdict") == "upstream_stale", F.col("imaged"))
    return all_.withColumn("verdict", verdict).select("verdict", since.alias("since"), "cameras", "polled", "imaged")


def feed_health(frames: DataFrame, at: int, streak: int = 3, poll_ms: int = 5 * 60_000, image_ms: int = 15 * 60_000) -> DataFrame:
    """feed_verdict() of the polls up to an instant."""
    return feed_verdict(feed_parts(frames.where(F.col("fetched") <= at)), at, streak, poll_ms, image_ms)


def sliding_rates(rows: DataFrame, by: str, time: str, width_min: int = 10) -> DataFrame:
    """Rows a minute over the last `width_min` minutes, at each minute that has some. Summed up by minute
    before each minute's sum goes to the minutes that see it."""
    minutes = rows.groupBy(by, F.floor(F.col(time) / 60_000).alias("_m")).agg(F.count("*").alias("_n"))
    slots = minutes.select(by, "_n", F.explode(F.sequence(F.col("_m"), F.col("_m") + width_min - 1)).alias("minute"))
    return slots.groupBy(by, "minute").agg((F.sum("_n") / width_min).alias("per_minute"))
