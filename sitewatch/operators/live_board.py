"""The live board as tables: latest rows per camera, open sessions, change feeds, feed verdicts, health rules.

Each is a batch query over everything up to an instant; streaming.board keeps the same board as rows come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import with_previous, with_running
from .polling import feed_health
from .sessions import board, judging, transitions


def on_roster(frames: DataFrame, roster: DataFrame) -> DataFrame:
    """Frames of cameras that the roster has; one that is gone must not speak for a feed."""
    return frames.join(roster.select("camera_id").distinct(), "camera_id", "left_semi")


def latest_pictures(readings: DataFrame, at: int) -> DataFrame:
    """crossing_id, camera_id, object_key, t: each camera's last picture; rows without one replace nothing."""
    rows = readings.where((F.col("t") <= at) & F.col("object_key").isNotNull())
    return rows.groupBy("crossing_id", "camera_id").agg(F.max(F.struct("t", "event_id", "object_key")).alias("x")).select("crossing_id", "camera_id", "x.object_key", "x.t")


def open_sessions(emissions: DataFrame) -> DataFrame:
    """crossing_id, session_id of each crossing's open session. emissions: session_id, crossing_id, is_open,
    seq. The last session opened is it, unless it was closed since; closing another changes nothing, and
    repeated emissions come to the same."""
    last = emissions.where("is_open").groupBy("crossing_id").agg(F.max(F.struct("seq", "session_id")).alias("x")).select("crossing_id", "x.session_id", F.col("x.seq").alias("opened"))
    shut = emissions.where("NOT is_open").groupBy(F.col("session_id").alias("s_id")).agg(F.max("seq").alias("closed"))
    return last.join(shut, (F.col("session_id") == F.col("s_id")) & (F.col("closed") > F.col("opened")), "left_anti").select("crossing_id", "session_id")


def session_changes(emissions: DataFrame, values: list[str]) -> DataFrame:
    """The emissions that differ from their crossing's one before, by seq (milliseconds)."""
    rows = with_previous(emissions, ["crossing_id"], ["seq"], values, "_b")
    return rows.where(~F.col("_b").eqNullSafe(F.struct(*values)) | F.col("_b").isNull()).drop("_b")


#: The columns of a board's row that make a change worth telling.
VISIBLE = ("state", "stale", "since", "open_session", "cameras", "feed", "feed_since")


def voting(readings: DataFrame, roster: DataFrame) -> DataFrame:
    """Readings that count on the board: judgements of the roster's scoring cameras."""
    return judging(readings).join(roster.where("scores").select("camera_id"), "camera_id", "left_semi")


def assembled(now: DataFrame, since: DataFrame, pictures: DataFrame, opened: DataFrame, feed: DataFrame, roster: DataFrame) -> DataFrame:
    """A row for each crossing of the roster from its parts: consensus, the last change, its cameras' last
    pictures, its open session, and the verdict on all feeds, which is one row."""
    none = F.struct("camera_id", F.lit(None).cast("string").alias("object_key"), F.lit(None).cast("long").alias("t"))
    shown = pictures.select("camera_id", F.struct("camera_id", "object_key", "t").alias("picture"))
    cameras = roster.join(shown, "camera_id", "left").groupBy("crossing_id").agg(F.array_sort(F.collect_list(F.coalesce("picture", none))).alias("cameras"))
    out = cameras.join(now.select("crossing_id", "state", "stale", "witness", "witness_t"), "crossing_id", "left").join(since, "crossing_id", "left").join(opened, "crossing_id", "left")
    out = out.join(feed.select(F.col("verdict").alias("feed"), F.col("since").alias("feed_since")), F.lit(True), "left")
    return out.select("crossing_id", F.coalesce("state", F.lit("UNKNOWN")).alias("state"), F.coalesce("stale", F.lit(True)).alias("stale"), "since", "witness", "witness_t", F.col("session_id").alias("open_session"), "cameras", "feed", "feed_since")


def full_board(readings: DataFrame, roster: DataFrame, emissions: DataFrame, frames: DataFrame, at: int, stale_ms: int = 15 * 60_000) -> DataFrame:
    """The board at an instant, from all that was read, emitted and polled: see assembled(). Only scoring cameras
    vote, only the roster's cameras speak for the feeds."""
    votes = voting(readings, roster).where(F.col("t") <= at)
    since = transitions(votes, stale_ms).groupBy("crossing_id").agg(F.max("t").alias("since"))
    return assembled(board(votes, at, stale_ms), since, latest_pictures(readings, at), open_sessions(emissions.where(F.col("seq") <= at)), feed_health(on_roster(frames, roster), at), roster)


def board_changes(before: DataFrame, now: DataFrame, visible: list[str]) -> DataFrame:
    """The rows of a board (crossing_id, ...) that differ from the board before in what is visible."""
    old = before.select(F.col("crossing_id").alias("_c"), F.struct(*visible).alias("_old"))
    return now.join(old, F.col("crossing_id") == F.col("_c"), "left").where(~F.struct(*visible).eqNullSafe(F.col("_old"))).select(now.columns)


def fresh_alerts(alerts: DataFrame, now: int, catching_up: bool, fresh_ms: int = 10 * 60_000) -> DataFrame:
    """Alerts to send: while a stream catches up, those of old edges are held back."""
    return alerts.where(F.col("t") >= now - fresh_ms) if catching_up else alerts


def silent_sessions(current: DataFrame, watermark: int, at_head: bool, gap_ms: int = 15 * 60_000, drift_ms: int = 2 * 60_000) -> DataFrame:
    """Open sessions (session_id, ended, ...) to close for silence: their deadline and the drift have passed,
    and nothing is still on its way."""
    due = F.col("ended") + gap_ms + drift_ms < watermark
    return current.where(F.col("is_open") & due & F.lit(at_head)).withColumn("is_open", F.lit(False))


def feed_transitions(frames: DataFrame, streak: int = 3, poll_ms: int = 5 * 60_000, image_ms: int = 15 * 60_000) -> DataFrame:
    """event_id, fetched, verdict: the polls at which the verdict on all feeds, judged at each poll's own time,
    becomes another than before ("ok" at first).

    Each poll changes its own camera's part only: whether that camera is down, and when a new picture
    last came. Sums and maxima of these changes along all polls give the verdict."""
    order = ["fetched", "event_id"]
    bad = frames.withColumn("_bad", (F.col("status") == "error").cast("int"))
    runs = with_running(bad.withColumn("_good", 1 - F.col("_bad")), ["camera_id"], order, {"_g": "_good"})
    runs = with_running(runs, ["camera_id", "_g"], order, {"_n": "_bad"})
    runs = runs.withColumn("_down", (F.col("_n") >= streak).cast("int"))
    runs = with_previous(runs, ["camera_id"], order, ["_down"], "_was")
    step = runs.withColumns({"_new": F.col("_was").isNull().cast("int"), "_change": F.col("_down") - F.coalesce("_was._down", F.lit(0)), "_pic": F.when(F.col("status") == "ok", F.col("fetched"))})
    along = with_running(step.withColumn("_all", F.lit(0)), ["_all"], order, {"cameras": "_new", "down": "_change"}, {"newest": "_pic"})
    verdict = F.when(F.col("down") >= F.col("cameras"), "upstream_down").when(F.col("newest") < F.col("fetched") - image_ms, "upstream_stale").otherwise("ok")
    judged = with_previous(along.withColumn("verdict", verdict), ["_all"], order, ["verdict", "fetched"], "_b")
    # silence of all before a poll isn't seen: at its own time the newest poll is this one
    return judged.where(F.coalesce(F.col("_b.verdict"), F.lit("ok")) != F.col("verdict")).select("event_id", "fetched", "verdict")


#: What is said of each verdict; {} is the time since when.
NOTES = {
    "upstream_stale": "All cameras show what they showed before{}; new pictures are taken up as they come.",
    "upstream_down": "Polls fail at every camera{}; they go on.",
    "capture_stale": "Nothing has been polled{}: the fault is here.",
}


def feed_note(verdict: str, since: str) -> Column:
    """The note on a feed, or null if it needs none. since: ms or null."""
    from ..functions.scalars import local

    clock = F.date_format(local(since), "h:mm a")
    at = F.when(F.col(since).isNull(), "").otherwise(F.concat(F.lit(" since "), clock))
    down = F.when(F.col(since).isNull(), "").otherwise(F.concat(F.lit(" (last good one: "), clock, F.lit(")")))
    out = F
    for name, text in NOTES.items():
        head, tail = text.split("{}")
        out = out.when(F.col(verdict) == name, F.concat(F.lit(head), down if name == "upstream_down" else at, F.lit(tail)))
    return out


def health(frames: DataFrame, roster: DataFrame, at: int, stall_s: int = 900, hold_s: int = 300, errors: int = 10, errors_s: int = 600, hour_s: int = 3600, silent_s: int = 900) -> DataFrame:
    """rule, camera_id of every health rule that fires at an instant (camera_id null: of all cameras).

    A rule must have held for its time: stalled since stall_s + hold_s, more than `errors` failures in a row
    of which the first too many is errors_s old, two hours of polls without a new picture though some
    didn't fail, nothing at all for silent_s."""
    rows = on_roster(frames.where(F.col("fetched") <= at), roster)
    age = lambda s: F.lit(at - s * 1000)
    per = rows.groupBy("camera_id").agg(
        F.max(F.when(F.col("status") == "ok", F.col("fetched"))).alias("new"), F.max(F.when(F.col("status") != "error", F.col("fetched"))).alias("good"),
        F.count_if((F.col("fetched") > age(2 * hour_s)) & (F.col("status") == "ok")).alias("oks"), F.count_if((F.col("fetched") > age(2 * hour_s)) & (F.col("fetched") <= age(hour_s)) & (F.col("status") != "error")).alias("fine1"),
        F.count_if((F.col("fetched") > age(hour_s)) & (F.col("status") != "error")).alias("fine2"))
    bad = rows.join(per.select(F.col("camera_id").alias("_c"), F.coalesce("good", F.lit(-1)).alias("good")), (F.col("camera_id") == F.col("_c")) & (F.col("fetched") > F.col("good")))
    nth = bad.withColumn("n", F.row_number().over(Window.partitionBy("camera_id").orderBy("fetched", "event_id")))
    erroring = nth.where((F.col("n") == errors + 1) & (F.col("fetched") <= age(errors_s))).select(F.lit("erroring").alias("rule"), "camera_id")
    stalled = per.where(F.col("new") < age(stall_s + hold_s)).select(F.lit("stalled").alias("rule"), "camera_id")
    frozen = per.where("oks = 0 AND fine1 > 0 AND fine2 > 0").select(F.lit("all duplicates").alias("rule"), "camera_id")
    whole = rows.agg(F.max("fetched").alias("polled"), F.max(F.when(F.col("status") == "ok", F.col("fetched"))).alias("new"))
    none = F.lit(None).cast("string").alias("camera_id")
    all_stalled = whole.where(F.col("new") < age(stall_s + hold_s)).select(F.lit("all stalled").alias("rule"), none)
    missing = whole.where(F.col("polled").isNull() | (F.col("polled") < age(silent_s))).select(F.lit("no polls").alias("rule"), none)
    return erroring.union(stalled).union(frozen).union(all_stalled).union(missing)
