"""What the history pages show: hours, outlooks, headings, the tape of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import local
from .history import closed, even_sample

HOUR = 3_600_000


def hour_of_day(grid: DataFrame) -> DataFrame:
    """The week's grid (crossing_id, slot, blocked, scoreable) as 24 hours."""
    return grid.groupBy("crossing_id", (F.col("slot") % 24).alias("hour")).agg(F.sum("blocked").alias("blocked"), F.sum("scoreable").alias("scoreable"))


def share(blocked: str = "blocked", scoreable: str = "scoreable") -> Column:
    return F.when(F.col(scoreable) > 0, F.col(blocked) / F.col(scoreable)).otherwise(0.0)


def heat(blocked: str = "blocked", scoreable: str = "scoreable") -> Column:
    """How strongly an hour is tinted, 18 to 100 percent; null for none."""
    s = share(blocked, scoreable)
    return F.when(s > 0, F.floor(18 + 82 * F.least(F.lit(1.0), s * 2) + 0.5).cast("int"))


def prose_hour(h: Column) -> Column:
    x = F.pmod(h, F.lit(24))
    return F.concat(F.when(x % 12 == 0, 12).otherwise(x % 12).cast("string"), F.when(x < 12, " AM").otherwise(" PM"))


def worst_hours(day: DataFrame, least: int = 4, near: float = 0.6, width: int = 5) -> DataFrame:
    """crossing_id, worst: the run of hours at or near the peak share, around midnight too; a peak of 0 has
    none. Hours with fewer than `least` scoreable readings count as 0."""
    s = F.when(F.col("scoreable") >= least, share()).otherwise(0.0)
    rows = day.groupBy("crossing_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", s.alias("s")))), lambda x: x["s"]).alias("s"))
    rows = rows.withColumn("peak", F.array_max("s")).where("peak > 0").withColumn("at", F.array_position("s", F.col("peak")).cast("int") - 1)
    ok = lambda k: F.element_at("s", (F.pmod(k, F.lit(24)) + 1).cast("int")) >= F.col("peak") * near
    first_bad = lambda sign: F.array_position(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: ~ok(F.col("at") + sign * k)), F.lit(True)).cast("int")
    run = lambda sign: F.when(first_bad(sign) == 0, width).otherwise(first_bad(sign) - 1)
    rows = rows.withColumn("left", run(-1)).withColumn("right", F.least(run(1), width - F.col("left")))
    start, end = F.col("at") - F.col("left"), F.col("at") + F.col("right")
    text = F.when(start == end, F.concat(F.lit("around "), prose_hour(start))).otherwise(F.concat(prose_hour(start), F.lit("-"), prose_hour(end + 1)))
    return rows.select("crossing_id", text.alias("worst"))


def durations(sessions: DataFrame) -> DataFrame:
    """crossing_id, durations: seconds of its closed certified sessions, in the order they began."""
    return closed(sessions).groupBy("crossing_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("started", "seconds"))), lambda x: x["seconds"]).alias("durations"))


def wait_outlook(sessions: DataFrame, elapsed_s: int) -> DataFrame:
    """crossing_id, outlook: how long a blockage that has lasted `elapsed_s` will last, by the sessions that
    lasted longer: their upper median rest, up to five minutes; if there is none, the longest one."""
    rows = closed(sessions).withColumn("rest", F.when(F.col("seconds") > elapsed_s, F.col("seconds") - elapsed_s))
    whole = Window.partitionBy("crossing_id")
    rows = rows.withColumns({"n": F.count("rest").over(whole), "record": F.max("seconds").over(whole), "r": F.row_number().over(whole.orderBy(F.col("rest").asc_nulls_last(), "started"))})
    one = rows.where("r = floor(n / 2) + 1 OR (n = 0 AND r = 1)").dropDuplicates(["crossing_id"])
    est = F.greatest(F.lit(5), F.ceil(F.col("rest") / 60 / 5) * 5).cast("int")
    text = F.when(F.col("n") == 0, F.concat(F.lit("none has lasted this long (the longest took "), F.floor(F.col("record") / 60 + 0.5).cast("int"), F.lit(" min)")))
    text = text.otherwise(F.concat(F.lit("half of those that lasted this long ended within "), est, F.lit(" more min ("), F.col("n"), F.lit(" of them)")))
    return one.select("crossing_id", text.alias("outlook"))


def last_days(daily: DataFrame, n: int = 14) -> DataFrame:
    """Of each crossing's days with minutes (crossing_id, day, minutes) the last n."""
    order = Window.partitionBy("crossing_id").orderBy(F.desc("day"))
    return daily.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def day_heading(ms: str) -> Column:
    return F.date_format(local(ms), "EEEE, MMMM d")


def day_time(ms: str) -> Column:
    return F.date_format(local(ms), "EEEE, MMMM d, hh:mm a")


def short_date(ms: str) -> Column:
    return F.date_format(local(ms), "MMM d")


def by_day(sessions: DataFrame) -> DataFrame:
    """day, heading, sessions: a heading for each local day on which sessions began."""
    return sessions.groupBy(F.to_date(local("started")).cast("string").alias("day"), day_heading("started").alias("heading")).agg(F.count("*").alias("sessions"))


def featured(rows: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    return rows.where(F.col("crossing_id").isin(*ids))


def crossing_label(crossing: str, labels: dict[str, str]) -> Column:
    """A crossing's label, or its id."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]) if labels else None
    return F.col(crossing) if known is None else F.coalesce(F.try_element_at(known, F.col(crossing)), F.col(crossing))


def and_joined(names: Column) -> Column:
    """A list in prose: "a", "a and b", "a, b, and c"."""
    n = F.size(names)
    return F.when(n < 3, F.array_join(names, " and ")).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(names, -1)))


def tape(sessions: DataFrame, observations: DataFrame, pad_ms: int = 120_000, k: int = 10) -> DataFrame:
    """session_id, camera_id, t, object_key: up to k pictures of each session, padded, evenly from the camera
    that saw most of it blocked; of equals the one that saw so first; if none did, the first with a picture."""
    spans = sessions.select("session_id", F.col("crossing_id").alias("_x"), (F.col("started") - pad_ms).alias("_a"), (F.col("ended") + pad_ms).alias("_b"))
    spans = spans.withColumn("_h", F.explode(F.sequence(F.floor(F.col("_a") / HOUR), F.floor(F.col("_b") / HOUR))))
    rows = observations.where("object_key IS NOT NULL").join(spans, (F.col("crossing_id") == F.col("_x")) & (F.floor(F.col("t") / HOUR) == F.col("_h")) & F.col("t").between(F.col("_a"), F.col("_b")))
    at = F.struct("t", "event_id")
    per = rows.groupBy("session_id", "camera_id").agg(F.count_if(F.col("state") == "BLOCKED").alias("hits"), F.min(F.when(F.col("state") == "BLOCKED", at)).alias("hit"), F.min(at).alias("seen"))
    order = Window.partitionBy("session_id").orderBy(F.desc("hits"), F.col("hit").asc_nulls_last(), "seen")
    one = per.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("session_id", "camera_id")
    return even_sample(rows.join(one, ["session_id", "camera_id"], "left_semi"), ["session_id"], ["t", "event_id"], k).select("session_id", "camera_id", "t", "object_key")


def plan_summary(sessions: DataFrame, readings: DataFrame) -> DataFrame:
    """Per crossing what a rebuild would bring: its window, how many sessions, which versions."""
    windows = readings.groupBy("crossing_id").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.array_join(F.array_sort(F.collect_set("version")), ",").alias("versions"))
    kept = sessions.groupBy("crossing_id").agg(F.count("*").alias("n"))
    return windows.join(kept, "crossing_id", "left").select("crossing_id", "low", "high", F.coalesce("n", F.lit(0)).alias("sessions"), "versions")
