"""Versioned history: which layer holds, local-time patterns, and rebuilding a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import local
from ..sources import versioned


def latest_layer(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with the same keys the one ingested last; of a tie the larger version."""
    order = Window.partitionBy(*keys).orderBy(F.desc("ingested"), F.desc("version"), F.desc("event_id")) if "event_id" in rows.columns else Window.partitionBy(*keys).orderBy(F.desc("ingested"), F.desc("version"))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def timeline(layers: DataFrame, crossing: str | None, low: int, high: int) -> DataFrame:
    """Resolved readings of a closed range. The range and the crossing are filtered before the window."""
    rows = layers.where(F.col("t").between(low, high))
    if crossing is not None:
        rows = rows.where(F.col("crossing_id") == crossing)
    return latest_layer(rows, ["camera_id", "t"])


def hour_grid(resolved: DataFrame) -> DataFrame:
    """Per crossing all 168 local hours of the week: blocked and scoreable readings."""
    at = resolved.where("state IN ('BLOCKED', 'CLEAR')").withColumn("l", local("t"))
    slots = at.groupBy("crossing_id", ((F.dayofweek("l") - 1) * 24 + F.hour("l")).alias("slot")).agg(F.count_if(F.col("state") == "BLOCKED").alias("blocked"), F.count("*").alias("scoreable"))
    spine = slots.select("crossing_id").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(167))))
    return spine.join(slots, ["crossing_id", "slot"], "left").select("crossing_id", "slot", F.coalesce("blocked", F.lit(0)).alias("blocked"), F.coalesce("scoreable", F.lit(0)).alias("scoreable"))


def closed(sessions: DataFrame) -> DataFrame:
    """Certified sessions that are over, whatever an emission of an open one says about its end."""
    rows = sessions.where("NOT is_open") if "is_open" in sessions.columns else sessions
    return rows.where("certified AND seconds IS NOT NULL")


def daily_minutes(sessions: DataFrame) -> DataFrame:
    """Blocked minutes by local day on which a session began, each rounded half to even."""
    return closed(sessions).groupBy("crossing_id", F.to_date(local("started")).cast("string").alias("day")).agg(F.sum(F.expr("bround(seconds / 60D, 0)")).cast("long").alias("minutes"))


def summary(resolved: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per crossing: share of blocked readings, certified sessions, minutes a day of coverage."""
    seen = resolved.where("state IN ('BLOCKED', 'CLEAR')").groupBy("crossing_id").agg(F.count_if(F.col("state") == "BLOCKED").alias("b"), F.count("*").alias("s"), ((F.max("t") - F.min("t")) / 86_400_000).alias("span"))
    days = F.round(F.greatest(F.lit(1.0), "span"), 2)
    kept = closed(sessions).groupBy("crossing_id").agg(F.count("*").alias("n"), F.sum(F.expr("bround(seconds / 60D, 0)")).alias("m"))
    out = seen.join(kept, "crossing_id", "left")
    return out.select("crossing_id", F.round(F.col("b") / F.col("s"), 4).alias("blocked_share"), F.coalesce("n", F.lit(0)).alias("sessions_closed"), days.alias("coverage_days"), F.round(F.coalesce("m", F.lit(0.0)) / days, 1).alias("minutes_per_day"))


BINS = (10, 20, 30, 45, 60)


def duration_histogram(sessions: DataFrame) -> DataFrame:
    """Certified sessions by length: under 10, 20, 30, 45, 60 minutes, and longer; empty bins are 0."""
    ladder = F.lit(len(BINS))
    for i in reversed(range(len(BINS))):
        ladder = F.when(F.col("seconds") < BINS[i] * 60, i).otherwise(ladder)
    found = closed(sessions).groupBy("crossing_id", ladder.alias("bin")).agg(F.count("*").alias("n"))
    spine = sessions.select("crossing_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(BINS)))))
    return spine.join(found, ["crossing_id", "bin"], "left").select("crossing_id", "bin", F.coalesce("n", F.lit(0)).alias("sessions"))


def day_night(sessions: DataFrame, newest: int = 500, least: int = 3) -> DataFrame:
    """Upper median minutes of sessions that began by day (6 to 18 local) and by night, of each
    crossing's newest ones; nothing unless both have enough."""
    order = Window.partitionBy("crossing_id").orderBy(F.desc("started"), "session_id")
    rows = closed(sessions).where("seconds > 0").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= newest)
    rows = rows.withColumn("part", F.when(F.hour(local("started")).between(6, 17), "day").otherwise("night"))
    rank = Window.partitionBy("crossing_id", "part").orderBy("seconds", "session_id")
    rows = rows.withColumns({"r": F.row_number().over(rank), "n": F.count("*").over(Window.partitionBy("crossing_id", "part"))})
    mid = rows.where("r = floor(n / 2) + 1 AND n >= " + str(least)).select("crossing_id", "part", (F.col("seconds") / 60).alias("minutes"), "n")
    both = mid.groupBy("crossing_id").agg(F.count("*").alias("c")).where("c = 2")
    return mid.join(both.select("crossing_id"), "crossing_id", "left_semi").select("crossing_id", "part", F.round("minutes", 6).alias("median_minutes"), "n")


def longest(sessions: DataFrame, k: int = 5, least: int = 3) -> DataFrame:
    """The k longest sessions that count; none where they are fewer than `least`."""
    found = closed(sessions).orderBy(F.desc("seconds"), "started", "crossing_id").limit(max(k, least)).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("seconds"), "started", "crossing_id")))
    enough = found.where(F.col("_r") == least).select(F.lit(True).alias("_enough"))  # a row or none
    return found.join(enough, F.col("_enough"), "left_semi").where(F.col("_r") <= k).select("session_id", "crossing_id", "seconds")


def with_layer(existing: DataFrame, layer: DataFrame, keys: list[str]) -> DataFrame:
    """existing and what another detector's layer adds: rows whose keys are there already change nothing, and of
    several with the same keys in the layer the least is added."""
    rest = [c for c in existing.columns if c not in keys]
    added = layer.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_x")).select(*keys, "_x.*").select(*existing.columns)
    return existing.unionByName(added.join(existing.select(*keys), keys, "left_anti"))


def coverage(readings: DataFrame) -> DataFrame:
    """Per crossing and camera the span it reported in, and how far that falls short of the crossing's."""
    mine = readings.groupBy("crossing_id", "camera_id").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count("*").alias("n"))
    whole = Window.partitionBy("crossing_id")
    return mine.select("crossing_id", "camera_id", "low", "high", "n", (F.col("low") - F.min("low").over(whole)).alias("late_ms"), (F.max("high").over(whole) - F.col("high")).alias("early_ms"))


def violations(readings: DataFrame, roster: DataFrame, now: int, edge_ms: int = 15 * 60_000) -> DataFrame:
    """Why a rebuild from these readings must not run: (crossing_id, rule, detail), none if it may."""
    windows = readings.groupBy("crossing_id").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    live = windows.where(F.col("high") > now - edge_ms).select("crossing_id", F.lit("live edge").alias("rule"), F.col("high").cast("string").alias("detail"))
    witnesses = roster.where("scores").select("crossing_id", "camera_id")
    unknown = windows.join(witnesses, "crossing_id", "left_anti").select("crossing_id", F.lit("unknown crossing").alias("rule"), F.lit("").alias("detail"))
    expected = witnesses.join(windows.select("crossing_id"), "crossing_id", "left_semi")
    seen = coverage(readings)
    absent = expected.join(seen, ["crossing_id", "camera_id"], "left_anti").select("crossing_id", F.lit("absent witness").alias("rule"), F.col("camera_id").alias("detail"))
    short = seen.join(expected, ["crossing_id", "camera_id"], "left_semi").where((F.col("late_ms") > edge_ms) | (F.col("early_ms") > edge_ms)).select("crossing_id", F.lit("short witness").alias("rule"), F.col("camera_id").alias("detail"))
    return live.union(unknown).union(absent).union(short)


#: Rules that a caller may waive; the others hold always.
WAIVABLE = ("absent witness", "short witness", "empty derivation")


def guards(readings: DataFrame, roster: DataFrame, now: int, existing: DataFrame, fresh: DataFrame, waive: bool = False) -> DataFrame:
    """violations() and two more: no readings at all, and nothing derived where sessions exist that the
    rebuild would remove. existing, fresh: sessions (crossing_id, started) as they are and as derived."""
    windows = readings.groupBy("crossing_id").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    none = readings.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("crossing_id"), F.lit("empty input").alias("rule"), F.lit("").alias("detail"))
    lost = windows.join(fresh.select("crossing_id").distinct(), "crossing_id", "left_anti").join(existing.select(F.col("crossing_id").alias("_x"), "started"), (F.col("crossing_id") == F.col("_x")) & F.col("started").between(F.col("low"), F.col("high")))
    lost = lost.groupBy("crossing_id").agg(F.count("*").alias("n")).select("crossing_id", F.lit("empty derivation").alias("rule"), F.col("n").cast("string").alias("detail"))
    out = none.union(violations(readings, roster, now)).union(lost)
    return out.where(~F.col("rule").isin(*WAIVABLE)) if waive else out


def refuse(violations: DataFrame) -> None:
    """Raises if there are violations; names some of them."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r['rule']} ({r['crossing_id']} {r['detail']})" for r in found))


def outside(old: DataFrame, windows: DataFrame) -> DataFrame:
    """Sessions that began outside their crossing's window (crossing_id, low, high), closed, a row a crossing."""
    w = windows.select(F.col("crossing_id").alias("w"), "low", "high")
    return old.join(w, (F.col("crossing_id") == F.col("w")) & F.col("started").between(F.col("low"), F.col("high")), "left_anti")


def rebuilt(old: DataFrame, new: DataFrame, windows: DataFrame) -> DataFrame:
    """Sessions after a rebuild: old ones outside the windows, and all new ones."""
    kept = outside(old, windows)
    return kept.unionByName(new.select(*kept.columns))


def load_rebuild(path: str, new: DataFrame, windows: DataFrame, keys: tuple[str, ...] = ("session_id", "version")) -> bool:
    """rebuilt() of the versioned table at `path`, in one commit: no reader sees windows that are emptied and not
    yet filled. Run guards() first."""
    return versioned.replace(path, lambda old: outside(old, windows), new, list(keys))


def even_sample(rows: DataFrame, keys: list[str], order: list[str], k: int = 10) -> DataFrame:
    """At most k rows of each key, evenly from the first to the last."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    # row i is a pick if some step lands on it: floor(j * (n - 1) / (k - 1) + 0.5) = i
    step = F.expr(f"ceil((_i - 0.5D) * {k - 1} / (_n - 1))")
    hit = F.floor(step * (F.col("_n") - 1) / (k - 1) + 0.5) == F.col("_i")
    return numbered.where((F.col("_n") <= k) | hit).drop("_i", "_n")
