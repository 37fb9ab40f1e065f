"""Labels and training sets: interval joins, weak labels, a repeatable split, exams, name matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import DAY_MS
from ..functions.scalars import folded

HOUR = 3_600_000


def by_hour(intervals: DataFrame, low: Column, high: Column) -> DataFrame:
    """Intervals once for each hour they touch, so that a range join has an equal key."""
    cut = intervals.withColumns({"i_low": low, "i_high": high}).where("i_low <= i_high")
    return cut.withColumn("i_hour", F.explode(F.sequence(F.floor(F.col("i_low") / HOUR), F.floor(F.col("i_high") / HOUR)))).select(F.col("crossing_id").alias("i_crossing"), "i_low", "i_high", "i_hour")


def in_intervals(frames: DataFrame, intervals: DataFrame, low: Column, high: Column, how: str = "left_semi") -> DataFrame:
    """Frames (crossing_id, t) in any interval of their crossing, or with left_anti in none."""
    hours = by_hour(intervals, low, high)
    return frames.join(hours, (F.col("crossing_id") == F.col("i_crossing")) & (F.floor(F.col("t") / HOUR) == F.col("i_hour")) & F.col("t").between(F.col("i_low"), F.col("i_high")), how)


def in_core(frames: DataFrame, sessions: DataFrame, margin_ms: int = 120_000) -> DataFrame:
    """Frames well within a session. Of sessions with a `closed` column only closed ones count, as nobody
    knows where an open one ends; quiet() minds all of them."""
    sessions = sessions.where("closed") if "closed" in sessions.columns else sessions
    return in_intervals(frames, sessions, F.col("started") + margin_ms, F.col("ended") - margin_ms)


def quiet(frames: DataFrame, sessions: DataFrame, margin_ms: int = 1_800_000) -> DataFrame:
    return in_intervals(frames, sessions, F.col("started") - margin_ms, F.col("ended") + margin_ms, "left_anti")


def split(examples: DataFrame, share: float = 0.15) -> DataFrame:
    """Examples with `split`: of each label the first share of them by hash, at least one, is val.

    Examples are counted by the hash's first digits; only within those digits are they ranked, so a label's
    examples don't meet in one task."""
    rows = examples.withColumn("_h", F.sha2(F.col("object_key"), 256)).withColumn("_p", F.substring("_h", 1, 3))
    count = rows.groupBy("label", "_p").agg(F.count("*").alias("_c"))
    label, sofar = Window.partitionBy("label"), Window.partitionBy("label").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    count = count.select(F.col("label").alias("_label"), F.col("_p").alias("_q"), (F.greatest(F.lit(1), F.floor(F.sum("_c").over(label) * share)) - F.coalesce(F.sum("_c").over(sofar), F.lit(0))).alias("_left"))
    rows = rows.join(count, (F.col("label") == F.col("_label")) & (F.col("_p") == F.col("_q")))
    rank = F.row_number().over(Window.partitionBy("label", "_p").orderBy("_h", "object_key"))
    return rows.withColumn("split", F.when(rank <= F.col("_left"), "val").otherwise("train")).select(*examples.columns, "split")


def weak_labels(frames: DataFrame, sessions: DataFrame, gold: DataFrame, sweep: DataFrame) -> DataFrame:
    """(object_key, camera_id, label, source, split): gold frames stay out; the core of a session is
    BLOCKED; else a swept CLEAR, else a quiet frame is CLEAR; the rest is dropped."""
    rest = frames.join(gold.select("object_key"), "object_key", "left_anti")
    core = in_core(rest, sessions).withColumns({"label": F.lit("BLOCKED"), "source": F.lit("session"), "_p": F.lit(0)})
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    swept = rest.withColumn("_b", base("object_key")).join(sweep.select(base("object_key").alias("_b"), "camera_id").distinct(), ["_b", "camera_id"], "left_semi").drop("_b").withColumns({"label": F.lit("CLEAR"), "source": F.lit("sweep"), "_p": F.lit(1)})
    calm = quiet(rest, sessions).withColumns({"label": F.lit("CLEAR"), "source": F.lit("quiet"), "_p": F.lit(2)})
    union = core.unionByName(swept).unionByName(calm).groupBy("object_key").agg(F.min(F.struct("_p", "camera_id", "label", "source")).alias("x"))
    return split(union.select("object_key", "x.camera_id", "x.label", "x.source"))


def exam(rows: DataFrame) -> DataFrame:
    """Per judge: true and false positives and negatives, unknown ones, and hard errors. rows: judge,
    truth and verdict as BLOCKED, CLEAR or UNKNOWN."""
    hit = lambda t, v: F.count_if((F.col("truth") == t) & (F.col("verdict") == v))
    out = rows.groupBy("judge").agg(hit("BLOCKED", "BLOCKED").alias("tp"), hit("CLEAR", "BLOCKED").alias("fp"), hit("CLEAR", "CLEAR").alias("tn"), hit("BLOCKED", "CLEAR").alias("fn"), F.count_if(F.col("verdict") == "UNKNOWN").alias("unknown"), F.count("*").alias("n"))
    return out.withColumn("hard_errors", F.col("fp") + F.col("fn"))


def match_names(targets: DataFrame, items: DataFrame) -> DataFrame:
    """targets (target_id, name) with the first item (item_id, name) of the same folded name, or null."""
    first = items.groupBy(folded("name").alias("_f")).agg(F.min("item_id").alias("item_id"))
    return targets.join(first, folded("name") == F.col("_f"), "left").select("target_id", "name", "item_id")


def next_pick(times: np.ndarray, stride_ms: int) -> np.ndarray:
    """Of each of the sorted times the place of the first at least a stride later; len(times) is a place for none."""
    return np.maximum(np.searchsorted(times, times + stride_ms), np.arange(1, len(times) + 1))


def stride_sample(frames: DataFrame, stride_ms: int) -> DataFrame:
    """Of each camera the first frame, then the first at least a stride after the one taken before.

    A camera's times are cut into units of a day (or eight strides). Within a unit every time points to the pick
    that would follow it; doubling the pointers gives the last pick from any time on. As a pick reaches a
    stride into the next unit at most, only the times of a unit's first stride, and the first behind it, can be
    its first pick: these with the instant from which the pick after the unit's last is due are the unit's
    function. Functions are composed along units, and each unit's picks follow from its first."""
    unit = max(DAY_MS, 8 * stride_ms)

    @F.pandas_udf("array<struct<first: long, due: long>>")
    def function(units: pd.Series) -> pd.Series:
        def of(times: np.ndarray) -> list[dict]:
            step = next_pick(times, stride_ms)
            last = np.where(step < len(times), step, np.arange(len(times)))
            while (further := last[last]).tobytes() != last.tobytes():
                last = further
            n = min(len(times), int(np.searchsorted(times, times[0] // unit * unit + stride_ms)) + 1)
            return [{"first": int(f), "due": int(d) + stride_ms} for f, d in zip(times[:n], times[last[:n]])]

        return units.map(of)

    @F.pandas_udf("array<long>")
    def picks(units: pd.Series, firsts: pd.Series) -> pd.Series:
        def of(times: np.ndarray, first: int) -> np.ndarray:
            step = np.append(next_pick(times, stride_ms), len(times))
            found = np.array([np.searchsorted(times, first)])
            while len(more := np.setdiff1d(step[found], found)) and more[0] < len(times):
                found, step = np.union1d(found, more), step[step]
            return times[found[found < len(times)]]

        return pd.Series([of(t, f) for t, f in zip(units, firsts)])

    times = frames.select("camera_id", "t").where("t IS NOT NULL").groupBy("camera_id", F.floor(F.col("t") / unit).alias("u")).agg(F.array_sort(F.collect_set("t")).alias("times"))
    per = times.withColumn("f", function("times")).groupBy("camera_id").agg(F.array_sort(F.collect_list(F.struct("u", "f"))).alias("units"))
    # along the units: [the instant a pick is due from, then each unit's first pick or null]
    due = lambda fs, at: F.get(F.filter(fs, lambda x: x["first"] >= at), F.lit(0))
    low = F.lit(-(1 << 62)).cast("long")
    walked = F.aggregate("units", F.array(low), lambda a, u: F.concat(F.array(F.coalesce(due(u["f"], a[0])["due"], a[0])), F.slice(a, F.lit(2), F.size(a)), F.array(due(u["f"], a[0])["first"])))
    firsts = per.select("camera_id", "units", walked.alias("w")).select("camera_id", "w", F.posexplode("units").alias("i", "x")).select(F.col("camera_id").alias("_c"), F.col("x.u").alias("_u"), F.get("w", F.col("i") + 1).alias("first")).where("first IS NOT NULL")
    begun = times.join(firsts, F.col("camera_id").eqNullSafe(F.col("_c")) & (F.col("u") == F.col("_u")))
    return begun.select("camera_id", F.explode(picks("times", "first")).alias("t"))


def add_new(existing: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """existing and those rows of more whose key it lacks, one of each key."""
    return existing.unionByName(only_new(existing, more, key))


def only_new(existing: DataFrame, more: DataFrame, key: str) -> DataFrame:
    return more.join(existing.select(key), key, "left_anti").dropDuplicates([key])
