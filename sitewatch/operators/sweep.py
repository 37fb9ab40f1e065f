"""Which frames to have labelled: a coarse sample, and around each hit a walk to its edges.

Verdicts come from a table (state of each frame); a frame that has a label already is neutral: it isn't
asked for again and neither extends nor ends a walk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import with_running
from ..functions.scalars import iso_text
from .labels import stride_sample

#: CLEAR frames in a row that end a walk, steps of a walk at most, frames of a camera looked at together.
STREAK, WALK, PART = 3, 40, 4096


def numbered(frames: DataFrame) -> DataFrame:
    """frames with `i`, their place along their camera, from 0."""
    return with_running(frames.withColumn("_one", F.lit(1)), ["camera_id"], ["t", "event_id"], {"i": "_one"}).withColumn("i", F.col("i") - 1).drop("_one")


def planned(frames: DataFrame, stride_ms: int = 15 * 60_000, labelled: DataFrame | None = None) -> DataFrame:
    """The frames (event_id, camera_id, t, state, ...) that a sweep judges, with `picked` (of the coarse sample)
    and `open_ended` (a walk from it ended by its length).

    A walk sees WALK frames at most, so a camera's frames are taken in parts with a margin of so many."""
    rows = frames
    if labelled is not None:
        rows = rows.join(labelled.select(F.col("object_key").alias("_k")).distinct(), F.col("object_key") == F.col("_k"), "left").withColumn("_known", F.col("_k").isNotNull()).drop("_k")
    else:
        rows = rows.withColumn("_known", F.lit(False))
    rows = numbered(rows)
    picks = stride_sample(frames, stride_ms).select(F.col("camera_id").alias("_c"), F.col("t").alias("_t"))
    first = rows.groupBy("camera_id", "t").agg(F.min("event_id").alias("_e")).join(picks, (F.col("camera_id") == F.col("_c")) & (F.col("t") == F.col("_t"))).select(F.col("_e"), F.lit(True).alias("_p"))
    rows = rows.join(first, F.col("event_id") == F.col("_e"), "left").withColumn("picked", F.coalesce("_p", F.lit(False))).drop("_e", "_p")
    part = F.floor(F.col("i") / PART)
    near = F.array_distinct(F.transform(F.array(F.lit(-WALK), F.lit(0), F.lit(WALK)), lambda d: F.floor((F.col("i") + d) / PART)))
    rows = rows.withColumn("_home", part).withColumn("_part", F.explode(near)).where("_part >= 0")
    blocked = (F.col("state") == "BLOCKED") & ~F.col("_known")
    clear = (F.col("state") == "CLEAR") & ~F.col("_known")
    hit = F.col("picked") & blocked
    by = ["camera_id", "_part"]
    for name, order in (("up", F.col("i")), ("down", F.col("i").desc())):
        w = Window.partitionBy(*by).orderBy(order)
        rows = rows.withColumn("_g", F.sum(blocked.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.withColumn("_clear", F.sum(clear.cast("int")).over(Window.partitionBy(*by, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
        ahead = w.rowsBetween(1, WALK)
        # the nearest frame ahead at which the streak is full; without one the walk ends by its length
        edge = (F.min if name == "up" else F.max)(F.when((F.col("_clear") >= STREAK) & (F.col("_g") > 0), F.col("i"))).over(ahead)
        rows = rows.withColumn("_n", F.count("*").over(ahead)).withColumn("_edge", F.when(hit, edge))
        reach = F.coalesce("_edge", F.col("i") + (WALK if name == "up" else -WALK))
        rows = rows.withColumn(f"_reach_{name}", F.when(hit, reach)).withColumn(f"_open_{name}", hit & F.col("_edge").isNull() & (F.col("_n") >= WALK))
        behind = w.rowsBetween(-WALK, -1)
        rows = rows.withColumn(f"_in_{name}", (F.max(f"_reach_{name}").over(behind) >= F.col("i")) if name == "up" else (F.min(f"_reach_{name}").over(behind) <= F.col("i")))
    covered = F.col("picked") | F.coalesce("_in_up", F.lit(False)) | F.coalesce("_in_down", F.lit(False))
    out = rows.where((F.col("_part") == F.col("_home")) & covered & ~F.col("_known"))
    return out.select(*frames.columns, "picked", (F.col("_open_up") | F.col("_open_down")).alias("open_ended"))


def label_records(judged: DataFrame, labeller: str, now: str, source: str = "vlm-spot-check") -> DataFrame:
    """Label records of judged frames (object_key, camera_id, crossing_id, t, state, confidence, reason)."""
    stamp = F.expr(iso_text("floor(t / 1000) * 1000"))
    return judged.select(
        "object_key", "camera_id", "crossing_id", F.regexp_replace(stamp, r"\+00:00$", "Z").alias("captured_at"), F.concat(F.substring(stamp, 12, 5), F.lit(" UTC")).alias("local_time"),
        F.col("state").alias("label"), "confidence", F.substring("reason", 1, 200).alias("reason"), F.lit("unrecorded").alias("lighting"), F.lit(source).alias("source"),
        F.lit(labeller).alias("labeller"), F.lit(now).alias("labelled_at"), (F.col("state") != "UNKNOWN").alias("visually_resolvable"))
