"""Scoring pictures against a per-camera reference, on arrays of grey levels, row by row of a picture."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files

#: Ranges of brightness.
BINS = 8


@dataclass(frozen=True)
class Thresholds:
    """Limits of the comparison; the version string tells them, so another set is another version."""

    changed_pixel: float = 40
    spread_multiple: float = 4.0
    row_density: float = 0.45
    least_rows: int = 10
    clear_fraction: float = 0.10
    dark: float = 12

    @property
    def version(self) -> str:
        return f"reference/d{self.changed_pixel}-r{self.row_density}-b{self.least_rows}-c{self.clear_fraction}"

    @property
    def values(self) -> dict:
        """Each limit by name, as a model store keeps them."""
        return asdict(self)

    @classmethod
    def of(cls, values: dict) -> "Thresholds":
        return cls(**{f.name: (int(values[f.name]) if float(values[f.name]).is_integer() else values[f.name]) for f in fields(cls) if f.name in values})


def cropped(scenes: DataFrame, width: int, top: int = 50, bottom: int = 44) -> DataFrame:
    """scenes without the bars burned in above and below; a picture of no more rows than these is null."""
    rows = F.size("pixels") / width
    return scenes.withColumn("pixels", F.when(rows > top + bottom, F.slice("pixels", F.lit(top * width + 1), (F.size("pixels") - (top + bottom) * width).cast("int"))))


def brightness(scenes: DataFrame) -> DataFrame:
    """scenes with `bin` (0 to 7) of the 75th percentile of grey levels, and `luminance`, their mean."""
    n = F.size("pixels")
    rank = (n - 1) * 0.75
    ordered = F.array_sort("pixels")
    low, high = F.element_at(ordered, (F.floor(rank) + 1).cast("int")), F.element_at(ordered, (F.ceil(rank) + 1).cast("int"))
    p75 = low + (high - low) * (rank - F.floor(rank))
    total = F.aggregate("pixels", F.lit(0), lambda a, x: a + x)
    found = F.col("pixels").isNotNull() & (n > 0)
    return scenes.withColumns({"bin": F.when(found, F.least(F.floor(F.floor(p75) * BINS / LEVELS), F.lit(BINS - 1)).cast("int")), "luminance": F.when(found, total / n)})


#: Levels of a pixel; pixels that are counted together; pictures that one task counts at a time.
LEVELS, SLAB, HELD = 256, 1024, 4096
COUNTS = "camera_id string, bin int, slab int, sign int, counts binary"


def level_counts(scenes: DataFrame, sign: int = 1) -> DataFrame:
    """COUNTS: how often each pixel of a slab had each grey level, over pictures (vec_id, camera_id, bin, parts,
    pixels), compressed. A camera's pictures of a bin are counted in `parts` tasks; the counts then add up."""
    slabs = F.transform(F.sequence(F.lit(0), F.floor((F.size("pixels") - 1) / SLAB).cast("int")), lambda i: F.struct(i.alias("slab"), F.slice("pixels", i * SLAB + 1, F.lit(SLAB)).alias("x")))
    rows = scenes.select("camera_id", "bin", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"), F.explode(slabs).alias("s")).select("camera_id", "bin", "part", "s.slab", "s.x")

    def count(group: pa.Table) -> pa.Table:
        total = np.zeros(SLAB * LEVELS, np.int64)
        for x in group.column("x").chunks:
            at = np.arange(len(x.flatten())) - np.repeat(x.offsets.to_numpy()[:-1] - x.offsets.to_numpy()[0], pc.list_value_length(x).to_numpy())
            seen = x.flatten().is_valid().to_numpy(zero_copy_only=False)
            levels = pc.fill_null(x.flatten(), 0).to_numpy()
            if len(levels) and (levels.min() < 0 or levels.max() >= LEVELS):
                raise ValueError(f"a grey level is from 0 to {LEVELS - 1}")
            total += np.bincount((at * LEVELS + levels)[seen], minlength=SLAB * LEVELS)
        one = group.slice(0, 1).select(["camera_id", "bin", "slab"])
        return one.append_column("sign", pa.array([sign], pa.int32())).append_column("counts", pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)]))

    return rows.groupBy("camera_id", "bin", "slab", "part").applyInArrow(count, COUNTS)


def middle(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower and the upper middle level of each row of counts, which are one if the number is odd."""
    n, upto = counts.sum(1), np.cumsum(counts, 1)
    return (upto > ((n - 1) // 2)[:, None]).argmax(1), (upto > (n // 2)[:, None]).argmax(1)


def from_counts(counts: DataFrame, frames: DataFrame) -> DataFrame:
    """(camera_id, bin, frames, pos, median, spread) of COUNTS that are added up by sign, for the pairs in frames
    (camera_id, bin, frames). Medians and the distances from them follow from the counts alone."""

    def found(group: pa.Table) -> pa.Table:
        total = np.zeros((SLAB, LEVELS), np.int64)
        for sign, packed in zip(group.column("sign").to_pylist(), group.column("counts").to_pylist()):
            total += sign * np.frombuffer(zlib.decompress(packed), "<i8").reshape(SLAB, LEVELS)
        pos = np.flatnonzero(total.sum(1))
        total = total[pos]
        low, high = middle(total)
        apart = np.abs(2 * np.arange(LEVELS)[None, :] - (low + high)[:, None])  # in halves of a level
        spread = np.bincount((np.arange(len(pos))[:, None] * 2 * LEVELS + apart).ravel(), total.ravel(), len(pos) * 2 * LEVELS).reshape(len(pos), 2 * LEVELS).astype(np.int64)
        near, far = middle(spread)
        one = {c: [group.column(c)[0].as_py()] * len(pos) for c in ("camera_id", "bin", "frames")}
        return pa.Table.from_pydict({**one, "pos": pos + SLAB * group.column("slab")[0].as_py(), "median": (low + high) // 2, "spread": (near + far) / 4}, pa.schema([("camera_id", pa.string()), ("bin", pa.int32()), ("frames", pa.int64()), ("pos", pa.int32()), ("median", pa.int32()), ("spread", pa.float64())]))

    pairs = frames.select(F.col("camera_id").alias("_camera"), F.col("bin").alias("_bin"), "frames")
    rows = counts.join(pairs, F.col("camera_id").eqNullSafe(F.col("_camera")) & (F.col("bin") == F.col("_bin"))).drop("_camera", "_bin")
    return rows.groupBy("camera_id", "bin", "frames", "slab").applyInArrow(found, "camera_id string, bin int, frames long, pos int, median int, spread double")


def in_bins(binned: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(camera_id, bin, frames) of the pairs with `least` pictures at least, and their pictures, ready to be counted."""
    frames = binned.where("bin IS NOT NULL").groupBy("camera_id", "bin").agg(F.count("*").alias("frames")).where(F.col("frames") >= least)
    pairs = frames.select(F.col("camera_id").alias("_camera"), F.col("bin").alias("_bin"), F.ceil(F.col("frames") / HELD).alias("parts"))
    return frames, binned.join(pairs, F.col("camera_id").eqNullSafe(F.col("_camera")) & (F.col("bin") == F.col("_bin"))).select("vec_id", "camera_id", "bin", "parts", "pixels")


def reference(scenes: DataFrame, least: int = 15) -> DataFrame:
    """(camera_id, bin, frames, pos, median, spread): per pixel the median, cut to a whole level, and
    the median distance from the median; groups of fewer than `least` frames are left out. No row is a pixel
    before the result: slabs of pixels are counted by grey level, and counts are added up."""
    frames, pictures = in_bins(brightness(scenes), least)
    return from_counts(level_counts(pictures), frames)


def by_lighting(model: DataFrame) -> DataFrame:
    """(camera_id, bin, r_bin, ref): for each camera and bin the reference to compare with, that of the nearest
    bin, at most one away and the lower of two. Looked up by equal keys, so a stream can be joined to it."""
    ref = model.groupBy("camera_id", F.col("bin").alias("r_bin")).agg(F.array_sort(F.collect_list(F.struct("pos", "median", "spread"))).alias("ref"))
    near = ref.withColumn("bin", F.explode(F.sequence(F.greatest(F.col("r_bin") - 1, F.lit(0)), F.least(F.col("r_bin") + 1, F.lit(BINS - 1)))))
    best = near.groupBy("camera_id", "bin").agg(F.min_by(F.struct("r_bin", "ref"), F.struct(F.abs(F.col("bin") - F.col("r_bin")), "r_bin")).alias("x"))
    return best.select(F.col("camera_id").alias("r_camera"), F.col("bin").alias("l_bin"), "x.r_bin", "x.ref")


def compared(scenes: DataFrame, model: DataFrame, limits: Thresholds = Thresholds(), side: int = 8, band: DataFrame | None = None) -> DataFrame:
    """scenes with what the comparison found: `ref` (null without one), `same_size`, `obstructed` (by row),
    `band_rows` and `changed`. References are those of by_lighting(). With bands (camera_id, top, bottom)
    only rows within a camera's band count as band_rows. scenes may be a stream."""
    one = brightness(scenes).join(by_lighting(model), (F.col("camera_id") == F.col("r_camera")) & (F.col("bin") == F.col("l_bin")), "left").drop("r_camera", "l_bin")
    one = one.withColumn("same_size", F.size("pixels") == F.size("ref"))
    changed = F.zip_with("pixels", "ref", lambda x, r: (F.abs(x - r["median"]) > F.greatest(F.lit(float(limits.changed_pixel)), limits.spread_multiple * r["spread"])).cast("int"))
    one = one.withColumn("mask", F.when(F.col("same_size"), changed))
    rows = F.transform(F.sequence(F.lit(0), (F.size("mask") / side).cast("int") - 1), lambda i: F.aggregate(F.slice("mask", i * side + 1, side), F.lit(0), lambda a, x: a + x) / side)
    one = one.withColumn("obstructed", F.transform(rows, lambda d: (d > limits.row_density).cast("int")))
    inside = F.lit(True)
    if band is not None:
        one = one.join(band.select(F.col("camera_id").alias("b_camera"), "top", "bottom"), F.col("camera_id") == F.col("b_camera"), "left")
        counted = F.transform("obstructed", lambda o, i: F.when(F.col("top").isNull() | ((i >= F.col("top")) & (i < F.col("bottom"))), o).otherwise(0))
    else:
        counted = F.transform("obstructed", lambda o, i: F.when(inside, o).otherwise(0))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    return one.withColumns({"band_rows": total(counted), "changed": total("mask") / F.size("mask")})


def percent(x: Column) -> Column:
    """A share in whole percent, ties to even."""
    return F.concat(F.bround(x * 100, 0).cast("int").cast("string"), F.lit("%"))


def judged(scenes: DataFrame, model: DataFrame, limits: Thresholds = Thresholds(), side: int = 8, band: DataFrame | None = None) -> DataFrame:
    """vec_id, camera_id, state, confidence, reason, version: a verdict for each scene."""
    return with_verdicts(scenes, model, limits, side, band).select("vec_id", "camera_id", "state", "confidence", "reason", "version")


def reference_scorer(model: DataFrame, limits: Thresholds = Thresholds(), side: int = 8, band: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """A scorer (see scoring) of frames with `pixels`, for batches and streams; the pixels go."""
    return lambda frames: with_verdicts(frames, model, limits, side, band).select(*[c for c in frames.columns if c != "pixels"], "state", "confidence", "reason", "version")


def with_verdicts(scenes: DataFrame, model: DataFrame, limits: Thresholds = Thresholds(), side: int = 8, band: DataFrame | None = None) -> DataFrame:
    """scenes with state, confidence, reason and version. What can't be read, is too dark, has no reference or
    another size, or is in between, is UNKNOWN with confidence 0."""
    one = compared(scenes, model, limits, side, band)
    rows, changed = F.col("band_rows"), percent(F.col("changed"))
    ladder = [
        (F.col("bin").isNull(), "UNKNOWN", 0.0, F.lit("unreadable picture")),
        (F.col("luminance") < limits.dark, "UNKNOWN", 0.0, F.concat(F.lit("below the limit of light (mean level "), F.bround("luminance", 0).cast("int").cast("string"), F.lit(")"))),
        (F.col("ref").isNull(), "UNKNOWN", 0.0, F.lit("nothing to compare with at this brightness")),
        (~F.col("same_size"), "UNKNOWN", 0.0, F.lit("another number of pixels than the reference")),
        (rows >= limits.least_rows, "BLOCKED", F.least(F.lit(0.95), 0.6 + 0.35 * F.least(F.lit(1.0), rows / (3 * limits.least_rows))), F.concat(F.lit("obstructed in "), rows, F.lit(" rows, "), changed, F.lit(" of pixels changed"))),
        (F.col("changed") <= limits.clear_fraction, "CLEAR", 0.85, F.concat(F.lit("looks as when empty ("), changed, F.lit(" changed)"))),
        (F.lit(True), "UNKNOWN", 0.0, F.concat(changed, F.lit(" changed, but full rows are too few ("), rows, F.lit(")"))),
    ]
    state = conf = reason = F
    for when, s, c, text in ladder:
        state, conf, reason = state.when(when, F.lit(s)), conf.when(when, c if isinstance(c, Column) else F.lit(c)), reason.when(when, text)
    return one.withColumns({"state": state, "confidence": F.round(conf, 6), "reason": F.substring(reason, 1, 200), "version": F.lit(limits.version)})


def bands(blocked: DataFrame, model: DataFrame, limits: Thresholds = Thresholds(), side: int = 8, support: float = 0.5, pad: int = 6) -> DataFrame:
    """(camera_id, top, bottom, profiles): the rows in which blocked pictures of a camera are obstructed, half
    of them at least, widened by `pad`; and how many pictures could be compared. A camera without such
    rows has no band."""
    seen = compared(blocked, model, limits, side).where("obstructed IS NOT NULL").select("camera_id", F.posexplode("obstructed").alias("row", "o"))
    rows = seen.groupBy("camera_id", "row").agg(F.avg("o").alias("support"), F.count("*").alias("profiles"))
    per = rows.groupBy("camera_id").agg(F.min(F.when(F.col("support") >= support, F.col("row"))).alias("low"), F.max(F.when(F.col("support") >= support, F.col("row"))).alias("high"), (F.max("row") + 1).alias("height"), F.max("profiles").alias("profiles"))
    return per.where("low IS NOT NULL").select("camera_id", F.greatest(F.lit(0), F.col("low") - pad).alias("top"), F.least(F.col("height"), F.col("high") + pad + 1).alias("bottom"), "profiles")


def refined(scenes: DataFrame, limits: Thresholds = Thresholds(), least: int = 15, side: int = 8, band: DataFrame | None = None) -> DataFrame:
    """reference() of the scenes that don't look blocked against the reference of all of them. A camera that
    would lose more than half of its scenes, or have too few, keeps the first one. All scenes are counted once;
    those that look blocked are counted and taken off again."""
    wide = ["vec_id", "camera_id", "pixels"]
    frames, pictures = in_bins(brightness(scenes.select(*wide)), least)
    counts = files.held(level_counts(pictures), "counts")
    first = files.held(from_counts(counts, frames), "reference")
    clear = F.coalesce(F.col("ref").isNotNull() & (F.col("band_rows") < limits.least_rows), F.lit(False))
    seen = files.held(compared(scenes.select(*wide), first, limits, side, band).select("vec_id", "camera_id", "bin", clear.alias("clear"), F.when(~clear, F.col("pixels")).alias("pixels")), "seen")
    per = seen.groupBy("camera_id").agg(F.count("*").alias("n"), F.count_if("clear").alias("k"))
    again = per.where(F.col("k") >= F.greatest(F.lit(least), F.floor(F.col("n") / 2))).select("camera_id")
    frames2 = seen.where("clear").join(again, "camera_id", "left_semi").groupBy("camera_id", "bin").agg(F.count("*").alias("frames")).where(F.col("frames") >= least)
    gone = seen.where("NOT clear AND bin IS NOT NULL").withColumn("parts", F.lit(1)).join(frames2.select("camera_id", "bin"), ["camera_id", "bin"], "left_semi")
    parts = gone.groupBy(F.col("camera_id").alias("_camera"), F.col("bin").alias("_bin")).agg(F.ceil(F.count("*") / HELD).alias("parts"))
    gone = gone.drop("parts").join(parts, (F.col("camera_id") == F.col("_camera")) & (F.col("bin") == F.col("_bin")))
    second = from_counts(counts.unionByName(level_counts(gone, -1)), frames2)
    return first.join(again, "camera_id", "left_anti").unionByName(second)


def softmax_verdict(rows: DataFrame, blocked: str, clear: str, high: float = 0.7, low: float = 0.3) -> DataFrame:
    """State, confidence and reason from two logits: at least `high` is BLOCKED, at most `low` CLEAR."""
    p = 1 / (1 + F.exp(F.col(clear) - F.col(blocked)))
    state = F.when(F.col("p") >= high, "BLOCKED").when(F.col("p") <= low, "CLEAR").otherwise("UNKNOWN")
    reason = F.format_string("p(blocked) %.2f", F.round("p", 2))
    return rows.withColumn("p", p).withColumns({"state": state, "confidence": F.when(F.col("p") >= high, F.col("p")).when(F.col("p") <= low, 1 - F.col("p")).otherwise(0.0), "reason": reason})
