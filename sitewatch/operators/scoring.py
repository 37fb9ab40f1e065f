"""From frames to observations: which frames are judged, by what, and how a verdict becomes a record.

A scorer is a function from frames (with their pictures, features or whatever it needs) to frames with
`state`, `confidence`, `reason` and `version`. The same function serves a batch and a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..sources.files import STATES

Scorer = Callable[[DataFrame], DataFrame]
#: What a camera that doesn't view its site earns for a frame.
UNSCORED_VERSION, UNSCORED_REASON = "unscored/1", "not judged: the tracks are out of view"
REASON = 200
_scorers: dict[str, Scorer] = {}


def register(name: str, scorer: Scorer) -> Scorer:
    _scorers[name] = scorer
    return scorer


def scorer(name: str) -> Scorer:
    if name not in _scorers:
        raise ValueError(f"no scorer {name!r}; there are {sorted(_scorers)}")
    return _scorers[name]


def by_table(verdicts: DataFrame, key: str = "object_key") -> Scorer:
    """A scorer that looks verdicts up (key, state, confidence, reason, version): the injected judge."""
    return lambda frames: frames.join(verdicts, key)


def scoreable(frames: DataFrame, roster: DataFrame) -> DataFrame:
    """Frames that bring a new picture of an enabled camera, with the roster's crossing_id and scores."""
    of = roster.select(F.col("camera_id").alias("_cam"), F.col("crossing_id").alias("_site"), "scores")
    rows = frames.drop("crossing_id").join(of, F.col("camera_id") == F.col("_cam"))
    return rows.where("object_key IS NOT NULL AND status NOT IN ('duplicate', 'not_modified')").withColumnRenamed("_site", "crossing_id").drop("_cam")


def minted(rows: DataFrame) -> DataFrame:
    """rows with verdicts as observations: UNKNOWN has no confidence, the reason is cut, and what is no
    state is UNKNOWN."""
    state = F.when(F.col("state").isin(*STATES), F.col("state")).otherwise("UNKNOWN")
    rows = rows.withColumn("state", state)
    return rows.withColumns({"confidence": F.when(F.col("state") == "UNKNOWN", 0.0).otherwise(F.col("confidence")), "reason": F.substring("reason", 1, REASON)})


def unscored(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"state": F.lit("UNKNOWN"), "confidence": F.lit(0.0), "reason": F.lit(UNSCORED_REASON), "version": F.lit(UNSCORED_VERSION)})


def score(frames: DataFrame, roster: DataFrame, judge: Scorer) -> DataFrame:
    """Observations of the frames: cameras that score are judged, the others get the fixed record."""
    rows = scoreable(frames, roster)
    seen = minted(judge(rows.where("scores")))
    return seen.unionByName(unscored(rows.where("NOT scores")), allowMissingColumns=True).drop("scores")


def groups(roster: DataFrame) -> DataFrame:
    """Per crossing of a roster (camera_id, crossing_id, scores, lat, lon): its cameras, those that score, and
    the first coordinates there are."""
    there = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    names = lambda on: F.array_sort(F.collect_set(F.when(on, F.col("camera_id"))))
    rows = roster.groupBy("crossing_id").agg(names(F.lit(True)).alias("cameras"), names(F.col("scores")).alias("witnesses"), F.min_by(F.when(there, F.struct("lat", "lon")), F.when(there, F.col("camera_id"))).alias("at"))
    return rows.select("crossing_id", "cameras", "witnesses", "at.lat", "at.lon")


def in_window(rows: DataFrame, since: int | None, until: int | None) -> DataFrame:
    """Rows from `since` on, before `until`."""
    rows = rows if since is None else rows.where(F.col("t") >= since)
    return rows if until is None else rows.where(F.col("t") < until)


def scan(frames: DataFrame, roster: DataFrame, judge: Scorer, camera: str | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """The observation job: a camera's frames of a window, scored."""
    frames = frames if camera is None else frames.where(F.col("camera_id") == camera)
    return score(in_window(frames, since, until), roster, judge)


def counts(frames: DataFrame, observations: DataFrame) -> DataFrame:
    """By camera: observations of each state, and frames that gave none."""
    of = lambda s: F.count_if(F.col("state") == s).alias(s.lower())
    scored = observations.groupBy("camera_id").agg(*map(of, ("BLOCKED", "CLEAR", "UNKNOWN")), F.count("*").alias("scored"))
    seen = frames.groupBy("camera_id").agg(F.count("*").alias("frames"))
    names = ("blocked", "clear", "unknown", "scored")
    out = seen.join(scored, "camera_id", "left").select("camera_id", "frames", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    return out.withColumn("skipped", F.col("frames") - F.col("scored")).drop("frames")


def routed(frames: DataFrame, trained: DataFrame, classifier: Scorer, otherwise: Scorer) -> DataFrame:
    """Frames of cameras with a trained model by the classifier, all others by the other scorer; each row
    has the version of what judged it."""
    cameras = trained.select("camera_id").distinct()
    return classifier(frames.join(cameras, "camera_id", "left_semi")).unionByName(otherwise(frames.join(cameras, "camera_id", "left_anti")), allowMissingColumns=True)


#: What a classifier gives for a frame; trouble is why it gave nothing, else empty.
LOGITS = StructType([StructField("clear", DoubleType()), StructField("blocked", DoubleType()), StructField("trouble", StringType())])


def logits(load: Callable[[str], Callable | None]) -> Callable:
    """For predict_batch_udf: a function from cameras and a matrix of features, a row each, to LOGITS. load(camera)
    gives a function from a matrix to two logits a row, or None; it is called once a worker and camera. Where a
    model fails on a batch its rows are tried one by one, so that only those fail which fail alone."""
    models: dict = {}

    def of(camera: str, rows: np.ndarray) -> list[dict]:
        try:
            if camera not in models:
                models[camera] = load(camera)
            if models[camera] is None:
                raise ValueError("no model for this camera")
            found = np.asarray(models[camera](rows), float)
            if found.shape != (len(rows), 2):
                raise ValueError(f"a model gave {found.shape} for {len(rows)} frames")
            return [{"clear": c, "blocked": b, "trouble": ""} for c, b in found.tolist()]
        except Exception as e:  # a scorer never raises
            if len(rows) > 1 and models.get(camera) is not None:
                return [of(camera, rows[i : i + 1])[0] for i in range(len(rows))]
            return [{"clear": float("nan"), "blocked": float("nan"), "trouble": str(e)[:REASON] or type(e).__name__}] * len(rows)

    def predict(cameras: np.ndarray, features: np.ndarray) -> list[dict]:
        out: list = [None] * len(cameras)
        names = np.array(["" if c is None else str(c) for c in cameras.tolist()])
        for camera in np.unique(names):
            at = np.flatnonzero(names == camera)
            for i, row in zip(at, of(str(camera), features[at])):
                out[i] = row
        return out

    return lambda: predict


def classified(frames: DataFrame, load: Callable[[str], Callable | None], version: str, width: int, batch: int = 256) -> DataFrame:
    """frames (event_id, camera_id, features) judged by a model of each camera, `batch` at a time: see logits().
    No model, no features of `width` numbers or a failing model is UNKNOWN and never an error."""
    from pyspark.ml.functions import predict_batch_udf

    from .scenes import softmax_verdict

    model = predict_batch_udf(lambda: logits(load)(), return_type=LOGITS, batch_size=batch, input_tensor_shapes=[None, [width]])
    there = F.coalesce((F.size("features") == width) & ~F.exists("features", lambda x: x.isNull()), F.lit(False))
    full = F.when(there, F.col("features").cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), width))
    rows = frames.select("event_id", "camera_id", there.alias("_there"), model("camera_id", full).alias("_m"))
    rows = rows.select("event_id", "camera_id", "_m.clear", "_m.blocked", F.when(F.col("_there"), F.nullif(F.col("_m.trouble"), F.lit(""))).otherwise("unreadable picture").alias("trouble"))
    judged = softmax_verdict(rows, "blocked", "clear")
    bad = F.col("trouble").isNotNull()
    return judged.select("event_id", "camera_id", F.when(bad, "UNKNOWN").otherwise(F.col("state")).alias("state"), F.when(bad, 0.0).otherwise(F.col("confidence")).alias("confidence"), F.when(bad, F.col("trouble")).otherwise(F.col("reason")).alias("reason"), F.lit(version).alias("version"))


def classifier_version(name: str, weights: bytes, high: float = 0.7) -> str:
    return f"{name}-c{high}-h{hashlib.sha256(weights).hexdigest()[:12]}"


def auto_version(*versions: str) -> str:
    return f"auto({'|'.join(versions)})"


def prompt_version(model: str, prompt: str) -> str:
    return f"{model}/{hashlib.sha256(prompt.encode()).hexdigest()[:8]}"


def content_hash(data: str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.col(data).cast("binary"), 256))


def moment(text: str) -> datetime:
    """An instant from ISO text; without an offset it is UTC; what isn't one raises."""
    at = datetime.fromisoformat(text)
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def window_of(now: datetime, start: str | None = None, end: str | None = None, hours: float = 24) -> tuple[int, int]:
    """(low, high) in ms: up to `end` or now; from `start`, or so many hours before."""
    high = moment(end) if end else now
    low = moment(start) if start else high - timedelta(hours=hours)
    ms = lambda d: (d - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)
    return ms(low), ms(high)


def two_class_head(rows: DataFrame, features: str = "features", label: str = "label", weights: tuple[float, float] = (1.0, 2.0)):
    """A linear head on fixed features (an array): label 1 weighs more. Returns a function that adds
    `predicted` and `p`."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vector = lambda df: df.withColumn("_x", array_to_vector(F.col(features).cast("array<double>")))
    weighed = vector(rows).withColumns({"_y": F.col(label).cast("double"), "_w": F.when(F.col(label) == 1, weights[1]).otherwise(weights[0])})
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1e-3, maxIter=50, probabilityCol="_p", predictionCol="_q", rawPredictionCol="_m").fit(weighed)
    return lambda df: model.transform(vector(df)).withColumns({"p": vector_to_array("_p")[1], "predicted": F.col("_q").cast("int")}).drop("_x", "_p", "_q", "_m")
