"""Files the engine reads and writes: JSON lines of records with strict decoding, rosters, inventories,
label files, picture files, stores of reference models, listings.

A line is one record. What isn't a record of its schema, by its fields and their types, is kept apart with the
reason rather than dropped: decode() gives every line, valid() and quarantined() its two halves.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

STATES = ("CLEAR", "BLOCKED", "UNKNOWN")
STATUSES = ("ok", "not_modified", "duplicate", "error")
STAMPS = ("last_modified", "fetched_at")


@dataclass(frozen=True)
class Record:
    """A kind of record: its fields, which of them must be there, and rules (name, SQL that must hold)."""

    fields: str
    required: tuple[str, ...]
    rules: tuple[tuple[str, str], ...] = ()

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.fields)


def one_of(field: str, values: tuple[str, ...]) -> tuple[str, str]:
    return f"bad {field}", f"{field} IS NULL OR {field} IN ({', '.join(repr(v) for v in values)})"


FRAME = Record(
    "camera_id string, crossing_id string, captured_at string, captured_at_source string, fetched_at string, fetch_status string, object_key string, content_hash string, image_bytes long, error string, poller_version string",
    ("camera_id", "crossing_id", "captured_at", "captured_at_source", "fetched_at", "poller_version"),
    (one_of("fetch_status", STATUSES), one_of("captured_at_source", STAMPS)),
)
OBSERVATION = Record(
    "crossing_id string, camera_id string, captured_at string, observed_at string, state string, confidence double, reason string, object_key string, detector_version string",
    ("crossing_id", "camera_id", "captured_at", "observed_at", "state", "confidence", "detector_version"),
    (one_of("state", STATES), ("bad confidence", "confidence BETWEEN 0 AND 1")),
)
SESSION = Record(
    "session_id string, crossing_id string, started_at string, ended_at string, duration_seconds long, peak_queue_occupancy double, is_open boolean, detector_version string, observation_count long",
    ("session_id", "crossing_id", "started_at", "detector_version"),
)
CAMERA = Record(
    "camera_id string, name string, crossing_id string, image_url string, source string, lat double, lon double, scores boolean, poll_interval_seconds double, enabled boolean, notes string",
    ("camera_id", "name", "crossing_id", "image_url"),
    (("bad image_url", "image_url RLIKE '^https?://[^/ ]+'"), ("bad source", "source IS NULL OR source RLIKE '^(manual|[a-z]+_inventory)$'"), ("bad poll_interval_seconds", "poll_interval_seconds IS NULL OR poll_interval_seconds >= 15")),
)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir). Without one a
    temporary folder serves, but on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sitewatch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def held(rows: DataFrame, name: str) -> DataFrame:
    """rows written to scratch() and read again, where several steps need them."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def utc_ms(text: str) -> Column:
    """Milliseconds of an ISO instant; without an offset it is UTC, whatever the session's zone."""
    return F.expr(f"unix_millis(try_to_timestamp(CASE WHEN {text} RLIKE '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$' THEN {text} ELSE concat({text}, 'Z') END))")


def iso(ms: str) -> Column:
    from ..functions.scalars import iso_text

    return F.expr(iso_text(ms))


def lines(spark: SparkSession, path: str, glob: str = "*.jsonl*") -> DataFrame:
    """(value, path) of every line below a folder, .gz files too; blank lines are none."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("path")).where(F.length(F.trim("value")) > 0)


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with further columns, each computed once a row. Through a projection Spark takes a filter down, with the whole
    expression in place of each use of its name, so that a line was parsed dozens of times; it doesn't through a
    generator, here one of a single row."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def decode(rows: DataFrame, kind: Record) -> DataFrame:
    """rows (value, ...) with `record`, and `problem`: why the line is no record of its kind, else null.
    Null values (tombstones) are left out.

    A line is one JSON object, with no field twice and nothing before or behind it. try_parse_json stops at the end of
    the first value, so the text is put in an object with a mark of its own behind it: only where that object has
    these two fields is the text one value."""
    mark = "cast(xxhash64(value) AS string)"
    rows = once(rows.where("value IS NOT NULL"), _given=F.expr(f"try_parse_json(concat('{{\"r\":', value, ',\"m\":\"', {mark}, '\"}}'))"))
    shape = F.expr(f"CASE WHEN try_variant_get(_given, '$.m', 'string') = {mark} THEN schema_of_variant(_given) END")
    return checked(once(rows, _shape=shape), kind, "$.r", "OBJECT<m: STRING, r: ", ">")


#: By type of a field, what a JSON value must be.
FITS = {"string": "STRING", "boolean": "BOOLEAN", "bigint": "(?:BIGINT|DOUBLE|DECIMAL[^A-Za-z]*|STRING)", "double": "(?:BIGINT|DOUBLE|DECIMAL[^A-Za-z]*|STRING)"}


def plain(kind: Record) -> str:
    """What schema_of_variant says (fields by name) of an object that has the required fields, none but the kind's, and
    all of fitting types."""
    fields = sorted((f.name, FITS[f.dataType.simpleString()]) for f in kind.schema)
    return "OBJECT<" + "".join(f"{n}: {fit}(?:, |(?=>))" if n in kind.required else f"(?:{n}: (?:{fit}|VOID)(?:, |(?=>)))?" for n, fit in fields) + ">"


def checked(rows: DataFrame, kind: Record, root: str = "$", before: str = "", behind: str = "") -> DataFrame:
    """rows (_given, a variant with an object at the path `root`; _shape, what schema_of_variant says of it, in which
    the object's stands between `before` and `behind`; ...) with `record` and `problem`. A text must be given as a
    text, a yes or no as one; a number as a number, or a text that is one. An explicit null is as good as no field."""
    fields = {f.name: f.dataType.simpleString() for f in kind.schema}
    at = lambda n, as_: F.expr(f"try_variant_get(_given, '{root}.{n}', '{as_}')")
    flat = once(rows, _plain=F.coalesce(F.col("_shape").rlike(f"^{before}{plain(kind)}{behind}$"), F.lit(False)))
    # only what isn't plain is looked at field by field; with fields beside `root`, a line is more than one value
    alone = F.expr("size(try_variant_get(_given, '$', 'map<string,variant>')) = 2") if root != "$" else F.lit(True)
    flat = once(flat, _object=F.col("_plain") | F.coalesce(F.col("_shape").startswith(before + "OBJECT<") & alone, F.lit(False)))
    values = F.when(F.col("_object"), F.expr(f"try_variant_get(_given, '{root}', 'struct<{', '.join(f'{n}: {t}' for n, t in fields.items())}>')"))
    flat = flat.select("*", F.inline(F.array(values)).alias(*[f"_f_{n}" for n in fields]))
    flat = once(flat, _parts=F.when(F.col("_object") & ~F.col("_plain"), F.expr(f"try_variant_get(_given, '{root}', 'map<string,variant>')")))
    # by one expression a field, as Spark's generated code runs no lambdas
    kind_of = lambda n: F.coalesce(F.schema_of_variant(F.try_element_at("_parts", F.lit(n))), F.lit("VOID"))
    form = F.coalesce(
        F.when(F.size(F.array_except(F.map_keys("_parts"), F.array(*map(F.lit, fields)))) > 0, "unknown field"), *[F.when(kind_of(n) == "VOID", f"without {n}") for n in kind.required],
        *[F.when(~kind_of(n).rlike(f"^(?:{FITS[t]}|VOID)$"), f"bad {n}") for n, t in fields.items()])
    flat = once(flat, _form=F.when(~F.col("_object"), "malformed").when(~F.col("_plain"), form))
    # a number that none was made of, or only by cutting it; a time that isn't one
    off = {n: F.when(F.col(f"_f_{n}").isNull(), at(n, "string").isNotNull()).otherwise(F.col(f"_f_{n}").cast("double") != at(n, "double") if t == "bigint" else F.lit(False)) for n, t in fields.items() if t in ("bigint", "double")}
    off |= {n: F.col(f"_f_{n}").isNotNull() & utc_ms(f"_f_{n}").isNull() for n in fields if n.endswith("_at")}

    def broken(label: str, rule: str) -> Column:
        for name in fields:
            rule = rule.replace(name, f"_f_{name}") if name in rule.split() else rule
        return F.when(~F.expr(rule), label)

    problem = F.coalesce("_form", *[F.when(bad, f"bad {n}") for n, bad in off.items()], *[broken(*r) for r in kind.rules])
    record = F.struct(*[F.col(f"_f_{n}").alias(n) for n in fields])
    return once(flat, problem=problem).select(*[c for c in rows.columns if c not in ("_given", "_shape")], record.alias("record"), "problem")


def valid(decoded: DataFrame) -> DataFrame:
    return decoded.where("problem IS NULL").select("record.*")


def quarantined(decoded: DataFrame) -> DataFrame:
    return decoded.where("problem IS NOT NULL").drop("record")


def read_frames(spark: SparkSession, path: str, camera: str | list[str] | None = None, glob: str = "*.jsonl*") -> DataFrame:
    """decode() of the frame records below `path`; with `camera`, of the files in folders of that name, or of
    one of several names, only: the folder is listed once."""
    found = lines(spark, path, glob)
    names = [camera] if isinstance(camera, str) else camera
    if names is not None:
        found = found.where(F.exists(F.split("path", "/"), lambda p: p.isin(*names) | F.substring_index(p, "=", -1).isin(*names)))
    return decode(found, FRAME)


def frames_of(decoded: DataFrame) -> DataFrame:
    """Valid frame records, their instants in ms (t, fetched)."""
    return valid(decoded).withColumns({"t": utc_ms("captured_at"), "fetched": utc_ms("fetched_at"), "status": F.coalesce("fetch_status", F.lit("ok"))})


def in_order(frames: DataFrame) -> DataFrame:
    """Frames in event order; the last step, for a union keeps no order. A sort reads what it sorts twice, first to find
    its ranges, so the frames are held: else each line would be read and decoded twice."""
    return held(frames, "frames").orderBy("t", "camera_id", "fetched")


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """decode() of the observation records below `path`, the input of a rebuild."""
    return decode(lines(spark, path), OBSERVATION)


def readings_of(decoded: DataFrame) -> DataFrame:
    return valid(decoded).select("crossing_id", "camera_id", utc_ms("captured_at").alias("t"), "state", "confidence", "reason", "object_key", F.col("detector_version").alias("version"))


def write_lines(rows: DataFrame, path: str, by: tuple[str, ...] = (), packed: bool = False) -> None:
    """rows as JSON lines below `path`, in folders by `by`; nulls are left out."""
    writer = rows.write.mode("append").option("compression", "gzip" if packed else "none")
    (writer.partitionBy(*by) if by else writer).option("ignoreNullFields", "true").json(path)


def roster_entries(spark: SparkSession, path: str) -> DataFrame:
    """(value, record, problem) of each camera of a roster: a JSON list, or an object with the list as `cameras`."""
    text = spark.read.option("wholetext", "true").text(path).where(F.length(F.trim("value")) > 0)
    whole = F.expr("coalesce(try_variant_get(try_parse_json(value), '$.cameras', 'array<variant>'), try_variant_get(try_parse_json(value), '$', 'array<variant>'), array(cast(NULL AS variant)))")
    each = text.select(F.explode(whole).alias("_given")).select(F.expr("to_json(_given)").alias("value"), "_given", F.expr("schema_of_variant(_given)").alias("_shape"))
    return checked(each, CAMERA)


def load_roster(spark: SparkSession, path: str) -> DataFrame:
    """The enabled cameras of a roster. One bad camera makes the whole roster an error, as does a roster without
    an enabled one: a camera that is left out in silence would just go unseen."""
    entries = roster_entries(spark, path)
    bad = entries.where("problem IS NOT NULL").select("problem", F.substring(F.coalesce("value", F.lit("no list of cameras")), 1, 200).alias("value")).limit(5).collect()
    if bad:
        raise ValueError(f"{path}: " + "; ".join(f"{r['problem']} in {r['value']}" for r in bad))
    rows = valid(entries).withColumns({"source": F.coalesce("source", F.lit("manual")), "scores": F.coalesce("scores", F.lit(True)), "enabled": F.coalesce("enabled", F.lit(True)), "poll_interval_seconds": F.coalesce("poll_interval_seconds", F.lit(30.0)), "notes": F.coalesce("notes", F.lit(""))})
    rows = rows.where("enabled")
    if rows.isEmpty():
        raise ValueError(f"no enabled camera in {path}")
    return rows


def append_labels(more: DataFrame, path: str, key: str = "object_key") -> int:
    """Appends those rows whose key the label files at `path` lack, one of each; returns how many. Doing it
    again adds nothing."""
    from ..operators.labels import only_new

    spark = more.sparkSession
    fresh = more.dropDuplicates([key])
    if exists(spark, path):
        fresh = only_new(spark.read.schema(more.schema).json(path), more, key)
    held = scratch(spark, "labels")
    fresh.write.parquet(held)  # what is read can't be appended to at once
    fresh = spark.read.schema(more.schema).parquet(held)
    n = fresh.count()
    if n:
        write_lines(fresh, path)
    return n


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def frame_bytes(spark: SparkSession, path: str, frames: DataFrame) -> DataFrame:
    """frames (object_key, ...) with the bytes of their pictures below `path`; those without bytes go, and those
    whose key has another shape than a frame's."""
    from ..functions.scalars import is_frame_key

    frames = frames.where(is_frame_key("object_key"))
    keys = F.regexp_extract(F.col("path"), r"(frames/.*)$", 1)
    pictures = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jpg").load(path)
    return frames.join(pictures.select(keys.alias("_k"), "content"), F.col("object_key") == F.col("_k")).drop("_k")


def save_model(model: DataFrame, band: DataFrame, path: str, limits: dict | None = None) -> None:
    """A reference model (camera_id, bin, frames, pos, median, spread) as rows with arrays, the bands, and the
    thresholds that verdicts on it are to use, by name."""
    rows = model.groupBy("camera_id", "bin", "frames").agg(F.array_sort(F.collect_list(F.struct("pos", "median", "spread"))).alias("pixels"))
    rows.write.mode("overwrite").parquet(f"{path}/bins")
    band.write.mode("overwrite").parquet(f"{path}/bands")
    named = [(k, float(v)) for k, v in sorted((limits or {}).items())]
    band.sparkSession.createDataFrame(named, "name string, value double").coalesce(1).write.mode("overwrite").parquet(f"{path}/limits")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """The model, the bands and the thresholds that save_model() wrote."""
    rows = spark.read.parquet(f"{path}/bins").select("camera_id", "bin", "frames", F.explode("pixels").alias("p"))
    limits = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/limits").collect()}  # one for each threshold
    return rows.select("camera_id", "bin", "frames", "p.pos", "p.median", "p.spread"), spark.read.parquet(f"{path}/bands"), limits


def sync_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """local (key, size) with `upload`: manifests always, other files if the remote listing lacks them."""
    there = remote.select(F.col("key").alias("_k")).distinct()
    return local.join(there, F.col("key") == F.col("_k"), "left").select("key", "size", (F.col("key").startswith("manifests/") | F.col("_k").isNull()).alias("upload"))


def sync_stats(plan: DataFrame) -> DataFrame:
    """uploaded and skipped pictures, the bytes to send, manifests."""
    manifest = F.col("key").startswith("manifests/")
    return plan.agg(F.count_if(F.col("upload") & ~manifest).alias("uploaded"), F.count_if(~F.col("upload")).alias("skipped"), F.coalesce(F.sum(F.when(F.col("upload"), F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(manifest).alias("manifests"))
