"""Further queries: files, scoring, live board, sweeps, pages, training sets; and all of registry's."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalars
from .operators import history, labels, live_board, pages, polling, scenes, scoring, sessions, sweep, training
from .registry import (
    ALERTS_SQL, DAY, FRAMED_SQL, FRAMES_SQL, ISO, LABELS_SQL, LOCAL, MODEL_SQL, NEXT, ORACLE_SQL, QUERIES, RESOLVED_SQL, SESSIONS_SQL, SMALL, bright_sql, derived, framed, query, roster, scenes_sql,
)
from .sources import files, inventory, tables
from .sources.tables import POLLS_SQL, READINGS_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
TAIL = SESSIONS_SQL[len(READINGS_SQL) + 2 :]


def iso_sql(ms: str) -> str:
    return ISO.replace("started", ms)


# --- files ---------------------------------------------------------------------------------------


def frame_lines(spark, sf_dir):
    """camera_id, value: a manifest line for each poll; some are no frame records."""
    f = polling.frames(tables.polls(spark, sf_dir))
    naive = F.when(F.col("event_id") % 2 == 0, files.iso("t")).otherwise(F.regexp_replace(files.iso("t"), r"\+00:00$", ""))
    record = F.struct(
        F.when(F.col("event_id") % 50 != 4, F.col("camera_id")).alias("camera_id"), F.concat(F.lit("X"), F.substring("camera_id", 2, 9).cast("int") % 3).alias("crossing_id"), naive.alias("captured_at"), F.col("t_source").alias("captured_at_source"),
        files.iso("fetched").alias("fetched_at"), F.when(F.col("event_id") % 50 == 1, "lost").otherwise(F.col("status")).alias("fetch_status"), "object_key", F.concat(F.lit("sha256:"), "hash").alias("content_hash"),
        F.col("size").alias("image_bytes"), F.col("message").alias("error"), F.concat(F.lit("p/"), "event_id").alias("poller_version"), F.when(F.col("event_id") % 50 == 0, 1).alias("extra"))
    line = F.when(F.col("event_id") % 50 == 2, F.lit('{"camera_id": "C')).when(F.col("event_id") % 50 == 3, F.lit("  ")).otherwise(F.to_json(record))
    return f.select(F.col("camera_id").alias("cam"), line.alias("value"))


def manifest(spark, sf_dir):
    path = files.scratch(spark, "manifests")
    frame_lines(spark, sf_dir).write.partitionBy("cam").option("compression", "gzip").text(path)
    return path


@query("manifest_scan", f"WITH {FRAMES_SQL} SELECT 'p/' || event_id AS poller_version, camera_id, t, fetched, status, object_key, 'sha256:' || hash AS content_hash FROM frames WHERE event_id % 50 NOT IN (0, 1, 2, 3, 4) AND camera_id IN ('C1', 'C4')")
def _(spark, sf_dir):
    path = manifest(spark, sf_dir)
    found = files.frames_of(files.read_frames(spark, path, ["C1", "C4"], "*"))
    return files.in_order(found.select("poller_version", "camera_id", "t", "fetched", "status", "object_key", "content_hash"))


@query("manifest_quarantine", "SELECT CASE event_id % 50 WHEN 0 THEN 'unknown field' WHEN 1 THEN 'bad fetch_status' WHEN 2 THEN 'malformed' ELSE 'without camera_id' END AS problem, count(*) AS lines FROM events WHERE event_id % 50 IN (0, 1, 2, 4) GROUP BY 1")
def _(spark, sf_dir):
    return files.quarantined(files.decode(files.lines(spark, manifest(spark, sf_dir), "*"), files.FRAME)).groupBy("problem").agg(F.count("*").alias("lines"))


@query("backfill_input", f"WITH {READINGS_SQL} SELECT crossing_id, camera_id, t, state, round(confidence, 6) AS confidence, version FROM readings WHERE event_id % 40 > 1")
def _(spark, sf_dir):
    r = tables.readings(spark, sf_dir)
    path = files.scratch(spark, "observations")
    files.write_lines(r.select("crossing_id", "camera_id", files.iso("t").alias("captured_at"), files.iso("t").alias("observed_at"), F.when(F.col("event_id") % 40 == 1, "JAMMED").otherwise(F.col("state")).alias("state"), F.when(F.col("event_id") % 40 == 0, 1.5).otherwise(F.col("confidence")).alias("confidence"), F.col("version").alias("detector_version")), path)
    got = files.readings_of(files.decode(files.lines(spark, path, "*.json"), files.OBSERVATION))
    return got.select("crossing_id", "camera_id", "t", "state", F.round("confidence", 6).alias("confidence"), "version")


@query("roster_source", f"WITH {READINGS_SQL} SELECT DISTINCT camera_id, crossing_id, camera_id <> 'C5' AS scores, 30.0::DOUBLE AS poll_interval_seconds FROM readings WHERE camera_id <> 'C4'")
def _(spark, sf_dir):
    path = files.scratch(spark, "roster")
    name, url = F.concat(F.lit("Camera "), "camera_id").alias("name"), F.concat(F.lit("https://cams/"), "camera_id").alias("image_url")
    rows = roster(spark, sf_dir).select("camera_id", name, "crossing_id", url, F.when(F.col("camera_id") == "C5", False).alias("scores"), F.when(F.col("camera_id") == "C4", False).alias("enabled"))
    rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(path)  # a roster is some cameras
    return files.load_roster(spark, path).select("camera_id", "crossing_id", "scores", "poll_interval_seconds")


def inventories(spark, sf_dir):
    """payload, value: inventories of a hundred suppliers each, with drifting field names and odd entries."""
    s = tables.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") % 4
    opt = lambda on, c: F.when(on, c)
    item = F.to_json(F.struct(
        opt(k == 0, F.col("s_suppkey")).alias("device-id"), opt(k == 1, F.col("s_suppkey")).alias("deviceId"), opt(k >= 2, F.col("s_suppkey")).alias("id"),
        opt(k != 3, F.col("s_name")).alias("device-name"), opt(k == 3, F.lit("")).alias("deviceName"), F.concat(F.lit("Ramp "), "s_suppkey").alias("cctv-other"), F.concat(F.lit("http://cams/"), "s_suppkey").alias("cctv-url"),
        opt(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal") / 100).alias("latitude"), opt(F.col("s_suppkey") % 7 != 0, F.col("s_nationkey") - 100).alias("lon")))
    raw = F.when(F.col("s_suppkey") % 23 == 0, F.lit("17")).otherwise(item)
    rows = s.groupBy(F.floor(F.col("s_suppkey") / 100).alias("payload")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", raw.alias("raw")))), lambda x: x["raw"]), ",").alias("list"))
    return rows.select("payload", F.when(F.col("payload") % 2 == 0, F.concat(F.lit('{"CCTVInventoryRequest":['), "list", F.lit("]}"))).otherwise(F.concat(F.lit("["), "list", F.lit("]"))).alias("value"))


@query("inventory_items", """WITH p AS (SELECT s_suppkey // 100 AS payload, (row_number() OVER (PARTITION BY s_suppkey // 100 ORDER BY s_suppkey) - 1)::INT AS place, * FROM supplier)
 SELECT payload, place, printf('%6s  %-38s %20s  %s', s_suppkey::VARCHAR, CASE WHEN s_suppkey % 4 = 3 THEN '?' ELSE s_name END, CASE WHEN s_suppkey % 7 = 0 THEN '?' ELSE printf('%.5f,%.5f', (s_acctbal / 100)::DOUBLE, (s_nationkey - 100)::DOUBLE) END, 'Ramp ' || s_suppkey) AS line
 FROM p WHERE s_suppkey % 23 <> 0""")
def _(spark, sf_dir):
    return inventory.described(inventory.items(inventories(spark, sf_dir))).withColumn("payload", F.col("payload").cast("long"))


@query("inventory_resolved", """SELECT upper(s_name) AS name, 'X' || (s_suppkey % 3) AS crossing_id, s_suppkey % 23 <> 0 AND s_suppkey % 4 <> 3 AS found,
   CASE WHEN s_suppkey % 23 <> 0 AND s_suppkey % 4 <> 3 THEN 'cam-' || s_suppkey END AS camera_id, CASE WHEN s_suppkey % 23 <> 0 AND s_suppkey % 4 <> 3 THEN 'https://cams/' || s_suppkey END AS image_url FROM supplier
 UNION ALL SELECT 'ramp-' || s_suppkey, 'X0', s_suppkey % 23 <> 0, CASE WHEN s_suppkey % 23 <> 0 THEN 'cam-' || s_suppkey END, CASE WHEN s_suppkey % 23 <> 0 THEN 'https://cams/' || s_suppkey END FROM supplier WHERE s_suppkey % 4 = 3""")
def _(spark, sf_dir):
    s = tables.table(spark, sf_dir, "supplier")
    targets = s.select(F.upper("s_name").alias("name"), F.concat(F.lit("X"), F.col("s_suppkey") % 3).alias("crossing_id")).union(s.where("s_suppkey % 4 = 3").select(F.concat(F.lit("ramp-"), "s_suppkey"), F.lit("X0")))
    return inventory.resolved(inventory.items(inventories(spark, sf_dir)), targets).select("name", "crossing_id", "found", "camera_id", "image_url")


@query("label_file", f"WITH {READINGS_SQL}, {FRAMED_SQL} SELECT object_key, CASE WHEN event_id % 6 = 0 THEN 'first' ELSE 'second' END AS label FROM framed WHERE event_id % 6 = 0 OR event_id % 9 = 0")
def _(spark, sf_dir):
    f, path = framed(spark, sf_dir), files.scratch(spark, "labels")
    for step, label in ((6, "first"), (9, "second"), (9, "third")):
        files.append_labels(f.where(f"event_id % {step} = 0").select("object_key", F.lit(label).alias("label")), path)
    return spark.read.schema("object_key string, label string").json(path)


@query("sync_plan", f"""WITH {READINGS_SQL}, {FRAMED_SQL}, l AS (SELECT object_key AS key, event_id % 1000 AS size, event_id % 3 = 0 AS there FROM framed UNION ALL SELECT 'manifests/' || digest, 10, true FROM readings WHERE event_id % 100 = 0)
 SELECT count(*) FILTER (NOT there AND key NOT LIKE 'manifests/%') AS uploaded, count(*) FILTER (there AND key NOT LIKE 'manifests/%') AS skipped, coalesce(sum(size) FILTER (NOT there OR key LIKE 'manifests/%'), 0)::BIGINT AS bytes, count(*) FILTER (key LIKE 'manifests/%') AS manifests FROM l""")
def _(spark, sf_dir):
    f = framed(spark, sf_dir)
    local = f.select(F.col("object_key").alias("key"), (F.col("event_id") % 1000).alias("size"), "event_id").union(f.where("event_id % 100 = 0").select(F.concat(F.lit("manifests/"), "digest"), F.lit(10), F.lit(0)))
    return files.sync_stats(files.sync_plan(local.select("key", "size"), local.where("event_id % 3 = 0").select("key")))


@query("training_manifest", ORACLE_SQL["weak_labels"])
def _(spark, sf_dir):
    path = files.scratch(spark, "manifest")
    files.write_lines(QUERIES["weak_labels"](spark, sf_dir), path)
    return spark.read.schema("object_key string, camera_id string, label string, source string, split string").json(path)


@query("model_store", f"""WITH m AS ({ORACLE_SQL["scene_reference"]}) SELECT m.*, 7 AS least_rows, 31.5::DOUBLE AS changed_pixel, 2 AS top FROM m""")
def _(spark, sf_dir):
    path = files.scratch(spark, "model")
    limits = scenes.Thresholds(changed_pixel=31.5, least_rows=7)
    files.save_model(scenes.reference(tables.scenes(spark, sf_dir)), spark.createDataFrame([("C0", 2, 7)], "camera_id string, top int, bottom int"), path, limits.values)
    model, band, found = files.load_model(spark, path)
    found = scenes.Thresholds.of(found)
    return model.withColumns({"spread": F.round("spread", 6), "least_rows": F.lit(found.least_rows), "changed_pixel": F.lit(found.changed_pixel), "top": F.lit(band.first()["top"])})


@query("frame_identity", f"""WITH {READINGS_SQL} SELECT event_id, 'sha256:' || sha256(digest) AS content_hash, 'manifests/' || camera_id || '/' || strftime(make_timestamp(t * 1000), '%Y/%m/%d/%H') || '.jsonl.gz' AS manifest_key,
   floor(t / 1000)::BIGINT AS s FROM readings""")
def _(spark, sf_dir):
    return tables.readings(spark, sf_dir).select("event_id", scoring.content_hash("digest").alias("content_hash"), scalars.manifest_key("camera_id", "t").alias("manifest_key"), F.unix_seconds(F.timestamp_millis("t")).alias("s"))


# --- scoring -------------------------------------------------------------------------------------

VERDICT_SQL = "verdicts AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'UNKNOWN' ELSE state END AS state, CASE WHEN event_id % 11 = 0 THEN 0.4 ELSE confidence END AS confidence, repeat('r', (150 + event_id % 100)::INT) AS reason, 'judge/1' AS version FROM readings)"
SCORED_SQL = f"""{READINGS_SQL}, {FRAMES_SQL}, {VERDICT_SQL}, scored AS (
 SELECT f.event_id, 'X' || (substr(f.camera_id, 2)::INT % 3) AS crossing_id, f.camera_id, f.t, CASE WHEN f.camera_id = 'C5' THEN 'UNKNOWN' ELSE v.state END AS state,
   CASE WHEN f.camera_id = 'C5' OR v.state = 'UNKNOWN' THEN 0 ELSE v.confidence END AS confidence,
   CASE WHEN f.camera_id = 'C5' THEN '{scoring.UNSCORED_REASON}' ELSE substr(v.reason, 1, 200) END AS reason, CASE WHEN f.camera_id = 'C5' THEN '{scoring.UNSCORED_VERSION}' ELSE v.version END AS version
 FROM frames f JOIN verdicts v USING (event_id) WHERE f.object_key IS NOT NULL AND f.status = 'ok')"""


def verdicts(spark, sf_dir):
    odd = F.col("event_id") % 11 == 0
    return tables.readings(spark, sf_dir).select("event_id", F.when(odd, "UNKNOWN").otherwise(F.col("state")).alias("state"), F.when(odd, 0.4).otherwise(F.col("confidence")).alias("confidence"), F.expr("repeat('r', cast(150 + event_id % 100 AS int))").alias("reason"), F.lit("judge/1").alias("version"))


def poll_frames(spark, sf_dir):
    return polling.frames(tables.polls(spark, sf_dir))


@query("frame_key_shape", f"WITH {READINGS_SQL}, {FRAMED_SQL}, k AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN object_key WHEN 1 THEN '../' || object_key WHEN 2 THEN replace(object_key, '.jpg', '.jpg' || chr(10)) WHEN 3 THEN replace(object_key, '/2024', '/../2024') ELSE upper(object_key) END AS k FROM framed) SELECT event_id, coalesce(regexp_matches(k, '^frames/[A-Za-z0-9_-]+/[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}/[0-9]{{2}}/[0-9]+-[0-9a-f]{{8}}[.]jpg$') AND NOT contains(k, chr(10)), false) AS fits FROM k")
def _(spark, sf_dir):
    k, r = F.col("object_key"), F.col("event_id") % 5
    odd = F.when(r == 0, k).when(r == 1, F.concat(F.lit("../"), k)).when(r == 2, F.replace(k, F.lit(".jpg"), F.lit(".jpg\n"))).when(r == 3, F.replace(k, F.lit("/2024"), F.lit("/../2024"))).otherwise(F.upper(k))
    return framed(spark, sf_dir).withColumn("object_key", odd).select("event_id", scalars.is_frame_key("object_key").alias("fits"))


@query("scored_frames", f"WITH {SCORED_SQL} SELECT event_id, crossing_id, camera_id, t, state, round(confidence, 6) AS confidence, reason, version FROM scored")
def _(spark, sf_dir):
    got = scoring.score(poll_frames(spark, sf_dir), roster(spark, sf_dir), scoring.by_table(verdicts(spark, sf_dir), "event_id"))
    return got.select("event_id", "crossing_id", "camera_id", "t", "state", F.round("confidence", 6).alias("confidence"), "reason", "version")


@query("scan_job", f"""WITH {SCORED_SQL}, c AS (SELECT camera_id, count(*) FILTER (state = 'BLOCKED') AS blocked, count(*) FILTER (state = 'CLEAR') AS clear, count(*) FILTER (state = 'UNKNOWN') AS unknown, count(*) AS scored FROM scored WHERE t >= {DAY} AND t < {NEXT} GROUP BY 1),
 n AS (SELECT camera_id, count(*) AS frames FROM frames WHERE t >= {DAY} AND t < {NEXT} GROUP BY 1)
 SELECT camera_id, coalesce(blocked, 0) AS blocked, coalesce(clear, 0) AS clear, coalesce(unknown, 0) AS unknown, coalesce(scored, 0) AS scored, frames - coalesce(scored, 0) AS skipped FROM n LEFT JOIN c USING (camera_id)""")
def _(spark, sf_dir):
    f = poll_frames(spark, sf_dir)
    path = files.scratch(spark, "observations")
    files.write_lines(scoring.scan(f, roster(spark, sf_dir), scoring.by_table(verdicts(spark, sf_dir), "event_id"), None, DAY, NEXT).select("camera_id", "state"), path)
    return scoring.counts(scoring.in_window(f, DAY, NEXT), spark.read.schema("camera_id string, state string").json(path))


@query("routed_verdicts", f"""WITH {READINGS_SQL}, {VERDICT_SQL}, p AS (SELECT event_id, 1 / (1 + exp((event_id % 7) - value / 40)) AS p FROM events)
 SELECT r.event_id, r.camera_id, CASE WHEN r.camera_id IN ('C0', 'C2') THEN CASE WHEN p >= 0.7 THEN 'BLOCKED' WHEN p <= 0.3 THEN 'CLEAR' ELSE 'UNKNOWN' END ELSE v.state END AS state, CASE WHEN r.camera_id IN ('C0', 'C2') THEN 'head-c0.7-h{scoring.hashlib.sha256(b"weights").hexdigest()[:12]}' ELSE 'judge/1' END AS version
 FROM readings r JOIN verdicts v USING (event_id) JOIN p USING (event_id)""")
def _(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").selectExpr("event_id", "value / 40 AS b", "cast(event_id % 7 AS double) AS c")
    f = tables.readings(spark, sf_dir).select("event_id", "camera_id").join(e, "event_id")
    version = scoring.classifier_version("head", b"weights")
    head = scoring.register("classifier", lambda rows: scenes.softmax_verdict(rows, "b", "c").withColumn("version", F.lit(version)))
    scoring.register("table", scoring.by_table(verdicts(spark, sf_dir), "event_id"))
    got = scoring.routed(f, spark.createDataFrame([("C0",), ("C2",)], "camera_id string"), head, scoring.scorer("table"))
    return got.select("event_id", "camera_id", "state", "version")


BLOCKED_SQL = f"""{MODEL_SQL}, s AS ({scenes_sql(True)}), b AS ({bright_sql('s')}), bins AS (SELECT DISTINCT camera_id, bin FROM model),
 near AS (SELECT b.vec_id, b.camera_id, luminance, bins.bin AS r FROM b LEFT JOIN bins ON bins.camera_id = b.camera_id AND abs(bins.bin - b.bin) <= 1 QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY abs(bins.bin - b.bin), bins.bin) = 1),
 mask AS (SELECT n.vec_id, n.camera_id, s.pos // 8 AS row, (abs(s.x - m.median) > greatest(25.0, 3 * m.spread))::INT AS hit FROM near n JOIN s USING (vec_id) JOIN model m ON m.camera_id = n.camera_id AND m.bin = n.r AND m.pos = s.pos),
 rows AS (SELECT vec_id, camera_id, row, (avg(hit) > 0.45)::INT AS o, sum(hit) AS h FROM mask GROUP BY 1, 2, 3)"""


@query("scene_profiles", f"WITH {BLOCKED_SQL}, bands AS (SELECT 'C1' AS camera_id, 2 AS top, 5 AS bottom) SELECT vec_id, r.camera_id, coalesce(sum(o) FILTER (top IS NULL OR (row >= top AND row < bottom)), 0)::INT AS band_rows, round(sum(h) / 64, 6) AS changed FROM rows r LEFT JOIN bands USING (camera_id) GROUP BY 1, 2")
def _(spark, sf_dir):
    band = spark.createDataFrame([("C1", 2, 5)], "camera_id string, top int, bottom int")
    got = scenes.compared(tables.scenes(spark, sf_dir, True), scenes.reference(tables.scenes(spark, sf_dir)), SMALL, 8, band)
    return got.where("ref IS NOT NULL").select("vec_id", "camera_id", "band_rows", F.round("changed", 6).alias("changed"))


@query("track_bands", f"""WITH {BLOCKED_SQL}, sup AS (SELECT camera_id, row, avg(o) AS support, count(*) AS profiles FROM rows WHERE vec_id % 11 = 0 GROUP BY 1, 2)
 SELECT camera_id, greatest(0, min(row) FILTER (support >= 0.5) - 1)::INT AS top, least(8, max(row) FILTER (support >= 0.5) + 2)::INT AS bottom, max(profiles) AS profiles FROM sup GROUP BY 1 HAVING min(row) FILTER (support >= 0.5) IS NOT NULL""")
def _(spark, sf_dir):
    return scenes.bands(tables.scenes(spark, sf_dir, True).where("vec_id % 11 = 0"), scenes.reference(tables.scenes(spark, sf_dir)), SMALL, pad=1)


def model_sql(name: str, plain: str) -> str:
    """The reference of the scenes in `plain`, all its tables named after `name`."""
    return f"""{name}_b AS ({bright_sql(plain)}), {name}_e AS (SELECT camera_id, bin, count(*) AS frames FROM {name}_b GROUP BY 1, 2 HAVING count(*) >= 15),
 {name}_f AS (SELECT e.camera_id, e.bin, e.frames, p.pos, p.x FROM {plain} p JOIN {name}_b b USING (vec_id, camera_id) JOIN {name}_e e ON e.camera_id = b.camera_id AND e.bin = b.bin),
 {name}_m AS (SELECT camera_id, bin, frames, pos, median(x) AS m FROM {name}_f GROUP BY 1, 2, 3, 4),
 {name} AS (SELECT camera_id, bin, frames, pos, floor(any_value(m))::INT AS median, median(abs(x - m)) AS spread FROM {name}_f JOIN {name}_m USING (camera_id, bin, frames, pos) GROUP BY 1, 2, 3, 4)"""


@query("refined_reference", f"""WITH s AS ({scenes_sql(True)}), {model_sql('one', 's')}, bins AS (SELECT DISTINCT camera_id, bin FROM one),
 near AS (SELECT b.vec_id, b.camera_id, bins.bin AS r FROM one_b b JOIN bins ON bins.camera_id = b.camera_id AND abs(bins.bin - b.bin) <= 1 QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY abs(bins.bin - b.bin), bins.bin) = 1),
 rows AS (SELECT n.vec_id, n.camera_id, s.pos // 8 AS row, (avg((abs(s.x - m.median) > greatest(25.0, 3 * m.spread))::INT) > 0.45)::INT AS o FROM near n JOIN s USING (vec_id) JOIN one m ON m.camera_id = n.camera_id AND m.bin = n.r AND m.pos = s.pos GROUP BY 1, 2, 3),
 kept AS (SELECT vec_id, camera_id FROM rows GROUP BY 1, 2 HAVING sum(o) < 3), n AS (SELECT camera_id, count(DISTINCT vec_id) AS n FROM s GROUP BY 1), k AS (SELECT camera_id, count(*) AS k FROM kept GROUP BY 1),
 again AS (SELECT camera_id FROM n LEFT JOIN k USING (camera_id) WHERE coalesce(k, 0) >= greatest(15, n // 2)), t AS (SELECT s.* FROM s JOIN kept USING (vec_id, camera_id) WHERE camera_id IN (SELECT camera_id FROM again)), {model_sql('two', 't')}
 SELECT camera_id, bin, frames, pos::INT AS pos, median, round(spread, 6) AS spread FROM (SELECT * FROM one WHERE camera_id NOT IN (SELECT camera_id FROM again) UNION ALL SELECT * FROM two)""")
def _(spark, sf_dir):
    return scenes.refined(tables.scenes(spark, sf_dir, True), SMALL).withColumn("spread", F.round("spread", 6))


@query("two_class_head")
def _(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("features"), (F.col("label") < 5).cast("int").alias("label")).where("embedding IS NOT NULL")
    val = F.pmod(F.xxhash64("vec_id"), F.lit(100)) < 15
    name = lambda c: F.when(F.col(c) == 1, "BLOCKED").otherwise("CLEAR")
    judged = scoring.two_class_head(rows.where(~val))(rows.where(val))
    return labels.exam(judged.select(F.lit("head").alias("judge"), name("label").alias("truth"), name("predicted").alias("verdict")))


@query("roster_places", f"WITH {READINGS_SQL}, r AS (SELECT DISTINCT crossing_id, camera_id, substr(camera_id, 2)::INT AS n FROM readings) SELECT crossing_id, string_agg(camera_id, ',' ORDER BY camera_id) AS cameras, string_agg(camera_id, ',' ORDER BY camera_id) FILTER (camera_id <> 'C5') AS witnesses, (arg_min(n, camera_id) FILTER (n >= 2))::DOUBLE AS lat, (-arg_min(n, camera_id) FILTER (n >= 2))::DOUBLE AS lon FROM r GROUP BY 1")
def _(spark, sf_dir):
    n = F.substring("camera_id", 2, 9).cast("double")
    rows = roster(spark, sf_dir).withColumns({"lat": F.when(n >= 2, n), "lon": F.when(n >= 2, -n)})
    return scoring.groups(rows).select("crossing_id", F.array_join("cameras", ",").alias("cameras"), F.array_join("witnesses", ",").alias("witnesses"), "lat", "lon")


@query("rebuild_guards", f"""WITH {SESSIONS_SQL}, w AS (SELECT crossing_id, min(t) AS low, max(t) AS high FROM readings WHERE camera_id <> 'C4' GROUP BY 1), e AS (SELECT s.crossing_id, count(*) AS n FROM sessions s JOIN w ON w.crossing_id = s.crossing_id AND s.started BETWEEN low AND high WHERE s.crossing_id = 'X1' GROUP BY 1)
 SELECT crossing_id, 'absent witness' AS rule, 'C4' AS detail FROM w WHERE crossing_id = 'X1' UNION ALL SELECT crossing_id, 'empty derivation', n::VARCHAR FROM e UNION ALL SELECT crossing_id, 'live edge', high::VARCHAR FROM w WHERE high > {NEXT} - 900000
 UNION ALL SELECT crossing_id, 'short witness', camera_id FROM (SELECT crossing_id, camera_id, low - min(low) OVER (PARTITION BY crossing_id) AS late, max(high) OVER (PARTITION BY crossing_id) - high AS early FROM (SELECT crossing_id, camera_id, min(t) AS low, max(t) AS high FROM readings WHERE camera_id <> 'C4' GROUP BY 1, 2)) WHERE camera_id <> 'C5' AND (late > 900000 OR early > 900000)""")
def _(spark, sf_dir):
    given, s = tables.readings(spark, sf_dir).where("camera_id <> 'C4'"), derived(spark, sf_dir)
    return history.guards(given, roster(spark, sf_dir), NEXT, s, s.where("crossing_id <> 'X1'"))


# --- live board ----------------------------------------------------------------------------------

EMISSIONS_SQL = """emissions AS (SELECT session_id, crossing_id, true AS is_open, started AS seq, 0 AS part FROM sessions UNION ALL SELECT session_id, crossing_id, true, started + 1, 1 FROM sessions UNION ALL SELECT session_id, crossing_id, false, ended + 900001, 2 FROM sessions)"""
OPEN_SQL = f"last AS (SELECT * FROM emissions WHERE is_open AND seq <= {NEXT} QUALIFY row_number() OVER (PARTITION BY crossing_id ORDER BY seq DESC, session_id DESC) = 1), open AS (SELECT crossing_id, session_id FROM last l WHERE NOT EXISTS (SELECT 1 FROM emissions e WHERE NOT e.is_open AND e.seq <= {NEXT} AND e.session_id = l.session_id AND e.seq > l.seq))"


def emissions(spark, sf_dir):
    s = derived(spark, sf_dir)
    row = lambda is_open, seq: s.select("session_id", "crossing_id", F.lit(is_open).alias("is_open"), seq.alias("seq"))
    return row(True, F.col("started")).union(row(True, F.col("started") + 1)).union(row(False, F.col("ended") + 900_001))


@query("open_sessions", f"WITH {SESSIONS_SQL}, {EMISSIONS_SQL}, {OPEN_SQL.replace(str(NEXT), '(SELECT max(started) FROM sessions)')} SELECT crossing_id, session_id FROM open")
def _(spark, sf_dir):
    """At the instant at which the last session began, so there is one at least."""
    at = derived(spark, sf_dir).agg(F.max("started")).first()[0]
    return live_board.open_sessions(emissions(spark, sf_dir).where(F.col("seq") <= at))


@query("open_session_count", f"WITH {SESSIONS_SQL}, {EMISSIONS_SQL}, asked AS (SELECT crossing_id AS x, max(started) + 60000 AS m FROM sessions GROUP BY 1) SELECT x AS crossing_id, (SELECT count(*) FROM sessions s WHERE s.started <= m AND s.ended + 900001 > m) AS open FROM asked")
def _(spark, sf_dir):
    """How many sessions are open, all crossings together, a minute after each crossing's last one began."""
    s = derived(spark, sf_dir)
    at = {r["crossing_id"]: r["at"] for r in s.groupBy("crossing_id").agg((F.max("started") + 60_000).alias("at")).collect()}
    told, counts = emissions(spark, sf_dir), None
    for crossing, t in sorted(at.items()):
        one = live_board.open_sessions(told.where(F.col("seq") <= t)).agg(F.count("*").alias("open")).select(F.lit(crossing).alias("crossing_id"), "open")
        counts = one if counts is None else counts.unionByName(one)
    return spark.createDataFrame([], "crossing_id string, open long") if counts is None else counts


@query("session_changes", f"WITH {SESSIONS_SQL}, {EMISSIONS_SQL} SELECT session_id, crossing_id, is_open, seq FROM emissions WINDOW w AS (PARTITION BY crossing_id ORDER BY seq) QUALIFY lag(session_id) OVER w IS DISTINCT FROM session_id OR lag(is_open) OVER w IS DISTINCT FROM is_open")
def _(spark, sf_dir):
    return live_board.session_changes(emissions(spark, sf_dir), ["session_id", "is_open"])


VOTES_SQL = f"""votes AS (SELECT * FROM readings WHERE camera_id <> 'C5' AND t <= {NEXT}),
 held AS (SELECT * FROM (SELECT *, least(coalesce(lead(t) OVER (PARTITION BY camera_id ORDER BY t, event_id), t + 900001), t + 900001) AS gone FROM votes) WHERE gone > t),
 judged AS (SELECT a.crossing_id, a.t, CASE WHEN bool_or(h.state = 'BLOCKED') THEN 'BLOCKED' WHEN bool_or(h.state = 'CLEAR') THEN 'CLEAR' ELSE 'UNKNOWN' END AS state FROM (SELECT DISTINCT crossing_id, t FROM votes) a LEFT JOIN held h ON h.crossing_id = a.crossing_id AND h.t <= a.t AND h.gone > a.t GROUP BY 1, 2),
 since AS (SELECT crossing_id, max(t) AS since FROM (SELECT *, lag(state) OVER (PARTITION BY crossing_id ORDER BY t) AS before FROM judged) WHERE before IS NULL OR before <> state GROUP BY 1),
 lastvote AS (SELECT crossing_id, camera_id, arg_max(state, (t, event_id)) AS state, max(t) AS t, {NEXT} - max(t) <= 900000 AS fresh FROM votes GROUP BY 1, 2),
 w AS (SELECT crossing_id, max((t, camera_id)) FILTER (fresh AND state = 'BLOCKED') AS b, max((t, camera_id)) FILTER (fresh AND state = 'CLEAR') AS c, max((t, camera_id)) FILTER (fresh AND state = 'UNKNOWN') AS u, count(*) FILTER (fresh) AS n FROM lastvote GROUP BY 1)"""


def pictured(spark, sf_dir):
    """Readings with a picture's key; every fourth has none."""
    return framed(spark, sf_dir).withColumn("object_key", F.when(F.col("event_id") % 4 != 0, F.col("object_key")))


@query("live_board", f"""WITH {SESSIONS_SQL}, {FRAMED_SQL}, {EMISSIONS_SQL}, {OPEN_SQL}, {VOTES_SQL},
 pics AS (SELECT crossing_id, camera_id, arg_max(object_key, (t, event_id)) AS k FROM framed WHERE event_id % 4 <> 0 AND t <= {NEXT} GROUP BY 1, 2), roster AS (SELECT DISTINCT crossing_id, camera_id FROM readings),
 cams AS (SELECT r.crossing_id, string_agg(r.camera_id || '=' || coalesce(k, '-'), ' ' ORDER BY r.camera_id) AS cameras FROM roster r LEFT JOIN pics USING (crossing_id, camera_id) GROUP BY 1)
 SELECT crossing_id, CASE WHEN b IS NOT NULL THEN 'BLOCKED' WHEN c IS NOT NULL THEN 'CLEAR' ELSE 'UNKNOWN' END AS state, coalesce(n, 0) = 0 AS stale, since.since AS since, coalesce(b, c, u)[2] AS witness, coalesce(b, c, u)[1] AS witness_t, session_id AS open_session, cams.cameras, h.verdict AS feed, h.since AS feed_since
 FROM cams CROSS JOIN ({ORACLE_SQL['feed_health']}) h LEFT JOIN w USING (crossing_id) LEFT JOIN since USING (crossing_id) LEFT JOIN open USING (crossing_id)""")
def _(spark, sf_dir):
    got = live_board.full_board(pictured(spark, sf_dir), roster(spark, sf_dir), emissions(spark, sf_dir), poll_frames(spark, sf_dir), NEXT)
    return got.withColumn("cameras", F.array_join(F.transform("cameras", lambda c: F.concat(c["camera_id"], F.lit("="), F.coalesce(c["object_key"], F.lit("-")))), " "))


@query("board_changes", f"""WITH {READINGS_SQL}, per AS (SELECT crossing_id, camera_id, now, arg_max(state, (t, event_id)) AS state, now - max(t) <= 900000 AS fresh FROM readings JOIN (VALUES ({NEXT - 600000}), ({NEXT})) v(now) ON t <= now GROUP BY 1, 2, 3),
 b AS (SELECT crossing_id, now, CASE WHEN bool_or(fresh AND state = 'BLOCKED') THEN 'BLOCKED' WHEN bool_or(fresh AND state = 'CLEAR') THEN 'CLEAR' ELSE 'UNKNOWN' END AS state, NOT bool_or(fresh) AS stale FROM per GROUP BY 1, 2)
 SELECT n.crossing_id, n.state, n.stale FROM b n LEFT JOIN b o ON o.crossing_id = n.crossing_id AND o.now = {NEXT - 600000} WHERE n.now = {NEXT} AND (o.state IS DISTINCT FROM n.state OR o.stale IS DISTINCT FROM n.stale)""")
def _(spark, sf_dir):
    r = tables.readings(spark, sf_dir)
    return live_board.board_changes(sessions.board(r, NEXT - 600_000), sessions.board(r, NEXT), ["state", "stale"]).select("crossing_id", "state", "stale")


@query("alerted_at", f"""WITH {READINGS_SQL}, {ALERTS_SQL.replace("AND k >= 3 THEN 'R'", "AND k >= 3 THEN 'R' WHEN row_number() OVER (PARTITION BY crossing_id, epoch ORDER BY t, event_id) = 1 THEN 'R'")}
 SELECT r.crossing_id, r.t AS at, coalesce((SELECT arg_max(mark, (m.t, m.event_id)) FROM marks m WHERE m.crossing_id = r.crossing_id AND m.t <= r.t) = 'F', false) AS alerted FROM (SELECT DISTINCT crossing_id, t + 1000 AS t FROM readings WHERE event_id % 10 = 0) r""")
def _(spark, sf_dir):
    r = tables.readings(spark, sf_dir)
    return sessions.alerted_at(r, r.where("event_id % 10 = 0").select("crossing_id", (F.col("t") + 1000).alias("at")).distinct())


@query("feed_transitions", f"""WITH {FRAMES_SQL}, g AS (SELECT *, sum((status <> 'error')::INT) OVER (PARTITION BY camera_id ORDER BY fetched, event_id ROWS UNBOUNDED PRECEDING) AS g FROM frames),
 n AS (SELECT *, (sum((status = 'error')::INT) OVER (PARTITION BY camera_id, g ORDER BY fetched, event_id ROWS UNBOUNDED PRECEDING) >= 3)::INT AS down FROM g),
 c AS (SELECT *, down - coalesce(lag(down) OVER w, 0) AS d, (lag(down) OVER w IS NULL)::INT AS fresh FROM n WINDOW w AS (PARTITION BY camera_id ORDER BY fetched, event_id)),
 a AS (SELECT *, sum(d) OVER w AS downs, sum(fresh) OVER w AS cameras, max(fetched) FILTER (status = 'ok') OVER w AS newest FROM c WINDOW w AS (ORDER BY fetched, event_id ROWS UNBOUNDED PRECEDING)),
 v AS (SELECT *, CASE WHEN downs >= cameras THEN 'upstream_down' WHEN newest < fetched - 900000 THEN 'upstream_stale' ELSE 'ok' END AS verdict FROM a)
 SELECT event_id, fetched, verdict FROM v QUALIFY coalesce(lag(verdict) OVER (ORDER BY fetched, event_id), 'ok') <> verdict""")
def _(spark, sf_dir):
    return live_board.feed_transitions(poll_frames(spark, sf_dir))


@query("health_rules", f"""WITH {FRAMES_SQL}, r AS (SELECT * FROM frames WHERE fetched <= {NEXT}),
 p AS (SELECT camera_id, max(fetched) FILTER (status = 'ok') AS new, coalesce(max(fetched) FILTER (status <> 'error'), -1) AS good, count(*) FILTER (fetched > {NEXT - 7200000} AND status = 'ok') AS oks, count(*) FILTER (fetched > {NEXT - 7200000} AND fetched <= {NEXT - 3600000} AND status <> 'error') AS f1, count(*) FILTER (fetched > {NEXT - 3600000} AND status <> 'error') AS f2 FROM r GROUP BY 1),
 e AS (SELECT r.camera_id, r.fetched, row_number() OVER (PARTITION BY r.camera_id ORDER BY r.fetched, r.event_id) AS n FROM r JOIN p ON p.camera_id = r.camera_id AND r.fetched > p.good)
 SELECT 'erroring' AS rule, camera_id FROM e WHERE n = 4 AND fetched <= {NEXT - 600000} UNION ALL SELECT 'stalled', camera_id FROM p WHERE new < {NEXT - 1200000} UNION ALL SELECT 'all duplicates', camera_id FROM p WHERE oks = 0 AND f1 > 0 AND f2 > 0
 UNION ALL SELECT 'all stalled', NULL FROM (SELECT max(new) AS m FROM p) WHERE m < {NEXT - 1200000} UNION ALL SELECT 'no polls', NULL FROM (SELECT max(fetched) AS m FROM r) WHERE m IS NULL OR m < {NEXT - 900000}""")
def _(spark, sf_dir):
    return live_board.health(poll_frames(spark, sf_dir), roster(spark, sf_dir), NEXT, errors=3)


#: Name, which polls there are, milliseconds past the last of them: feeds that earn each verdict.
FEEDS = [("fine", "fetched <= 1706000000000", 1), ("unpolled", "true", 400_000), ("down", "status = 'error' OR fetched <= 1705000000000", 2), ("stale", "status <> 'ok' OR fetched <= 1705000000000", 3)]


def feed_note_sql() -> str:
    body = ORACLE_SQL["feed_health"][len("WITH ") + len(FRAMES_SQL) + 2 :]
    one = lambda name, rule, past: f"""SELECT '{name}' AS feed, x.* FROM (WITH given AS (SELECT * FROM frames WHERE {rule}), {body.replace("FROM frames WHERE fetched <= " + str(NEXT), "FROM given").replace(str(NEXT), f"(SELECT max(fetched) + {past} FROM given)")}) x"""
    return f"""WITH {FRAMES_SQL}, h AS ({" UNION ALL ".join(one(*f) for f in FEEDS)}), c AS (SELECT *, ltrim(strftime({LOCAL.format('since')}, '%I:%M %p'), '0') AS c FROM h)
 SELECT feed, verdict, CASE verdict WHEN 'upstream_stale' THEN 'All cameras show what they showed before since ' || c || '; new pictures are taken up as they come.' WHEN 'upstream_down' THEN 'Polls fail at every camera (last good one: ' || c || '); they go on.'
   WHEN 'capture_stale' THEN 'Nothing has been polled since ' || c || ': the fault is here.' END AS note FROM c"""


@query("stale_feed_notes", feed_note_sql())
def _(spark, sf_dir):
    frames, out = poll_frames(spark, sf_dir), None
    for name, rule, past in FEEDS:
        given = frames.where(rule)
        at = (given.agg(F.max("fetched")).first()[0] or 0) + past
        one = polling.feed_health(given, at).select(F.lit(name).alias("feed"), "verdict", live_board.feed_note("verdict", "since").alias("note"))
        out = one if out is None else out.unionByName(one)
    return out


@query("held_back_alerts", f"WITH {READINGS_SQL}, {ALERTS_SQL}, a AS (SELECT crossing_id, t FROM marks WHERE mark = 'F' AND (before IS NULL OR before = 'R')) SELECT crossing_id, t FROM a WHERE t >= (SELECT max(t) FROM a) - 500000")
def _(spark, sf_dir):
    """While catching up at 100 seconds past the last alert: that one and those not ten minutes old are sent."""
    alerts = sessions.rising_edges(tables.readings(spark, sf_dir))
    now = alerts.agg(F.max("t")).first()[0]
    return live_board.fresh_alerts(alerts, (now or 0) + 100_000, True).select("crossing_id", "t")


@query("silent_sessions", f"WITH {SESSIONS_SQL} SELECT session_id, false AS is_open FROM sessions WHERE started > {DAY} AND ended + 1020000 < {NEXT}")
def _(spark, sf_dir):
    now = derived(spark, sf_dir).where(F.col("started") > DAY).withColumn("is_open", F.lit(True))
    return live_board.silent_sessions(now, NEXT, True).select("session_id", "is_open")


# --- sweeps, pages, training ---------------------------------------------------------------------

SWEEP_SQL = f"""picks AS (SELECT camera_id, min(t) AS t FROM readings GROUP BY 1 UNION ALL SELECT p.camera_id, (SELECT min(r.t) FROM readings r WHERE r.camera_id = p.camera_id AND r.t >= p.t + 43200000) FROM picks p WHERE p.t IS NOT NULL),
 known AS (SELECT *, event_id % 13 = 0 AS known, row_number() OVER (PARTITION BY camera_id ORDER BY t, event_id) - 1 AS i FROM framed),
 x AS (SELECT k.*, p.t IS NOT NULL AND row_number() OVER (PARTITION BY k.camera_id, k.t ORDER BY event_id) = 1 AS picked, state = 'BLOCKED' AND NOT known AS b, state = 'CLEAR' AND NOT known AS c FROM known k LEFT JOIN (SELECT DISTINCT camera_id, t FROM picks WHERE t IS NOT NULL) p ON p.camera_id = k.camera_id AND p.t = k.t),
 g AS (SELECT *, sum(b::INT) OVER (PARTITION BY camera_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS gu, sum(b::INT) OVER (PARTITION BY camera_id ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS gd FROM x),
 h AS (SELECT *, sum(c::INT) OVER (PARTITION BY camera_id, gu ORDER BY i ROWS UNBOUNDED PRECEDING) AS cu, sum(c::INT) OVER (PARTITION BY camera_id, gd ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS cd FROM g),
 e AS (SELECT *, min(CASE WHEN cu >= 3 AND gu > 0 THEN i END) OVER (PARTITION BY camera_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 40 FOLLOWING) AS eu, max(CASE WHEN cd >= 3 AND gd > 0 THEN i END) OVER (PARTITION BY camera_id ORDER BY i ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS ed,
   count(*) OVER (PARTITION BY camera_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 40 FOLLOWING) AS nu, count(*) OVER (PARTITION BY camera_id ORDER BY i ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS nd FROM h),
 hits AS (SELECT camera_id, i, coalesce(eu, i + 40) AS high, coalesce(ed, i - 40) AS low, (eu IS NULL AND nu >= 40) OR (ed IS NULL AND nd >= 40) AS open_ended FROM e WHERE picked AND b)"""


@query("sweep_plan", f"""WITH RECURSIVE {READINGS_SQL}, {FRAMED_SQL}, {SWEEP_SQL}
 SELECT e.event_id, e.camera_id, e.t, e.state, e.picked, coalesce(h.open_ended, false) AS open_ended FROM e LEFT JOIN hits h ON h.camera_id = e.camera_id AND h.i = e.i
 WHERE NOT known AND (picked OR EXISTS (SELECT 1 FROM hits q WHERE q.camera_id = e.camera_id AND e.i BETWEEN q.low AND q.high))""")
def _(spark, sf_dir):
    f = framed(spark, sf_dir)
    return sweep.planned(f, 43_200_000, f.where("event_id % 13 = 0").select("object_key")).select("event_id", "camera_id", "t", "state", "picked", "open_ended")


@query("label_records", f"""WITH {READINGS_SQL}, {FRAMED_SQL} SELECT object_key, camera_id, crossing_id, strftime(make_timestamp(t * 1000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at, strftime(make_timestamp(t * 1000), '%H:%M UTC') AS local_time, state AS label, round(confidence, 6) AS confidence, repeat('r', least(200, 150 + event_id % 100)::INT) AS reason,
   'unrecorded' AS lighting, 'vlm-spot-check' AS source, 'table/1' AS labeller, '2024-02-01T00:00:00Z' AS labelled_at, state <> 'UNKNOWN' AS visually_resolvable FROM framed WHERE event_id % 5 = 0""")
def _(spark, sf_dir):
    f = framed(spark, sf_dir).where("event_id % 5 = 0").withColumns({"reason": F.expr("repeat('r', cast(150 + event_id % 100 AS int))"), "confidence": F.round("confidence", 6)})
    return sweep.label_records(f, "table/1", "2024-02-01T00:00:00Z")


GRID_SQL = f"""{RESOLVED_SQL}, day AS (SELECT crossing_id, s.hour::INT AS hour, coalesce(blocked, 0) AS blocked, coalesce(scoreable, 0) AS scoreable FROM (SELECT DISTINCT crossing_id FROM resolved WHERE state <> 'UNKNOWN') c CROSS JOIN range(24) s(hour)
   LEFT JOIN (SELECT crossing_id, hour({LOCAL.format('t')}) AS hour, count(*) FILTER (state = 'BLOCKED') AS blocked, count(*) AS scoreable FROM resolved WHERE state <> 'UNKNOWN' GROUP BY 1, 2) g USING (crossing_id, hour))"""


@query("hour_of_day", f"WITH {GRID_SQL} SELECT *, CASE WHEN blocked > 0 THEN floor(18 + 82 * least(1.0, 2.0 * (blocked / scoreable)) + 0.5)::INT END AS heat FROM day")
def _(spark, sf_dir):
    return pages.hour_of_day(QUERIES["hour_of_week"](spark, sf_dir)).withColumn("heat", pages.heat())


PROSE = "(CASE WHEN ({0} + 48) % 12 = 0 THEN 12 ELSE ({0} + 48) % 12 END)::INT || CASE WHEN ({0} + 48) % 24 < 12 THEN ' AM' ELSE ' PM' END"


@query("worst_hours", f"""WITH {GRID_SQL}, s AS (SELECT crossing_id, hour, CASE WHEN scoreable >= 4 THEN blocked / scoreable ELSE 0 END AS s FROM day), p AS (SELECT crossing_id, max(s) AS peak, arg_max(hour, (s, -hour)) AS h FROM s GROUP BY 1 HAVING max(s) > 0),
 bad AS (SELECT p.crossing_id, k, sign, s.s < 0.6 * peak AS bad FROM p CROSS JOIN range(1, 6) r(k) CROSS JOIN (VALUES (-1), (1)) v(sign) JOIN s ON s.crossing_id = p.crossing_id AND s.hour = (p.h + sign * k + 48) % 24),
 run AS (SELECT crossing_id, coalesce(min(k) FILTER (bad AND sign = -1), 6) - 1 AS l, coalesce(min(k) FILTER (bad AND sign = 1), 6) - 1 AS r FROM bad GROUP BY 1),
 x AS (SELECT crossing_id, h - l AS a, h + least(r, 5 - l) AS b FROM p JOIN run USING (crossing_id))
 SELECT crossing_id, CASE WHEN a = b THEN 'around ' || {PROSE.format('a')} ELSE {PROSE.format('a')} || '-' || {PROSE.format('(b + 1)')} END AS worst FROM x""")
def _(spark, sf_dir):
    return pages.worst_hours(pages.hour_of_day(QUERIES["hour_of_week"](spark, sf_dir)))


@query("wait_outlook", f"""WITH {SESSIONS_SQL}, d AS (SELECT crossing_id, seconds, CASE WHEN seconds > 1200 THEN seconds - 1200 END AS rest FROM sessions WHERE certified), n AS (SELECT crossing_id, count(rest) AS n, max(seconds) AS record, list_sort(list(rest) FILTER (rest IS NOT NULL)) AS l FROM d GROUP BY 1)
 SELECT crossing_id, CASE WHEN n = 0 THEN 'none has lasted this long (the longest took ' || floor(record / 60 + 0.5)::INT || ' min)' ELSE 'half of those that lasted this long ended within ' || greatest(5, ceil(l[n // 2 + 1] / 60 / 5) * 5)::INT || ' more min (' || n || ' of them)' END AS outlook FROM n""")
def _(spark, sf_dir):
    return pages.wait_outlook(derived(spark, sf_dir), 1200)


@query("session_durations", f"WITH {SESSIONS_SQL} SELECT crossing_id, string_agg(seconds, ' ' ORDER BY started) AS durations FROM sessions WHERE certified GROUP BY 1")
def _(spark, sf_dir):
    return pages.durations(derived(spark, sf_dir)).withColumn("durations", F.array_join(F.col("durations").cast("array<string>"), " "))


@query("last_days", f"WITH d AS ({ORACLE_SQL['daily_minutes']}) SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY crossing_id ORDER BY day DESC) <= 14")
def _(spark, sf_dir):
    return pages.last_days(QUERIES["daily_minutes"](spark, sf_dir))


@query("day_sheet", f"WITH {SESSIONS_SQL} SELECT strftime({LOCAL.format('started')}, '%Y-%m-%d') AS day, strftime({LOCAL.format('started')}, '%A, %B %-d') AS heading, count(*) AS sessions FROM sessions GROUP BY 1, 2")
def _(spark, sf_dir):
    return pages.by_day(derived(spark, sf_dir))


@query("record_list", f"WITH {SESSIONS_SQL} SELECT session_id, 'Crossing ' || substr(crossing_id, 2) AS label, strftime({LOCAL.format('started')}, '%A, %B %-d, %I:%M %p') AS at, strftime({LOCAL.format('started')}, '%b %-d') AS since FROM sessions WHERE crossing_id IN ('X0', 'X2')")
def _(spark, sf_dir):
    rows = pages.featured(derived(spark, sf_dir), ("X0", "X2"))
    return rows.orderBy("started", "crossing_id").select("session_id", pages.crossing_label("crossing_id", {"X0": "Crossing 0", "X2": "Crossing 2"}).alias("label"), pages.day_time("started").alias("at"), pages.short_date("started").alias("since"))


@query("featured_names", f"WITH {READINGS_SQL}, n AS (SELECT list_sort(list(DISTINCT CASE crossing_id WHEN 'X0' THEN 'Alder' ELSE crossing_id END)) AS l FROM readings) SELECT CASE WHEN len(l) < 3 THEN array_to_string(l, ' and ') ELSE array_to_string(l[:-2], ', ') || ', and ' || l[-1] END AS names FROM n")
def _(spark, sf_dir):
    labels_ = tables.readings(spark, sf_dir).select("crossing_id").distinct().withColumn("label", pages.crossing_label("crossing_id", {"X0": "Alder"}))
    return labels_.agg(F.array_sort(F.collect_list("label")).alias("l")).select(pages.and_joined(F.col("l")).alias("names"))


@query("session_tape", f"""WITH {SESSIONS_SQL}, {FRAMED_SQL}, o AS (SELECT s.session_id, f.camera_id, f.t, f.event_id, f.state, f.object_key FROM sessions s JOIN framed f ON f.crossing_id = s.crossing_id AND f.t BETWEEN s.started - 120000 AND s.ended + 120000 WHERE f.event_id % 4 <> 0),
 d AS (SELECT session_id, camera_id FROM o GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY count(*) FILTER (state = 'BLOCKED') DESC, min((t, event_id)) FILTER (state = 'BLOCKED') NULLS LAST, min((t, event_id))) = 1),
 n AS (SELECT o.*, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM o JOIN d USING (session_id, camera_id))
 SELECT session_id, camera_id, t, object_key FROM n WHERE n <= 10 OR i IN (SELECT floor(j * (n - 1) / 9 + 0.5) FROM range(10) r(j))""")
def _(spark, sf_dir):
    return pages.tape(derived(spark, sf_dir), pictured(spark, sf_dir))


@query("plan_summary", f"WITH {RESOLVED_SQL}, {TAIL}, w AS (SELECT crossing_id, min(t) AS low, max(t) AS high, string_agg(DISTINCT version, ',' ORDER BY version) AS versions FROM layered GROUP BY 1), k AS (SELECT crossing_id, count(*) AS n FROM sessions GROUP BY 1) SELECT crossing_id, low, high, coalesce(n, 0) AS sessions, versions FROM w LEFT JOIN k USING (crossing_id)")
def _(spark, sf_dir):
    return pages.plan_summary(derived(spark, sf_dir), tables.layered(spark, sf_dir))


@query("session_windows", f"""WITH {SESSIONS_SQL}, r AS (SELECT session_id, crossing_id, started, CASE WHEN started % 3 = 0 THEN NULL ELSE ended END AS ended, 1 AS seq FROM sessions UNION ALL SELECT session_id, crossing_id, started, ended + 1000, 2 FROM sessions WHERE started % 5 = 0),
 last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) = 1), e AS (SELECT crossing_id, max(t) AS t FROM readings WHERE t <= {NEXT} GROUP BY 1)
 SELECT session_id, crossing_id, started, coalesce(ended, t) AS ended, ended IS NOT NULL AS closed FROM last LEFT JOIN e USING (crossing_id) WHERE coalesce(ended, t) >= started""")
def _(spark, sf_dir):
    s = derived(spark, sf_dir)
    rows = s.select("session_id", "crossing_id", "started", F.when(F.col("started") % 3 != 0, F.col("ended")).alias("ended"), F.lit(1).alias("seq")).union(s.where("started % 5 = 0").select("session_id", "crossing_id", "started", F.col("ended") + 1000, F.lit(2)))
    return training.session_windows(rows, tables.readings(spark, sf_dir).where(F.col("t") <= NEXT))


@query("example_files", f"""WITH {READINGS_SQL}, {FRAMED_SQL}, f AS (SELECT '/data/a/' || camera_id || '/' || string_split(object_key, '/')[-1] AS path FROM framed WHERE event_id % 2 = 0 UNION ALL SELECT '/data/b/' || camera_id || '/' || string_split(object_key, '/')[-1] FROM framed WHERE event_id % 3 = 0 UNION ALL SELECT '/data/c/other/' || string_split(object_key, '/')[-1] FROM framed)
 SELECT object_key, camera_id, min(path) AS path FROM framed JOIN f ON string_split(path, '/')[-1] = string_split(object_key, '/')[-1] AND list_contains(string_split(path, '/'), camera_id) GROUP BY 1, 2""")
def _(spark, sf_dir):
    f = framed(spark, sf_dir)
    at = lambda rows, folder: rows.select(F.concat(F.lit(folder), training.base_name("object_key")).alias("path"))
    named = lambda rows, folder: rows.select(F.concat(F.lit(folder), "camera_id", F.lit("/"), training.base_name("object_key")).alias("path"))
    paths = named(f.where("event_id % 2 = 0"), "/data/a/").union(named(f.where("event_id % 3 = 0"), "/data/b/")).union(at(f, "/data/c/other/"))
    return training.with_files(f.select("object_key", "camera_id"), paths)


@query("human_overlap", f"""WITH {SESSIONS_SQL}, h AS (SELECT session_id AS seen_id, crossing_id, started + 400000 AS a, ended + 200000 AS b FROM sessions WHERE started % 7 = 0)
 SELECT s.session_id, h.seen_id, least(s.ended, b + 300000) - greatest(s.started, a - 300000) AS overlap_ms FROM sessions s JOIN h ON h.crossing_id = s.crossing_id AND a <= b AND s.started <= b + 300000 AND s.ended >= a - 300000""")
def _(spark, sf_dir):
    s = derived(spark, sf_dir)
    seen = s.where("started % 7 = 0").select(F.col("session_id").alias("seen_id"), "crossing_id", (F.col("started") + 400_000).alias("seen_start"), (F.col("ended") + 200_000).alias("seen_end"), F.lit(300_000).alias("precision_ms")).where("seen_start <= seen_end")
    return training.overlapping(s, seen)


@query("saved_positives", f"""WITH m AS ({ORACLE_SQL['weak_labels']}), {READINGS_SQL}, {FRAMED_SQL}
 SELECT * FROM m WHERE object_key NOT IN (SELECT object_key FROM framed WHERE event_id % 31 = 0) UNION ALL SELECT object_key, camera_id, 'BLOCKED', 'saved', 'train' FROM framed WHERE event_id % 19 = 0 AND event_id % 31 <> 0 AND object_key NOT IN (SELECT object_key FROM m)""")
def _(spark, sf_dir):
    f = framed(spark, sf_dir)
    return training.with_positives(QUERIES["weak_labels"](spark, sf_dir), f.where("event_id % 19 = 0").select("object_key", "camera_id"), f.where("event_id % 31 = 0"))


@query("gold_exam", f"""WITH {READINGS_SQL}, {FRAMED_SQL}, gold AS (SELECT object_key, state AS truth FROM framed WHERE event_id % 9 = 0 AND state <> 'UNKNOWN'), v AS (SELECT object_key, CASE WHEN event_id % 4 = 0 THEN 'UNKNOWN' WHEN confidence > 0.5 THEN 'BLOCKED' ELSE 'CLEAR' END AS verdict FROM framed), j AS (SELECT truth, verdict FROM gold JOIN v USING (object_key))
 SELECT 'candidate' AS judge, count(*) FILTER (truth = 'BLOCKED' AND verdict = 'BLOCKED') AS tp, count(*) FILTER (truth = 'CLEAR' AND verdict = 'BLOCKED') AS fp, count(*) FILTER (truth = 'CLEAR' AND verdict = 'CLEAR') AS tn, count(*) FILTER (truth = 'BLOCKED' AND verdict = 'CLEAR') AS fn, count(*) FILTER (verdict = 'UNKNOWN') AS unknown, count(*) AS n, count(*) FILTER (verdict <> 'UNKNOWN' AND truth <> verdict) AS hard_errors FROM j""")
def _(spark, sf_dir):
    f = framed(spark, sf_dir)
    gold = f.where("event_id % 9 = 0 AND state <> 'UNKNOWN'").select("object_key", F.col("state").alias("truth"))
    judged = f.select("object_key", F.when(F.col("event_id") % 4 == 0, "UNKNOWN").when(F.col("confidence") > 0.5, "BLOCKED").otherwise("CLEAR").alias("verdict"))
    return labels.exam(gold.join(judged, "object_key").withColumn("judge", F.lit("candidate")))


@query("policy_unknowns", f"WITH {SCORED_SQL} SELECT crossing_id, count(*) FILTER (state = 'UNKNOWN' AND version LIKE 'unscored/%') AS policy, count(*) FILTER (state = 'UNKNOWN' AND version NOT LIKE 'unscored/%') AS refused FROM scored GROUP BY 1")
def _(spark, sf_dir):
    rows = QUERIES["scored_frames"](spark, sf_dir)
    return rows.groupBy("crossing_id").agg(F.count_if(sessions.policy_unknown()).alias("policy"), F.count_if((F.col("state") == "UNKNOWN") & ~sessions.policy_unknown()).alias("refused"))
