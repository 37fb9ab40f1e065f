"""Queries by name over the given tables, each with the SQL that says the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import history, labels, polling, scenes, sessions
from .sources import tables
from .sources.tables import LAYERED_SQL, POLLS_SQL, READINGS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


ISO = "strftime(make_timestamp(started * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN started % 1000 = 0 THEN '' ELSE '.' || lpad((started % 1000)::VARCHAR, 3, '0') || '000' END || '+00:00'"
SESSIONS_SQL = f"""{READINGS_SQL}, runs AS (
  SELECT *, coalesce(sum(b) OVER (PARTITION BY crossing_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 0) AS run FROM (
    SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY crossing_id ORDER BY t, event_id) > 900000 THEN 1 ELSE 0 END AS b
    FROM readings WHERE state = 'BLOCKED')),
sessions AS (
  SELECT substr(sha256(crossing_id || '|' || {ISO}), 1, 32) AS session_id, *,
    readings >= 2 AND seconds >= 300 AS certified FROM (
    SELECT crossing_id, min(t) AS started, max(t) AS ended, (max(t) - min(t)) // 1000 AS seconds, count(*) AS readings,
      max(confidence) AS peak, arg_min(version, (t, event_id)) AS version FROM runs GROUP BY crossing_id, run))"""


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.derive_sessions(tables.readings(spark, sf_dir))


@query("session_derivation", f"WITH {SESSIONS_SQL} SELECT session_id, crossing_id, started, ended, seconds, readings, round(peak, 6) AS peak, version, certified FROM sessions")
def _(spark, sf_dir):
    return derived(spark, sf_dir).withColumn("peak", F.round("peak", 6))


ALERTS_SQL = """epochs AS (SELECT *, sum(g) OVER (PARTITION BY crossing_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM (
    SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY crossing_id ORDER BY t, event_id) > 1200000 THEN 1 ELSE 0 END AS g FROM readings WHERE state <> 'UNKNOWN')),
  numbered AS (SELECT *, sum(c) OVER (PARTITION BY crossing_id, epoch ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN state <> lag(state) OVER (PARTITION BY crossing_id, epoch ORDER BY t, event_id) THEN 1 ELSE 0 END AS c FROM epochs)),
  kth AS (SELECT *, row_number() OVER (PARTITION BY crossing_id, epoch, run ORDER BY t, event_id) AS k FROM numbered),
  marks AS (SELECT *, lag(mark) OVER (PARTITION BY crossing_id, epoch ORDER BY t, event_id) AS before FROM (
    SELECT *, CASE WHEN state = 'BLOCKED' AND k >= 2 THEN 'F' WHEN state = 'CLEAR' AND k >= 3 THEN 'R' END AS mark FROM kth) WHERE mark IS NOT NULL)"""


@query("rising_edge_alerts", f"WITH {READINGS_SQL}, {ALERTS_SQL} SELECT crossing_id, t, camera_id, round(confidence, 6) AS confidence FROM marks WHERE mark = 'F' AND (before IS NULL OR before = 'R')")
def _(spark, sf_dir):
    return sessions.rising_edges(tables.readings(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query("count_by_state", f"WITH {READINGS_SQL} SELECT crossing_id, count(*) FILTER (state = 'BLOCKED') AS blocked, count(*) FILTER (state = 'CLEAR') AS clear, count(*) FILTER (state = 'UNKNOWN') AS unknown FROM readings GROUP BY 1")
def _(spark, sf_dir):
    of = lambda s: F.count_if(F.col("state") == s)
    return tables.readings(spark, sf_dir).groupBy("crossing_id").agg(of("BLOCKED").alias("blocked"), of("CLEAR").alias("clear"), of("UNKNOWN").alias("unknown"))


SPANS_SQL = """ends AS (SELECT crossing_id, t, least(coalesce(nxt, t + 900000), t + 900000) AS e FROM (
    SELECT *, min(t) OVER (PARTITION BY camera_id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM readings) WHERE state = 'BLOCKED'),
  spans AS (SELECT crossing_id, min(t) AS span_start, max(e) AS span_end FROM (
    SELECT *, sum(n) OVER (PARTITION BY crossing_id ORDER BY t, e ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN t <= max(e) OVER (PARTITION BY crossing_id ORDER BY t, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM ends))
    GROUP BY crossing_id, island)"""


@query("blocked_spans", f"WITH {READINGS_SQL}, {SPANS_SQL} SELECT * FROM spans")
def _(spark, sf_dir):
    return sessions.blocked_spans(tables.readings(spark, sf_dir))


#: 2024-01-10 and a day later, UTC.
DAY, NEXT = 1_704_844_800_000, 1_704_931_200_000


@query("blocked_spans_clipped", f"WITH {READINGS_SQL}, {SPANS_SQL} SELECT crossing_id, greatest(span_start, {DAY}) AS span_start, least(span_end, {NEXT}) AS span_end FROM spans WHERE greatest(span_start, {DAY}) < least(span_end, {NEXT})")
def _(spark, sf_dir):
    return sessions.clip(sessions.blocked_spans(tables.readings(spark, sf_dir)), DAY, NEXT)


@query("board_at", f"""WITH {READINGS_SQL}, votes AS (
  SELECT crossing_id, camera_id, arg_max(state, (t, event_id)) AS state, max(t) AS t, {NEXT} - max(t) <= 900000 AS fresh FROM readings WHERE t <= {NEXT} GROUP BY 1, 2),
 w AS (SELECT crossing_id, max((t, camera_id)) FILTER (fresh AND state = 'BLOCKED') AS b, max((t, camera_id)) FILTER (fresh AND state = 'CLEAR') AS c,
   max((t, camera_id)) FILTER (fresh AND state = 'UNKNOWN') AS u, count(*) FILTER (fresh) AS n FROM votes GROUP BY 1)
 SELECT crossing_id, {NEXT}::BIGINT AS at, CASE WHEN b IS NOT NULL THEN 'BLOCKED' WHEN c IS NOT NULL THEN 'CLEAR' ELSE 'UNKNOWN' END AS state, n = 0 AS stale,
   coalesce(b, c, u)[2] AS witness, coalesce(b, c, u)[1] AS witness_t FROM w""")
def _(spark, sf_dir):
    return sessions.board(tables.readings(spark, sf_dir), NEXT).withColumn("at", F.col("at").cast("long"))


@query("consensus_transitions", f"""WITH {READINGS_SQL}, held AS (SELECT * FROM (
   SELECT *, least(coalesce(lead(t) OVER (PARTITION BY camera_id ORDER BY t, event_id), t + 900001), t + 900001) AS gone FROM readings) WHERE gone > t),
 instants AS (SELECT DISTINCT crossing_id, t FROM readings),
 judged AS (SELECT a.crossing_id, a.t, CASE WHEN bool_or(h.state = 'BLOCKED') THEN 'BLOCKED' WHEN bool_or(h.state = 'CLEAR') THEN 'CLEAR' ELSE 'UNKNOWN' END AS state
   FROM instants a LEFT JOIN held h ON h.crossing_id = a.crossing_id AND h.t <= a.t AND h.gone > a.t GROUP BY 1, 2)
 SELECT crossing_id, t, state FROM (SELECT *, lag(state) OVER (PARTITION BY crossing_id ORDER BY t) AS before FROM judged) WHERE before IS NULL OR before <> state""")
def _(spark, sf_dir):
    return sessions.transitions(tables.readings(spark, sf_dir))


@query("suggested_gap", f"""WITH {READINGS_SQL} SELECT camera_id, CASE WHEN count(*) < 3 THEN 900000.0::DOUBLE ELSE greatest(max(d) * 2.0::DOUBLE, median(d) * 4, 900000) END AS gap_ms
 FROM (SELECT *, t - lag(t) OVER (PARTITION BY camera_id ORDER BY t) AS d FROM readings) GROUP BY 1""")
def _(spark, sf_dir):
    return sessions.suggested_gap(tables.readings(spark, sf_dir))


@query("late_arrivals_ignored", f"""WITH {READINGS_SQL}, late AS (SELECT event_id, camera_id, CASE WHEN event_id % 5 = 0 THEN t - 3600000 ELSE t END AS t FROM readings)
 SELECT event_id, camera_id, t FROM (SELECT *, max(t) OVER (PARTITION BY camera_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM late) WHERE m IS NULL OR t >= m""")
def _(spark, sf_dir):
    late = tables.readings(spark, sf_dir).selectExpr("event_id", "camera_id", "CASE WHEN event_id % 5 = 0 THEN t - 3600000 ELSE t END AS t")
    return sessions.newest_only(late)


@query("flag_clusters", f"""WITH {READINGS_SQL}, f AS (SELECT *, sum(b) OVER (PARTITION BY camera_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
   SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY camera_id ORDER BY t, event_id) > 3600000 THEN 1 ELSE 0 END AS b FROM readings WHERE state = 'UNKNOWN'))
 SELECT camera_id, min(t) AS first_t, max(t) AS last_t, count(*) AS flags FROM f GROUP BY camera_id, run HAVING count(*) >= 3""")
def _(spark, sf_dir):
    return sessions.flag_clusters(tables.readings(spark, sf_dir).where("state = 'UNKNOWN'"), within_ms=3_600_000)


RESOLVED_SQL = f"""{LAYERED_SQL}, resolved AS (SELECT * FROM layered QUALIFY row_number() OVER (PARTITION BY camera_id, t ORDER BY ingested DESC, version DESC, event_id DESC) = 1)"""


@query("layer_resolution", f"WITH {RESOLVED_SQL} SELECT event_id, camera_id, t, state, version FROM resolved")
def _(spark, sf_dir):
    return history.latest_layer(tables.layered(spark, sf_dir), ["camera_id", "t"]).select("event_id", "camera_id", "t", "state", "version")


@query("timeline", f"WITH {RESOLVED_SQL} SELECT camera_id, t, state, round(confidence, 6) AS confidence, version FROM resolved WHERE crossing_id = 'X1' AND t BETWEEN {DAY} AND {NEXT}")
def _(spark, sf_dir):
    return history.timeline(tables.layered(spark, sf_dir), "X1", DAY, NEXT).orderBy("t", "camera_id").select("camera_id", "t", "state", F.round("confidence", 6).alias("confidence"), "version")


VERSIONS_SQL = f"""{SESSIONS_SQL}, versions AS (
  SELECT session_id, crossing_id, started, seconds, CASE WHEN crossing_id = 'X2' THEN NULL ELSE readings END AS readings, 'v1' AS version, started + 60000 AS ingested FROM sessions UNION ALL
  SELECT session_id, crossing_id, started, seconds + 60, readings, 'v2', started + 86400000 FROM sessions WHERE started % 5 = 0)"""


@query("session_list", f"""WITH {VERSIONS_SQL}, one AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ingested DESC, version DESC) = 1)
 SELECT session_id, crossing_id, started, seconds, version, readings IS NULL OR (readings >= 2 AND seconds >= 300) AS certified FROM one ORDER BY started DESC, session_id LIMIT 50""")
def _(spark, sf_dir):
    s = derived(spark, sf_dir)
    first = s.select("session_id", "crossing_id", "started", "seconds", F.expr("CASE WHEN crossing_id = 'X2' THEN NULL ELSE readings END").alias("readings"), F.lit("v1").alias("version"), (F.col("started") + 60_000).alias("ingested"))
    second = s.where("started % 5 = 0").select("session_id", "crossing_id", "started", (F.col("seconds") + 60).alias("seconds"), "readings", F.lit("v2").alias("version"), (F.col("started") + 86_400_000).alias("ingested"))
    one = history.latest_layer(first.unionByName(second), ["session_id"])
    return one.select("session_id", "crossing_id", "started", "seconds", "version", scalars.certified("readings", "seconds").alias("certified")).orderBy(F.desc("started"), "session_id").limit(50)


LOCAL = "timezone('America/Los_Angeles', make_timestamptz({} * 1000))"


@query("hour_of_week", f"""WITH {RESOLVED_SQL}, g AS (SELECT crossing_id, dayofweek({LOCAL.format('t')}) * 24 + hour({LOCAL.format('t')}) AS slot, count(*) FILTER (state = 'BLOCKED') AS blocked, count(*) AS scoreable
   FROM resolved WHERE state <> 'UNKNOWN' GROUP BY 1, 2)
 SELECT c.crossing_id, s.slot::INT AS slot, coalesce(blocked, 0) AS blocked, coalesce(scoreable, 0) AS scoreable FROM (SELECT DISTINCT crossing_id FROM g) c CROSS JOIN range(168) s(slot) LEFT JOIN g ON g.crossing_id = c.crossing_id AND g.slot = s.slot""")
def _(spark, sf_dir):
    return history.hour_grid(history.latest_layer(tables.layered(spark, sf_dir), ["camera_id", "t"]))


@query("crossing_summary", f"""WITH {RESOLVED_SQL}, {SESSIONS_SQL[len(READINGS_SQL) + 2:]},
 seen AS (SELECT crossing_id, count(*) FILTER (state = 'BLOCKED') AS b, count(*) AS s, round(greatest(1.0::DOUBLE, (max(t) - min(t)) / 86400000), 2) AS days FROM resolved WHERE state <> 'UNKNOWN' GROUP BY 1),
 kept AS (SELECT crossing_id, count(*) AS n, sum(round_even(seconds / 60, 0)) AS m FROM sessions WHERE certified GROUP BY 1)
 SELECT crossing_id, round(b / s, 4) AS blocked_share, coalesce(n, 0) AS sessions_closed, days AS coverage_days, round(coalesce(m, 0) / days, 1) AS minutes_per_day FROM seen LEFT JOIN kept USING (crossing_id)""")
def _(spark, sf_dir):
    return history.summary(history.latest_layer(tables.layered(spark, sf_dir), ["camera_id", "t"]), derived(spark, sf_dir))


@query("daily_minutes", f"WITH {SESSIONS_SQL} SELECT crossing_id, strftime({LOCAL.format('started')}, '%Y-%m-%d') AS day, sum(round_even(seconds / 60, 0))::BIGINT AS minutes FROM sessions WHERE certified GROUP BY 1, 2")
def _(spark, sf_dir):
    return history.daily_minutes(derived(spark, sf_dir))


@query("duration_histogram", f"""WITH {SESSIONS_SQL}, b AS (SELECT crossing_id, CASE WHEN seconds < 600 THEN 0 WHEN seconds < 1200 THEN 1 WHEN seconds < 1800 THEN 2 WHEN seconds < 2700 THEN 3 WHEN seconds < 3600 THEN 4 ELSE 5 END AS bin, count(*) AS n FROM sessions WHERE certified GROUP BY 1, 2)
 SELECT c.crossing_id, s.bin::INT AS bin, coalesce(n, 0) AS sessions FROM (SELECT DISTINCT crossing_id FROM sessions) c CROSS JOIN range(6) s(bin) LEFT JOIN b ON b.crossing_id = c.crossing_id AND b.bin = s.bin""")
def _(spark, sf_dir):
    return history.duration_histogram(derived(spark, sf_dir))


@query("day_night", f"""WITH {SESSIONS_SQL}, newest AS (SELECT *, CASE WHEN hour({LOCAL.format('started')}) BETWEEN 6 AND 17 THEN 'day' ELSE 'night' END AS part FROM sessions WHERE certified AND seconds > 0 QUALIFY row_number() OVER (PARTITION BY crossing_id ORDER BY started DESC, session_id) <= 500),
 r AS (SELECT *, row_number() OVER (PARTITION BY crossing_id, part ORDER BY seconds, session_id) AS r, count(*) OVER (PARTITION BY crossing_id, part) AS n FROM newest),
 m AS (SELECT * FROM r WHERE r = n // 2 + 1 AND n >= 3)
 SELECT crossing_id, part, round(seconds / 60, 6) AS median_minutes, n FROM m WHERE crossing_id IN (SELECT crossing_id FROM m GROUP BY 1 HAVING count(*) = 2)""")
def _(spark, sf_dir):
    return history.day_night(derived(spark, sf_dir))


@query("longest_sessions", f"WITH {SESSIONS_SQL} SELECT session_id, crossing_id, seconds FROM sessions WHERE certified AND (SELECT count(*) FROM sessions WHERE certified) >= 3 ORDER BY seconds DESC, started, crossing_id LIMIT 5")
def _(spark, sf_dir):
    return history.longest(derived(spark, sf_dir))


@query("coverage", f"""WITH {READINGS_SQL}, m AS (SELECT crossing_id, camera_id, min(t) AS low, max(t) AS high, count(*) AS n FROM readings GROUP BY 1, 2)
 SELECT *, low - min(low) OVER (PARTITION BY crossing_id) AS late_ms, max(high) OVER (PARTITION BY crossing_id) - high AS early_ms FROM m""")
def _(spark, sf_dir):
    return history.coverage(tables.readings(spark, sf_dir))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.readings(spark, sf_dir).select("camera_id", "crossing_id").distinct().withColumn("scores", F.col("camera_id") != "C5")


@query("roster_groups", f"WITH {READINGS_SQL} SELECT crossing_id, count(DISTINCT camera_id) AS cameras, string_agg(DISTINCT camera_id, ',' ORDER BY camera_id) FILTER (camera_id <> 'C5') AS witnesses FROM readings GROUP BY 1")
def _(spark, sf_dir):
    return roster(spark, sf_dir).groupBy("crossing_id").agg(F.count("*").alias("cameras"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("scores"), F.col("camera_id")))), ",").alias("witnesses"))


@query("rebuild_violations", f"""WITH {READINGS_SQL}, r AS (SELECT * FROM readings WHERE camera_id <> 'C3' OR t > {DAY}), seen AS (SELECT *, low - min(low) OVER (PARTITION BY crossing_id) AS late, max(high) OVER (PARTITION BY crossing_id) - high AS early FROM (SELECT crossing_id, camera_id, min(t) AS low, max(t) AS high FROM r WHERE camera_id <> 'C4' GROUP BY 1, 2)),
 w AS (SELECT crossing_id, max(high) AS high FROM seen GROUP BY 1), roster AS (SELECT DISTINCT crossing_id, camera_id FROM readings WHERE camera_id <> 'C5')
 SELECT crossing_id, 'live edge' AS rule, high::VARCHAR AS detail FROM w WHERE high > {NEXT} - 900000
 UNION ALL SELECT crossing_id, 'absent witness', camera_id FROM roster WHERE crossing_id IN (SELECT crossing_id FROM w) AND camera_id NOT IN (SELECT camera_id FROM seen)
 UNION ALL SELECT crossing_id, 'short witness', camera_id FROM seen WHERE camera_id <> 'C5' AND (late > 900000 OR early > 900000)""")
def _(spark, sf_dir):
    given = tables.readings(spark, sf_dir).where(f"camera_id <> 'C4' AND (camera_id <> 'C3' OR t > {DAY})")
    return history.violations(given, roster(spark, sf_dir), NEXT)


@query("window_rebuild", f"""WITH {SESSIONS_SQL}, late AS (SELECT crossing_id, min(started) AS low, {NEXT} AS high FROM sessions WHERE started BETWEEN {DAY} AND {NEXT} GROUP BY 1)
 SELECT s.session_id, s.crossing_id, s.started, s.seconds FROM sessions s LEFT JOIN late l ON l.crossing_id = s.crossing_id AND s.started BETWEEN l.low AND l.high WHERE l.crossing_id IS NULL
 UNION ALL SELECT session_id, crossing_id, started, seconds + 1 FROM sessions WHERE started BETWEEN {DAY} AND {NEXT}""")
def _(spark, sf_dir):
    old = derived(spark, sf_dir).select("session_id", "crossing_id", "started", "seconds")
    fresh = old.where(F.col("started").between(DAY, NEXT))
    windows = fresh.groupBy("crossing_id").agg(F.min("started").alias("low"), F.lit(NEXT).alias("high"))
    return history.rebuilt(old, fresh.withColumn("seconds", F.col("seconds") + 1), windows)


@query("layer_union", f"""WITH {LAYERED_SQL}, more AS (SELECT * FROM layered WHERE version = 'v2' OR event_id % 3 = 0 UNION ALL SELECT * REPLACE (state || '!' AS state) FROM layered WHERE version = 'v2' AND event_id % 5 = 0),
 one AS (SELECT *, row_number() OVER (PARTITION BY event_id, version ORDER BY state) AS r FROM more)
 SELECT event_id, version, state, t FROM layered WHERE version = 'v1' UNION ALL SELECT event_id, version, state, t FROM one WHERE r = 1 AND version = 'v2'""")
def _(spark, sf_dir):
    rows = tables.layered(spark, sf_dir).select("event_id", "version", "state", "t")
    again = rows.where("version = 'v2' AND event_id % 5 = 0").withColumn("state", F.concat("state", F.lit("!")))
    return history.with_layer(rows.where("version = 'v1'"), rows.where("version = 'v2' OR event_id % 3 = 0").unionByName(again), ["event_id", "version"])


@query("even_sample", f"""WITH {READINGS_SQL}, n AS (SELECT camera_id, t, row_number() OVER (PARTITION BY camera_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY camera_id) AS n FROM readings WHERE state = 'BLOCKED')
 SELECT DISTINCT camera_id, t FROM n WHERE n <= 10 OR i IN (SELECT floor(j * (n - 1) / 9 + 0.5) FROM range(10) r(j))""")
def _(spark, sf_dir):
    return history.even_sample(tables.readings(spark, sf_dir).where("state = 'BLOCKED'"), ["camera_id"], ["t", "event_id"]).select("camera_id", "t").distinct()


FRAMES_SQL = f"""{POLLS_SQL}, s AS (SELECT *, CASE WHEN http = 304 THEN 'not_modified' WHEN http <> 200 OR hash IS NULL THEN 'error'
    WHEN hash = last_value(hash IGNORE NULLS) OVER (PARTITION BY camera_id ORDER BY fetched, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'duplicate' ELSE 'ok' END AS status FROM polls),
  u AS (SELECT *, status <> 'error' AND modified IS NOT NULL AND modified <= fetched AS usable FROM s),
  k AS (SELECT *, CASE WHEN usable THEN modified ELSE fetched END AS t, CASE WHEN usable THEN 'last_modified' ELSE 'fetched_at' END AS t_source,
    CASE WHEN status = 'error' THEN CASE WHEN http <> 200 THEN 'HTTP ' || http ELSE 'empty body' END END AS message FROM u),
  frames AS (SELECT *, CASE WHEN status <> 'error' THEN last_value(CASE WHEN status = 'ok' THEN camera_id || '/' || t || '-' || substr(hash, 1, 8) END IGNORE NULLS) OVER (PARTITION BY camera_id ORDER BY fetched, event_id ROWS UNBOUNDED PRECEDING) END AS object_key FROM k)"""


@query("poll_frames", f"WITH {FRAMES_SQL} SELECT event_id, camera_id, status, t, t_source, object_key, message FROM frames")
def _(spark, sf_dir):
    return polling.frames(tables.polls(spark, sf_dir)).select("event_id", "camera_id", "status", "t", "t_source", "object_key", "message")


@query("poll_counters", f"WITH {FRAMES_SQL} SELECT camera_id, status, count(*) AS polls, max(fetched) AS last_fetched, coalesce(sum(size) FILTER (status = 'ok'), 0)::BIGINT AS bytes, max(fetched) FILTER (status = 'ok') AS last_new FROM frames GROUP BY 1, 2")
def _(spark, sf_dir):
    return polling.counters(polling.frames(tables.polls(spark, sf_dir)))


@query("error_streaks", f"""WITH {FRAMES_SQL}, g AS (SELECT *, sum((status <> 'error')::INT) OVER (PARTITION BY camera_id ORDER BY fetched, event_id ROWS UNBOUNDED PRECEDING) AS g FROM frames)
 SELECT event_id, camera_id, row_number() OVER (PARTITION BY camera_id, g ORDER BY fetched, event_id)::INT AS streak, least(pow(2, row_number() OVER (PARTITION BY camera_id, g ORDER BY fetched, event_id)), 300)::BIGINT AS wait_s FROM g WHERE status = 'error'""")
def _(spark, sf_dir):
    return polling.streaks(polling.frames(tables.polls(spark, sf_dir))).select("event_id", "camera_id", "streak", "wait_s")


@query("refresh_cadence", f"""WITH {FRAMES_SQL}, l AS (SELECT camera_id, hash, max(t) AS t FROM frames WHERE hash IS NOT NULL GROUP BY 1, 2),
 g AS (SELECT * FROM (SELECT camera_id, t - lag(t) OVER (PARTITION BY camera_id ORDER BY t) AS gap FROM l) WHERE gap IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY gap) AS r, count(*) OVER (PARTITION BY camera_id) AS n FROM g)
 SELECT camera_id, max(gap) FILTER (r = n // 2 + 1) AS median_ms, max(gap) FILTER (r = floor(n * 0.9) + 1) AS p90_ms, max(n) AS gaps FROM r GROUP BY 1""")
def _(spark, sf_dir):
    return polling.refresh_cadence(polling.frames(tables.polls(spark, sf_dir)))


@query("feed_health", f"""WITH {FRAMES_SQL}, f AS (SELECT *, sum((status <> 'error')::INT) OVER (PARTITION BY camera_id ORDER BY fetched, event_id ROWS UNBOUNDED PRECEDING) AS g FROM frames WHERE fetched <= {NEXT}),
 c AS (SELECT camera_id, max(fetched) AS polled, max(fetched) FILTER (status = 'ok') AS imaged, max(fetched) FILTER (status <> 'error') AS answered, max(g) AS g FROM f GROUP BY 1),
 e AS (SELECT c.*, (SELECT count(*) FROM f WHERE f.camera_id = c.camera_id AND f.g = c.g AND status = 'error') AS e FROM c),
 a AS (SELECT count(*) AS cameras, max(polled) AS polled, max(imaged) AS imaged, max(answered) AS answered, min(e) AS least FROM e),
 v AS (SELECT *, CASE WHEN cameras = 0 THEN 'ok' WHEN polled < {NEXT} - 300000 THEN 'capture_stale' WHEN least >= 3 THEN 'upstream_down' WHEN imaged < {NEXT} - 900000 THEN 'upstream_stale' ELSE 'ok' END AS verdict FROM a)
 SELECT verdict, CASE verdict WHEN 'capture_stale' THEN polled WHEN 'upstream_down' THEN answered WHEN 'upstream_stale' THEN imaged END AS since, cameras, polled, imaged FROM v""")
def _(spark, sf_dir):
    return polling.feed_health(polling.frames(tables.polls(spark, sf_dir)), NEXT)


@query("sliding_rates", f"WITH {READINGS_SQL} SELECT state, t // 60000 + j AS minute, round(count(*) / 10, 6) AS per_minute FROM readings CROSS JOIN range(10) r(j) GROUP BY 1, 2")
def _(spark, sf_dir):
    return polling.sliding_rates(tables.readings(spark, sf_dir), "state", "t").withColumn("per_minute", F.round("per_minute", 6))


#: Limits for pictures of eight rows.
SMALL = scenes.Thresholds(changed_pixel=25, spread_multiple=3.0, least_rows=3)


def scenes_sql(blocked: bool) -> str:
    covered = "vec_id % 11 = 0 AND i BETWEEN 25 AND 48" if blocked else "false"
    return f"SELECT vec_id, 'C' || label AS camera_id, i - 1 AS pos, CASE WHEN {covered} THEN 20 ELSE greatest(0, least(255, floor((x::DOUBLE + 0.6::DOUBLE) / 1.2::DOUBLE * 127) + 40 * (vec_id % 3)))::INT END AS x FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"


def bright_sql(of: str) -> str:
    return f"SELECT vec_id, camera_id, least(floor(floor(quantile_cont(x, 0.75)) * 8 / 256), 7)::INT AS bin, avg(x) AS luminance FROM {of} GROUP BY 1, 2"


MODEL_SQL = f"""plain AS ({scenes_sql(False)}), pb AS ({bright_sql('plain')}),
 enough AS (SELECT camera_id, bin, count(*) AS frames FROM pb GROUP BY 1, 2 HAVING count(*) >= 15),
 flat AS (SELECT e.camera_id, e.bin, e.frames, p.pos, p.x FROM plain p JOIN pb USING (vec_id, camera_id) JOIN enough e ON e.camera_id = pb.camera_id AND e.bin = pb.bin),
 mid AS (SELECT camera_id, bin, frames, pos, median(x) AS m FROM flat GROUP BY 1, 2, 3, 4),
 model AS (SELECT camera_id, bin, frames, pos, floor(any_value(m))::INT AS median, median(abs(x - m)) AS spread FROM flat JOIN mid USING (camera_id, bin, frames, pos) GROUP BY 1, 2, 3, 4)"""


@query("scene_brightness", f"WITH s AS ({scenes_sql(True)}) SELECT vec_id, camera_id, bin, round(luminance, 6) AS luminance FROM ({bright_sql('s')})")
def _(spark, sf_dir):
    return scenes.brightness(tables.scenes(spark, sf_dir, True)).select("vec_id", "camera_id", "bin", F.round("luminance", 6).alias("luminance"))


@query("scene_reference", f"WITH {MODEL_SQL} SELECT camera_id, bin, frames, pos::INT AS pos, median, round(spread, 6) AS spread FROM model")
def _(spark, sf_dir):
    return scenes.reference(tables.scenes(spark, sf_dir)).withColumn("spread", F.round("spread", 6))


@query("scene_verdicts", f"""WITH {MODEL_SQL}, s AS ({scenes_sql(True)}), b AS ({bright_sql('s')}), bins AS (SELECT DISTINCT camera_id, bin FROM model),
 near AS (SELECT b.vec_id, b.camera_id, luminance, bins.bin AS r FROM b LEFT JOIN bins ON bins.camera_id = b.camera_id AND abs(bins.bin - b.bin) <= 1 QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY abs(bins.bin - b.bin), bins.bin) = 1),
 mask AS (SELECT n.vec_id, s.pos // 8 AS row, (abs(s.x - m.median) > greatest(25.0, 3 * m.spread))::INT AS hit FROM near n JOIN s USING (vec_id) JOIN model m ON m.camera_id = n.camera_id AND m.bin = n.r AND m.pos = s.pos),
 rows AS (SELECT vec_id, row, avg(hit) AS d, sum(hit) AS h FROM mask GROUP BY 1, 2),
 per AS (SELECT vec_id, count(*) FILTER (d > 0.45) AS band, sum(h) / 64 AS changed FROM rows GROUP BY 1),
 j AS (SELECT n.vec_id, camera_id, band, luminance, r, changed, CASE WHEN luminance < 12 THEN 'UNKNOWN' WHEN r IS NULL THEN 'UNKNOWN' WHEN band >= 3 THEN 'BLOCKED' WHEN changed <= 0.10 THEN 'CLEAR' ELSE 'UNKNOWN' END AS state FROM near n LEFT JOIN per USING (vec_id))
 SELECT vec_id, camera_id, state, round(CASE state WHEN 'BLOCKED' THEN least(0.95, 0.6 + 0.35 * least(1.0, band / 9)) WHEN 'CLEAR' THEN 0.85 ELSE 0 END, 6)::DOUBLE AS confidence,
   CASE WHEN luminance < 12 THEN 'below the limit of light (mean level ' || round_even(luminance, 0)::INT || ')' WHEN r IS NULL THEN 'nothing to compare with at this brightness'
     WHEN band >= 3 THEN 'obstructed in ' || band || ' rows, ' || round_even(changed * 100, 0)::INT || '% of pixels changed' WHEN changed <= 0.10 THEN 'looks as when empty (' || round_even(changed * 100, 0)::INT || '% changed)'
     ELSE round_even(changed * 100, 0)::INT || '% changed, but full rows are too few (' || band || ')' END AS reason, 'reference/d25-r0.45-b3-c0.1' AS version FROM j""")
def _(spark, sf_dir):
    return scenes.judged(tables.scenes(spark, sf_dir, True), scenes.reference(tables.scenes(spark, sf_dir)), SMALL)


@query("softmax_verdicts", """SELECT event_id, CASE WHEN p >= 0.7 THEN 'BLOCKED' WHEN p <= 0.3 THEN 'CLEAR' ELSE 'UNKNOWN' END AS state, round(CASE WHEN p >= 0.7 THEN p WHEN p <= 0.3 THEN 1 - p ELSE 0 END, 6) AS confidence
 FROM (SELECT event_id, 1 / (1 + exp((event_id % 7) - value / 40)) AS p FROM events)""")
def _(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events").selectExpr("event_id", "value / 40 AS b", "cast(event_id % 7 AS double) AS c")
    return scenes.softmax_verdict(rows, "b", "c").select("event_id", "state", F.round("confidence", 6).alias("confidence"))


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.readings(spark, sf_dir).withColumn("object_key", scalars.frame_key("camera_id", "t", "digest"))


KEY = "'frames/' || camera_id || '/' || strftime(make_timestamp(t * 1000), '%Y/%m/%d/%H') || '/' || t || '-' || substr(digest, 1, 8) || '.jpg'"
FRAMED_SQL = f"framed AS (SELECT *, {KEY} AS object_key FROM readings)"


@query("frame_keys", f"WITH {READINGS_SQL}, {FRAMED_SQL} SELECT event_id, object_key, t FROM framed")
def _(spark, sf_dir):
    return framed(spark, sf_dir).select("event_id", "object_key", scalars.frame_time("object_key").alias("t"))


LABELS_SQL = f"""{SESSIONS_SQL}, {FRAMED_SQL}, gold AS (SELECT * FROM framed WHERE event_id % 97 = 0), sweep AS (SELECT * FROM framed WHERE state = 'CLEAR' AND confidence >= 0.1 AND event_id % 3 = 0),
 rest AS (SELECT * FROM framed WHERE object_key NOT IN (SELECT object_key FROM gold)),
 core AS (SELECT * FROM rest f WHERE EXISTS (SELECT 1 FROM sessions s WHERE s.crossing_id = f.crossing_id AND f.t BETWEEN s.started + 120000 AND s.ended - 120000)),
 quiet AS (SELECT * FROM rest f WHERE NOT EXISTS (SELECT 1 FROM sessions s WHERE s.crossing_id = f.crossing_id AND f.t BETWEEN s.started - 1800000 AND s.ended + 1800000))"""


@query("core_frames", f"WITH {LABELS_SQL} SELECT event_id FROM core")
def _(spark, sf_dir):
    f = framed(spark, sf_dir)
    return labels.in_core(f.join(f.where("event_id % 97 = 0").select("object_key"), "object_key", "left_anti"), derived(spark, sf_dir)).select("event_id")


@query("quiet_frames", f"WITH {LABELS_SQL} SELECT event_id FROM quiet")
def _(spark, sf_dir):
    f = framed(spark, sf_dir)
    return labels.quiet(f.join(f.where("event_id % 97 = 0").select("object_key"), "object_key", "left_anti"), derived(spark, sf_dir)).select("event_id")


@query("weak_labels", f"""WITH {LABELS_SQL}, u AS (SELECT object_key, camera_id, 'BLOCKED' AS label, 'session' AS source, 0 AS p FROM core UNION ALL
   SELECT object_key, camera_id, 'CLEAR', 'sweep', 1 FROM rest WHERE object_key IN (SELECT object_key FROM sweep) UNION ALL SELECT object_key, camera_id, 'CLEAR', 'quiet', 2 FROM quiet),
 one AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY object_key ORDER BY p) = 1),
 n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256(object_key), object_key) AS r, count(*) OVER (PARTITION BY label) AS n FROM one)
 SELECT object_key, camera_id, label, source, CASE WHEN r <= greatest(1, floor(n * 0.15)) THEN 'val' ELSE 'train' END AS split FROM n""")
def _(spark, sf_dir):
    f = framed(spark, sf_dir)
    return labels.weak_labels(f, derived(spark, sf_dir), f.where("event_id % 97 = 0"), f.where("state = 'CLEAR' AND confidence >= 0.1 AND event_id % 3 = 0"))


@query("exam_confusion", """WITH x AS (SELECT CASE quality WHEN 1 THEN 'BLOCKED' ELSE 'CLEAR' END AS truth, lang, n_chars FROM labels JOIN documents USING (doc_id)),
 j AS (SELECT 'candidate' AS judge, truth, CASE WHEN lang = 'es' THEN 'UNKNOWN' WHEN n_chars > 200 THEN 'BLOCKED' ELSE 'CLEAR' END AS verdict FROM x UNION ALL
   SELECT 'production', truth, CASE WHEN lang = 'es' THEN 'UNKNOWN' WHEN n_chars > 400 THEN 'BLOCKED' ELSE 'CLEAR' END FROM x)
 SELECT judge, count(*) FILTER (truth = 'BLOCKED' AND verdict = 'BLOCKED') AS tp, count(*) FILTER (truth = 'CLEAR' AND verdict = 'BLOCKED') AS fp, count(*) FILTER (truth = 'CLEAR' AND verdict = 'CLEAR') AS tn,
   count(*) FILTER (truth = 'BLOCKED' AND verdict = 'CLEAR') AS fn, count(*) FILTER (verdict = 'UNKNOWN') AS unknown, count(*) AS n, count(*) FILTER (verdict <> 'UNKNOWN' AND truth <> verdict) AS hard_errors FROM j GROUP BY 1""")
def _(spark, sf_dir):
    x = tables.table(spark, sf_dir, "labels").join(tables.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id").withColumn("truth", F.when(F.col("quality") == 1, "BLOCKED").otherwise("CLEAR"))
    by = lambda name, n: x.select(F.lit(name).alias("judge"), "truth", F.when(F.col("lang") == "es", "UNKNOWN").when(F.col("n_chars") > n, "BLOCKED").otherwise("CLEAR").alias("verdict"))
    return labels.exam(by("candidate", 200).unionByName(by("production", 400)))


@query("name_match", """WITH i AS (SELECT s_suppkey AS item_id, s_name AS name FROM supplier), t AS (SELECT s_suppkey AS target_id, upper(replace(s_name, '#', ' ')) || CASE WHEN s_suppkey % 50 = 0 THEN 'x' ELSE '' END AS name FROM supplier)
 SELECT target_id, t.name, min(item_id) AS item_id FROM t LEFT JOIN i ON regexp_replace(lower(t.name), '[^\\p{L}\\p{N}]', '', 'g') = regexp_replace(lower(i.name), '[^\\p{L}\\p{N}]', '', 'g') GROUP BY 1, 2""")
def _(spark, sf_dir):
    s = tables.table(spark, sf_dir, "supplier")
    targets = s.selectExpr("s_suppkey AS target_id", "concat(upper(replace(s_name, '#', ' ')), CASE WHEN s_suppkey % 50 = 0 THEN 'x' ELSE '' END) AS name")
    return labels.match_names(targets, s.selectExpr("s_suppkey AS item_id", "s_name AS name"))


@query("stride_sample", f"""WITH RECURSIVE {READINGS_SQL}, picks AS (SELECT camera_id, min(t) AS t FROM readings GROUP BY 1 UNION ALL
   SELECT p.camera_id, (SELECT min(r.t) FROM readings r WHERE r.camera_id = p.camera_id AND r.t >= p.t + 43200000) FROM picks p WHERE p.t IS NOT NULL) SELECT camera_id, t FROM picks WHERE t IS NOT NULL""")
def _(spark, sf_dir):
    return labels.stride_sample(tables.readings(spark, sf_dir), 43_200_000)


@query("label_append", f"WITH {READINGS_SQL} SELECT digest, version FROM readings WHERE event_id % 2 = 0 UNION ALL SELECT digest, 'new' FROM readings WHERE event_id % 3 = 0 AND event_id % 2 <> 0")
def _(spark, sf_dir):
    r = tables.readings(spark, sf_dir)
    return labels.add_new(r.where("event_id % 2 = 0").select("digest", "version"), r.where("event_id % 3 = 0").select("digest", F.lit("new").alias("version")), "digest")


@query("texts", f"""WITH {SESSIONS_SQL} SELECT session_id, CASE WHEN floor(seconds / 60 + 0.5) >= 60 THEN (floor(seconds / 60 + 0.5)::INT // 60) || 'h ' || (floor(seconds / 60 + 0.5)::INT % 60) || 'm' ELSE floor(seconds / 60 + 0.5)::INT || 'm' END AS duration,
   CASE WHEN seconds >= 3600 THEN (seconds // 3600)::INT || 'h ' ELSE '' END || (seconds % 3600 // 60)::INT || 'm ' || (seconds % 60)::INT || 's' AS ticker,
   (CASE WHEN hour({LOCAL.format('started')}) % 12 = 0 THEN 12 ELSE hour({LOCAL.format('started')}) % 12 END)::INT || CASE WHEN hour({LOCAL.format('started')}) < 12 THEN 'A' ELSE 'P' END AS hour,
   CASE WHEN peak > 0 AND peak < 0.01 THEN '<1%' ELSE floor(peak * 100 + 0.5)::INT || '%' END AS peak FROM sessions""")
def _(spark, sf_dir):
    s = derived(spark, sf_dir).withColumn("h", F.hour(scalars.local("started")))
    return s.select("session_id", scalars.duration_text("seconds").alias("duration"), scalars.ticker_text("seconds").alias("ticker"), scalars.hour_label("h").alias("hour"), scalars.percent_text("peak").alias("peak"))
