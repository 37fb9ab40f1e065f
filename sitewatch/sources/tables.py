"""Readings, poll records and scenes derived from the given tables. Event time is in whole
milliseconds since 1970 (UTC), truncated once, here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_MS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One judgement for each event."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('X', user_id % 3) AS crossing_id", "concat('C', user_id % 6) AS camera_id", f"{EPOCH_MS} AS t",
        "CASE WHEN event_type IN ('purchase', 'signup') THEN 'BLOCKED' WHEN event_type = 'error' THEN 'UNKNOWN' ELSE 'CLEAR' END AS state",
        "CASE WHEN event_type = 'error' THEN 0D ELSE least(1D, value / 500) END AS confidence",
        "sha2(cast(event_id AS string), 256) AS digest", "'v1' AS version",
    )


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a first detector and, a day later, of a second one for each seventh of them."""
    first = readings(spark, sf_dir).withColumn("ingested", F.col("t") + 60_000)
    second = first.where("event_id % 7 = 0").withColumns({"version": F.lit("v2"), "state": F.expr("CASE state WHEN 'BLOCKED' THEN 'CLEAR' WHEN 'CLEAR' THEN 'BLOCKED' ELSE state END"), "ingested": F.col("t") + 86_400_000})
    return first.unionByName(second)


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One HTTP poll for each event; errors are 404, 500 and answers without a body."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('C', user_id % 6) AS camera_id", f"{EPOCH_MS} AS fetched",
        "CASE event_type WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END WHEN 'view' THEN 304 ELSE 200 END AS http",
        "event_type = 'error' AS bad", "cast(get_json_object(props, '$.k') AS int) AS k",
    ).selectExpr("event_id", "camera_id", "fetched", "http", "CASE WHEN http = 200 AND NOT bad THEN sha2(cast(k % 4 AS string), 256) END AS hash",
        "CASE WHEN http = 200 AND NOT bad THEN 1000L + k END AS size",
        "CASE WHEN k % 10 = 0 THEN NULL WHEN k % 10 = 1 THEN fetched + 3600000 ELSE fetched - 90000 END AS modified")


def scenes(spark: SparkSession, sf_dir: str, blocked: bool = False) -> DataFrame:
    """An 8 x 8 picture, as 64 grey levels, for each embedding; `blocked` covers rows 3-5 of some."""
    covered = "vec_id % 11 = 0 AND i BETWEEN 24 AND 47" if blocked else "false"
    pixel = f"CASE WHEN {covered} THEN 20 ELSE cast(greatest(0, least(255, floor((cast(x AS double) + 0.6D) / 1.2D * 127) + 40 * (vec_id % 3))) AS int) END"
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "concat('C', label) AS camera_id", f"transform(embedding, (x, i) -> {pixel}) AS pixels")


#: The same for DuckDB, as common table expressions.
READINGS_SQL = """readings AS (
  SELECT event_id, 'X' || (user_id % 3) AS crossing_id, 'C' || (user_id % 6) AS camera_id, (epoch_us(ts) // 1000) AS t,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'BLOCKED' WHEN event_type = 'error' THEN 'UNKNOWN' ELSE 'CLEAR' END AS state,
    CASE WHEN event_type = 'error' THEN 0 ELSE least(1.0::DOUBLE, value / 500) END AS confidence,
    sha256(event_id::VARCHAR) AS digest, 'v1' AS version FROM events)"""
LAYERED_SQL = READINGS_SQL + """, layered AS (
  SELECT *, t + 60000 AS ingested FROM readings UNION ALL
  SELECT * REPLACE ('v2' AS version, CASE state WHEN 'BLOCKED' THEN 'CLEAR' WHEN 'CLEAR' THEN 'BLOCKED' ELSE state END AS state), t + 86400000 AS ingested
  FROM readings WHERE event_id % 7 = 0)"""
POLLS_SQL = """polls AS (
  SELECT event_id, camera_id, fetched, http, CASE WHEN http = 200 AND NOT bad THEN sha256((k % 4)::VARCHAR) END AS hash, CASE WHEN http = 200 AND NOT bad THEN 1000 + k END AS size,
    CASE WHEN k % 10 = 0 THEN NULL WHEN k % 10 = 1 THEN fetched + 3600000 ELSE fetched - 90000 END AS modified
  FROM (SELECT event_id, 'C' || (user_id % 6) AS camera_id, (epoch_us(ts) // 1000) AS fetched,
    CASE event_type WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END WHEN 'view' THEN 304 ELSE 200 END AS http, event_type = 'error' AS bad, (props->>'$.k')::INT AS k FROM events))"""
