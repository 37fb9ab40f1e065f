"""Boundaries of the session and alert rules, batch and stream."""

import shutil
import tempfile

from sitewatch.operators import history, labels, sessions
from sitewatch.sources import versioned
from sitewatch.streaming import live

MIN = 60_000
SCHEMA = "event_id long, crossing_id string, camera_id string, t long, state string, confidence double, version string"


def rows(spark, *given):
    return spark.createDataFrame([(i, c, cam, t, s, 0.9, "v1") for i, (c, cam, t, s) in enumerate(given)], SCHEMA)


def found(df):
    return sorted((r["started"], r["ended"], r["readings"]) for r in df.collect())


def test_gap_is_inclusive(spark):
    df = rows(spark, ("X", "a", 0, "BLOCKED"), ("X", "b", 15 * MIN, "BLOCKED"), ("X", "a", 30 * MIN + 1, "BLOCKED"))
    assert found(sessions.derive_sessions(df)) == [(0, 15 * MIN, 2), (30 * MIN + 1, 30 * MIN + 1, 1)]


def test_clear_and_unknown_do_not_split_and_crossings_are_apart(spark):
    df = rows(spark, ("X", "a", 0, "BLOCKED"), ("X", "a", 1, "CLEAR"), ("X", "a", 2, "UNKNOWN"), ("X", "a", 3, "BLOCKED"), ("Y", "b", 1, "BLOCKED"))
    assert found(sessions.derive_sessions(df)) == [(0, 3, 2), (1, 1, 1)]


def test_empty_input(spark):
    df = rows(spark, ("X", "a", 0, "BLOCKED")).where("false")
    assert sessions.derive_sessions(df).count() == sessions.rising_edges(df).count() == sessions.blocked_spans(df).count() == 0


def test_alert_fires_once_and_rearms(spark):
    states = "BBBBCCBBCCCBBU"
    names = {"B": "BLOCKED", "C": "CLEAR", "U": "UNKNOWN"}
    df = rows(spark, *[("X", "a", i * MIN, names[s]) for i, s in enumerate(states)])
    assert [r["t"] // MIN for r in sessions.rising_edges(df).orderBy("t").collect()] == [1, 12]


def test_silence_ends_an_epoch(spark):
    df = rows(spark, ("X", "a", 0, "BLOCKED"), ("X", "a", 20 * MIN, "BLOCKED"), ("X", "a", 40 * MIN + 1, "BLOCKED"), ("X", "a", 41 * MIN, "BLOCKED"))
    assert [r["t"] for r in sessions.rising_edges(df).orderBy("t").collect()] == [20 * MIN, 41 * MIN]


def test_a_stale_reading_never_counts_as_clear(spark):
    df = rows(spark, ("X", "a", 0, "CLEAR"))
    assert [(r["state"], r["stale"]) for r in sessions.board(df, 15 * MIN).collect()] == [("CLEAR", False)]
    assert [(r["state"], r["stale"]) for r in sessions.board(df, 15 * MIN + 1).collect()] == [("UNKNOWN", True)]


def test_spans_merge_when_they_touch(spark):
    df = rows(spark, ("X", "a", 0, "BLOCKED"), ("X", "b", 15 * MIN, "BLOCKED"), ("X", "b", 16 * MIN, "CLEAR"))
    assert [(r["span_start"], r["span_end"]) for r in sessions.blocked_spans(df).collect()] == [(0, 16 * MIN)]


def test_local_midnight_and_both_clock_changes(spark):
    from sitewatch.functions.scalars import local

    at = {"2024-03-10T09:59": (1, 59), "2024-03-10T10:00": (3, 0), "2024-11-03T08:59": (1, 59), "2024-11-03T09:00": (1, 0), "2024-01-02T08:00": (0, 0)}
    df = spark.createDataFrame([(k,) for k in at], "s string").selectExpr("s", "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(s AS timestamp_ntz)) AS t")
    got = {r["s"]: (r["l"].hour, r["l"].minute) for r in df.withColumn("l", local("t")).collect()}
    assert got == at


def test_stride_is_a_recurrence(spark):
    df = rows(spark, *[("X", "a", t, "CLEAR") for t in (0, 6, 10, 16, 21)])
    assert sorted(r["t"] for r in labels.stride_sample(df, 10).collect()) == [0, 10, 21]


def test_even_sample_keeps_ends(spark):
    df = rows(spark, *[("X", "a", t, "CLEAR") for t in range(23)])
    got = sorted(r["t"] for r in history.even_sample(df, ["camera_id"], ["t"]).collect())
    assert got == sorted({int(i * 22 / 9 + 0.5) for i in range(10)})


def streamed(spark, df, make, parts=3):
    """The rows a stream gives when df arrives in some files by time, and once more far later."""
    folder = tempfile.mkdtemp(prefix="stream-")
    given = sorted(df.collect(), key=lambda r: r["t"])
    size = -(-len(given) // parts)
    for i in range(parts):
        spark.createDataFrame(given[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").json(f"{folder}/in")
    for i in (1, 2):  # moves the watermark
        last = spark.createDataFrame([(10**6 + i, "Z", "z", given[-1]["t"] + i * 86_400_000, "BLOCKED", 0.1, "v1")], df.schema)
        last.coalesce(1).write.mode("append").json(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(f"{folder}/in")
    q = make(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = spark.read.parquet(f"{folder}/out").where("crossing_id <> 'Z'").collect()
    shutil.rmtree(folder)
    return got


def test_streams_agree_with_batch(spark):
    states = ["BLOCKED", "BLOCKED", "CLEAR", "BLOCKED", "UNKNOWN", "CLEAR", "CLEAR", "CLEAR", "BLOCKED", "BLOCKED"]
    df = rows(spark, *[(f"X{i % 2}", f"c{i % 4}", 1_700_000_000_000 + (i * 3 + (i // 12) * 40) * MIN, states[(i * 7) % 10]) for i in range(48)])
    batch = found(sessions.derive_sessions(df))
    grown = streamed(spark, df, live.growing_sessions)
    assert sorted((r["started"], r["ended"], r["readings"]) for r in grown if not r["is_open"]) == batch
    assert {r["session_id"] for r in grown} == {r["session_id"] for r in sessions.derive_sessions(df).collect()}
    assert sorted((r["started"], r["ended"], r["readings"]) for r in streamed(spark, df, live.closed_sessions)) == batch
    alerts = sorted((r["crossing_id"], r["t"]) for r in sessions.rising_edges(df).collect())
    assert sorted((r["crossing_id"], r["t"]) for r in streamed(spark, df, live.live_alerts)) == alerts


def test_closed_sessions_break_where_batch_does(spark):
    """Rows a gap apart are one session, a millisecond more is two, in the stream as in batch."""
    df = rows(spark, ("X", "a", 0, "BLOCKED"), ("X", "a", 15 * MIN, "BLOCKED"), ("X", "a", 30 * MIN + 1, "BLOCKED"))
    assert sorted((r["started"], r["ended"], r["readings"]) for r in streamed(spark, df, live.closed_sessions)) == found(sessions.derive_sessions(df)) == [(0, 15 * MIN, 2), (30 * MIN + 1, 30 * MIN + 1, 1)]


def test_merge_keeps_the_newest_and_replays_do_nothing(spark):
    a = spark.createDataFrame([("s", 1, 10), ("u", 1, 1)], "id string, ingested int, v int")
    b = spark.createDataFrame([("s", 2, 20)], "id string, ingested int, v int")
    once = versioned.merged(a, b, ["id"], ["ingested"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, versioned.merged(once, b, ["id"], ["ingested"]).collect())) == [("s", 2, 20), ("u", 1, 1)]
