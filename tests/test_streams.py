"""Streams: restarts, heartbeats, late rows, versioned tables."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from sitewatch.operators import sessions
from sitewatch.sources import versioned
from sitewatch.streaming import live

MIN = 60_000
START = 1_700_000_000_000
READING = "event_id long, crossing_id string, camera_id string, t long, state string, confidence double, version string"


def readings(spark, *given):
    return spark.createDataFrame([(i, c, cam, START + t, s, 0.5 + i % 4 / 10, "v1") for i, (c, cam, t, s) in enumerate(given)], READING)


class Feed:
    """A folder of files that a stream reads, one a micro-batch, and where its query writes."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.at, self.n = spark, schema, tempfile.mkdtemp(prefix="feed-"), 0

    def add(self, rows, name="in"):
        rows = rows if isinstance(rows, list) else rows.collect()
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").json(f"{self.at}/{name}")

    def stream(self, name="in"):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(f"{self.at}/{name}")

    def run(self, df, out="out"):
        q = df.writeStream.format("parquet").option("path", f"{self.at}/{out}").option("checkpointLocation", f"{self.at}/{out}-ck").trigger(availableNow=True).start()
        q.awaitTermination(300)
        return self.spark.read.parquet(f"{self.at}/{out}").collect()


def closed(rows):
    return sorted((r["crossing_id"], r["started"], r["ended"], r["readings"]) for r in rows if not r["is_open"])


def test_a_restart_loses_and_repeats_nothing(spark):
    """State, timers and output go on from the checkpoint, in the middle of sessions and of alerts."""
    rng = random.Random(1)
    names = ["BLOCKED", "BLOCKED", "CLEAR", "UNKNOWN"]
    t, given = 0, []
    for i in range(120):
        t += rng.choice([1, 2, 3, 5, 16, 22]) * MIN
        given.append((f"X{i % 2}", f"c{i % 4}", t, rng.choice(names)))
    df = readings(spark, *given)
    rows = sorted(df.collect(), key=lambda r: r["t"])
    feed = Feed(spark, df.schema)
    for part in range(2):
        for i in range(3):
            feed.add(rows[part * 60 + i * 20 : part * 60 + i * 20 + 20])
        if part == 1:
            feed.add(readings(spark, ("Z", "z", t + 86_400_000, "BLOCKED")))
            feed.add(readings(spark, ("Z", "z", t + 2 * 86_400_000, "BLOCKED")))
        grown, alerts = feed.run(live.growing_sessions(feed.stream())), feed.run(live.live_alerts(feed.stream()), "alerts")
    want = sorted((r["crossing_id"], r["started"], r["ended"], r["readings"]) for r in sessions.derive_sessions(df).collect())
    assert closed(r for r in grown if r["crossing_id"] != "Z") == want and len(want) > 10
    edges = sorted((r["crossing_id"], r["t"]) for r in sessions.rising_edges(df).collect())
    assert sorted((r["crossing_id"], r["t"]) for r in alerts) == edges and len(edges) > 5


def test_silence_closes_while_only_heartbeats_come(spark):
    df = readings(spark, ("X", "a", 0, "BLOCKED"), ("X", "b", 4 * MIN, "BLOCKED"))
    feed = Feed(spark, df.schema)
    feed.add(df)
    beat = lambda t: spark.createDataFrame([(None, None, None, START + t, None, None, None)], df.schema)
    with_beats = lambda: live.growing_sessions(feed.stream(), beats=feed.stream("beats"))
    feed.add(beat(0), "beats")
    assert closed(feed.run(with_beats())) == []
    feed.add(beat(21 * MIN), "beats")  # 4 + 15 minutes, and two of lateness: not a millisecond past it
    assert closed(feed.run(with_beats())) == []
    feed.add(beat(21 * MIN + 1), "beats")
    feed.add(beat(21 * MIN + 2), "beats")
    assert closed(feed.run(with_beats())) == [("X", START, START + 4 * MIN, 2)]
    windows = feed.run(live.closed_sessions(feed.stream(), beats=feed.stream("beats")), "windows")
    assert [(r["started"], r["ended"], r["readings"]) for r in windows] == [(START, START + 4 * MIN, 2)]


def test_late_rows_are_kept_apart_and_counted(spark):
    df = readings(spark, ("X", "a", 0, "BLOCKED"), ("X", "a", 10 * MIN, "BLOCKED"), ("X", "a", 9 * MIN, "BLOCKED"), ("X", "a", 7 * MIN, "BLOCKED"), ("X", "a", 11 * MIN, "BLOCKED"), ("X", "a", 60 * MIN, "BLOCKED"), ("X", "a", 12 * MIN, "BLOCKED"), ("X", "a", 200 * MIN, "CLEAR"))
    rows = sorted(df.collect(), key=lambda r: r["event_id"])
    feed = Feed(spark, df.schema)
    for r in rows:  # after 10 the watermark is at 8: 9 is heard, 7 is late; after 60 it is at 58: 12 is late
        feed.add([r])
    live.kept_apart(live.session_events(feed.stream()), f"{feed.at}/events", f"{feed.at}/ck").awaitTermination(300)
    events = spark.read.parquet(f"{feed.at}/events")
    late = sorted(r["t"] - START for r in live.quarantine(events).collect())
    assert late == [7 * MIN, 12 * MIN]
    got = closed(live.as_sessions(events).collect())
    assert got == [("X", START, START + 11 * MIN, 4), ("X", START + 60 * MIN, START + 60 * MIN, 1)]
    assert sum(n for *_, n in got) + len(late) == sum(r["state"] == "BLOCKED" for r in rows)


SESSION = "session_id string, detector_version string, ingested long, v int"
KEYS = ["session_id", "detector_version"]


def saved(spark, path, number=None):
    return {(r["session_id"], r["detector_version"]): (r["ingested"], r["v"]) for r in versioned.current(spark, path, number).collect()}


def test_a_reader_sees_a_whole_batch_or_none(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="versioned-") + "/t"
    batch = lambda n, lo, hi: spark.createDataFrame([(f"s{i}", "v1", n, n * 1000 + i) for i in range(lo, hi)], SESSION)
    sink = versioned.merge_sink(path, KEYS, ["ingested"])
    with pytest.raises(ValueError):
        versioned.current(spark, path)
    sink(batch(0, 0, 100), 0)
    seen = []
    commit = versioned.commit

    def watched(spark, path, new):
        seen.append(saved(spark, path))  # every slice is written, nothing is committed
        if len(seen) == 1:
            raise RuntimeError("lost")
        commit(spark, path, new)

    monkeypatch.setattr(versioned, "commit", watched)
    with pytest.raises(RuntimeError):
        sink(batch(1, 50, 120), 1)
    old = {(f"s{i}", "v1"): (0, i) for i in range(100)}
    assert seen == [old] and saved(spark, path) == old
    sink(batch(1, 50, 120), 1)  # the batch again
    assert seen[1] == old
    new = old | {(f"s{i}", "v1"): (1, 1000 + i) for i in range(50, 120)}
    assert saved(spark, path) == new and saved(spark, path, 0) == old
    sink(batch(1, 0, 5), 1)  # committed already
    sink(batch(0, 0, 5), 0)
    assert saved(spark, path) == new and len(versioned.log(spark, path)) == 2
    versioned.compacted(spark, path, 1)
    assert saved(spark, path) == new and versioned.log(spark, path) == [1]


def test_two_writers_make_one_commit_each(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="versioned-") + "/t"
    row = lambda k, v: spark.createDataFrame([(k, "v1", 1, v)], SESSION)
    versioned.merge(path, row("a", 1), KEYS, ["ingested"])
    commit, raced = versioned.commit, []

    def between(spark, path, new):
        if not raced:
            raced.append(1)
            monkeypatch.setattr(versioned, "commit", commit)
            versioned.merge(path, row("b", 2), KEYS, ["ingested"], writer="other")
        commit(spark, path, new)

    monkeypatch.setattr(versioned, "commit", between)
    versioned.merge(path, row("c", 3), KEYS, ["ingested"])
    assert {k: v for (k, _), (_, v) in saved(spark, path).items()} == {"a": 1, "b": 2, "c": 3} and versioned.log(spark, path) == [0, 1, 2]


def test_merging_by_version_ties_and_ignore(spark):
    path = tempfile.mkdtemp(prefix="versioned-") + "/t"
    rows = lambda *r: spark.createDataFrame(list(r), SESSION)
    versioned.merge(path, rows(("s", "v1", 5, 1), ("s", "v2", 5, 2)), KEYS, ["ingested"])
    versioned.merge(path, rows(("s", "v1", 5, 0), ("s", "v2", 4, 9)), KEYS, ["ingested"])  # of equals the later batch's; older ones don't count
    assert saved(spark, path) == {("s", "v1"): (5, 0), ("s", "v2"): (5, 2)}
    versioned.merge(path, rows(("s", "v1", 9, 7), ("u", "v1", 1, 3), ("u", "v1", 2, 4)), KEYS, ["ingested"], ignore=True)
    assert saved(spark, path) == {("s", "v1"): (5, 0), ("s", "v2"): (5, 2), ("u", "v1"): (2, 4)}
    assert not versioned.merge(path, rows(), KEYS, ["ingested"])
    empty = tempfile.mkdtemp(prefix="versioned-") + "/t"
    versioned.merge(empty, rows(), KEYS, ["ingested"])
    assert saved(spark, empty) == {}


def test_a_window_is_replaced_in_one_commit(spark):
    path = tempfile.mkdtemp(prefix="versioned-") + "/t"
    made = spark.createDataFrame([("a", "v1", 1, 10), ("b", "v1", 1, 20), ("c", "v1", 1, 30)], SESSION)
    versioned.merge(path, made, KEYS, ["ingested"])
    versioned.replace(path, lambda old: old.where("NOT v BETWEEN 15 AND 30"), spark.createDataFrame([("d", "v1", 2, 16)], SESSION), KEYS)
    assert {k for k, _ in saved(spark, path)} == {"a", "d"} and {k for k, _ in saved(spark, path, 0)} == {"a", "b", "c"}
    versioned.replace(path, lambda old: old.where(F.lit(False)), made.limit(0), KEYS)
    assert saved(spark, path) == {}


def test_a_running_board_is_the_batch_board_at_each_instant(spark):
    """Replayed in files, the events give the board that a batch over all events up to then gives; what is told are
    the rows that changed, and a batch that runs again tells the same."""
    from sitewatch.operators import live_board, polling
    from sitewatch.streaming import board

    rng = random.Random(5)
    roster = spark.createDataFrame([("a", "X", True), ("b", "X", True), ("c", "Y", True), ("d", "Y", False), ("e", "Z", True)], "camera_id string, crossing_id string, scores boolean")
    site = {"a": "X", "b": "X", "c": "Y", "d": "Y", "gone": "Y"}
    reads, polls, opens, t = [], [], [], 0
    steps = [[] for _ in range(4)]
    for i in range(48):
        t += rng.choice([20, 60, 200, 400] if i % 24 < 19 else [1500, 2400]) * 1000 + 1
        camera, step = rng.choice(list(site)), i // 12
        state = rng.choice(["BLOCKED", "BLOCKED", "CLEAR", "CLEAR", "UNKNOWN"])
        version = "unscored/1" if state == "UNKNOWN" and rng.random() < 0.4 else "v1"
        reads.append((i, site[camera], camera, t, state, 0.5, version, None if rng.random() < 0.3 else f"k{i}"))
        polls.append((i, camera, t + 7, rng.choice(["ok", "error", "error", "error", "duplicate"]) if step != 2 else "error"))
        if rng.random() < 0.4:
            s = rng.randrange(max(1, i - 6), i + 2)
            opens.append((f"s{s}", "XYZ"[s % 3], rng.random() < 0.6, t + 9))
        steps[step].append(t + 9)
    readings_ = spark.createDataFrame(reads, READING + ", object_key string")
    frames = spark.createDataFrame(polls, "event_id long, camera_id string, fetched long, status string")
    emissions = spark.createDataFrame(opens, "session_id string, crossing_id string, is_open boolean, seq long")
    ticks = spark.createDataFrame([(step[-1] + (1_200_000 if i == 2 else 0),) for i, step in enumerate(steps)], "t long")
    instants = [r["t"] for r in ticks.collect()]
    everything = sorted(board.events(readings_, frames, emissions, ticks).collect(), key=lambda r: (r["t"], r["kind"]))
    feed = Feed(spark, spark.createDataFrame([], board.EVENT).schema)
    told = {}
    running = board.RunningBoard(f"{feed.at}/board", roster, lambda changes, n: told.setdefault(n, []).append({r["crossing_id"]: r for r in changes.collect()}))
    before, seen = -1, {}
    shown = lambda r: tuple(r[c] for c in ("crossing_id", *live_board.VISIBLE, "witness", "witness_t"))
    for n, at in enumerate(instants):
        feed.add([r for r in everything if before < r["t"] <= at])
        board.running(feed.stream(), running, f"{feed.at}/ck", None).awaitTermination(300)
        want = {r["crossing_id"]: r for r in live_board.full_board(readings_.where(F.col("t") <= at), roster, emissions, frames, at).collect()}
        got = {r["crossing_id"]: r for r in running.board(spark).collect()}
        assert {k: shown(r) for k, r in got.items()} == {k: shown(r) for k, r in want.items()}, n
        changed = {k for k, r in want.items() if k not in seen or tuple(r[c] for c in live_board.VISIBLE) != tuple(seen[k][c] for c in live_board.VISIBLE)}
        assert set(told[n][0]) == changed, n
        before, seen = at, want
    assert len({r["feed"] for t in told.values() for r in t[0].values()}) > 1 and any(r["open_session"] for t in told.values() for r in t[0].values())
    again = spark.createDataFrame([r for r in everything if instants[-2] < r["t"] <= instants[-1]], feed.schema)
    running(again, len(instants) - 1)
    assert told[len(instants) - 1][0] == told[len(instants) - 1][1] and {r["crossing_id"]: shown(r) for r in running.board(spark).collect()} == {k: shown(r) for k, r in want.items()}
    out = tempfile.mkdtemp(prefix="told-")
    board.changes_to(out)(running.board(spark), 3)
    assert spark.read.json(out).count() == 3 and board.board_payloads(running.board(spark)).select("key").distinct().count() == 3
    assert polling.feed_verdict(polling.feed_parts(frames.limit(0)), 0).first()["verdict"] == "ok"
