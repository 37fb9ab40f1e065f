"""What is composed from parts gives what one pass over all rows gives: machines, samples, counts of levels."""

import json
import random
import statistics
import tempfile

import pytest

from sitewatch.functions import automata, ordered
from sitewatch.operators import labels, polling, scenes, scoring, sessions

DAY = ordered.DAY_MS


def test_a_machine_over_days_is_a_fold(spark, monkeypatch):
    monkeypatch.setattr(automata, "PIECE", 4)  # several pieces a day
    rng = random.Random(3)
    machine = automata.Machine(tuple(tuple(rng.randrange(5) for _ in range(3)) for _ in range(5)), start=2)
    data = [(k, DAY * rng.randrange(6) + rng.randrange(40), i, rng.randrange(3)) for i, k in enumerate(rng.choice(["a", "b", None]) for _ in range(160))] + [("one", 5, 999, 1)]
    df = spark.createDataFrame(data, "k string, t long, id long, x int")
    got = automata.states(df, ["k"], ["t", "id"], df["x"], machine).collect()
    assert len(got) == len(data) and automata.states(df.where("false"), ["k"], ["t", "id"], df["x"], machine).count() == 0
    for k in ("a", "b", None, "one"):
        state = 2
        for _, _, i, x in sorted((r for r in data if r[0] == k), key=lambda r: r[1:3]):
            row = next(r for r in got if r["id"] == i)
            assert (row["state_before"], row["state"], row["k"]) == (state, machine.moves[state][x], k)
            state = machine.moves[state][x]


def alerts_of(rows, policy):
    """The rule row by row: (crossing, t) of each alert, and whether it stands after each row."""
    out, stands, state = [], [], {}
    for i, x, _, t, s, *_ in sorted(rows, key=lambda r: (r[3], r[0])):
        on, blocked, clear, last = state.get(x, (False, 0, 0, None))
        if s != "UNKNOWN":
            if last is not None and t - last > policy.silence_ms:
                on, blocked, clear = False, 0, 0
            blocked, clear = (blocked + 1, 0) if s == "BLOCKED" else (0, clear + 1)
            if blocked >= policy.confirm and not on:
                on = True
                out.append((x, t))
            if clear >= policy.rearm:
                on = False
            state[x] = (on, blocked, clear, t)
        stands.append((x, t, state.get(x, (False,))[0]))
    return sorted(out), stands


@pytest.mark.parametrize("confirm,rearm", [(2, 3), (1, 1), (3, 2)])
def test_alerts_are_the_rule_row_by_row(spark, confirm, rearm):
    rng, t, rows = random.Random(confirm), 0, []
    for i in range(150):
        t += rng.choice([1, 2, 5, 21, 700]) * 60_000
        rows.append((i, rng.choice("XY"), "c", t, rng.choice(["BLOCKED", "BLOCKED", "CLEAR", "UNKNOWN"]), 0.5, "v1"))
    policy = sessions.AlertPolicy(confirm=confirm, rearm=rearm)
    df = spark.createDataFrame(rows, "event_id long, crossing_id string, camera_id string, t long, state string, confidence double, version string")
    want, stands = alerts_of(rows, policy)
    assert sorted((r["crossing_id"], r["t"]) for r in sessions.rising_edges(df, policy).collect()) == want and len(want) > 2
    asked = spark.createDataFrame([(x, t) for x, t, _ in stands] + [("X", -5), ("none", 7)], "crossing_id string, at long")
    got = {(r["crossing_id"], r["at"]): r["alerted"] for r in sessions.alerted_at(df, asked, policy).collect()}
    assert got == {(x, t): on for x, t, on in stands} | {("X", -5): False, ("none", 7): False}


@pytest.mark.parametrize("stride", [1, 7, 400, DAY // 3, 2 * DAY])
def test_a_sample_is_the_recurrence(spark, stride):
    rng = random.Random(stride)
    rows = [("a", DAY * rng.randrange(9) + rng.choice([0, 1, 5, 400, DAY - 1, rng.randrange(DAY)])) for _ in range(120)] + [("b", -DAY), ("b", -1), ("c", None)]
    df = spark.createDataFrame(rows, "camera_id string, t long")
    want = []
    for camera in "ab":
        due = None
        for t in sorted({t for c, t in rows if c == camera}):
            if due is None or t >= due:
                want.append((camera, t))
                due = t + stride
    assert sorted(map(tuple, labels.stride_sample(df, stride).collect())) == want


def test_streaks_and_last_values_over_days(spark):
    rng = random.Random(8)
    polls = [(i, "C", i * DAY // 5 + i, rng.choice([200, 200, 304, 500]), rng.choice("ab") * 64) for i in range(60)]
    df = spark.createDataFrame([(i, c, t, h, x if h == 200 else None, None) for i, c, t, h, x in polls], "event_id long, camera_id string, fetched long, http int, hash string, modified long")
    frames = polling.frames(df)
    n, stored, want = 0, None, {}
    for i, _, _, http, x in polls:
        n = n + 1 if http == 500 else 0
        status = {500: "error", 304: "not_modified"}.get(http) or ("duplicate" if x == stored else "ok")
        stored = x if http == 200 else stored
        want[i] = (status, n)
    assert {r["event_id"]: r["status"] for r in frames.collect()} == {i: s for i, (s, _) in want.items()}
    assert {r["event_id"]: r["streak"] for r in polling.streaks(frames).collect()} == {i: k for i, (s, k) in want.items() if s == "error"}


def test_levels_are_counted_in_slabs_and_parts(spark, monkeypatch):
    """Pictures of more pixels than a slab has, counted in several tasks, of unlike sizes, with levels left out."""
    for name, value in (("SLAB", 16), ("HELD", 5)):
        monkeypatch.setattr(scenes, name, value)
    rng = random.Random(2)
    pictures = [(i, "C", [rng.randrange(60, 90) for _ in range(40 if i % 4 else 35)]) for i in range(23)] + [(100, "D", [9] * 40)] * 3 + [(101, "D", None), (102, "D", [])]
    pictures[5][2][7] = None
    df = spark.createDataFrame(pictures, "vec_id long, camera_id string, pixels array<int>")
    got = {(r["camera_id"], r["pos"]): (r["frames"], r["median"], r["spread"]) for r in scenes.reference(df, 3).collect()}
    bins = {b["vec_id"]: b["bin"] for b in scenes.brightness(df).collect()}
    assert len(set(bins[i] for i in range(23))) == 1
    for camera, rows in (("C", pictures[:23]), ("D", [(100, "D", [9] * 40)] * 3)):
        for pos in range(40):
            x = [p[pos] for _, _, p in rows if len(p) > pos and p[pos] is not None]
            m = statistics.median(x)
            assert got[(camera, pos)] == (len(rows), int(m), statistics.median(abs(v - m) for v in x)), pos
    assert len(got) == 80
    with pytest.raises(Exception, match="grey level"):
        scenes.reference(spark.createDataFrame([(i, "C", [300] * 4) for i in range(3)], df.schema), 1).collect()


def test_one_scorer_for_batch_and_stream(spark):
    """The same function gives the same observations of a table and of a stream of it."""
    rng = random.Random(4)
    side = 8
    picture = lambda base, rows: [20 if i < rows * side else base + rng.randrange(3) for i in range(64)]
    scenes_ = spark.createDataFrame([(i, "a", picture(120, 0)) for i in range(20)], "vec_id long, camera_id string, pixels array<int>")
    limits = scenes.Thresholds(changed_pixel=25, spread_multiple=3.0, least_rows=3)
    judge = scenes.reference_scorer(scenes.reference(scenes_), limits)
    roster = spark.createDataFrame([("a", "X", True), ("b", "X", True), ("c", "Y", False)], "camera_id string, crossing_id string, scores boolean")
    frames = [{"event_id": i, "camera_id": c, "t": i, "status": "ok" if i % 9 else "duplicate", "object_key": f"k{i}", "pixels": p} for i, (c, p) in enumerate([("abcz"[i % 4], picture(120 if i % 3 else 200, i % 7)) for i in range(40)])]
    folder = tempfile.mkdtemp(prefix="scorer-")
    for part in range(2):
        with open(f"{folder}/{part}.json", "w") as f:
            f.writelines(json.dumps(x) + "\n" for x in frames[part::2])
    schema = "event_id long, camera_id string, t long, status string, object_key string, pixels array<int>"
    scored = lambda df: scoring.score(df, roster, judge).select("event_id", "crossing_id", "state", "confidence", "reason", "version")
    q = scored(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    q.awaitTermination(240)
    batch = sorted(map(tuple, scored(spark.read.schema(schema).json(f"{folder}/*.json")).collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect())) == batch
    assert {r[2] for r in batch} == {"BLOCKED", "CLEAR", "UNKNOWN"} and len(batch) == sum(f["status"] == "ok" and f["camera_id"] != "z" for f in frames)
