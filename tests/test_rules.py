"""Rules of sources, polling, scoring, sweeps and the live board at their boundaries."""

import json
import os
import tempfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sitewatch.functions import ordered, scalars
from sitewatch.operators import history, labels, live_board, pages, polling, scenes, scoring, sessions, sweep, training
from sitewatch.sources import files, inventory, versioned
from sitewatch.streaming import live

MIN = 60_000
READING = "event_id long, crossing_id string, camera_id string, t long, state string, confidence double, version string"


def rows(spark, *given, version="v1"):
    return spark.createDataFrame([(i, c, cam, t, s, 0.9, version) for i, (c, cam, t, s) in enumerate(given)], READING)


def polls(spark, *given):
    return spark.createDataFrame([(i, "C", t, http, h, m) for i, (t, http, h, m) in enumerate(given)], "event_id long, camera_id string, fetched long, http int, hash string, modified long")


def test_errors_carry_the_time_of_the_poll(spark):
    """404, 500, no answer and an empty body are errors, whatever Last-Modified says."""
    got = polling.frames(polls(spark, (1000, 404, None, 500), (2000, 500, None, 500), (3000, None, None, 500), (4000, 200, None, 500), (5000, 200, "a" * 64, 4500), (6000, 304, None, 4500), (7000, 200, "a" * 64, 9000))).orderBy("fetched").collect()
    assert [r["status"] for r in got] == ["error"] * 4 + ["ok", "not_modified", "duplicate"]
    assert [r["t"] for r in got] == [1000, 2000, 3000, 4000, 4500, 4500, 7000]
    assert [r["message"] for r in got][:4] == ["HTTP 404", "HTTP 500", "no answer", "empty body"]
    assert all(r["object_key"] is None for r in got[:4]) and len({r["object_key"] for r in got[4:]}) == 1


def test_bytes_that_come_back_are_stored_again(spark):
    got = polling.frames(polls(spark, (1, 200, "a" * 64, None), (2, 200, "b" * 64, None), (3, 200, "a" * 64, None))).collect()
    assert [r["status"] for r in got] == ["ok"] * 3


def test_an_error_message_is_cut(spark):
    long = polls(spark, (1, 500, None, None)).withColumn("error", F.lit("x" * 900))
    assert len(polling.frames(long).first()["message"]) == 500


def test_feed_verdict_and_since(spark):
    f = lambda *g: polling.frames(polls(spark, *g))
    at = 100 * MIN
    one = lambda df: tuple(polling.feed_health(df, at).select("verdict", "since").first())
    assert one(f((at, 200, "a" * 64, None)).where("false")) == ("ok", None)
    assert one(f((at - 6 * MIN, 200, "a" * 64, None))) == ("capture_stale", at - 6 * MIN)
    assert one(f((at - 9 * MIN, 200, "a" * 64, None), (at - 3, 500, None, None), (at - 2, 500, None, None), (at - 1, 404, None, None))) == ("upstream_down", at - 9 * MIN)
    assert one(f((at - 16 * MIN, 200, "a" * 64, None), (at - 1, 304, None, None))) == ("upstream_stale", at - 16 * MIN)
    assert one(f((at - 1, 304, None, None))) == ("ok", None)  # nothing new ever: no witness for a stale feed
    got = live_board.feed_transitions(f((0, 200, "a" * 64, None), (1 * MIN, 500, None, None), (2 * MIN, 500, None, None), (3 * MIN, 500, None, None), (20 * MIN, 304, None, None), (21 * MIN, 200, "b" * 64, None)))
    assert [(r["fetched"] // MIN, r["verdict"]) for r in got.orderBy("fetched").collect()] == [(3, "upstream_down"), (20, "upstream_stale"), (21, "ok")]


def test_health_rules(spark):
    at = 300 * MIN
    roster = spark.createDataFrame([("C",)], "camera_id string")
    fired = lambda *g: {r["rule"] for r in live_board.health(polling.frames(polls(spark, *g)), roster, at).collect()}
    assert fired((at - MIN, 200, "a" * 64, None)) == set()
    assert fired((at - 21 * MIN, 200, "a" * 64, None), (at - MIN, 304, None, None)) == {"stalled", "all stalled"}
    assert fired((at - 16 * MIN, 200, "a" * 64, None)) == {"no polls"}
    assert "erroring" in fired(*[(at - 40 * MIN + i * MIN, 500, None, None) for i in range(40)])
    assert "erroring" not in fired(*[(at - 15 * MIN + i * MIN, 500, None, None) for i in range(15)])
    assert "all duplicates" in fired((at - 200 * MIN, 200, "a" * 64, None), *[(at - 119 * MIN + i * 5 * MIN, 304, None, None) for i in range(24)])


def test_what_isnt_asked_neither_votes_nor_ends_a_span(spark):
    blocked = rows(spark, ("X", "a", 0, "BLOCKED"))
    policy = rows(spark, ("X", "a", MIN, "UNKNOWN"), version="unscored/1").withColumn("event_id", F.lit(9))
    real = policy.withColumn("version", F.lit("v1"))
    span = lambda df: [(r["span_start"], r["span_end"]) for r in sessions.blocked_spans(df).collect()]
    assert span(blocked.union(policy)) == [(0, 15 * MIN)] and span(blocked.union(real)) == [(0, MIN)]
    assert sessions.board(blocked.union(policy), 2 * MIN).first()["state"] == "BLOCKED" and sessions.board(blocked.union(real), 2 * MIN).first()["state"] == "UNKNOWN"


def test_order_across_days(spark):
    """Two levels give what one window gives, over days without rows as well."""
    day = ordered.DAY_MS
    data = [("a", t, i, (i * 7) % 5) for i, t in enumerate([0, 1, 1, day - 1, day, 3 * day, 3 * day, 9 * day + 5])] + [("b", 4 * day, 50, 1), (None, 2, 60, 3), (None, 5 * day, 61, 4)]
    df = spark.createDataFrame(data, "k string, t long, id long, x long")
    got = ordered.with_running(ordered.with_next(ordered.with_previous(df, ["k"], ["t", "id"], ["x", "id"]), ["k"], ["t", "id"], ["id"]), ["k"], ["t", "id"], {"s": "x"}, {"m": "x"})
    got = ordered.with_running(got, ["k"], ["t", "id"], {"s0": "x"}, {"m0": "x"}, before=True)
    for k in ("a", "b", None):
        mine = sorted((t, i, x) for kk, t, i, x in data if kk == k)
        found = sorted((r for r in got.collect() if r["k"] == k), key=lambda r: (r["t"], r["id"]))
        assert [r["before"] and r["before"]["id"] for r in found] == [None, *[i for _, i, _ in mine[:-1]]]
        assert [r["after"] and r["after"]["id"] for r in found] == [*[i for _, i, _ in mine[1:]], None]
        xs = [x for _, _, x in mine]
        assert [(r["s"], r["m"], r["s0"], r["m0"]) for r in found] == [(sum(xs[: i + 1]), max(xs[: i + 1]), sum(xs[:i]), max(xs[:i], default=None)) for i in range(len(xs))]


def test_lines_that_are_no_records_are_kept_apart(spark):
    good = {"crossing_id": "X", "camera_id": "C", "captured_at": "2024-01-01T00:00:01", "observed_at": "2024-01-01T02:00:01+02:00", "state": "CLEAR", "confidence": 1, "detector_version": "v"}
    bad = [{**good, "extra": 1}, {**good, "state": "JAMMED"}, {**good, "confidence": 1.01}, {**good, "captured_at": "noon"}, {k: v for k, v in good.items() if k != "state"}]
    lines = [json.dumps(x) for x in (good, *bad)] + ['{"camera_id": ', "[1, 2]", "7", None]
    got = files.decode(spark.createDataFrame([(x,) for x in lines], "value string"), files.OBSERVATION)
    assert [r["problem"] for r in files.quarantined(got).collect()] == ["unknown field", "bad state", "bad confidence", "bad captured_at", "without state", "malformed", "malformed", "malformed"]
    assert [(r["t"], r["confidence"]) for r in files.readings_of(got).collect()] == [(1_704_067_201_000, 1.0)]
    assert files.decode(spark.createDataFrame([], "value string"), files.FRAME).count() == 0


def test_records_are_strict(spark):
    """Wrong types, a field twice, and anything besides the one object are no record; null is as good as absent."""
    good = json.dumps({"crossing_id": "X", "camera_id": "C", "captured_at": "2024-01-01T00:00:01", "observed_at": "2024-01-01T02:00:01+02:00", "state": "CLEAR", "confidence": 1, "detector_version": "v"})
    edit = lambda a, b: good.replace(a, b)
    lines = {
        edit('"C"', "5"): "bad camera_id", edit('"C"', '{"a": 1}'): "bad camera_id", edit('"C"', "true"): "bad camera_id", good + " trailing": "malformed", good + good: "malformed", good + "," + good: "malformed", good + "] ,0]": "malformed",
        edit('"camera_id": "C"', '"camera_id": "C", "camera_id": "C"'): "malformed", f"[{good}]": "malformed", "null": "malformed", edit(": 1", ': "high"'): "bad confidence", edit(": 1", ": [1]"): "bad confidence", edit('"C"', "null"): "without camera_id",
        good: None, f"  {good} ": None, edit(": 1", ': "0.5"'): None, edit("}", ', "reason": null}'): None, edit('"v"', '"\\u00e9"'): None}
    got = files.decode(spark.createDataFrame([(x,) for x in lines], "value string"), files.OBSERVATION).collect()
    assert {r["value"]: r["problem"] for r in got} == lines
    assert {r["record"]["confidence"] for r in got if r["problem"] is None} == {1.0, 0.5}
    frame = {"camera_id": "C", "crossing_id": "X", "captured_at": "2024-01-01T00:00:00Z", "captured_at_source": "fetched_at", "fetched_at": "2024-01-01T00:00:00Z", "poller_version": "p"}
    sizes = {7: 7, 7.0: 7, 7.5: "bad image_bytes", 10**30: "bad image_bytes"}
    rows = spark.createDataFrame([(json.dumps(frame | {"image_bytes": n}), float(n)) for n in sizes] + [(None, 0.0)], "value string, n double")
    assert {r["n"]: r["problem"] or r["record"]["image_bytes"] for r in files.decode(rows, files.FRAME).collect()} == {float(k): v for k, v in sizes.items()}


def test_a_line_is_parsed_once(spark):
    """However often the steps behind use what was read: F1, F2 (each filter on the problem had the parsing dozens of times)."""
    rows = spark.createDataFrame([("{}",)], "value string")
    for kind, read in ((files.FRAME, files.frames_of), (files.FRAME, files.quarantined), (files.OBSERVATION, files.readings_of)):
        plan = read(files.decode(rows, kind))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson(") == 1


def test_the_decoder_runs_no_lambdas(spark):
    """with one, Spark leaves generated code and copies each row for a look at what few lines need."""
    plan = files.readings_of(files.decode(spark.createDataFrame([("{}",)], "value string"), files.OBSERVATION))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("parseJson(") == 1


def test_frames_are_decoded_before_they_are_sorted(spark):
    """a sort runs what is below it twice."""
    frame = {"camera_id": "C", "crossing_id": "X", "captured_at_source": "fetched_at", "fetched_at": "2024-01-01T00:00:09Z", "poller_version": "p"}
    rows = spark.createDataFrame([(json.dumps(frame | {"captured_at": f"2024-01-01T00:00:0{n}Z"}),) for n in (3, 1, 2)], "value string")
    got = files.in_order(files.frames_of(files.decode(rows, files.FRAME)))
    assert "parseJson(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r["t"] - 1_704_067_200_000 for r in got.collect()] == [1000, 2000, 3000]


def test_a_line_is_one_value(spark):
    """What would end the object into which a line is put, or stand beside the line in it, makes no record."""
    good = json.dumps({"crossing_id": "X", "camera_id": "C", "captured_at": "2024-01-01T00:00:01", "observed_at": "2024-01-01T02:00:01+02:00", "state": "CLEAR", "confidence": 1, "detector_version": "v"})
    for behind in ("}", "}}", ',"a":1', ',"x":1', ',"x":{}', f',"x":{good}', f',"r":{good}', ',"m":"1"', ',"m":"1"}', ',"n":{}', "],", ',"', "//", ","):
        got = files.decode(spark.createDataFrame([(good + behind,)], "value string"), files.OBSERVATION).select("problem", "record.state").first()
        assert tuple(got) == ("malformed", None), behind


def test_a_roster_must_have_cameras(spark):
    folder = tempfile.mkdtemp(prefix="roster-")
    a = {"camera_id": "a", "name": "A", "crossing_id": "X", "image_url": "https://x/a.jpg"}
    bad = {"fast": a | {"poll_interval_seconds": 14.9}, "extra": a | {"zoom": 1}, "number": a | {"camera_id": 5}, "url": a | {"image_url": "x"}, "short": {"camera_id": "a"}, "word": "a", "flag": a | {"scores": "no"}, "place": a | {"lat": "north"}}
    for name, cameras in (("none", []), ("off", [a | {"enabled": False}]), ("on", [a]), ("object", {"cameras": [a | {"poll_interval_seconds": 15, "lat": 1, "lon": "2.5"}]}), *[(k, [a, v]) for k, v in bad.items()]):
        with open(f"{folder}/{name}.json", "w") as f:
            json.dump(cameras, f)
    for name in ("none", "off", *bad):
        with pytest.raises(ValueError):
            files.load_roster(spark, f"{folder}/{name}.json")
    assert [tuple(r) for r in files.load_roster(spark, f"{folder}/on.json").select("camera_id", "scores", "enabled").collect()] == [("a", True, True)]
    assert tuple(files.load_roster(spark, f"{folder}/object.json").select("poll_interval_seconds", "lat", "lon", "source").first()) == (15.0, 1.0, 2.5, "manual")


def test_labels_are_appended_once(spark):
    path = tempfile.mkdtemp(prefix="labels-") + "/l"
    a = spark.createDataFrame([("k1", "x"), ("k2", "x"), ("k1", "x")], "object_key string, label string")
    assert [files.append_labels(a, path), files.append_labels(a, path), files.append_labels(a.withColumn("object_key", F.concat("object_key", F.lit("'"))), path)] == [2, 0, 2]
    assert spark.read.json(path).count() == 4


def test_frames_without_bytes_go(spark):
    root = tempfile.mkdtemp(prefix="bytes-")
    key = "frames/C/2024/01/01/00/5-aaaaaaaa.jpg"
    os.makedirs(os.path.dirname(f"{root}/{key}"))
    with open(f"{root}/{key}", "wb") as f:
        f.write(b"abc")
    got = files.frame_bytes(spark, root, spark.createDataFrame([(key,), ("frames/none.jpg",)], "object_key string")).collect()
    assert [(r["object_key"], bytes(r["content"])) for r in got] == [(key, b"abc")]


def test_the_first_present_name_counts(spark):
    payload = json.dumps({"CCTVInventoryRequest": [{"device-id": 1, "device-name": "", "deviceName": "Elm - 4th", "url": "http://x/http://y", "lat": "1.5"}, 7, {"id": 2, "title": "ELM 4TH"}, {"id": 3, "name": "Oak", "cctv-other": "Elm, 9th"}]})
    got = inventory.items(spark.createDataFrame([(0, payload), (1, "{}"), (2, '[{"id": 9}]')], "payload long, value string"))
    assert got.count() == 4
    wanted = spark.createDataFrame([("elm 4TH", "X"), ("Elm 9th", "Y"), ("Pine", "Z")], "name string, crossing_id string")
    found = {r["name"]: r for r in inventory.resolved(got, wanted, blind=("Elm-9th",)).collect()}
    assert (found["elm 4TH"]["camera_id"], found["elm 4TH"]["image_url"], found["elm 4TH"]["lat"], found["elm 4TH"]["scores"]) == ("cam-1", "https://x/http://y", 1.5, True)
    assert found["Elm 9th"]["camera_id"] == "cam-3" and not found["Elm 9th"]["scores"] and not found["Pine"]["found"]


def test_windows_of_a_query():
    now = datetime(2024, 1, 2, tzinfo=timezone.utc)
    day = 86_400_000
    end = 1_704_153_600_000
    assert scoring.window_of(now) == (end - day, end) and scoring.window_of(now, hours=1) == (end - 3_600_000, end)
    assert scoring.window_of(now, start="2024-01-01T00:00:00", end="2024-01-01T12:00:00+00:00", hours=1) == (end - day, end - day // 2)
    with pytest.raises(ValueError):
        scoring.window_of(now, start="yesterday")


def test_scorers(spark):
    with pytest.raises(ValueError):
        scoring.scorer("no such")
    given = [(1, "a", [1.0]), (2, "b", [1.0]), (3, "a", None), (4, "c", [1.0]), (5, "a", [2.0]), (6, "a", [-1.0]), (7, "a", [1.0, 2.0]), (8, "a", [None]), (9, None, [1.0])]
    frames = spark.createDataFrame(given, "event_id long, camera_id string, features array<double>").coalesce(1)

    def load(camera):
        if camera in ("b", ""):
            return None
        if camera == "c":
            return lambda x: 1 / 0

        def model(rows):
            assert rows.ndim == 2 and rows.shape[1] == 1
            if (rows < 0).any():
                raise ValueError("below zero")
            return [(0.0, 3.0 * float(x)) for x in rows[:, 0]]

        return model

    got = {r["event_id"]: r for r in scoring.classified(frames, load, "head/1", 1).collect()}
    assert len(got) == 9 and got[1]["state"] == got[5]["state"] == "BLOCKED" and all(got[i]["state"] == "UNKNOWN" and got[i]["confidence"] == 0 for i in (2, 3, 4, 6, 7, 8, 9))
    assert got[2]["reason"] == "no model for this camera" and got[6]["reason"] == "below zero" and {got[i]["reason"] for i in (3, 7, 8)} == {"unreadable picture"} and {r["version"] for r in got.values()} == {"head/1"}
    odd = spark.createDataFrame([("JAMMED", 0.7, "r" * 300), ("UNKNOWN", 0.9, None), ("CLEAR", 0.8, "ok")], "state string, confidence double, reason string")
    assert [(r["state"], r["confidence"], len(r["reason"] or "")) for r in scoring.minted(odd).collect()] == [("UNKNOWN", 0.0, 200), ("UNKNOWN", 0.0, 0), ("CLEAR", 0.8, 2)]
    assert scoring.auto_version("a/1", "b/2") == "auto(a/1|b/2)" and scenes.Thresholds().version == "reference/d40-r0.45-b10-c0.1"


def picture(spark, *given):
    return spark.createDataFrame([(i, "C", list(x)) for i, x in enumerate(given)], "vec_id long, camera_id string, pixels array<int>")


def test_verdict_ladder(spark):
    side, plain = 8, [120] * 240
    model = scenes.reference(picture(spark, *[plain] * 15))
    mass = lambda n: [20] * (n * side) + [120] * (240 - n * side)
    got = {r["vec_id"]: r for r in scenes.judged(picture(spark, plain, mass(10), mass(9), mass(30), [5] * 240, [250] * 240, [120] * 80, [], [120] * 200 + [20] * 16 + [120] * 24), model).collect()}
    assert [got[i]["state"] for i in range(9)] == ["CLEAR", "BLOCKED", *["UNKNOWN"] * 6, "CLEAR"]
    assert (got[1]["confidence"], got[1]["reason"]) == (round(0.6 + 0.35 * 10 / 30, 6), "obstructed in 10 rows, 33% of pixels changed")
    assert got[4]["reason"] == "below the limit of light (mean level 5)" and got[5]["reason"] == "nothing to compare with at this brightness"
    assert got[6]["reason"] == "another number of pixels than the reference" and got[7]["reason"] == "unreadable picture"
    assert got[2]["reason"] == "30% changed, but full rows are too few (9)"
    dim = scenes.Thresholds(least_rows=3)
    three = {r["vec_id"]: r for r in scenes.judged(picture(spark, mass(3), mass(6)), model, dim).collect()}
    assert (three[0]["confidence"], three[1]["confidence"]) == (round(0.6 + 0.35 / 3, 6), round(0.6 + 0.35 * 6 / 9, 6)) and three[0]["reason"] == "obstructed in 3 rows, 10% of pixels changed"
    band = spark.createDataFrame([("C", 10, 20)], "camera_id string, top int, bottom int")
    assert scenes.judged(picture(spark, mass(3)), model, dim, 8, band).first()["state"] == "CLEAR"
    got = scenes.bands(picture(spark, mass(4), mass(6), mass(2)), model).first()
    assert (got["top"], got["bottom"], got["profiles"]) == (0, 10, 3)
    assert [len(r["pixels"] or []) for r in scenes.cropped(picture(spark, [1] * 8 * 95, [1] * 8 * 94), 8).collect()] == [8, 0]


def test_refinement_forgets_what_blocked(spark):
    # 9 of 30 show a mass; the others alternate so that spreads aren't 0
    clear = [[100 + (i % 2)] * 64 for i in range(21)]
    mass = [[100 + (i % 2)] * 16 + [20] * 24 + [100] * 24 for i in range(9)]
    limits = scenes.Thresholds(changed_pixel=25, spread_multiple=3.0, least_rows=3)
    got = scenes.refined(picture(spark, *clear, *mass), limits)
    assert {r["frames"] for r in got.collect()} == {21}
    few = scenes.refined(picture(spark, *clear[:14], *mass[:6]), limits)
    assert {r["frames"] for r in few.collect()} == {20}  # 14 would be too few to rebuild from


def test_a_sweep_walks_to_the_edges(spark):
    step = 2 * MIN
    states = ["CLEAR"] * 10 + ["BLOCKED"] * 8 + ["CLEAR"] * 12
    f = rows(spark, *[("X", "a", i * step, s) for i, s in enumerate(states)]).withColumn("object_key", F.concat(F.lit("k"), "event_id"))
    at = lambda df: sorted(r["event_id"] for r in df.collect())
    picks = [0, 8, 16, 24]
    assert at(sweep.planned(f, 15 * MIN)) == sorted({*picks, *range(7, 21)})
    known = f.where("event_id IN (18, 19)").select("object_key")
    assert at(sweep.planned(f, 15 * MIN, known)) == sorted({*picks, *range(7, 23)} - {18, 19})
    long = rows(spark, *[("X", "a", i * step, "BLOCKED") for i in range(60)]).withColumn("object_key", F.lit("k"))
    got = sweep.planned(long, 1000 * MIN)
    assert at(got) == list(range(41)) and [r["event_id"] for r in got.where("open_ended").collect()] == [0]


def test_worst_hours_and_outlook(spark):
    day = lambda share: spark.createDataFrame([("X", h, share.get(h, 0), 10) for h in range(24)], "crossing_id string, hour int, blocked int, scoreable int")
    worst = lambda share: [r["worst"] for r in pages.worst_hours(day(share)).collect()]
    assert worst({}) == [] and worst({6: 5}) == ["around 6 AM"] and worst({0: 5, 23: 4, 1: 3}) == ["11 PM-2 AM"] and worst({h: 5 for h in range(24)}) == ["7 PM-1 AM"]
    s = spark.createDataFrame([("X", i, m * 60, True) for i, m in enumerate([10, 12, 15, 20, 25, 40, 90])], "crossing_id string, started long, seconds long, certified boolean")
    says = lambda m: pages.wait_outlook(s, m * 60).first()["outlook"]
    assert says(5) == "half of those that lasted this long ended within 15 more min (7 of them)" and says(30) == "half of those that lasted this long ended within 60 more min (2 of them)"
    assert says(100) == "none has lasted this long (the longest took 90 min)"
    text = spark.createDataFrame([(69 * 60 + 29,), (None,), (3599,)], "s long").select(scalars.duration_text("s"), scalars.ticker_text("s")).collect()
    assert [r[0] for r in text] == ["1h 9m", "-", "1h 0m"] and text[0][1] == "1h 9m 29s"


def test_open_sessions_and_late_alerts(spark):
    e = spark.createDataFrame([("a", "X", True, 1), ("b", "X", True, 2), ("a", "X", False, 3), ("c", "Y", True, 1), ("c", "Y", False, 2), ("c", "Y", True, 3)], "session_id string, crossing_id string, is_open boolean, seq long")
    assert sorted(map(tuple, live_board.open_sessions(e).collect())) == [("X", "b"), ("Y", "c")]
    alerts = spark.createDataFrame([("X", 0), ("X", 50 * MIN)], "crossing_id string, t long")
    assert live_board.fresh_alerts(alerts, 55 * MIN, True).count() == 1 and live_board.fresh_alerts(alerts, 55 * MIN, False).count() == 2
    now = spark.createDataFrame([("a", 0, True)], "session_id string, ended long, is_open boolean")
    assert [live_board.silent_sessions(now, w, head).count() for w, head in ((17 * MIN, True), (17 * MIN + 1, True), (99 * MIN, False))] == [0, 1, 0]


def test_saved_sessions_merge_by_slice(spark):
    path = tempfile.mkdtemp(prefix="merge-") + "/t"
    sink = versioned.merge_sink(path, ["id"], ["ingested"])
    batch = lambda n, lo, hi: spark.createDataFrame([(f"s{i}", n, n * 100 + i) for i in range(lo, hi)], "id string, ingested int, v int")
    for n, (lo, hi) in enumerate([(0, 200), (150, 210), (5, 6)]):
        sink(batch(n, lo, hi), n)
    sink(batch(1, 150, 210), 1)  # a replay of an older batch
    sink(batch(2, 5, 6), 2)
    got = {r["id"]: r["v"] for r in versioned.current(spark, path).collect()}
    assert len(got) == 210 and got["s5"] == 205 and got["s160"] == 260 and got["s0"] == 0
    versioned.compacted(spark, path, 1)
    assert {r["id"]: r["v"] for r in versioned.current(spark, path).collect()} == got


def test_streams_of_records(spark):
    """Frames pass a stream unchanged under their key; alerts are JSON; a stream scores as a batch does."""
    folder = tempfile.mkdtemp(prefix="records-")
    line = json.dumps({"camera_id": "C", "crossing_id": "X", "captured_at": "2024-01-01T00:00:00Z", "captured_at_source": "fetched_at", "fetched_at": "2024-01-01T00:00:00Z", "object_key": "k", "poller_version": "p"})
    with open(f"{folder}/a.jsonl", "w") as f:
        f.write(line + "\n{bad\n\n")
    source = live.stream_lines(spark, folder, "*.jsonl")
    live.record_sink(live.keyed_lines(source, files.FRAME, "camera_id"), f"{folder}/out", f"{folder}/ck").awaitTermination(120)
    got = spark.read.parquet(f"{folder}/out").collect()
    assert [(r["key"], r["value"]) for r in got] == [("C", line)]
    live.to_topic(live.keyed_lines(source, files.FRAME, "camera_id"), "nowhere", f"{folder}/topic", f"{folder}/ck3", "parquet").awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(f"{folder}/topic").collect()] == [("C", line)]
    seen = spark.createDataFrame([("X", "C", "BLOCKED", 0.5, 7)], "crossing_id string, camera_id string, state string, confidence double, t long")
    assert [(r["key"], json.loads(r["value"])) for r in live.observation_payloads(seen).collect()] == [("X", {"crossing_id": "X", "camera_id": "C", "state": "BLOCKED", "confidence": 0.5})]
    alert = spark.createDataFrame([("X", 1_704_067_200_000, 0.5, "why")], "crossing_id string, t long, confidence double, reason string")
    assert [(r["key"], json.loads(r["value"])) for r in live.alert_payloads(alert).collect()] == [("X", {"crossing_id": "X", "started_at": "2024-01-01T00:00:00+00:00", "confidence": 0.5, "reason": "why"})]
    roster = spark.createDataFrame([("C", "X", True)], "camera_id string, crossing_id string, scores boolean")
    judge = lambda df: df.withColumns({"state": F.lit("CLEAR"), "confidence": F.lit(0.5), "reason": F.lit("r"), "version": F.lit("j")})
    frames = files.valid(files.decode(live.stream_lines(spark, folder, "*.jsonl"), files.FRAME)).withColumns({"status": F.coalesce("fetch_status", F.lit("ok")), "t": files.utc_ms("captured_at")})
    live.record_sink(scoring.score(frames, roster, judge).select("camera_id", "crossing_id", "t", "state", "version"), f"{folder}/obs", f"{folder}/ck2").awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(f"{folder}/obs").collect()] == [("C", "X", 1_704_067_200_000, "CLEAR", "j")]


def test_a_session_that_is_open_reaches_to_the_last_frame(spark):
    r = spark.createDataFrame([("a", "X", 0, 5, 1), ("a", "X", 0, None, 2), ("b", "X", 90, None, 1), ("c", "X", 2, 4, 1)], "session_id string, crossing_id string, started long, ended long, seq int")
    got = training.session_windows(r, spark.createDataFrame([("X", 50)], "crossing_id string, t long"))
    assert sorted((x["session_id"], x["ended"], x["closed"]) for x in got.collect()) == [("a", 50, False), ("c", 4, True)]


def test_a_rebuild_is_refused(spark):
    df = rows(spark, ("X", "a", 0, "BLOCKED"), ("X", "a", 90 * MIN, "CLEAR"))
    roster = spark.createDataFrame([("a", "X", True), ("b", "X", True)], "camera_id string, crossing_id string, scores boolean")
    s = spark.createDataFrame([("X", 5)], "crossing_id string, started long")
    rules = lambda *a, **k: {r["rule"] for r in history.guards(*a, **k).collect()}
    assert rules(df, roster, 200 * MIN, s, s.where("false")) == {"absent witness", "empty derivation"}
    assert rules(df, roster, 200 * MIN, s, s.where("false"), waive=True) == set()
    assert rules(df.where("false"), roster, 200 * MIN, s, s, waive=True) == {"empty input"}
    assert rules(df, roster.where("false"), 100 * MIN, s, s, waive=True) == {"unknown crossing", "live edge"}
    history.refuse(history.guards(df, roster, 200 * MIN, s, s, waive=True))
    with pytest.raises(ValueError):
        history.refuse(history.guards(df, roster, 200 * MIN, s, s))


def test_open_sessions_give_no_core_but_no_quiet_either(spark):
    frames = rows(spark, ("X", "a", 10 * MIN, "CLEAR"), ("X", "a", 200 * MIN, "CLEAR"))
    s = spark.createDataFrame([("X", 0, 20 * MIN, False)], "crossing_id string, started long, ended long, closed boolean")
    assert labels.in_core(frames, s).count() == 0 and labels.in_core(frames, s.drop("closed")).count() == 1
    assert [r["t"] for r in labels.quiet(frames, s).collect()] == [200 * MIN]
