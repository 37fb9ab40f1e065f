"""Sessions, alerts, consensus and spans from readings (crossing_id, camera_id, t, state, confidence, version)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.automata import Machine, states
from ..functions.ordered import DAY_MS, with_next, with_previous, with_running
from ..functions.scalars import certified, session_id

POLICY_PREFIX = "unscored/"


@dataclass(frozen=True)
class SessionPolicy:
    gap_ms: int = 15 * 60_000


@dataclass(frozen=True)
class AlertPolicy:
    confirm: int = 2
    rearm: int = 3
    silence_ms: int = 20 * 60_000


def derive_sessions(readings: DataFrame, policy: SessionPolicy = SessionPolicy()) -> DataFrame:
    """Runs of BLOCKED readings of a crossing no further apart than the gap, which is inclusive."""
    runs = with_previous(readings.where("state = 'BLOCKED'"), ["crossing_id"], ["t", "event_id"], ["t"])
    runs = runs.withColumn("_b", F.coalesce((F.col("t") - F.col("before.t") > policy.gap_ms).cast("int"), F.lit(0)))
    runs = with_running(runs, ["crossing_id"], ["t", "event_id"], {"run": "_b"})
    out = runs.groupBy("crossing_id", "run").agg(
        F.min("t").alias("started"), F.max("t").alias("ended"), F.count("*").alias("readings"), F.max("confidence").alias("peak"), F.min_by("version", F.struct("t", "event_id")).alias("version"))
    out = out.withColumn("seconds", F.floor((F.col("ended") - F.col("started")) / 1000))
    return out.select(session_id("crossing_id", "started").alias("session_id"), "crossing_id", "started", "ended", "seconds", "readings", "peak", "version", certified("readings", "seconds").alias("certified"))


#: What a row tells an alert's machine; LAPSE is added where a silence came before it.
BLOCKED, CLEAR, LAPSE, ASK = 0, 1, 2, 4


def alert_machine(policy: AlertPolicy = AlertPolicy()) -> Machine:
    """States are (alert stands, streak): no streak, 1 to `confirm` BLOCKED in a row, or 1 to `rearm` CLEAR. A
    state's number is below streaks(policy) as long as no alert stands."""
    n = streaks(policy)

    def move(state: int, symbol: int) -> int:
        if symbol == ASK:
            return state
        on, streak = (0, 0) if symbol >= LAPSE else divmod(state, n)
        if symbol % LAPSE == BLOCKED:
            streak = min(streak + 1, policy.confirm) if streak <= policy.confirm else 1
            return (1 if on or streak >= policy.confirm else 0) * n + streak
        clear = min(streak - policy.confirm + 1, policy.rearm) if streak > policy.confirm else 1
        return (0 if clear >= policy.rearm else on) * n + policy.confirm + clear

    return Machine(tuple(tuple(move(s, x) for x in range(5)) for s in range(2 * n)))


def streaks(policy: AlertPolicy) -> int:
    return policy.confirm + policy.rearm + 1


def alert_symbols(readings: DataFrame, policy: AlertPolicy) -> DataFrame:
    """The readings that an alert's machine hears, with `_x`, what each tells it."""
    rows = with_previous(readings.where("state <> 'UNKNOWN'"), ["crossing_id"], ["t", "event_id"], ["t"])
    lapse = F.coalesce(F.col("t") - F.col("before.t") > policy.silence_ms, F.lit(False))
    return rows.withColumn("_x", F.when(F.col("state") == "BLOCKED", BLOCKED).otherwise(CLEAR) + F.when(lapse, LAPSE).otherwise(0)).drop("before")


def rising_edges(readings: DataFrame, policy: AlertPolicy = AlertPolicy()) -> DataFrame:
    """One alert per blockage: at the second BLOCKED in a row, then none until three CLEAR in a row or
    a silence. UNKNOWN is invisible."""
    n = streaks(policy)
    rows = states(alert_symbols(readings, policy), ["crossing_id"], ["t", "event_id"], F.col("_x"), alert_machine(policy), "_was", "_is")
    fires = (F.col("_is") >= n) & ((F.col("_was") < n) | (F.col("_x") == BLOCKED + LAPSE))
    return rows.where(fires).select("crossing_id", "t", "camera_id", "confidence")


def alerted_at(readings: DataFrame, instants: DataFrame, policy: AlertPolicy = AlertPolicy()) -> DataFrame:
    """Whether a crossing's alert stands at given instants (crossing_id, at), each once, after what was read
    up to them."""
    heard = alert_symbols(readings, policy).select("crossing_id", "t", F.lit(0).alias("_ask"), F.col("event_id").cast("long").alias("event_id"), "_x")
    asked = instants.select("crossing_id", F.col("at").alias("t"), F.lit(1).alias("_ask"), F.lit(0).cast("long").alias("event_id"), F.lit(ASK).alias("_x"))
    rows = states(heard.unionByName(asked), ["crossing_id"], ["t", "_ask", "event_id"], F.col("_x"), alert_machine(policy), "_was", "_is")
    return rows.where("_ask = 1").select("crossing_id", F.col("t").alias("at"), (F.col("_is") >= streaks(policy)).alias("alerted"))


def blocked_spans(readings: DataFrame, hold_ms: int = 15 * 60_000) -> DataFrame:
    """When each crossing counts as blocked: a BLOCKED reading holds until its camera's next later one,
    at most hold_ms; what touches is one span. Cameras that don't judge by policy end nothing."""
    rows = judging(readings)
    times = rows.groupBy("camera_id", "t").agg(F.collect_set(F.when(F.col("state") == "BLOCKED", F.col("crossing_id"))).alias("blocked"))
    ends = with_next(times, ["camera_id"], ["t"], ["t"]).select(F.explode("blocked").alias("crossing_id"), "t", F.least(F.coalesce("after.t", F.col("t") + hold_ms), F.col("t") + hold_ms).alias("e"))
    ends = ends.groupBy("crossing_id", "t").agg(F.max("e").alias("e"))
    reach = with_running(ends, ["crossing_id"], ["t"], maxima={"reach": "e"}, before=True)
    islands = with_running(reach.withColumn("_n", F.coalesce((F.col("t") > F.col("reach")).cast("int"), F.lit(1))), ["crossing_id"], ["t"], {"island": "_n"})
    return islands.groupBy("crossing_id", "island").agg(F.min("t").alias("span_start"), F.max("e").alias("span_end")).drop("island")


def policy_unknown() -> Column:
    """Whether a row says only that its camera isn't asked; such rows neither vote nor end anything."""
    return (F.col("state") == "UNKNOWN") & F.col("version").startswith(POLICY_PREFIX)


def judging(readings: DataFrame) -> DataFrame:
    return readings.where(~policy_unknown())


def clip(spans: DataFrame, low: int, high: int) -> DataFrame:
    """Spans within [low, high]; empty ones go."""
    cut = spans.withColumns({"span_start": F.greatest("span_start", F.lit(low)), "span_end": F.least("span_end", F.lit(high))})
    return cut.where("span_start < span_end")


def consensus(votes: DataFrame) -> DataFrame:
    """Per crossing and instant (at) over fresh votes (state, t): any BLOCKED wins, then any CLEAR;
    none fresh is UNKNOWN and stale. The witness is the newest vote of the winning state."""
    pick = lambda s: F.max(F.when(F.col("fresh") & (F.col("state") == s), F.struct("t", "camera_id")))
    out = votes.groupBy("crossing_id", "at").agg(pick("BLOCKED").alias("b"), pick("CLEAR").alias("c"), pick("UNKNOWN").alias("u"), F.count_if("fresh").alias("n_fresh"))
    state = F.when(F.col("b").isNotNull(), "BLOCKED").when(F.col("c").isNotNull(), "CLEAR").otherwise("UNKNOWN")
    witness = F.coalesce("b", "c", "u")
    return out.select("crossing_id", "at", state.alias("state"), (F.col("n_fresh") == 0).alias("stale"), witness["camera_id"].alias("witness"), witness["t"].alias("witness_t"))


def board(readings: DataFrame, at: int, stale_ms: int = 15 * 60_000) -> DataFrame:
    """What was known of every crossing at an instant: each camera's latest reading votes while fresh."""
    last = judging(readings).where(F.col("t") <= at).groupBy("crossing_id", "camera_id").agg(F.max(F.struct("t", "event_id", "state")).alias("x"))
    votes = last.select("crossing_id", "camera_id", F.lit(at).alias("at"), "x.t", "x.state", (F.lit(at) - F.col("x.t") <= stale_ms).alias("fresh"))
    return consensus(votes)


def transitions(readings: DataFrame, stale_ms: int = 15 * 60_000) -> DataFrame:
    """Instants at which a crossing's consensus changed, judged at each of its readings.

    Every reading is an instant for its crossing; each camera's state there is its last one before or
    at it, carried along the crossing's readings, so no row meets another by a join."""
    # a camera's state counts until its next reading: as an interval it adds one vote, then takes it back
    held = with_next(readings, ["camera_id"], ["t", "event_id"], ["t"]).withColumn("_n", F.col("after.t")).withColumn("gone", F.least(F.coalesce("_n", F.col("t") + stale_ms + 1), F.col("t") + stale_ms + 1)).where("gone > t")
    votes = held.select("crossing_id", "t", F.when(F.col("state") == "BLOCKED", 1).otherwise(0).alias("b"), F.when(F.col("state") == "CLEAR", 1).otherwise(0).alias("c"))
    votes = votes.unionByName(held.select("crossing_id", F.col("gone").alias("t"), F.when(F.col("state") == "BLOCKED", -1).otherwise(0).alias("b"), F.when(F.col("state") == "CLEAR", -1).otherwise(0).alias("c")))
    votes = votes.groupBy("crossing_id", "t").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    level = with_running(votes, ["crossing_id"], ["t"], {"nb": "b", "nc": "c"})
    at = level.join(readings.select("crossing_id", "t").distinct(), ["crossing_id", "t"], "left_semi")
    at = at.withColumn("state", F.when(F.col("nb") > 0, "BLOCKED").when(F.col("nc") > 0, "CLEAR").otherwise("UNKNOWN"))
    return with_previous(at, ["crossing_id"], ["t"], ["state"]).where("before IS NULL OR before.state <> state").select("crossing_id", "t", "state")


def suggested_gap(readings: DataFrame, least_ms: int = 15 * 60_000) -> DataFrame:
    """A gap for each camera: twice its longest interval, four medians, or the least."""
    steps = with_previous(readings, ["camera_id"], ["t", "event_id"], ["t"]).withColumn("d", F.col("t") - F.col("before.t"))
    out = steps.groupBy("camera_id").agg(F.count("*").alias("n"), F.max("d").alias("worst"), F.percentile("d", 0.5).alias("median"))
    return out.select("camera_id", F.when(F.col("n") < 3, F.lit(float(least_ms))).otherwise(F.greatest(F.col("worst") * 2.0, F.col("median") * 4, F.lit(float(least_ms)))).alias("gap_ms"))


#: Arrivals that one window orders.
ARRIVALS = 10_000


def newest_only(readings: DataFrame, arrival: str = "event_id") -> DataFrame:
    """Readings that were, on arrival, not older than what their camera had already sent."""
    spread = readings.withColumn("_arrived", F.col(arrival).cast("long") * (DAY_MS // ARRIVALS))
    return with_running(spread, ["camera_id"], ["_arrived"], maxima={"_m": "t"}, before=True).where("_m IS NULL OR t >= _m").drop("_m", "_arrived")


def flag_clusters(flags: DataFrame, least: int = 3, within_ms: int = 6 * 60_000) -> DataFrame:
    """Groups of at least `least` flags of a camera, each within `within_ms` of the one before."""
    order = ["t", "event_id"]
    rows = with_previous(flags, ["camera_id"], order, ["t"]).withColumn("_b", F.coalesce((F.col("t") - F.col("before.t") > within_ms).cast("int"), F.lit(0)))
    rows = with_running(rows, ["camera_id"], order, {"run": "_b"})
    return rows.groupBy("camera_id", "run").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("flags")).where(F.col("flags") >= least).drop("run")
