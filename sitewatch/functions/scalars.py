"""Scalar expressions: ids, keys, local time, texts. All are native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Los_Angeles"
CERTIFIED_READINGS, CERTIFIED_SECONDS = 2, 300


def iso_text(ms: str) -> str:
    """SQL for the ISO text of a UTC instant: no fraction if it is whole seconds, else six digits."""
    return f"concat(date_format(timestampadd(MILLISECOND, {ms}, TIMESTAMP_NTZ'1970-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss\"), CASE WHEN {ms} % 1000 = 0 THEN '' ELSE concat('.', lpad(cast({ms} % 1000 AS string), 3, '0'), '000') END, '+00:00')"


def session_id(crossing: str, start: str) -> Column:
    """A session's id follows from where and when it began, so a rebuild gives the same one."""
    return F.expr(f"substring(sha2(concat({crossing}, '|', {iso_text(start)}), 256), 1, 32)")


def local(ms: str, zone: str = ZONE) -> Column:
    """Wall-clock time at the sites."""
    return F.expr(f"convert_timezone('UTC', '{zone}', timestampadd(MILLISECOND, {ms}, TIMESTAMP_NTZ'1970-01-01 00:00:00'))")


def certified(readings: str, seconds: str) -> Column:
    """Enough evidence for a session; rows from before evidence was counted pass."""
    return F.expr(f"{readings} IS NULL OR ({readings} >= {CERTIFIED_READINGS} AND coalesce({seconds}, 0) >= {CERTIFIED_SECONDS})")


def frame_key(camera: str, ms: str, digest: str) -> Column:
    at = f"timestampadd(MILLISECOND, {ms}, TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    return F.expr(f"concat('frames/', {camera}, '/', date_format({at}, 'yyyy/MM/dd/HH'), '/', {ms}, '-', substring({digest}, 1, 8), '.jpg')")


def manifest_key(camera: str, ms: str) -> Column:
    at = f"timestampadd(MILLISECOND, {ms}, TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    return F.expr(f"concat('manifests/', {camera}, '/', date_format({at}, 'yyyy/MM/dd/HH'), '.jsonl.gz')")


#: Fixed: the only shape that a stored frame's key has.
FRAME_KEY = r"^frames/[A-Za-z0-9_-]+/[0-9]{4}/[0-9]{2}/[0-9]{2}/[0-9]{2}/[0-9]+-[0-9a-f]{8}[.]jpg$"


def is_frame_key(key: str) -> Column:
    """Whether a key may be asked of a store of frames; nothing else, such as a path that leads out of it."""
    return F.coalesce(F.col(key).rlike(FRAME_KEY.replace("$", r"\z")), F.lit(False))


def frame_time(key: str) -> Column:
    """The milliseconds in a frame's file name, or null."""
    return F.expr(f"try_cast(regexp_extract({key}, '([0-9]+)-[0-9a-f]{{8}}[.]jpg$', 1) AS bigint)")


def folded(name: str) -> Column:
    """A name without case, spaces and punctuation. lower() stands for full case folding."""
    return F.expr(f"regexp_replace(lower({name}), '[^\\\\p{{L}}\\\\p{{N}}]', '')")


def hour_label(hour: str) -> Column:
    return F.expr(f"concat(CASE WHEN pmod({hour}, 12) = 0 THEN 12 ELSE pmod({hour}, 12) END, CASE WHEN pmod({hour}, 24) < 12 THEN 'A' ELSE 'P' END)")


def percent_text(share: str) -> Column:
    return F.expr(f"CASE WHEN {share} IS NULL THEN '-' WHEN {share} > 0 AND {share} < 0.01 THEN '<1%' ELSE concat(cast(floor({share} * 100 + 0.5) AS int), '%') END")


def duration_text(seconds: str) -> Column:
    """Whole minutes, rounded half up: "1h 9m" or "12m"; null is "-"."""
    m = f"cast(floor({seconds} / 60 + 0.5) AS int)"
    return F.expr(f"CASE WHEN {seconds} IS NULL THEN '-' WHEN {m} >= 60 THEN concat(cast(floor({m} / 60) AS int), 'h ', {m} % 60, 'm') ELSE concat({m}, 'm') END")


def ticker_text(seconds: str) -> Column:
    """The running form, with seconds: "1h 9m 5s", "12m 0s"."""
    return F.expr(f"concat(CASE WHEN {seconds} >= 3600 THEN concat(cast(floor({seconds} / 3600) AS int), 'h ') ELSE '' END, cast(floor({seconds} % 3600 / 60) AS int), 'm ', cast({seconds} % 60 AS int), 's')")
