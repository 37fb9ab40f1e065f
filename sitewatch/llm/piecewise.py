"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last WINDOW bytes ends a chunk wherever it meets a trigger, so an edit moves only the
boundaries beside it. Each chunk gives one letter; a fingerprint is "block:letters:letters", the
letters at that block size and at twice of it. Fingerprints are compared by edit distance wherever
their block sizes agree.

Defined cases: null text is empty, and its fingerprint is "3::"; equal fingerprints have likeness 1,
those without a common block size 0; null doc_id sorts first; rows that repeat a doc_id are all kept,
ordered by a hash of the text; a single document is its own next one; an empty table gives no row;
other columns are ignored, whatever they are called. Memory follows the longest text (about 30 bytes
for each of its bytes), not the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_points, lean, prefix_sums, range_of, stretch_hashes

WINDOW, LETTERS, LEAST_BLOCK = 7, 64, 3
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
STEP = 0x01000193


def rolled(data: np.ndarray) -> np.ndarray:
    """At each byte, a hash of it and the WINDOW - 1 bytes before it."""
    out, weight = np.zeros(len(data), np.uint32), 1
    for back in range(min(WINDOW, len(data))):
        out[back:] += data[: len(data) - back].astype(np.uint32) * np.uint32(weight)
        weight = weight * STEP % 2**32
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return out ^ (out >> np.uint32(12))


def letters(data: np.ndarray, sums: np.ndarray, ends: np.ndarray, most: int) -> str:
    """A letter for each chunk; the last one takes all that is left."""
    ends = ends[: most - 1] + 1
    if not len(data):
        return ""
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    begins = np.concatenate([[0], ends[:-1]])
    return "".join([ALPHABET[i] for i in (stretch_hashes(sums, begins, ends) >> np.uint64(58)).tolist()])


def fingerprint(text: bytes) -> str:
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return f"{LEAST_BLOCK}::"
    block = LEAST_BLOCK
    while block * LETTERS < len(data):
        block *= 2
    low = max(LEAST_BLOCK, block // 4)
    h = rolled(data)
    at = np.flatnonzero(h % np.uint32(low) == low - 1)
    ends = {low: at}
    while low < 2 * block:
        low *= 2
        at = at[h[at] % np.uint32(low) == low - 1]
        ends[low] = at
    while len(ends[block]) < LETTERS // 2 and block // 2 in ends:
        block //= 2
    sums = prefix_sums(data)
    return f"{block}:{letters(data, sums, ends[block], LETTERS)}:{letters(data, sums, ends[2 * block], LETTERS // 2)}"


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs of strings over ALPHABET of up to 64 letters, all pairs at
    once: a column of the table is two bit vectors (Myers 1999)."""
    n = len(a)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    code = {c: i for i, c in enumerate(ALPHABET)}
    has = np.zeros((n, len(ALPHABET)), np.uint64)
    for i, x in enumerate(a):
        for j, c in enumerate(x):
            has[i, code[c]] |= np.uint64(1 << j)
    other = np.zeros((n, max(lb, default=0)), np.int64)
    for i, x in enumerate(b):
        other[i, : len(x)] = [code[c] for c in x]
    one, rows = np.uint64(1), np.arange(n)
    top = one << np.maximum(la - 1, 0).astype(np.uint64)
    up, down, score = np.full(n, 2**64 - 1, np.uint64), np.zeros(n, np.uint64), la.copy()
    for j in range(other.shape[1]):
        on, eq = j < lb, has[rows, other[:, j]]
        xv, xh = eq | down, (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up), up & xh
        score += on * ((ph & top) != 0).astype(np.int64) - on * ((mh & top) != 0).astype(np.int64)
        ph, mh = (ph << one) | one, mh << one
        up, down = np.where(on, mh | ~(xv | ph), up), np.where(on, ph & xv, down)
    return np.where(la == 0, lb, score)


def likenesses(pairs: list[tuple[str, str]]) -> list[float]:
    """1 - distance / length of the longer, at the block size both have where it is highest."""
    jobs: list[tuple[int, str, str]] = []
    out = [0.0] * len(pairs)
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1.0
            continue
        (bx, *sx), (by, *sy) = x.split(":"), y.split(":")
        at_x, at_y = {int(bx): sx[0], 2 * int(bx): sx[1]}, {int(by): sy[0], 2 * int(by): sy[1]}
        jobs += [(i, at_x[k], at_y[k]) for k in at_x.keys() & at_y.keys() if at_x[k] and at_y[k]]
    if jobs:
        for (i, x, y), d in zip(jobs, edit_distances([j[1] for j in jobs], [j[2] for j in jobs]).tolist()):
            out[i] = max(out[i], 1 - d / max(len(x), len(y)))
    return out


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, doc_id, text, peek) sorted by part, peek, doc_id: each document beside its next one."""

    def pairs():
        held = None
        for batch in batches:
            for part, doc_id, text, peek in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3))):
                now = [doc_id, text, fingerprint(text.encode()), part]
                if held is not None and held[3] == part:
                    yield held, now
                held = None if peek else now

    done: list[tuple] = []
    for (doc_id, text, mark, _), (_, following, next_mark, _) in pairs():
        k = len(text) // 4
        edited = (text[: len(text) - k] + following[:k]).encode()
        done.append((doc_id, len(text), hashlib.sha256(edited).hexdigest(), mark, fingerprint(edited), next_mark))
        if len(done) == 500:
            yield batch_of(done)
            done = []
    if done:
        yield batch_of(done)


def batch_of(done: list[tuple]) -> pa.RecordBatch:
    near = likenesses([(x[3], x[4]) for x in done] + [(x[3], x[5]) for x in done])
    columns = [*map(list, zip(*done))][:5] + [near[: len(done)], near[len(done) :]]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def edited_fingerprints(docs: DataFrame, docs_per_part: int = 3000) -> DataFrame:
    """Fingerprints of every document (doc_id, text) and of its edited text, and their likenesses.

    Documents are dealt by ranges of doc_id and pass once, in order; a range's first document goes
    to the range before as well, for that one's last document to look at."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = cut_points(docs, "doc_id", max(1, docs.count() // docs_per_part + 1))
    docs = docs.withColumn("part", range_of(F.col("doc_id"), cuts)).withColumn("h", F.xxhash64("text"))
    # a row for each range
    first = docs.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "h")).alias("f"))
    ring = Window.orderBy("part")
    whole = Window.partitionBy(F.lit(0))
    first = first.select("part", "f", F.coalesce(F.lag("part").over(ring), F.max("part").over(whole)).alias("before"))
    first = first.select(F.col("f.doc_id").alias("f_id"), F.col("f.h").alias("f_h"), F.col("part").alias("f_part"), "before")
    # broadcast whatever the session's bound: a join by shuffle would move every text once more
    at = docs.join(F.broadcast(first), (docs.part == first.f_part) & docs.doc_id.eqNullSafe(first.f_id) & (docs.h == first.f_h), "left")
    places = F.when(F.col("before").isNull(), F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("peek")))).otherwise(F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("peek")), F.struct(F.col("before").alias("p"), F.lit(1).alias("peek"))))
    rows = at.select(F.explode(places).alias("x"), "doc_id", "text", "h").select("x.p", "doc_id", "text", "x.peek", "h")
    rows = rows.repartitionById(len(cuts) + 1, "p").sortWithinPartitions("p", "peek", F.col("doc_id").asc_nulls_first(), "h")
    return rows.mapInArrow(lean(compare_neighbours), SCHEMA)


def op8_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
