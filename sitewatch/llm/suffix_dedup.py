"""Removal of long byte strings that occur again, by blockwise suffix sorting with a difference cover.

Every LENGTH-byte window of a text belongs to one anchor, the least hash among the k-grams inside it;
equal windows have equal anchors at equal offsets. The windows of one anchor are neighbours, so a
stretch of text stands for them. Stretches are dealt by anchor, which makes the suffix buckets:

1. An anchor that occurs once in the corpus has no repeated window, and equal stretches are repeated
   as a whole. Both are settled by counting hashes; only unequal stretches of one anchor need sorting.
2. Those are sorted bucket by bucket, a block of about a MB at a time: suffixes that agree in their first
   COVER bytes are ordered by the ranks of positions of a difference cover modulo COVER, computed
   beforehand by prefix doubling over that sample alone. Neighbours are then compared byte by byte.
3. A bucket of more than CROWDED unequal stretches (at the edges of a passage that very many documents
   share) isn't sorted: its stretches are cut into chunks of a few windows, dealt by the bytes these have
   in common, and steps 1 and 2 are done with the chunks; what is crowded still is dealt by single
   windows, which counting settles. So no task holds more than CROWDED stretches of a bucket and a block.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; rows that repeat a doc_id
are each a document; rows equal in doc_id and text lose all windows, as these occur twice; null doc_id
is kept; an empty table gives no row; other columns are ignored, whatever they are called. Long
texts are taken in pieces that overlap by a window, so memory doesn't follow their length until their
own bytes are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, filter_place, id_filter, in_filter, lean, mix, prefix_sums, saved, stretch_hashes, utf8

LENGTH, GRAM, COVER = 200, 48, 64
#: Text bytes looked at at once; bytes of stretches sorted at once; stretches of a bucket at most, if it is
#: to be sorted; windows of a chunk, one level after the other.
PIECE, BLOCK_BYTES, CROWDED, CHUNKS = 1 << 18, 1 << 19, 2000, (16, 1)
#: Rows of a batch that become Python objects at once.
ROWS = 250
PLACE_BITS = np.uint64(22)


def difference_cover(v: int) -> list[int]:
    """Residues among which every difference modulo v occurs; chosen greedily."""
    cover, missing = [0], set(range(1, v))
    while missing:
        best = max(range(v), key=lambda x: len({(x - c) % v for c in cover} & missing | {(c - x) % v for c in cover} & missing))
        missing -= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
        cover.append(best)
    return sorted(cover)


SAMPLE = difference_cover(COVER)
#: From each residue, the least step to one of the cover: what two suffixes of that residue skip.
STEPS = np.array([min((c - r) % COVER for c in SAMPLE) for r in range(COVER)])


def anchors(raw: np.ndarray, offsets: np.ndarray):
    """(row, start, windows, anchor's place in the stretch, anchor's hash, stretch's hash) of all
    windows of some rows; places count from the row's first byte."""
    n = len(raw)
    if n < LENGTH:
        return None
    sums = prefix_sums(raw)
    at = np.arange(n - GRAM + 1)
    grams = stretch_hashes(sums, at, at + GRAM)
    low = ((grams >> PLACE_BITS) << PLACE_BITS) | at.astype(np.uint64)
    span, width = LENGTH - GRAM + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: n - LENGTH + 1], low[span - width : span - width + n - LENGTH + 1])
    place = (low & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    within = row[: len(place)] == row[LENGTH - 1 :]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1 : len(place)] != row[: len(place) - 1]) | ~within[:-1]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(place))
    keep = within[starts]
    starts, ends = starts[keep], ends[keep]
    # windows that reach into the next row end a stretch early
    limit = offsets[row[starts] + 1] - LENGTH + 1
    ends = np.minimum(ends, limit)
    windows, place = ends - starts, place[starts]
    whole = stretch_hashes(sums, starts, ends + LENGTH - 1) ^ mix((place - starts).astype(np.uint64))
    return row[starts], starts - offsets[row[starts]], windows, place - starts, grams[place], whole


def pieces(raw: np.ndarray, offsets: np.ndarray):
    """(first row, bytes, offsets, bytes before) of runs of rows, and of overlapping parts of long rows."""
    for i, j in blocks(offsets, PIECE):
        a, b = int(offsets[i]), int(offsets[j])
        if j - i > 1 or b - a <= 2 * PIECE:
            yield i, raw[a:b], offsets[i : j + 1] - a, 0
        else:
            for c in range(a, b - LENGTH + 1, PIECE):
                part = raw[c : min(b, c + PIECE + LENGTH - 1)]
                yield i, part, np.array([0, len(part)]), c - a


def anchored(docs: DataFrame) -> DataFrame:
    """(key, start, windows, lead, anchor, whole) of every stretch of docs (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for i, raw, offsets, before in pieces(*utf8(batch.column(1))):
                found = anchors(raw, offsets)
                if found is not None and len(found[0]):
                    row, start, windows, lead, anchor, whole = found
                    yield pa.RecordBatch.from_arrays([pa.array(keys[row + i]), pa.array((start + before).astype(np.int64)), pa.array(windows.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64))], names=["key", "start", "windows", "lead", "anchor", "whole"])

    return docs.select("key", "text").mapInArrow(lean(run), FOUND)


STRETCH = "bucket long, key long, start long, windows int, lead int, one boolean, bytes binary"


def wanted_parts(batches: Iterator[pa.RecordBatch]):
    """(key, stretch asked for, its bytes) of rows (key, text, wanted)."""
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            batch = whole.slice(i, ROWS)
            for key, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                for w in wanted:
                    yield key, w, text[w["start"] : w["start"] + w["windows"] + LENGTH - 1]


def cut_out(rows: DataFrame) -> DataFrame:
    """The bytes of the stretches that rows (key, text, wanted) ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for key, w, part in wanted_parts(batches):
            out.append((w["anchor"], key, w["start"], w["windows"], w["lead"], w["one"], part))
            size += len(part)
            if size > 1 << 21:
                yield stretches(out)
                out, size = [], 0
        if out:
            yield stretches(out)

    return rows.mapInArrow(lean(run), STRETCH)


def chunked(rows: DataFrame, chunk: int) -> DataFrame:
    """The stretches that rows (key, text, wanted) ask for in chunks of `chunk` windows, counted from the
    anchor on, as anchored() gives them: the new anchor is a hash of what a chunk's windows share."""

    def digest(part: bytes, at: int) -> int:
        return int.from_bytes(hashlib.blake2b(part, digest_size=8, key=at.to_bytes(4, "little", signed=True)).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, w, part in wanted_parts(batches):
            windows, lead, j = w["windows"], w["lead"], 0
            while j < windows:
                left = lead - j  # from the window's first byte to the anchor
                core = lead - left // chunk * chunk if left >= 0 else lead + (-left + chunk - 1) // chunk * chunk
                past = min(windows, core + 1)
                out.append((key, w["start"] + j, past - j, lead - j, digest(part[core : core + LENGTH - chunk + 1], lead - core), digest(part[j : past + LENGTH - 1], lead - j)))
                j = past
            if len(out) > 20_000:
                yield as_found(out)
                out = []
        if out:
            yield as_found(out)

    return rows.mapInArrow(lean(run), FOUND)


FOUND = "key long, start long, windows int, lead int, anchor long, whole long"


def as_found(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*out)), kinds)], names=[c.split()[0] for c in FOUND.split(", ")])


def stretches(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*out)), kinds)], names=[c.split()[0] for c in STRETCH.split(", ")])


def ranks(words: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows by their words, first word first."""
    order = np.lexsort(words[::-1])
    new = np.zeros(len(order), np.int64)
    for w in words:
        s = w[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_windows(buckets: np.ndarray, leads: np.ndarray, windows: np.ndarray, parts: list[bytes]) -> list[np.ndarray]:
    """For each stretch, which of its windows another stretch of the same bucket has too."""
    m = len(parts)
    lengths = np.array([len(p) for p in parts])
    # laid out so that each anchor is at a multiple of COVER: equal windows then have equal residues
    shift = (-leads) % COVER
    room = (shift + lengths + 4 * COVER + COVER - 1) // COVER * COVER
    base = np.concatenate([[0], np.cumsum(room)])
    text = np.zeros(int(base[-1]) + 8 * COVER, np.uint8)
    begins = base[:-1] + shift
    for b, p in zip(begins.tolist(), parts):
        text[b : b + len(p)] = np.frombuffer(p, np.uint8)
    n = int(base[-1])
    # ranks of the cover's positions: by COVER bytes, then doubled until they hold for 4 * COVER
    grid = (np.arange(0, n, COVER)[:, None] + np.array(SAMPLE)[None, :]).reshape(-1)
    view = np.lib.stride_tricks.sliding_window_view(text, COVER)[grid].view(">u8").astype(np.uint64)
    rank = ranks([np.ascontiguousarray(view[:, i]) for i in range(COVER // 8)])
    k = len(SAMPLE)
    for ahead in (1, 2):
        later = np.full(len(rank), -1, np.int64)
        later[: len(rank) - ahead * k] = rank[ahead * k :]
        rank = ranks([rank, later])
    column = np.full(COVER, -1)
    column[SAMPLE] = np.arange(k)
    # suffixes, a window each; those alone in bucket, offset and first COVER bytes have no equal
    owner = np.repeat(np.arange(m), windows)
    first = np.concatenate([[0], np.cumsum(windows)])
    nth = np.arange(len(owner)) - first[owner]
    at = begins[owner] + nth
    sums = prefix_sums(text[:n])
    head = mix(stretch_hashes(sums, at, at + COVER) ^ mix(buckets[owner].view(np.uint64) + (leads[owner] - nth).astype(np.uint64)))
    order = np.argsort(head)
    same = head[order[1:]] == head[order[:-1]]
    tied = np.zeros(len(order), bool)
    tied[1:] |= same
    tied[:-1] |= same
    order = order[tied]
    position = at[order] + STEPS[at[order] % COVER]
    order = order[np.lexsort((rank[position // COVER * k + column[position % COVER]], head[order]))]
    # neighbours: equal in all LENGTH bytes?
    flags = np.zeros(len(owner), bool)
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    pair = np.flatnonzero(head[order[1:]] == head[order[:-1]])
    x, y = at[order[pair]], at[order[pair + 1]]
    for step in range(0, LENGTH, 8):
        equal = words[x + step].view(np.uint64)[:, 0] == words[y + step].view(np.uint64)[:, 0]
        pair, x, y = pair[equal], x[equal], y[equal]
    flags[order[pair]] = True
    flags[order[pair + 1]] = True
    return np.split(flags, first[1:-1])


def runs_of(flags: np.ndarray) -> np.ndarray:
    """(from, past) of the runs of true."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


def sorted_buckets(rows: DataFrame) -> DataFrame:
    """(key, low, past): windows from low up to past of the stretches that occur once and whose windows
    another stretch has. Whole buckets are sorted together, about a MB of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def close():
            once = np.array([x[5] for x in held])
            flags = repeated_windows(np.array([x[0] for x in held]), np.array([x[4] for x in held]), np.array([x[3] for x in held]), [x[6] for x in held])
            found = [(held[i][1], held[i][2] + a, held[i][2] + b) for i in np.flatnonzero(once).tolist() if flags[i].any() for a, b in runs_of(flags[i]).tolist()]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], names=["key", "low", "past"])

        for whole in batches:
            for i in range(0, whole.num_rows, 4 * ROWS):
                for row in zip(*(c.to_pylist() for c in whole.slice(i, 4 * ROWS).columns)):
                    if row[0] != last and size > BLOCK_BYTES:
                        yield close()
                        held, size = [], 0
                    last = row[0]
                    held.append(row)
                    size += len(row[6])
        if held:
            yield close()

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), "key long, low long, past long")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def kept_of(text: bytes, marks: list[dict] | None) -> tuple[list[bytes], int]:
    """What stays of a text, and the number of runs that go."""
    spans: list[list[int]] = []
    for low, past in sorted((x["low"], x["past"] + LENGTH - 1) for x in marks or ()):
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], past)
        else:
            spans.append([low, past])
    ends = [0, *(x for s in spans for x in s), len(text)]
    return [text[a:b] for a, b in zip(ends[::2], ends[1::2])], len(spans)


def without(rows: DataFrame, bits=None) -> DataFrame:
    """doc_id, counts and digest of what stays of rows (doc_id, text, marks); with a filter, of rows
    (doc_id, text, key) that fail it, all of which stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            out = []
            if bits is not None:
                batch = batch.filter(pa.array(~in_filter(bits.value, batch.column(2).to_numpy())))
            marked = batch.column(2).to_pylist() if bits is None else [None] * batch.num_rows
            for doc_id, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), marked):
                kept, spans = kept_of(text or b"", marks)
                kept = b"".join(kept)
                out.append((doc_id, len(text or b""), len(text or b"") - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string() if i == 4 else pa.int64()) for i in range(5)], names=[c.split()[0] for c in RESULT.split(", ")])

    return rows.select("doc_id", "text", "marks" if bits is None else filter_place("key").alias("place")).mapInArrow(lean(run), RESULT)


def repeats(docs: DataFrame) -> DataFrame:
    """(key, marks) of the rows of docs (key, text) that have repeated windows; marks: ranges of them."""
    marks = repeated(docs, saved(anchored(docs), "anchors"), CHUNKS)
    return saved(marks.groupBy("key").agg(F.collect_set(F.struct("low", "past")).alias("marks")), "marks")


def repeated(docs: DataFrame, found: DataFrame, chunks: tuple[int, ...]) -> DataFrame:
    """(key, low, past): ranges of repeated windows among the stretches found, crowded buckets in chunks."""
    groups = found.groupBy("anchor").agg(F.count("*").alias("c"), F.min("whole").alias("w0"), F.max("whole").alias("w1")).where("c > 1")
    shared = saved(found.join(groups, "anchor").select("key", "start", "windows", "lead", "anchor", "whole", (F.col("w0") != F.col("w1")).alias("mixed")), "shared")

    # one of each unequal stretch of an anchor, and how often it occurs
    kinds = shared.where("mixed").groupBy("anchor", "whole").agg(F.count("*").alias("c"), F.min(F.struct("key", "start", "windows", "lead")).alias("x"))
    kinds = saved(kinds, "kinds")
    whole = shared.where("not mixed").select("key", "start", "windows").union(shared.where("mixed").join(kinds.where("c > 1").select("anchor", "whole"), ["anchor", "whole"]).select("key", "start", "windows"))
    marks = whole.select("key", F.col("start").alias("low"), (F.col("start") + F.col("windows")).alias("past"))

    crowd = saved(kinds.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("anchor"), "crowd")
    ask = F.struct("x.start", "x.windows", "x.lead", "anchor", (F.col("c") == 1).alias("one")).alias("w")
    few = kinds.join(crowd, "anchor", "left_anti").select("x.key", ask)
    marks = marks.union(sorted_buckets(cut_out(asked(docs, few))))
    if not chunks or crowd.isEmpty():
        return marks
    many = kinds.join(crowd, "anchor", "left_semi").select("x.key", ask)
    return marks.union(repeated(docs, saved(chunked(asked(docs, many), chunks[0]), "chunks"), chunks[1:]))


def asked(docs: DataFrame, stretches: DataFrame) -> DataFrame:
    """(key, text, wanted) of the rows of docs that stretches (key, w) are asked of."""
    wanted = saved(stretches.groupBy("key").agg(F.collect_list("w").alias("wanted")), "wanted")
    some = filtered(docs, docs.sparkSession.sparkContext.broadcast(id_filter(wanted, "key")))
    return some.join(wanted, "key").select("key", "text", "wanted")


def filtered(docs: DataFrame, bits, passing: bool = True) -> DataFrame:
    """The rows whose key passes the filter (or those that don't)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(bits.value, batch.column(batch.num_columns - 1).to_numpy()) == passing))

    return docs.withColumn("_place", filter_place("key")).mapInArrow(lean(run), docs.withColumn("_place", filter_place("key")).schema).drop("_place")


def key_of(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("doc_id").isNull(), F.coalesce(F.col("text").cast("string"), F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(key_of(docs).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the rest of every document. Texts with no
    repeat are digested where they lie; only the others are joined."""
    spark = docs.sparkSession
    docs = keyed(docs)
    marks = repeats(docs)
    bits = spark.sparkContext.broadcast(id_filter(marks, "key"))
    touched = filtered(docs, bits).join(marks, "key", "left").select("doc_id", "text", "marks")
    return without(touched).union(without(docs, bits))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with what deduplicated() keeps of each text as its text; other columns as they are,
    whatever they are called."""
    marks = repeats(keyed(docs))
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(marks, "key"))
    rows = docs.select(key_of(docs).alias("key"), F.col("text").cast("string").alias("text"), F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            kept = [None if t is None else b"".join(kept_of(t, m)[0]).decode(errors="ignore") for t, m in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), batch.column(1)], names=["text", "row"])

    touched = filtered(rows, bits).join(marks, "key", "left").select("text", "row", "marks")
    both = touched.mapInArrow(lean(run), rows.select("text", "row").schema).union(filtered(rows, bits, False).select("text", "row"))
    return both.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
