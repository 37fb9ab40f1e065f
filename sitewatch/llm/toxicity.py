"""Toxicity by a subsequence-kernel support vector machine with Nyström landmarks.

Units are the white-space separated words of a text, lower-cased, with "^" in front, as they stand and
without punctuation, and, where one letter makes up two fifths of a word or more, without that letter
("ixxdxxixxoxxt"); three or more single characters in a row are one unit ("i d i o t"); of what is
longer than SPAN letters every window of SPAN letters at half that step is one. The gap-weighted
subsequence kernel of order ORDER compares a unit with the landmarks, strings that toxic labelled
texts have and clean ones lack: every three letters they have in the same order count, those that
match with letters between them less, so gapped and stuffed spellings stay near. Kernel values become
features by the inverse root of the landmarks' own kernel matrix, and a linear machine with squared
hinge loss separates them. A text's score is that of its most toxic unit, made a probability on
labelled texts.

A margin is linear in the kernel values, hence in the unit's weighted triples of letters; so a table
of the machine's weight for each triple gives margins exactly, whatever the gaps.

The model is fitted to a bounded sample of labelled rows: TOXIC_DOCS and CLEAN_DOCS at most, by hash
of doc_id, none of which is held out. A toxic text gives every unit that begins with a telling landmark
as an example, so insults that share a text are all learned; words that many toxic texts have also stand
with letters put in between (virtual examples). Training goes over the whole texts of the sample ROUNDS
times; each time the unit of the largest margin joins the examples: of a toxic text without a telling unit
as its only one, of a clean text as one more. Everything else covers all rows and whole texts.

Defined cases: null or empty text has the score of a text without a suspicious unit; null doc_id isn't
held out; a label of null is no label and of two labels of a doc_id the larger holds; repeated rows are
each scored; an empty table gives no row; with no toxic or no clean label at all every score is 0;
other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, lean, saved, utf8

TOXIC_DOCS, CLEAN_DOCS = 3000, 6000
ORDER, DECAY, LANDMARKS, THRESHOLD, ROUNDS = 3, 0.7, 64, 0.3, 6
#: A landmark tells by itself if this share of the toxic texts has it, and PURE times as many toxic as clean ones.
TELLING, PURE = 0.02, 4
#: Lengths of the word beginnings that may be landmarks; letters of a unit looked at together.
STEMS, SPAN, CANDIDATES = range(3, 11), 24, 3000
#: Bytes of text taken at once.
BLOCK_BYTES = 1 << 22
START = ord("^")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@cache
def alphanumeric() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words on end, and where each word's begin and the last one's end."""
    raw, offsets = utf8(words)
    return np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int32), np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]


def gathered(letters: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of letters laid end to end, and their bounds."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return letters[np.repeat(begins - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds


def units_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of all texts: their letters on end with bounds, and which unit (second) is in which text
    (first). A word met twice is one unit."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    first = split.offsets.to_numpy() - (split.offsets[0].as_py() if len(texts) else 0)
    words = split.flatten().dictionary_encode()
    at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    letters, bounds = letters_of(words.dictionary)
    n, sizes = len(words.dictionary), np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    text_of, unit_of = [owner], [at]
    parts = [(letters, bounds[:-1], sizes)]
    # without punctuation
    kept = alphanumeric()[letters]
    left = np.add.reduceat(np.append(kept, False).astype(np.int64), bounds[:-1]) if n else np.zeros(0, np.int64)
    left[sizes == 0] = 0
    changed = np.flatnonzero((left < sizes) & (left > 0))
    bare, place = np.full(n, -1), n
    bare[changed] = place + np.arange(len(changed))
    bare_bounds = np.concatenate([[0], np.cumsum(left)])
    parts.append((letters[kept], bare_bounds[:-1][changed], left[changed]))
    place += len(changed)
    has = np.flatnonzero(bare[at] >= 0)
    text_of.append(owner[has])
    unit_of.append(bare[at[has]])
    # without a letter that the word is stuffed with
    word = np.repeat(np.arange(n), sizes)
    runs, count = np.unique(word << 21 | letters, return_counts=True)
    stuffed = (count >= 3) & (5 * count >= 2 * sizes[runs >> 21]) & (count < sizes[runs >> 21])
    filler, fillers = np.full(n, -1), runs[stuffed]
    filler[fillers >> 21] = fillers & (1 << 21) - 1
    changed = np.flatnonzero(filler >= 0)
    kept = (letters != filler[word]) & (filler[word] >= 0)
    left = np.bincount(word[kept], minlength=n)[changed]
    parts.append((letters[kept], np.cumsum(left) - left, left))
    bare[:] = -1
    bare[changed] = place + np.arange(len(changed))
    place += len(changed)
    has = np.flatnonzero(bare[at] >= 0)
    text_of.append(owner[has])
    unit_of.append(bare[at[has]])
    # single characters in a row
    single = np.zeros(len(at) + 2, np.int8)
    single[1:-1] = sizes[at] == 1
    edge = np.diff(single)
    apart = np.zeros(len(at) + 1, bool)
    apart[first[:-1]] = True
    starts = np.flatnonzero((edge[:-1] == 1) | (single[1:-1].astype(bool) & apart[:-1]))
    ends = np.flatnonzero((edge[1:] == -1) | (single[1:-1].astype(bool) & apart[1:])) + 1
    long = ends - starts >= 3
    starts, ends = starts[long], ends[long]
    heads = letters[np.minimum(bounds[:-1][at], max(0, len(letters) - 1))] if len(letters) else np.zeros(0, np.int32)
    spelled, spelled_bounds = gathered(heads, starts, ends - starts)
    parts.append((spelled, spelled_bounds[:-1], ends - starts))
    text_of.append(owner[starts])
    unit_of.append(place + np.arange(len(starts)))
    flat, begins, size, shift = [], [], [], 0
    for values, b, k in parts:
        flat.append(values)
        begins.append(b + shift)
        size.append(k)
        shift += len(values)
    out, out_bounds = gathered(np.concatenate(flat), np.concatenate(begins), np.concatenate(size))
    text, unit = np.concatenate(text_of), np.concatenate(unit_of)
    some = out_bounds[unit + 1] > out_bounds[unit]
    return out, out_bounds, text[some], unit[some]


def windows(letters: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(units, their letters in rows of one length, "^" in front) of all units, those above SPAN in windows."""
    led, at = np.insert(letters, bounds[:-1], START), bounds + np.arange(len(bounds))
    size = np.diff(at)
    # the windows of a unit begin at 0, SPAN / 2, ...
    number = np.maximum(1, -(-(size - SPAN // 2) // (SPAN // 2)))
    unit = np.repeat(np.arange(len(size)), np.where(size > SPAN, number, 1))
    nth = np.arange(len(unit)) - np.searchsorted(unit, unit)
    begin = at[unit] + nth * (SPAN // 2)
    size = np.minimum(at[unit + 1] - begin, SPAN)
    order = np.argsort(size, kind="stable")
    cuts = np.searchsorted(size[order], np.arange(SPAN + 2))
    for n in range(ORDER, SPAN + 1):
        rows = 1 << 22
        for a in range(cuts[n], cuts[n + 1], rows // (n * n)):
            some = order[a : min(cuts[n + 1], a + rows // (n * n))]
            yield unit[some], led[begin[some][:, None] + np.arange(n)]


def norms(rows: np.ndarray) -> np.ndarray:
    """Roots of the kernel of each row with itself."""
    m, n = rows.shape
    gap = np.arange(n)[:, None] - np.arange(n)[None, :]
    decay = np.where(gap > 0, np.float32(DECAY) ** np.maximum(gap, 0), 0).astype(np.float32)
    same = (rows[:, :, None] == rows[:, None, :]).astype(np.float32)
    before = np.float32(1)
    for _ in range(1, ORDER):
        # symmetric, so one side's sums, turned, make the other's
        half = (same * before).reshape(m * n, n) @ decay.T
        before = (half.reshape(m, n, n).transpose(0, 2, 1).reshape(m * n, n) @ decay.T).reshape(m, n, n)
    return np.sqrt(DECAY * DECAY * (same * before).sum(axis=(1, 2)))


def weighted_triples(codes: np.ndarray, table: np.ndarray, base: int) -> np.ndarray:
    """For rows of codes the sum over letters i < j < k of DECAY ** (k - i + 1) * table[codes of i, j, k]."""
    n = codes.shape[1]
    out = np.zeros((len(codes), *table.shape[1:]), np.float32)
    column = [np.ascontiguousarray(codes[:, i]) for i in range(n)]
    for i in range(n - 2):
        for j in range(i + 1, n - 1):
            pair = (column[i] * base + column[j]) * base
            for k in range(j + 1, n):
                out += np.float32(DECAY ** (k - i + 1)) * table[pair + column[k]]
    return out


@dataclass
class Model:
    """Landmarks, their features' matrix, the separating plane and the map of margins to probabilities."""

    landmarks: list[str]
    plane: np.ndarray
    bias: float
    slope: float
    offset: float

    def __post_init__(self):
        known = sorted({ord(c) for x in self.landmarks for c in x})
        self.base = len(known) + 1
        self.code = np.zeros(0x110000, np.int32)
        self.code[known] = np.arange(1, self.base)
        self.triples = np.zeros((self.base**3, len(self.landmarks)), np.float32)
        for l, x in enumerate(self.landmarks):
            c = self.code[[ord(ch) for ch in x]].tolist()
            for i in range(len(c) - 2):
                for j in range(i + 1, len(c) - 1):
                    for k in range(j + 1, len(c)):
                        self.triples[(c[i] * self.base + c[j]) * self.base + c[k], l] += DECAY ** (k - i + 1)
        self.triples /= np.array([norms(np.array([[ord(ch) for ch in x]], np.int32))[0] if len(x) >= ORDER else 1.0 for x in self.landmarks], np.float32)
        self.table = (self.triples @ self.plane).astype(np.float32)

    def kernel(self, units: list[str]) -> np.ndarray:
        """Normalized kernel of each unit (without its "^") with each landmark."""
        out = np.zeros((len(units), len(self.landmarks)))
        for unit, rows in windows(*letters_of(pa.array(units, pa.large_string()))):
            np.maximum.at(out, unit, weighted_triples(self.code[rows], self.triples, self.base) / norms(rows)[:, None])
        return out

    def margins(self, letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The margin of each unit; a unit of several windows has the largest."""
        out = np.full(len(bounds) - 1, -np.inf)
        for unit, rows in windows(letters, bounds):
            np.maximum.at(out, unit, weighted_triples(self.code[rows], self.table, self.base) / norms(rows) + self.bias)
        return np.where(out == -np.inf, self.bias, out)

    def best(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, list[str]]]:
        """Blocks of texts: each one's largest margin, and the unit that has it."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        for i, j in blocks(utf8(texts)[1], BLOCK_BYTES):
            letters, bounds, text, unit = units_of(texts.slice(i, j - i))
            value = self.margins(letters, bounds)[unit]
            order = np.lexsort((unit, -value, text))
            head = order[np.flatnonzero(np.diff(text[order], prepend=-1))]
            most, which = np.full(j - i, self.bias), [""] * (j - i)
            most[text[head]] = value[head]
            for t, u in zip(text[head].tolist(), unit[head].tolist()):
                which[t] = letters[bounds[u] : bounds[u + 1]].astype(np.uint32).tobytes().decode("utf-32-le")
            yield most, which

    def scores(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        out = [np.zeros(0)]
        for i, j in blocks(utf8(texts)[1], BLOCK_BYTES):
            letters, bounds, text, unit = units_of(texts.slice(i, j - i))
            most = np.full(j - i, -np.inf)
            np.maximum.at(most, text, self.margins(letters, bounds)[unit])
            out.append(np.where(most == -np.inf, self.bias, most))
        return 1 / (1 + np.exp(-np.clip(self.slope * np.concatenate(out) + self.offset, -30, 30)))


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Plane and bias (last) by Newton steps; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(30):
        on = y * (x @ w) < 1
        a = x[on] * weight[on, None]
        step = np.linalg.solve(a.T @ x[on] + np.diag(ridge), a.T @ y[on]) - w
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a probability along x, by Newton steps with a little shrinkage."""
    z, w = np.stack([x, np.ones(len(x))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - np.array([1e-2, 0]) * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def sample_of(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float] | None:
    """(doc_id, text, toxic) of the sample, and how many labelled clean rows one of its stands for,
    against toxic ones. At most TOXIC_DOCS + CLEAN_DOCS ids are broadcast."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic in (0, 1)")
    order = (F.xxhash64("l_id"), F.col("l_id"))
    count = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        return None
    taken = marks.where("toxic = 1").orderBy(*order).limit(TOXIC_DOCS).union(marks.where("toxic = 0").orderBy(*order).limit(CLEAN_DOCS))
    weight = (count[0] / min(count[0], CLEAN_DOCS)) / (count[1] / min(count[1], TOXIC_DOCS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(taken), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "toxic"), weight


def stem_counts(sample: DataFrame) -> list[tuple[str, int, int]]:
    """(stem, toxic documents, clean documents) of the CANDIDATES that tell most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for r in range(batch.num_rows):
                letters, bounds, _, _ = units_of(batch.column(1).slice(r, 1))
                text = letters.astype(np.uint32).tobytes().decode("utf-32-le")
                units = ["^" + text[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                counts[batch.column(2)[r].as_py()].update({u[:k] for u in units for k in STEMS if k <= len(u)})
            stems = list(counts[0].keys() | counts[1].keys())
            for i in range(0, len(stems), 100_000):
                part = stems[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([counts[1][s] for s in part], pa.int64()), pa.array([counts[0][s] for s in part], pa.int64())], names=["stem", "t", "c"])

    found = sample.mapInArrow(lean(run), "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t >= 2")
    tells = F.col("t") * F.log((F.col("t") + 0.5) / (4 * F.col("c") + 0.5))
    return [(r["stem"], r["t"], r["c"]) for r in found.where(tells > 0).orderBy(tells.desc(), "stem").limit(CANDIDATES).collect()]


def choose_landmarks(stems: list[tuple[str, int, int]]) -> list[str]:
    """The stems that tell most and aren't near to each other; of a stem and its longer forms that as
    many documents have, the longest."""
    count = {s: t for s, t, _ in stems}
    longest = {s: s for s, _, _ in stems}
    for s, t, _ in sorted(stems, key=lambda x: -len(x[0])):
        if count.get(s[:-1], 0) and t >= 0.95 * count[s[:-1]]:
            longest[s[:-1]] = longest[s]
    chosen: list[str] = []
    for s, _, _ in stems:
        s = longest[s]
        if s in chosen or sum(x.startswith(s) or s.startswith(x) for x in chosen) >= 3:
            continue
        chosen.append(s)
        if len(chosen) == LANDMARKS:
            break
    return chosen


def most_toxic(sample: DataFrame, model: Model) -> list[tuple[int, int, str, float]]:
    """(doc_id, toxic, unit, margin) of each text of the sample: its unit of the largest margin."""
    fixed = (model.landmarks, model.plane, model.bias, model.slope, model.offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*fixed)
        for batch in batches:
            found = list(own.best(batch.column(1)))
            margin, unit = np.concatenate([np.zeros(0), *(m for m, _ in found)]), [u for _, us in found for u in us]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(unit, pa.string()), pa.array(margin)], names=["doc_id", "toxic", "unit", "margin"])

    return sorted(tuple(r) for r in sample.mapInArrow(lean(run), "doc_id long, toxic int, unit string, margin double").collect())


def beginnings(sample: DataFrame, landmarks: list[str]) -> list[tuple[int, int, str, str]]:
    """(doc_id, toxic, landmark, unit) of the distinct units of each text that begin with a landmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sizes = set(landmarks), sorted({len(x) for x in landmarks})
        for batch in batches:
            found = []
            for r in range(batch.num_rows):
                letters, bounds, _, _ = units_of(batch.column(1).slice(r, 1))
                text = letters.astype(np.uint32).tobytes().decode("utf-32-le")
                units = {"^" + text[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())}
                found += [(batch.column(0)[r].as_py(), batch.column(2)[r].as_py(), u[:k], u[1:]) for u in units for k in sizes if k <= len(u) and u[:k] in own]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "toxic", "landmark", "unit"), x)) for x in found], schema=pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("landmark", pa.string()), ("unit", pa.string())]))

    return sorted(tuple(r) for r in sample.mapInArrow(lean(run), "doc_id long, toxic int, landmark string, unit string").collect())


def telling_landmarks(found: list[tuple[int, int, str, str]], toxic_docs: int, clean_weight: float) -> list[str]:
    """Landmarks that tell by themselves (TELLING, PURE), then, one by one, those that add most toxic texts
    less PURE times the clean ones that have it, until one would add less than a hundredth of the toxic texts."""
    has: dict[str, tuple[set, set]] = {}
    for doc, toxic, landmark, _ in found:
        has.setdefault(landmark, (set(), set()))[0 if toxic else 1].add(doc)
    kept: list[str] = []
    for landmark, (toxic, clean) in sorted(has.items()):
        if len(toxic) >= max(2, TELLING * toxic_docs) and len(toxic) >= PURE * clean_weight * len(clean):
            kept.append(landmark)
    met = {doc for x in kept for doc in has[x][0]}
    while rest := [x for x in sorted(has) if x not in kept]:
        gain = lambda x: len(has[x][0] - met) - PURE * clean_weight * len(has[x][1])
        best = max(rest, key=gain)
        if gain(best) < max(2, toxic_docs / 100):
            break
        kept.append(best)
        met |= has[best][0]
    return kept


def virtual(unit: str, known: str) -> list[str]:
    """The unit with letters put in: at one joint, at two, and at each joint another; the places and the
    letters follow from the unit by its CRC."""
    if len(unit) < ORDER + 1:
        return []
    seed = crc32(unit.encode())
    letter = lambda i: known[(seed >> 3) * (2 * i + 1) % len(known)]
    joints = range(1, len(unit))
    at, to = seed % len(joints), (seed >> 8) % len(joints)
    stuffed = [{at}, {at, to}, set(range(len(joints)))]
    return ["".join(c + (letter(i) if i in s and i < len(joints) else "") for i, c in enumerate(unit)) for s in stuffed]


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the labelled rows that aren't held out; None if only one label occurs."""
    found = sample_of(docs, labels)
    if found is None:
        return None
    sample, clean_weight = found
    # dealt anew: few files may hold all of the sample, which is gone over ROUNDS times
    sample = saved(sample.repartition(32, "doc_id"), "labelled")
    landmarks = choose_landmarks(stem_counts(sample))
    if not landmarks:
        return Model(["^" + "?" * 4], np.zeros(1), 0.0, 1.0, -30.0)
    model = Model(landmarks, np.ones(len(landmarks)), 0.0, 1.0, 0.0)
    values, vectors = np.linalg.eigh(model.kernel([x[1:] for x in landmarks]))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    began = beginnings(sample, landmarks)
    toxic_docs = sample.where("toxic = 1").select("doc_id").distinct().count()
    telling = set(telling_landmarks(began, toxic_docs, clean_weight))
    # each toxic text has every unit with a telling beginning as an example; words that many texts have
    # also stand with letters put in, at a weight that all such forms of a word share
    sure = sorted({(doc, unit) for doc, toxic, landmark, unit in began if toxic and landmark in telling})
    covered = {doc for doc, _ in sure}
    often = Counter(unit for _, unit in sure)
    known = "".join(sorted({c for x in landmarks for c in x if c.isalnum()})) or "x"
    stuffed = [(v, n / 3) for unit, n in sorted(often.items()) if n >= max(2, TELLING * toxic_docs) for v in virtual(unit, known)]
    features: dict[str, np.ndarray] = {}

    def seen(units: list[str]) -> np.ndarray:
        """Features of the units; landmarks don't change, so each unit is met once."""
        if new := sorted(set(units) - features.keys()):
            features.update(zip(new, model.kernel(new) @ root))
        return np.stack([features[x] for x in units])

    clean: set[tuple[int, str]] = set()
    for _ in range(ROUNDS):
        rows = most_toxic(sample, model)
        witness = [unit for _, unit in sure] + [unit for doc, toxic, unit, _ in rows if toxic and unit and doc not in covered]
        clean |= {(i, unit) for i, toxic, unit, _ in rows if not toxic}
        examples = [*witness, *(v for v, _ in stuffed), *(unit for _, unit in sorted(clean))]
        y = np.array([1.0] * (len(witness) + len(stuffed)) + [-1.0] * len(clean))
        weight = np.array([1.0] * len(witness) + [w for _, w in stuffed] + [clean_weight] * len(clean))
        w = squared_hinge(seen(examples), y, weight)
        model = Model(landmarks, root @ w[:-1], float(w[-1]), 1.0, 0.0)
    rows = most_toxic(sample, model)
    toxic = np.array([r[1] for r in rows], float)
    slope, offset = logistic(np.array([r[3] for r in rows]), toxic, np.where(toxic == 1, 1.0, clean_weight))
    return Model(landmarks, model.plane, model.bias, slope, offset)


RESULT = "doc_id long, held_out boolean, score double, predicted int"


def scored(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    fixed = (model.landmarks, model.plane, model.bias, model.slope, model.offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept_model(*fixed)
        for batch in batches:
            score = own.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(lean(run), RESULT)


_models: dict[bytes, Model] = {}


def kept_model(landmarks, plane, *rest) -> Model:
    """The model, once a worker."""
    key = repr((landmarks, plane.tobytes(), rest)).encode()
    if key not in _models:
        _models.clear()
        _models[key] = Model(landmarks, plane, *rest)
    return _models[key]


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
