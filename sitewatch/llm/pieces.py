"""SentencePiece encoding with seeded merge-dropout, and its lossless decoding.

Merges are taken from an agenda by rank, leftmost first. Each candidate that comes up is skipped if its
draw says so, and comes back only when one of its two symbols has changed. Draws are bits of a hash
keyed by the seed, the document, the unit's place in the document and how many candidates came up
before; so each occurrence of a word has a segmentation of its own, and a seed gives the same ones on
every run. At rate 0 the ids are those of the model itself.

No piece has a space mark behind another character or a line feed inside, so merges never cross
from a unit (a word with the spaces before it) into the next. Of a block of texts, each distinct unit
is merged once without dropout; the occurrences whose draws skip something are merged one by one, all
agendas of a block in step. Characters without a piece, and the space mark itself where a text
contains it, fall back to bytes; thus any text decodes to itself.

Defined cases: null text is empty and has no ids; null doc_id is a value like others; repeated rows
are each kept, and equal in doc_id and text they have equal ids; an empty table gives no row; other
columns are ignored, whatever they are called. Units above LONG characters keep their agenda in a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, lean, mix, utf8

MARK = "▁"
RATE, SEED = 0.1, 17
#: Characters of a unit whose agenda is a row of a table; bytes of text taken at once; rows in step.
LONG, BLOCK_BYTES, ROWS = 64, 1 << 21, 1 << 14
NONE, CANDIDATE, CHAIN = np.int32(2**31 - 1), 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_codecs: dict[tuple, Codec] = {}


def draws(keys: np.ndarray, rate256: int) -> np.ndarray:
    """64 draws for each key, a bit each that is 1 with probability rate256 / 256."""
    out = np.zeros(len(keys), np.uint64)
    for i in range(8):  # from the lowest binary digit of the rate to the highest
        if rate256 >> i & 1 or rate256 & ((1 << i) - 1):
            word = mix(keys + np.uint64((i + 1) * CANDIDATE % 2**64))
            out = out | word if rate256 >> i & 1 else out & word
    return out


def unit_keys(document: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The key of the unit at `place` of a document of key `document`."""
    return mix(document + mix(place.astype(np.uint64) * np.uint64(CHAIN) + np.uint64(1)))


def chained(keys: np.ndarray, n: int) -> np.ndarray:
    """Keys of the draws from 64 * n on."""
    return mix(keys + np.uint64(n * CHAIN % 2**64)) if n else keys


class Codec:
    """Encoder and decoder of a model file at a dropout rate and seed."""

    def __init__(self, path: str, rate: float = RATE, seed: int = SEED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        scores = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in normal}, reverse=True))}
        self.n, self.rate, self.seed = n, round(rate * 256), np.uint64(seed)
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        ids = {names[i]: i for i in normal}
        # what characters are as symbols: a piece, or beyond all pieces what falls back to bytes
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int32)
        for name, i in ids.items():
            if len(name) == 1 and name != MARK:
                self.symbol[ord(name)] = i
        self.symbol[32] = ids[MARK]
        # any two symbols that make a piece may merge: tables by a hash of the pair
        pairs = [(ids[a], ids[b], scores[model.get_score(i)], i) for i in normal for k in range(1, len(names[i])) if (a := names[i][:k]) in ids and (b := names[i][k:]) in ids]
        self.bits = int(np.ceil(np.log2(max(2, len(pairs))))) + 3
        self.pair = np.full(1 << self.bits, -1, np.int64)
        self.rank, self.into = np.full(1 << self.bits, NONE, np.int32), np.zeros(1 << self.bits, np.int32)
        for a, b, rank, i in pairs:
            key = a << 32 | b
            slot = int(self.slots(np.array([key]))[0])
            while self.pair[slot] != -1:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.pair[slot], self.rank[slot], self.into[slot] = key, rank, i
        raw = [bytes(1)] * n
        for i in normal:
            raw[i] = names[i].replace(MARK, " ").encode()
        for b, i in enumerate(self.byte.tolist()):
            raw[i] = bytes([b])
        self.raw_size = np.array([len(x) for x in raw])
        self.raw, self.raw_at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(self.raw_size) - self.raw_size

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The table's slot of each pair; that of a pair which doesn't merge has rank NONE."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self.slots(keys)
        found = self.pair[slot]
        on = np.flatnonzero((found != keys) & (found != -1))
        while len(on):
            slot[on] = (slot[on] + 1) & ((1 << self.bits) - 1)
            found = self.pair[slot[on]]
            on = on[(found != keys[on]) & (found != -1)]
        return slot

    def merged(self, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is left of rows of symbols (each `sizes` long) after all merges, on end; how many a row; and
        how many candidates came up. keys: the rows' keys for their draws, or None for no dropout."""
        m, width = symbols.shape
        rows, ahead = np.arange(m), np.arange(1, width + 1)
        alive = ahead - 1 < sizes[:, None]
        rank = np.full((m, width), NONE, np.int32)
        both = ahead < sizes[:, None]
        r, c = np.nonzero(both)
        slot = self.find(symbols[r, c], symbols[r, c + 1])
        rank[r, c] = self.rank[slot]
        after, before = np.tile(ahead, (m, 1)), np.tile(ahead - 2, (m, 1))
        ups, t, live = np.zeros(m, np.int64), 0, rows
        while len(live):
            part = rank[live] if len(live) < m else rank
            best = part.argmin(1)
            on = part[np.arange(len(live)), best] < NONE
            live, i = live[on], best[on]
            ups[live] += 1
            if keys is not None:
                if t % 64 == 0:
                    mask = draws(chained(keys, t // 64), self.rate)
                skip = (mask[live] >> np.uint64(t % 64)) & np.uint64(1) == 1
                rank[live[skip], i[skip]] = NONE
                a, i = live[~skip], i[~skip]
            else:
                a = live
            t += 1
            if not len(a):
                continue
            j = after[a, i]
            symbols[a, i] = self.into[self.find(symbols[a, i], symbols[a, j])]
            alive[a, j] = False
            rank[a, j] = NONE
            k = after[a, j]
            after[a, i] = k
            more = k < sizes[a]
            before[a[more], k[more]] = i[more]
            rank[a[~more], i[~more]] = NONE
            x, y, z = a[more], i[more], k[more]
            rank[x, y] = self.rank[self.find(symbols[x, y], symbols[x, z])]
            h = before[a, i]
            less = h >= 0
            x, y, z = a[less], h[less], i[less]
            rank[x, y] = self.rank[self.find(symbols[x, y], symbols[x, z])]
        return symbols[alive], alive.sum(1), ups

    def merged_long(self, symbols: np.ndarray, key: np.ndarray | None) -> np.ndarray:
        """merged() for one long row: the agenda is a heap, the symbols a linked list."""
        n = len(symbols)
        value: list[int | None] = symbols.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.rank[self.find(symbols[:-1], symbols[1:])].tolist()
        agenda = [(r, i, value[i], value[i + 1]) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(agenda)
        known: dict[tuple[int, int], tuple[int, int]] = {}
        t, mask = 0, 0
        while agenda:
            _, i, left, right = heapq.heappop(agenda)
            j = after[i]
            if value[i] != left or j >= n or value[j] != right:
                continue
            if key is not None:
                if t % 64 == 0:
                    mask = int(draws(chained(key, t // 64), self.rate)[0])
                t += 1
                if mask >> ((t - 1) % 64) & 1:
                    continue
            value[i], value[j] = int(self.into[self.find(np.array([left]), np.array([right]))[0]]), None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n:
                    pair = (value[a], value[after[a]])
                    if pair not in known:
                        known[pair] = int(self.rank[self.find(np.array([pair[0]]), np.array([pair[1]]))[0]])
                    if known[pair] != NONE:
                        heapq.heappush(agenda, (known[pair], a, *pair))
        return np.array([v for v in value if v is not None], np.int32)

    def all_merged(self, symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols left of the stretches of `symbols`, on end; each stretch's number of them; candidates."""
        count, ups = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        order = np.argsort(sizes, kind="stable")
        out: list[np.ndarray] = [np.zeros(0, np.int32)]
        short = int(np.searchsorted(sizes[order], LONG, "right"))
        a = 0
        while a < short:
            # rows of like length, about ROWS * 16 symbols of them
            b = min(short, a + max(1, ROWS * 16 // int(sizes[order[min(short, a + ROWS) - 1]] + 1)))
            some = order[a:b]
            width = int(sizes[some[-1]])
            at = np.minimum(begins[some][:, None] + np.arange(width), len(symbols) - 1)
            left, count[some], ups[some] = self.merged(symbols[at], sizes[some], None if keys is None else keys[some])
            out.append(left)
            a = b
        for i in order[short:].tolist():
            left = self.merged_long(symbols[begins[i] : begins[i] + sizes[i]], None if keys is None else keys[i : i + 1])
            out.append(left)
            count[i], ups[i] = len(left), 64
        flat, start = np.concatenate(out), np.zeros(len(sizes), np.int64)
        start[order] = np.cumsum(count[order]) - count[order]
        return flat, start, count, ups

    def fallen_back(self, symbols: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same with symbols that are no piece written as the pieces of their bytes."""
        odd = symbols >= self.n
        if not odd.any():
            return symbols, start, count
        which = np.flatnonzero(odd)
        letters, back = np.unique(symbols[which] - self.n, return_inverse=True)
        coded = [self.byte[list(chr(c).encode("utf-8", "surrogatepass"))] for c in letters.tolist()]
        length = np.ones(len(symbols), np.int64)
        length[which] = np.array([len(x) for x in coded])[back]
        until = np.concatenate([[0], np.cumsum(length)])
        out = np.repeat(symbols, length)
        lot, where = np.concatenate(coded), np.cumsum([0, *map(len, coded)])[:-1]
        n = length[which]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(until[which], n) + within] = lot[np.repeat(where[back], n) + within]
        return out, until[start], until[start + count] - until[start]

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of all texts, and where each text's begin; a space goes before each text."""
        none = pa.scalar("", pa.large_string())
        lead = pc.if_else(pc.equal(pc.binary_length(texts), 0), none, pa.scalar(" ", pa.large_string()))
        raw, offsets = utf8(pc.binary_join_element_wise(lead, texts, none))
        n = len(raw)
        space, feed = raw == 32, raw == 10
        new = feed.copy()
        new[1:] |= (space[1:] & ~space[:-1]) | feed[:-1]
        mark = np.flatnonzero((raw[: max(0, n - 2)] == 0xE2) & (raw[1 : max(1, n - 1)] == 0x96) & (raw[2:] == 0x81)) if n > 2 else np.zeros(0, np.int64)
        new[mark] = True
        new[mark[mark + 3 < n] + 3] = True
        new[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        # spaces behind a mark or line feed begin a unit, further ones of the same run don't
        starts = np.flatnonzero(new)
        bounds = np.append(starts, n)
        made = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)])
        return made, np.searchsorted(starts, offsets)

    def encode_block(self, texts: pa.Array, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and where each text's begin and the last one's end."""
        made, first = self.units(texts)
        words = made.dictionary_encode()
        at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        raw, offsets = utf8(words.dictionary)
        letters = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        until = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
        symbols, begins, sizes = self.symbol[letters], until[:-1], np.diff(until)
        flat, start, count, ups = self.all_merged(symbols, begins, sizes, None)
        if self.rate:
            texts_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
            keys = unit_keys(documents[texts_of], np.arange(len(at)) - first[texts_of])
            reach = np.minimum(ups, 64)
            low = np.where(reach >= 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(reach, 63).astype(np.uint64)) - np.uint64(1))
            hit = np.flatnonzero((draws(keys, self.rate) & low[at]) | (sizes[at] > LONG))
            more, m_start, m_count, _ = self.all_merged(symbols, begins[at[hit]], sizes[at[hit]], keys[hit])
            start, count = start[at], count[at]
            start[hit], count[hit] = m_start + len(flat), m_count
            flat = np.concatenate([flat, more])
        else:
            start, count = start[at], count[at]
        flat, start, count = self.fallen_back(flat, start, count)
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.repeat(start - ends[:-1], count) + np.arange(ends[-1])].astype("<u2")
        return ids, ends[first]

    def encode(self, texts: pa.Array, documents: np.ndarray) -> pa.Array:
        """Ids of texts as little-endian uint16 bytes."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        data, sizes = [], []
        for i, j in blocks(utf8(texts)[1], BLOCK_BYTES):
            ids, bounds = self.encode_block(texts.slice(i, j - i), documents[i:j])
            data.append(ids.tobytes())
            sizes.append(np.diff(bounds))
        ends = np.concatenate([[0], *map(np.asarray, sizes)]).cumsum() * 2
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(data))])

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of ids, without the space before each."""
        raw, offsets = utf8(ids)
        out: list[bytes] = []
        for i, j in blocks(offsets, 1 << 20):
            part = raw[offsets[i] : offsets[j]].view("<u2").astype(np.int64)
            size = self.raw_size[part]
            until = np.concatenate([[0], np.cumsum(size)])
            data = self.raw[np.repeat(self.raw_at[part] - until[:-1], size) + np.arange(until[-1])].tobytes()
            bounds = until[(offsets[i : j + 1] - offsets[i]) // 2].tolist()
            out += [data[a + 1 : b] for a, b in zip(bounds[:-1], bounds[1:])]
        return pa.array(out, pa.large_binary()).cast(pa.large_string())


def codec(path: str, rate: float = RATE, seed: int = SEED) -> Codec:
    """One codec a worker for each set of parameters, kept between tasks."""
    key = (path, rate, seed)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def document_key(doc_id: Column, seed: int = SEED) -> Column:
    return F.xxhash64(F.lit(seed), doc_id.cast("long"), doc_id.isNull())


def keyed(docs: DataFrame, seed: int, carry: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), document_key(F.col("doc_id"), seed).alias("document"), *[F.col(c).cast("string").alias(c) for c in carry])


def encoded(docs: DataFrame, path: str, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """doc_id, text and the ids (little-endian uint16) of every document (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, rate, seed)
        for batch in batches:
            for i, j in blocks(utf8(batch.column(1))[1], BLOCK_BYTES):
                part = batch.slice(i, j - i)
                ids = own.encode(part.column(1), part.column(2).to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), ids.cast(pa.binary())], names=["doc_id", "text", "ids"])

    return keyed(docs, seed).mapInArrow(lean(run), "doc_id long, text string, ids binary")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), own.decode(batch.column(1)).cast(pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, rate: float = RATE, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids, the text decoded from them, whether it is the text that went in, and the columns to
    carry along, as texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, rate, seed)
        for batch in batches:
            for i, j in blocks(utf8(batch.column(1))[1], BLOCK_BYTES):
                part = batch.slice(i, j - i)
                ids = own.encode(part.column(1), part.column(2).to_numpy().view(np.uint64)).cast(pa.binary())
                texts = own.decode(ids).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pc.divide(pc.binary_length(ids), 2).cast(pa.int64()), ids, texts, pc.equal(texts, part.column(1)), *part.columns[3:]], names=["doc_id", "n_tokens", "ids", "decoded", "lossless", *carry])

    return keyed(docs, seed, carry).mapInArrow(lean(run), ", ".join(["doc_id long, n_tokens long, ids binary, decoded string, lossless boolean", *[f"{c} string" for c in carry]]))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
    return rows.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), "lossless")
