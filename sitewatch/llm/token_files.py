"""Token-ID files: a zstandard dictionary shared by all documents, each compressed on its own.

write_token_files() tokenizes every document, puts the end id behind it and writes shards in
ascending doc_id order; read_token_files() reads them back. Layout of a shard, little-endian:

    magic "TOKSHRD1" | frames, one per document | index | footer
    index:  per document int64 doc_id, uint8 doc_id-is-null, uint64 end of its frame, uint64 end of its ids
    footer: uint64 place of the index, uint64 documents, uint64 ids, uint8 bytes an id,
            32 bytes SHA-256 of the dictionary, magic

Any document is opened by its index entry alone. The dictionary lies beside the shards and is
named by its hash, so a shard read with another dictionary is refused.

Defined cases: null text is empty (its record is the end id alone); null doc_id sorts first; rows
that repeat a doc_id are all kept, ordered by the checksum of their ids; an empty table gives no
shard and no row; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import AtomicFile, blocks, cut_points, file_system, hash_sample, lean, new_folder, range_of, saved, utf8

MAGIC = b"TOKSHRD1"
INDEX = np.dtype([("doc_id", "<i8"), ("no_id", "u1"), ("frame_end", "<u8"), ("ids_end", "<u8")])
FOOTER = "<QQQB32s8s"
#: Documents whose ids train the dictionary, by the order of a hash of doc_id, and bytes of such a text at
#: most: a bounded sample, on which compression alone depends.
DICTIONARY_DOCS, DICTIONARY_TEXT, DICTIONARY_BYTES = 2000, 1 << 16, 112 * 1024

_encoders: dict[str, Callable[[pa.Array, int], list[np.ndarray]]] = {}


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 characters are
    themselves, the other bytes follow from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and chr(b) not in " \xa0\xad"]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def merged(symbols: list[bytes], order: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """symbols after all merges, the first in `order` first."""
    while len(symbols) > 1:
        best = min(zip(symbols, symbols[1:]), key=lambda pair: order.get(pair, 1 << 60))
        if best not in order:
            break
        out, i = [], 0
        while i < len(symbols):
            if tuple(symbols[i : i + 2]) == best:
                out.append(symbols[i] + symbols[i + 1])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


def piece_encoder(setup: dict):
    """tiktoken's merges for the vocabulary of a tokenizer file, the end of a word written as a line feed
    (no piece has white space), and which ids end a word; None if the file is of another make.

    Merging by the rank of what two symbols make is the same as merging by the file's pairs, if every
    token that merges can reach comes out of its own letters; tokens that don't are left out."""
    import tiktoken

    model, letters = setup["model"], byte_letters()
    suffix = model.get("end_of_word_suffix")
    if model["type"] != "BPE" or not suffix or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
        return None

    def raw(token: str) -> bytes:
        end = token.endswith(suffix)
        return bytes(letters[c] for c in (token[: -len(suffix)] if end else token)) + b"\n" * end

    pairs = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    vocabulary = {raw(t): i for t, i in model["vocab"].items() if t not in {x["content"] for x in setup["added_tokens"]}}
    order = {p: i for i, p in enumerate(pairs)}
    made = [a + b for a, b in pairs]
    ids = [vocabulary.get(x) for x in made]
    if len(set(made)) < len(made) or None in ids or ids != sorted(ids):
        return None
    first = [bytes([b]) for b in range(256)] + [bytes([b, 10]) for b in range(256)]
    if not all(x in vocabulary and vocabulary[x] < ids[0] for x in first) or min(vocabulary[x] for x in first[256:]) < 256:
        return None
    split = lambda t: [bytes([b]) for b in t[:-2]] + [t[-2:]] if t.endswith(b"\n") else [bytes([b]) for b in t]
    ranks = {x: vocabulary[x] for x in first} | {x: i for x, i in zip(made, ids) if x[:-1].find(b"\n") < 0 and merged(split(x), order) == [x]}
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for t, i in ranks.items() if t.endswith(b"\n") and len(t) > 1]] = True
    return tiktoken.Encoding("pieces", pat_str=r"[^\n]*\n", mergeable_ranks=ranks, special_tokens={}), ends


#: Characters whose kind (letter, number, white space) no version of Unicode has changed: Latin, Greek,
#: Cyrillic, marks, general punctuation, kana, the first ideographs, Hangul. Runs with others go whole.
SAFE = "\\x21-\\x7e\\xa1-\\u0377\\u0400-\\u052f\\u2010-\\u2027\\u2030-\\u205e\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3"
#: Bytes of text whose words are encoded together.
BLOCK_BYTES = 1 << 22


def word_encoder(path: str) -> Callable[[pa.Array, int], list[np.ndarray]]:
    """Texts (an Arrow array of strings) to their ids with the tokenizer file at `path`, `end_id` behind each.

    Neither the normalizer nor the pre-tokenizer carries anything across ASCII white space, so
    encoding the space-separated runs one by one gives the ids of the whole text, and each run of a
    block is encoded once. Runs are normalized and taken apart by the file's split pattern; their
    pieces are merged all together. Runs with a special token or rare characters, and files of
    another make, go through the tokenizer whole. One encoder a worker, kept between tasks."""
    if path in _encoders:
        return _encoders[path]
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    setup = json.loads(tokenizer.to_str())
    splits, *more = (setup["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    plain = splits.get("type") == "Split" and splits["invert"] and splits["behavior"] == "Removed" and [(x["type"], x["add_prefix_space"], x["use_regex"]) for x in more] == [("ByteLevel", False, False)]
    made = piece_encoder(setup) if plain and [x["type"] for x in (setup["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] else None

    def whole(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)

    if made is None:

        def encode_whole(texts: pa.Array, end_id: int) -> list[np.ndarray]:
            return [np.append(whole([t or ""])[0], np.uint32(end_id)) for t in texts.to_pylist()]

        return _encoders.setdefault(path, encode_whole)

    merges, ends = made
    line = merges.encode_single_token(b"\n")
    take_apart, normal = regex.compile(splits["pattern"]["Regex"] + "|\n").findall, tokenizer.normalizer.normalize_str
    special = "|".join(re.escape(t["content"]) for t in setup["added_tokens"])
    safe = re.compile(f"[{SAFE}]*").fullmatch
    odd = re.compile(special or "(?!)").search

    def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All runs' ids on end, and where each run's begin and how many they are."""
        kind = pc.if_else(pc.string_is_ascii(texts), 0, 1).to_numpy(zero_copy_only=False).copy()
        if special:
            kind[pc.match_substring_regex(texts, special).to_numpy(zero_copy_only=False)] = 2
        rare = np.flatnonzero(kind == 1)
        others = texts.take(pa.array(rare)).to_pylist()
        kind[[i for i, x in zip(rare.tolist(), others) if not safe(x)]] = 2
        easy, hard, rest = (np.flatnonzero(kind == k) for k in range(3))
        lowered = "\n".join(texts.take(pa.array(easy)).to_pylist()).lower()
        clean = [lowered] if len(easy) else []
        if len(hard):
            clean += normal(" ".join(x for x in others if safe(x) and not odd(x))).split(" ")
        if len(clean) != len(hard) + (len(easy) > 0):
            raise ValueError(f"{len(hard)} runs became {len(clean)}")
        parts = take_apart("\n".join([*clean, ""]))
        ids = merges.encode_to_numpy("\n".join([*parts, ""])) if parts else np.zeros(0, np.uint32)
        # a boundary of runs comes back as two line feeds alone
        lone = ids == line
        nth = np.cumsum(lone)[~lone] // 2
        size = np.zeros(len(texts), np.int64)
        if 2 * (len(easy) + len(hard)) != lone.sum() or ends[ids].sum() + lone.sum() // 2 != len(parts):
            raise ValueError("words and ids don't fit")
        order = np.concatenate([easy, hard, rest])
        size[order[: len(easy) + len(hard)]] = np.bincount(nth, minlength=len(easy) + len(hard))
        more, lengths = whole(texts.take(pa.array(rest)).to_pylist())
        size[rest] = lengths
        begins = np.zeros(len(texts), np.int64)
        begins[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate([ids[~lone], more]), begins, size

    def encode(texts: pa.Array, end_id: int) -> list[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        out: list[np.ndarray] = []
        for i, j in blocks(utf8(texts)[1], BLOCK_BYTES):
            split = pc.ascii_split_whitespace(texts.slice(i, j - i))
            words = split.flatten().dictionary_encode()
            ids, begins, size = runs(words.dictionary)
            at = words.indices.to_numpy(zero_copy_only=False)
            lengths = size[at]
            until = np.concatenate([[0], np.cumsum(lengths)])
            flat = ids[np.repeat(begins[at] - until[:-1], lengths) + np.arange(until[-1])]
            bounds = until[split.offsets.to_numpy() - split.offsets[0].as_py()]
            out += [np.append(flat[a:b], np.uint32(end_id)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return out

    return _encoders.setdefault(path, encode)


def encoded(docs: DataFrame, tokenizer: str, end_id: int, width: int, dictionary: bytes | None) -> DataFrame:
    """doc_id, part and the ids of each document, as `width`-byte integers; compressed if a dictionary is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else None
        for batch in batches:
            for i, j in blocks(utf8(batch.column(2))[1], BLOCK_BYTES):
                part = batch.slice(i, j - i)
                ids = encode(part.column(2), end_id)
                stored = [x.astype(f"<u{width}").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([squeeze.compress(x) for x in stored] if squeeze else stored, pa.binary())],
                    names=["part", "doc_id", "n", "crc", "ids"],
                )

    return docs.mapInArrow(lean(run), "part int, doc_id long, n long, crc long, ids binary")


def trained(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """A dictionary from at most DICTIONARY_DOCS documents; of raw content if there is too little to train on."""
    sample = hash_sample(docs.where(F.octet_length("text").isNull() | (F.octet_length("text") <= DICTIONARY_TEXT)), "doc_id", DICTIONARY_DOCS)
    ids = [bytes(r.ids) for r in encoded(sample, tokenizer, end_id, width, None).select("ids").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, ids).as_bytes()
    except zstandard.ZstdError:
        return b"".join(ids)[:DICTIONARY_BYTES].ljust(8, b"\0")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int = 2, docs_per_shard: int = 4000) -> DataFrame:
    """Writes all of docs (doc_id, text) to `folder` and returns its manifest: shard, path, n_docs, n_ids.

    Ids are compressed before the one shuffle. Shards follow ranges of doc_id that cover like many
    rows, so they grow in number, not in size."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = cut_points(docs, "doc_id", max(1, docs.count() // docs_per_shard + 1))
    parts = docs.select(range_of(F.col("doc_id"), cuts).alias("part"), "doc_id", "text")
    dictionary = trained(parts, tokenizer, end_id, width)
    digest = hashlib.sha256(dictionary).digest()
    with AtomicFile(f"{folder}/{digest.hex()}.dict") as out:
        out.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, frames in by_part(batches):
            path = f"{folder}/ids-{part:06d}.tok"
            index: list[tuple] = []
            with AtomicFile(path) as out:
                out.write(MAGIC)
                place = len(MAGIC)
                total = 0
                for doc_id, n, frame in frames:
                    out.write(frame)
                    place, total = place + len(frame), total + n
                    index.append((doc_id or 0, doc_id is None, place, total))
                out.write(np.array(index, INDEX).tobytes())
                out.write(struct.pack(FOOTER, place, len(index), total, width, digest, MAGIC))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(index)], pa.int64()), pa.array([total], pa.int64())], names=["shard", "path", "n_docs", "n_ids"])

    rows = encoded(parts, tokenizer, end_id, width, dictionary).repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "crc", "n")
    return saved(rows.mapInArrow(lean(write), "shard int, path string, n_docs long, n_ids long"), "manifest")


def by_part(batches: Iterator[pa.RecordBatch]):
    """(part, iterator of its rows) from batches sorted by part."""
    rows = ((p, d, n, x) for b in batches for p, d, n, x in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4))))
    row = next(rows, None)
    while row is not None:
        part = row[0]

        def same():
            nonlocal row
            while row is not None and row[0] == part:
                yield row[1:]
                row = next(rows, None)

        yield part, same()


def open_shard(path: str):
    """(index, footer's fields, a function that gives document i's ids) of a shard."""
    store, name = file_system(path)
    file = store.open_input_file(name)
    size = file.size()
    file.seek(size - struct.calcsize(FOOTER))
    place, docs, ids, width, digest, magic = struct.unpack(FOOTER, file.read(struct.calcsize(FOOTER)))
    if magic != MAGIC:
        raise ValueError(f"{path} is no token shard")
    file.seek(place)
    index = np.frombuffer(file.read(docs * INDEX.itemsize), INDEX)
    with store.open_input_file(f"{name.rpartition('/')[0]}/{digest.hex()}.dict") as f:
        dictionary = f.read()
    if hashlib.sha256(dictionary).digest() != digest:
        raise ValueError(f"the dictionary of {path} isn't the one it was written with")
    expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    begins = np.concatenate([[len(MAGIC)], index["frame_end"][:-1]]).astype(np.int64) if docs else np.zeros(0, np.int64)

    def document(i: int) -> np.ndarray:
        file.seek(int(begins[i]))
        return np.frombuffer(expand.decompress(file.read(int(index["frame_end"][i]) - int(begins[i]))), f"<u{width}").astype("<u4")

    return index, (docs, ids, width), document


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document of the manifest's shards, read from the files."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    shards = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, path, start in zip(*(c.to_pylist() for c in batch.columns)):
                index, (docs, _, _), document = open_shard(path)
                ends = index["ids_end"].astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]]) if docs else ends
                for i in range(0, docs, 500):
                    j = min(docs, i + 500)
                    ids = [document(k) for k in range(i, j)]
                    if [len(x) for x in ids] != (ends[i:j] - begins[i:j]).tolist():
                        raise ValueError(f"{path}: the index doesn't fit the frames")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(index["doc_id"][i:j], pa.int64(), mask=index["no_id"][i:j].astype(bool)), pa.array(begins[i:j] + start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return shards.repartitionById(max(1, manifest.count()), "shard").mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids binary")


def crc_of_ids(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "token-files")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return crc_of_ids(read_token_files(write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)))
