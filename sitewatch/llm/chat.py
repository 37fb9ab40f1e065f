"""Chat formatting by token-level assembly.

Each segment, the text of one turn, is encoded by itself, with control strings inside it escaped;
reserved ids that no text can give mark where turns begin and end. The loss mask follows from prefix
sums of segment lengths. A formatted conversation reads

    <s>[INST] text [/INST]  (user; other roles: [INST] <<role>> text [/INST])
    text </s>               (assistant)

where the four control strings, and the marks around a role, are single reserved ids. The escape is a
backslash: one before each backslash of a text or role, and one behind the first character of each control
string and of each << and >> in it. So the formatted text alone gives the turns back.

Defined cases: null text is empty; null role is the role ""; turns go by turn, role, text, null turn
first, and repeated rows are each a turn; null conv_id is a conversation of its own; an empty table
gives the extra conversation alone, or nothing without it; other columns are ignored, whatever they
are called. A conversation may be longer than memory: its segments pass one by one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, saved

CONTROL = ("<s>", "[INST]", "[/INST]", "</s>", "<<", ">>")
#: The first reserved id: the vocabulary file leaves it and all above it free.
RESERVED = 50256
START, INST, END_INST, END, ROLE, END_ROLE = range(RESERVED, RESERVED + 6)
STRINGS = {START: "<s>", INST: "[INST] ", END_INST: " [/INST]", END: " </s>", ROLE: "<<", END_ROLE: ">> "}
_encodings: dict = {}


def escape(text: str) -> str:
    # a control string may begin within another, as in <<s>
    return re.sub("|".join(["\\\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)]), lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    """The text before escape(): a pair of backslashes is one, a single one is none."""
    return re.sub(r"\\(\\?)", r"\1", text)


def encoding(path: str):
    """The tiktoken encoding of a rank file, once a worker."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        _encodings[path] = tiktoken.Encoding("segments", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def segments(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Each turn's ids, in front of and behind its text the reserved ones, and where its loss is:
    conv_id, turn, role, text, ids, lead, tail. Turns are encoded where they lie, before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        for batch in batches:
            conv, turn, role, text = (batch.column(i).to_pylist() for i in range(4))
            ids, lead, tail = [], [], []
            for r, body in zip(role, enc.encode_ordinary_batch([escape(t) for t in text], num_threads=1)):
                if r == "assistant":
                    before, after = [], [END]
                else:
                    before = [START, INST] + ([] if r == "user" else [ROLE, *enc.encode_ordinary(escape(r)), END_ROLE])
                    after = [END_INST]
                ids.append([*before, *body, *after])
                lead.append(len(before))
                tail.append(len(after))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(lead, pa.int32()), pa.array(tail, pa.int32())], names=["conv_id", "turn", "role", "text", "ids", "lead", "tail"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run), "conv_id long, turn long, role string, text string, ids array<int>, lead int, tail int")


def formatted(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """The output: conv_id, place, start, ids, loss_start, loss_end, a row for each segment. A
    conversation's ids are those of its rows by place; places `loss_start` up to `loss_end`, counted
    from the conversation's first id, bear loss."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = segments(conversations, tokenizer).withColumn("place", F.row_number().over(order)).withColumn("end", F.sum(F.size("ids").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("end") - F.size("ids")
    loss = F.col("role") == "assistant"
    return rows.select("conv_id", "place", start.alias("start"), "ids", F.when(loss, start + F.col("lead")).alias("loss_start"), F.when(loss, F.col("end") - F.col("tail")).alias("loss_end"))


def turns_of(ids: list[int], enc) -> tuple[str, str]:
    """(role, text) read back from the ids of a segment."""
    if ids[0] != START:
        return "assistant", unescape(enc.decode(ids[:-1]))
    if ids[2] != ROLE:
        return "user", unescape(enc.decode(ids[2:-1]))
    k = ids.index(END_ROLE)
    return unescape(enc.decode(ids[3:k])), unescape(enc.decode(ids[k + 1 : -1]))


def rendered_length(ids: list[int], enc) -> int:
    """Characters of the formatted text of some ids."""
    n, run = 0, []
    for i in ids:
        if i >= RESERVED:
            n, run = n + len(enc.decode(run)) + len(STRINGS[i]), []
        else:
            run.append(i)
    return n + len(enc.decode(run))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(output: DataFrame, tokenizer: str) -> DataFrame:
    """Per conversation, digests of its turns and of its text under loss, from formatted()'s rows alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        conv, done, n = None, [], 0

        def close():
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), length))

        for batch in batches:
            for conv_id, place, start, ids, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if n == 0 or conv_id != conv:
                    if n:
                        close()
                    conv, n, at, chars, length = conv_id, 0, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                if start != at or place != n + 1:
                    raise ValueError(f"conversation {conv_id} lacks a segment before {place}")
                role, text = turns_of(ids, enc)
                turns.update(f"{role}\n{text}\n".encode())
                if a is not None:
                    under = unescape(enc.decode(ids[a - start : b - start]))
                    loss.update(under.encode())
                    chars += len(under)
                n, at, length = n + 1, at + len(ids), length + rendered_length(ids, enc)
            if len(done) > 500:
                yield digests(done)
                done = []
        if n:
            close()
        if done:
            yield digests(done)

    rows = output.select("conv_id", "place", "start", "ids", "loss_start", "loss_end")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(lean(run), DIGEST)


def digests(done: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*done)), kinds)], names=[c.split()[0] for c in DIGEST.split(", ")])


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return read_back(saved(formatted(given.unionByName(extra), path), "chat"), path)
