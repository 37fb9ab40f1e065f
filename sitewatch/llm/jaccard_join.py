"""N-gram Jaccard join by a token-group matrix.

A document's set holds its distinct shingles of five words. Documents link when
100 * intersection >= 80 * union; the join gives each document's component and no list of pairs.

1. Documents with equal sets are one node. Shingles are ordered from rare to frequent by a sketch of
   counts over all documents (the order decides speed, never the result).
2. Two linked nodes share asked(n) shingles (or all they need, if fewer), n being the smaller size,
   among the first n - ceil(0.8 n) + asked(n) of each; a node that shares fewer with all others together
   has no link and is done with. By these shingles, nodes that share most with the same least node are one group,
   split into blocks of bounded size, each with that least node as pivot. Blocks are opened: all their
   pairs are measured at once.
3. The matrix keeps each block's union of such shingles. Block pairs that share so many, and that
   aren't one component already, are bounded (a member's shingles found in the other's union) and opened.
   So no link between different sets is lost, and pairs inside what is linked already are spared.
   Blocks that lie in one component are met as one first, so their own pairs never come up.

Defined cases: null or wordless text has no shingles, links with nothing and is its own component;
texts of fewer than five words have their whole sequence as the one shingle; rows that repeat a
doc_id are each kept; null doc_id never names a component unless all its documents lack one; an empty
table gives no row; other columns are ignored, whatever they are called. Shingles are compared by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, connected_components, filter_place, id_filter, in_filter, lean, mix, prefix_sums, saved, stretch_hashes, utf8

#: asked(n) is SHARED and one more for every EACH shingles, for some dozen of a long text's are in others by chance.
SHINGLE, PERCENT, SHARED, EACH = 5, 80, 8, 100
#: Counters of the sketch, as many as the texts have shingles (BYTES a shingle, about) but within these
#: bounds; a byte each while counted, half a byte each once broadcast, so 32 MB at most. Documents of a block at most.
FEWEST, MOST, BYTES, SLICES, BLOCK = 1 << 20, 1 << 26, 8, 64, 256
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_places = [int(x) | 1 for x in mix(np.arange(1, SHINGLE + 1, dtype=np.uint64))]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the rows, A-Z lowered, and where each row's words begin."""
    data = _fold[raw]
    word = np.ones(len(data) + 1, bool)
    word[:-1] = (data != 32) & ((data < 9) | (data > 13))
    word[-1] = False
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]])
    begins, ends = np.flatnonzero(word & (~before | edge)), np.flatnonzero(before & (~word | edge))
    return stretch_hashes(prefix_sums(data), begins, ends), np.searchsorted(begins, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    words, starts = word_hashes(raw, offsets)
    n = len(words)
    rolling = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        rolling[: n - j] += words[j:] * np.uint64(_places[j % SHINGLE])
    rolling = mix(rolling)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(rolling[a : b - k + 1]))
        elif b > a:
            whole = sum(int(w) * p for w, p in zip(words[a:b].tolist(), _places)) + (b - a)
            out.append(mix(np.array([whole % 2**64], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> int:
    """A hash of a whole set; 0 has no shingles."""
    if not len(s):
        return 0
    return int(mix(np.array([int(s.sum(dtype=np.uint64)) ^ int(np.bitwise_xor.reduce(mix(s + np.uint64(1))))], np.uint64)).view(np.int64)[0]) or 1


def sets_of(batch: pa.RecordBatch, column: int):
    """(row, set) of a batch, half a MB of text at a time."""
    raw, offsets = utf8(batch.column(column))
    for i, j in blocks(offsets, 1 << 19):
        yield from zip(range(i, j), shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))


def counters_for(docs: DataFrame) -> int:
    """Counters of the sketch: a power of two that grows with the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST, max(FEWEST, 1 << (size // BYTES).bit_length()))


def counted(counts: np.ndarray, held: list[np.ndarray]) -> None:
    """Adds the shingles to the counters, which stop at 255 in a task."""
    at, n = np.unique(np.concatenate(held) % np.uint64(len(counts)), return_counts=True)
    at = at.astype(np.int64)
    counts[at] = np.minimum(counts[at] + n, 255)


def packed_counts(counts: np.ndarray) -> bytes:
    """Counters as the gaps between those that aren't 0, a byte place at a time, and their counts: half the
    room of the counters themselves, compressed either way."""
    at = np.flatnonzero(counts)
    gaps = np.diff(at, prepend=-1).astype("<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.compress(gaps.T.tobytes() + counts[at].tobytes())


def unpacked_counts(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of the counters that aren't 0."""
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(5, -1)
    return np.cumsum(np.ascontiguousarray(planes[:4].T).view("<u4").ravel(), dtype=np.int64) - 1, planes[4]


def measured(docs: DataFrame, counters: int) -> DataFrame:
    """doc_id, key, n, node of every document (doc_id, text, key), and (slice, counts) of the sketch, one
    set for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, np.uint8)
        for batch in batches:
            n, node, held, size = [], [], [], 0
            for _, s in sets_of(batch, 1):
                n.append(len(s))
                node.append(node_of(s))
                held.append(s)
                if (size := size + len(s)) > 1 << 20:
                    counted(counts, held)
                    held, size = [], 0
            if size:
                counted(counts, held)
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=["doc_id", "key", "n", "node", "slice", "counts"])
        none = pa.nulls(1, pa.int64())
        for k, part in enumerate(np.split(counts, SLICES) if counts.any() else []):
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([k], pa.int32()), pa.array([packed_counts(part)], pa.binary())], names=["doc_id", "key", "n", "node", "slice", "counts"])

    return docs.mapInArrow(lean(run), "doc_id long, key long, n long, node long, slice int, counts binary")


def frequency_classes(sketch: DataFrame, counters: int) -> np.ndarray:
    """Per counter a class of its total, two to a byte: the binary logarithm, in twos from 2 ** 8 on."""

    def add(at: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters // SLICES, np.uint32)
        for part in parts:
            for x in part.column(1):
                places, n = unpacked_counts(x.as_py())
                total[places] += n
        log = np.frexp(total.astype(np.float64))[1]
        log = np.minimum(15, np.where(log > 8, 8 + (log - 8) // 2, log)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([at[0].as_py()], pa.int32()), pa.array([zstandard.compress((log[::2] | log[1::2] << 4).tobytes())], pa.binary())], names=["slice", "classes"])

    out = np.zeros((SLICES, counters // SLICES // 2), np.uint8)
    for row in sketch.groupBy("slice").applyInArrow(add, "slice int, classes binary").collect():
        out[row["slice"]] = np.frombuffer(zstandard.decompress(row["classes"]), np.uint8)
    return out.reshape(-1)


def ranks(classes: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The frequency class of each shingle."""
    at = (s % np.uint64(2 * len(classes))).astype(np.int64)
    return classes[at >> 1] >> ((at & 1) << 2).astype(np.uint8) & 15


def needed(n: int) -> int:
    """Least intersection that a set of n shingles has with any set it links with."""
    return -(-PERCENT * n // 100)


def asked(n: int) -> int:
    """Of the rarest shingles of two linked sets so many at least are common, n being the smaller size, or all they need."""
    return SHARED + n // EACH


def prefixes(docs: DataFrame, classes) -> DataFrame:
    """(token, node): the rarest shingles of every set. Two linked sets have asked(n) of them in common,
    n being the smaller size, or as many as they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = classes.value
        for batch in batches:
            tokens, nodes, lengths = [], [], []
            for _, s in sets_of(batch, 1):
                if (n := len(s)) == 0:
                    continue
                p = min(n, n - needed(n) + asked(n))
                key = (ranks(rank, s).astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6))
                tokens.append(s[np.argpartition(key, p - 1)[:p]] if p < n else s)
                nodes.append(node_of(s))
                lengths.append(p if p < n else n)
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), lengths))], names=["token", "node"])

    return docs.mapInArrow(lean(run), "token long, node long")


def filtered(docs: DataFrame, bits) -> DataFrame:
    """(key, packed) of the rows of docs (text, key) whose key passes the filter: texts compressed, as they
    travel twice, and rows that a task meets again left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, met = zstandard.ZstdCompressor(level=3), np.zeros(0, np.int64)
        for batch in batches:
            passing = batch.filter(pa.array(in_filter(bits.value, batch.column(2).to_numpy())))
            keys, first = np.unique(passing.column(1).to_numpy(), return_index=True)
            first = np.sort(first[~np.isin(keys, met)])
            met = np.union1d(met, keys)
            for i in range(0, len(first), 500):
                part = passing.take(pa.array(first[i : i + 500]))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([squeeze.compress(t or b"") for t in part.column(0).cast(pa.binary()).to_pylist()], pa.binary())], names=["key", "packed"])

    return docs.select("text", "key", filter_place("key").alias("place")).mapInArrow(lean(run), "key long, packed binary")


def links_within(sets: list[np.ndarray], side: np.ndarray, roots: list[int]) -> list[tuple[int, int]]:
    """Links that span what is linked among the sets, of different sides unless all have the same;
    those with equal roots count as linked. Intersections of all pairs come from one product of
    matrices over the union of the tokens, some thousand tokens at a time."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    union, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(m), sizes)
    two = side.min() != side.max()
    if two:
        # the bound: what of a member is in the other side's union
        where = [np.bincount(inverse[side[rows] == k], minlength=len(union)) > 0 for k in (0, 1)]
        inside = np.bincount(rows, weights=np.where(side[rows] == 0, where[1][inverse], where[0][inverse]), minlength=m)
        keep = np.flatnonzero(100 * inside >= PERCENT * sizes)
        if len(set(side[keep].tolist())) < 2:
            return []
    else:
        keep = np.arange(m)
    kept = np.isin(rows, keep)
    rows, inverse = np.searchsorted(keep, rows[kept]), inverse[kept]
    # tokens of one set alone are in no intersection
    often = np.bincount(inverse, minlength=len(union)) > 1
    kept = often[inverse]
    rows, inverse = rows[kept], (np.cumsum(often) - 1)[inverse[kept]]
    common = np.zeros((len(keep), len(keep)), np.float32)
    order = np.argsort(inverse, kind="stable")
    rows, inverse = rows[order], inverse[order]
    step = 1 << 12
    for low in range(0, int(often.sum()), step):
        i, j = np.searchsorted(inverse, (low, low + step))
        part = np.zeros((len(keep), step), np.float32)
        part[rows[i:j], inverse[i:j] - low] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    size = sizes[keep]
    linked = np.triu(100 * common >= PERCENT * (size[:, None] + size[None, :] - common), 1)
    if two:
        linked &= side[keep][:, None] != side[keep][None, :]
    head = {r: r for r in roots}

    def find(x):
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
        i, j = int(keep[i]), int(keep[j])
        a, b = find(roots[i]), find(roots[j])
        if a != b:
            head[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def opened(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) among the nodes of each pair of blocks: pairs has (pair, side, node, root, key), key
    that of a text with that node. Texts travel, as they take less room than their hashes."""
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(pairs.select("key"), "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        expand, pair, links = zstandard.ZstdDecompressor(), None, []

        def close():
            rows = list(held.values())
            found = links_within([x[3] for x in rows], np.array([x[1] for x in rows]), [x[2] for x in rows]) if len(rows) > 1 else []
            links.extend((rows[i][0], rows[j][0]) for i, j in found)
            held.clear()

        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch = whole.slice(k, 200)
                at, side, node, root = (batch.column(i).to_pylist() for i in range(4))
                texts = pa.RecordBatch.from_arrays([pa.array([expand.decompress(x) for x in batch.column(4).to_pylist()], pa.large_binary())], names=["text"])
                for i, s in sets_of(texts, 0):
                    if at[i] != pair:
                        close()
                        pair = at[i]
                    held[node[i]] = (node[i], side[i], root[i], s)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
                    links = []
        close()
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = pairs.join(filtered(docs, bits), "key").select("pair", "side", "node", "root", "packed")
    return rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(lean(run), "a long, b long")


def met_pairs(matrix: DataFrame, by: str) -> DataFrame:
    """(by, o_by): pairs of groups of the matrix (token, by, n_low, n_high) that share so many tokens of sets
    of like size that members may link."""
    other = matrix.select([F.col(c).alias(f"o_{c}") for c in matrix.columns])
    alike = (F.col("n_high") * 100 >= F.col("o_n_low") * PERCENT) & (F.col("o_n_high") * 100 >= F.col("n_low") * PERCENT)
    met = matrix.join(other, (F.col("token") == F.col("o_token")) & (F.col(by) < F.col(f"o_{by}")) & alike)
    met = met.groupBy(by, f"o_{by}").agg(F.count("*").alias("c"), F.min(F.least("n_low", "o_n_low")).alias("n"))
    return met.where(enough(F.col("c"), F.col("n"))).select(by, f"o_{by}")


def enough(shared: Column, n: Column) -> Column:
    """Whether so many shared prefix shingles may be a link of two sets of n or more."""
    return shared >= F.least(F.lit(SHARED) + F.floor(n / EACH), F.ceil(n * PERCENT / 100))


def block_pairs(matrix: DataFrame) -> DataFrame:
    """(block, o_block) to open: matrix has (token, block, cls, n_low, n_high) of tokens of several classes,
    blocks of one class being in one component as a whole.

    Classes meet first, a row for each token and class however many blocks it has; then the blocks of
    those that met, by token and pair of classes."""
    classes = saved(matrix.groupBy("token", "cls").agg(F.min("n_low").alias("n_low"), F.max("n_high").alias("n_high")), "classes")
    met = saved(met_pairs(classes, "cls"), "classes-met")
    a = matrix.join(met, "cls").select("token", "cls", "o_cls", "block", "n_low", "n_high")
    b = matrix.select(F.col("token").alias("t"), F.col("cls").alias("k"), F.col("block").alias("o_block"), F.col("n_low").alias("o_n_low"), F.col("n_high").alias("o_n_high"))
    alike = (F.col("n_high") * 100 >= F.col("o_n_low") * PERCENT) & (F.col("o_n_high") * 100 >= F.col("n_low") * PERCENT)
    both = a.join(b, (F.col("token") == F.col("t")) & (F.col("o_cls") == F.col("k")) & alike)
    both = both.groupBy("block", "o_block").agg(F.count("*").alias("c"), F.min(F.least("n_low", "o_n_low")).alias("n"))
    return both.where(enough(F.col("c"), F.col("n"))).select("block", "o_block")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    counters = counters_for(docs)
    first = saved(measured(docs, counters), "sets")
    rows = first.where("slice is null").select("doc_id", "key", "n", "node")
    classes = spark.sparkContext.broadcast(frequency_classes(first.where("slice is not null").select("slice", "counts"), counters))

    one_of = saved(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.min("n").alias("n")), "nodes")

    token = Window.partitionBy("token")
    shared = prefixes(docs, classes).withColumn("least", F.min("node").over(token)).withColumn("most", F.max("node").over(token)).where("least <> most").drop("most").distinct()
    shared = saved(shared, "prefixes")
    # a row for each node; those that share too little with all others together, of four fifths of their size or more, have no link
    shared = shared.repartition("node").groupBy("node").agg(F.collect_list("token").alias("tokens"), F.collect_list("least").alias("leasts"))
    shared = saved(shared.join(one_of.select("node", "n"), "node").where(enough(F.size("tokens"), F.ceil(F.col("n") * PERCENT / 100))), "linkable")
    # the node that a node shares most of its rare shingles with, of those that come first in theirs
    follows = shared.select("node", F.explode("leasts").alias("least")).where("least <> node").groupBy("node", "least").agg(F.count("*").alias("c"))
    follows = follows.groupBy("node").agg(F.max(F.struct("c", "least")).alias("x")).select("node", F.col("x.least").alias("pivot"))
    members = shared.select("node").join(follows, "node", "left").select("node", F.coalesce("pivot", "node").alias("pivot"))
    parts = members.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    members = saved(members.join(parts, "pivot").select("node", "pivot", F.xxhash64("pivot", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block")), "blocks")

    blocked = saved(one_of.select("node", "key").join(members.select("node").union(members.select("pivot")).distinct(), "node", "left_semi"), "blocked")

    within = members.select(F.col("block").alias("pair"), F.lit(0).alias("side"), "node").union(members.select("block", F.lit(0), "pivot")).distinct()
    # a block of one node has no pair
    several = within.groupBy("pair").agg(F.count("*").alias("c")).where("c > 1").select("pair")
    within = within.join(several, "pair", "left_semi").withColumn("root", F.col("node"))
    links = saved(opened(within.join(blocked, "node"), docs), "links")
    roots = connected_components(links)

    # the matrix: each block's shingles, and the component it is all in
    # (members of the pivot's component stand apart from the block's others, for most are done with)
    pivots = roots.select(F.col("node").alias("pivot"), F.col("root").alias("p_root"))
    placed = members.join(roots, "node", "left").join(pivots, "pivot", "left").withColumn("root", F.coalesce("root", "node"))
    placed = saved(placed.select("node", F.xxhash64("block", F.col("root").eqNullSafe(F.col("p_root"))).alias("block"), "root"), "placed")
    whole = placed.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    whole = whole.select("block", F.when(F.col("low") == F.col("high"), F.xxhash64(F.lit("root"), "low")).otherwise(F.col("block")).alias("cls"))
    matrix = shared.select("node", "n", "tokens").join(placed.join(whole, "block").select("node", "block", "cls"), "node")
    matrix = matrix.select(F.explode("tokens").alias("token"), "block", "cls", "n").repartition("token").groupBy("token", "block", "cls").agg(F.min("n").alias("n_low"), F.max("n").alias("n_high"))
    # a shingle of one class alone makes no pair
    matrix = saved(matrix.withColumn("first", F.min("cls").over(token)).withColumn("last", F.max("cls").over(token)).where("first <> last").drop("first", "last"), "matrix")
    pairs = saved(block_pairs(matrix), "pairs").withColumn("pair", F.xxhash64("block", "o_block"))
    across = pairs.select("pair", F.lit(0).alias("side"), "block").union(pairs.select("pair", F.lit(1), "o_block")).join(placed, "block").select("pair", "side", "node", "root")
    more = opened(across.join(blocked, "node"), docs)
    final = connected_components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(more)) if not pairs.isEmpty() else roots

    smallest = one_of.join(final, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    names = smallest.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = smallest.join(names, "root").select(F.col("node").alias("c_node"), "component_id")
    out = rows.join(named, F.col("node") == F.col("c_node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
