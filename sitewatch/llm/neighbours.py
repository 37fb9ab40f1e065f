"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search on it.

Equal vectors are one node. The graph begins with neighbours inside cells of random hyperplanes, a
cell of too many nodes being cut across further directions, others in each tree; then each round joins every node's neighbours and
reverse neighbours with their vectors and lets these meet: neighbours of neighbours become neighbours.
Search starts at a query's own node and follows the edges from the best nodes found, until the best
ones lead to nothing better. Scores are computed in double precision from the original vectors.

Every row is indexed. The reverse neighbours that a node takes into a round are its nearest ones, as
the graph's degree is; this bounds a round's work and costs recall alone, which tests measure.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no
part, neither as queries nor as candidates; vectors of another length than most aren't compared; fewer
than k candidates give fewer rows; ties go to the smaller vec_id; rows that repeat a vec_id are one if
their vectors are equal, and otherwise each a candidate; null vec_id takes no part; an empty table gives
no row; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .common import discard, lean, saved

DEGREE, TREES, PER_TREE, CELL, ROUNDS, BEAM, EXPAND, SEED = 32, 8, 12, 256, 20, 96, 80, 7
#: Reverse edges of a node that the search follows at most.
BACK = 64
#: Rounds end at this share of new edges.
FEW = 0.002
#: Directions that large cells of a tree are cut across, and parts of a cut at most.
SPLITS, FAN = 4, 16


def valid(column: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return column.isNotNull() & (F.size(column) > 0) & F.forall(column, finite) & F.exists(column, lambda x: x != 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def packed(vectors: pa.Array) -> np.ndarray:
    """Rows of an Arrow column of equally long lists."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def best_of(edges: DataFrame, k: int, by: str = "src", other: str = "dst") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), other)
    return edges.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def split_cells(dealt: DataFrame) -> DataFrame:
    """(cell, node) of dealt (cell, node, along): a cell above 2 * CELL nodes is cut across a random direction
    of its tree at quantiles of its own nodes, and its parts across further ones. So what is near stays
    together, however dense, and each tree cuts it elsewhere. What no direction tells apart goes by hash."""
    dealt = saved(dealt, "cells")
    parts = F.ceil(F.count("*") / CELL).alias("parts")
    for level in range(SPLITS):
        large = saved(dealt.groupBy("cell").agg(parts).where("parts > 2"), "large")
        if large.isEmpty():
            return dealt.select("cell", "node")
        along = F.col("along")[level]
        cuts = dealt.join(large, "cell").groupBy("cell").agg(F.percentile_approx(along, [i / FAN for i in range(1, FAN)], 1000).alias("cuts"), F.least(F.first("parts"), F.lit(FAN)).alias("parts"))
        slab = F.floor(F.size(F.filter("cuts", lambda c: c < along)) * F.col("parts") / FAN)
        dealt = saved(dealt.join(cuts, "cell", "left").select(F.when(F.col("parts").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.lit(level), slab)).alias("cell"), "node", "along"), "cells")
    sizes = dealt.groupBy("cell").agg(parts)
    return dealt.join(sizes, "cell").select(F.when(F.col("parts") <= 2, F.col("cell")).otherwise(F.xxhash64("cell", F.pmod(F.xxhash64("node", "cell"), F.col("parts")))).alias("cell"), "node")


def first_graph(nodes: DataFrame, n: int, dim: int) -> DataFrame:
    """Edges (src, dst, score) to the nearest nodes in the same cell of any of TREES random cuts."""
    bits = max(0, int(np.ceil(np.log2(max(1, n) / CELL))))
    planes = np.random.default_rng(SEED).standard_normal((TREES, bits, dim))

    ways = np.random.default_rng(SEED + 1).standard_normal((TREES, SPLITS, dim))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = packed(batch.column(1)).astype(np.float64)
            for tree, (p, w) in enumerate(zip(planes, ways)):
                code = ((x @ p.T > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(x), np.int64)
                along = pa.FixedSizeListArray.from_arrays(pa.array((x @ w.T).reshape(-1)), SPLITS).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(code * TREES + tree), batch.column(0), along], names=["cell", "node", "along"])

    dealt = split_cells(nodes.mapInArrow(lean(cells), "cell long, node long, along array<double>")).join(nodes, "node").select("cell", "node", "vec")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in groups(batches):
            s = x @ x.T
            np.fill_diagonal(s, -np.inf)
            k = min(PER_TREE, len(ids) - 1)
            if k > 0:
                at = np.argpartition(-s, k - 1, axis=1)[:, :k]
                yield edges_of(np.repeat(ids, k), ids[at.reshape(-1)], np.take_along_axis(s, at, 1).reshape(-1))

    edges = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(lean(near), "src long, dst long, score double")
    return best_of(edges.dropDuplicates(["src", "dst"]), DEGREE)


def edges_of(src, dst, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(score, pa.float64())], names=["src", "dst", "score"])


def groups(batches: Iterator[pa.RecordBatch], extra: bool = False):
    """(node ids, vectors) of each run of rows (key, node, vec) with the same key; with `extra` also the two
    fields of a fourth column."""
    key, held = None, []

    def made():
        ids = np.concatenate([h[0] for h in held])
        x = np.concatenate([h[1] for h in held]).astype(np.float32)
        return (ids, x, *(np.concatenate([h[2][i] for h in held]) for i in (0, 1))) if extra else (ids, x)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), packed(batch.column(2))
        more = [c.to_numpy(zero_copy_only=False) for c in batch.column(3).flatten()] if extra else []
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and keys[a] != key:
                yield made()
                held = []
            key = keys[a]
            held.append((ids[a:b], x[a:b], [m[a:b] for m in more]))
    if held:
        yield made()


def descend(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """One round over a graph (src, dst, score, new): what meets among a node's neighbours and reverse
    neighbours joins the graph. Pairs that met in an earlier round, both of old edges, don't meet again."""
    reverse = best_of(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score", "new"), DEGREE)
    meets = graph.select("src", "dst", "new").union(reverse.select("src", "dst", "new")).groupBy("src", "dst").agg(F.max("new").alias("new"))
    worst = graph.groupBy("src").agg(F.when(F.count("*") < DEGREE, float("-inf")).otherwise(F.min("score")).alias("worst")).withColumnRenamed("src", "w")
    known = nodes.join(worst, F.col("node") == F.col("w"), "left").select("node", "vec", F.coalesce("worst", F.lit(float("-inf"))).alias("worst"))
    rows = meets.join(known, F.col("dst") == F.col("node")).select("src", "node", "vec", F.struct("worst", "new").alias("more"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, score, n = [], [], [], 0
        for ids, x, worst, new in groups(batches, True):
            if not new.any():
                continue
            s = x @ x.T
            s[~(new[:, None] | new[None, :])] = -np.inf
            np.fill_diagonal(s, -np.inf)
            # no more than DEGREE of a node's can stay in the graph
            k = min(DEGREE, len(ids) - 1)
            if k < 1:
                continue
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
            value = np.take_along_axis(s, at, 1)
            i, j = np.nonzero((value > worst[:, None]) & (value > -np.inf))
            src.append(ids[i])
            dst.append(ids[at[i, j]])
            score.append(value[i, j])
            n += len(i)
            if n > 1_000_000:
                yield best_edges(src, dst, score)
                src, dst, score, n = [], [], [], 0
        if n:
            yield best_edges(src, dst, score)

    met = rows.repartition("src").sortWithinPartitions("src").mapInArrow(lean(meet), "src long, dst long, score double")
    both = graph.withColumn("new", F.lit(False)).union(met.withColumn("new", F.lit(True)))
    return best_of(both.groupBy("src", "dst").agg(F.max("score").alias("score"), F.min("new").alias("new")), DEGREE)


def best_edges(src: list, dst: list, score: list) -> pa.RecordBatch:
    """The distinct edges with the DEGREE best of each node; the others can't stay in the graph."""
    src, dst, score = np.concatenate(src), np.concatenate(dst), np.concatenate(score)
    order = np.lexsort((-score, dst, src))
    src, dst, score = src[order], dst[order], score[order]
    first = np.ones(len(src), bool)
    first[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
    src, dst, score = src[first], dst[first], score[first]
    order = np.lexsort((-score, src))
    src, dst, score = src[order], dst[order], score[order]
    begins = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
    kept = np.arange(len(src)) - np.repeat(begins, np.diff([*begins, len(src)])) < DEGREE
    return edges_of(src[kept], dst[kept], score[kept])


def neighbour_graph(nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Edges (src, dst, score) from each node (node, vec) to about its DEGREE nearest. Rounds end when few
    edges are new, or after `rounds`."""
    n, dim = nodes.count(), (nodes.select(F.size("vec").alias("d")).first() or [1])[0]
    graph = saved(first_graph(nodes, n, dim).withColumn("new", F.lit(True)), "graph")
    for _ in range(rounds):
        old, graph = graph, saved(descend(graph, nodes), "graph")
        discard(old)
        if graph.where("new").count() <= FEW * graph.count():
            break
    return graph.drop("new")


def greedy_search(starts: DataFrame, graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(start, node, score): the best nodes met from each node of starts (start), itself included."""
    # a long vector is near to very many; of those that lead to it the nearest ones are edges of its own
    reverse = best_of(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"), BACK)
    both = saved(graph.select("src", "dst").union(reverse.select("src", "dst")).distinct(), "edges")
    own = starts.join(nodes, F.col("start") == F.col("node")).select("start", F.col("vec").alias("q"))
    beam = saved(own.select("start", F.col("start").alias("node"), dot(F.col("q"), F.col("q")).alias("score"), F.lit(False).alias("done")), "beam")
    width = max(BEAM, 2 * k)
    place = Window.partitionBy("start").orderBy(F.desc("score"), "node")
    while True:
        ranked = beam.withColumn("_r", F.row_number().over(place))
        front = ranked.where(~F.col("done") & (F.col("_r") <= max(EXPAND, k + 1)))
        if front.isEmpty():
            return beam.select("start", "node", "score")
        found = front.join(both, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        found = found.join(beam.select("start", "node"), ["start", "node"], "left_anti")
        found = found.join(nodes, "node").join(own, "start").select("start", "node", dot(F.col("q"), F.col("vec")).alias("score"), F.lit(False).alias("done"))
        kept = ranked.select("start", "node", "score", (F.col("done") | (F.col("_r") <= max(EXPAND, k + 1))).alias("done"))
        old, beam = beam, saved(kept.union(found).withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= width).drop("_r"), "beam")
        discard(old)


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, rounds: int = ROUNDS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, the rows whose vec_id is
    divisible by `every`."""
    kind = embeddings.schema["embedding"].dataType
    exact = kind.simpleString() if isinstance(kind, ArrayType) and isinstance(kind.elementType, (FloatType, DoubleType)) else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(exact).alias("vec")).where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    rows = saved(rows.where(F.size("vec") == sizes["d"]).distinct(), "vectors")
    same = Window.partitionBy("h", "vec").orderBy("vec_id")
    hashed = rows.withColumn("h", F.xxhash64("vec"))
    nodes = saved(hashed.groupBy("h", "vec").agg(F.min("vec_id").alias("first")).select(F.col("h").alias("node"), "vec").groupBy("node").agg(F.first("vec").alias("vec")), "nodes")
    # of equal vectors no query needs more than the k + 1 smallest ids
    members = saved(hashed.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).select(F.col("h").alias("node"), "vec_id"), "members")
    queries = saved(hashed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("h").alias("start")), "queries")
    found = greedy_search(queries.select("start").distinct(), neighbour_graph(nodes, rounds), nodes, k)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = Window.partitionBy("start").orderBy(F.desc("score"), "node")
    found = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= 2 * k).drop("r")
    pairs = queries.join(found, "start").join(members, "node").where("vec_id <> query_id")
    return pairs.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
