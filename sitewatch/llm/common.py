"""Helpers that several operators share: the shared folder, files, Arrow text, running sums."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch on its way to a Python worker, about; a longer text is alone in one.
ARROW_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the session has a bound of its own: by rows alone, long texts
    make batches of any size, held several times over in the JVM and in Python."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, giving memory it no longer needs back to the system at its end: a worker waits
    for its next task, beside others, with what it last took."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library than glibc
            pass

    return whole


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where it is unset
    (local mode, tests) a new temporary folder is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sitewatch-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; nothing is made there yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage ends here, and the
    files outlive any executor."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the files of a saved() table that nothing reads any more, as each round of a loop leaves one."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.saved_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a URI as Spark writes it (file:/x as well as file:///x)."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that appears under its name when it is whole. A task that runs twice writes the same
    bytes, so either attempt may win."""

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.tmp, compression=None)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.tmp, self.path)
        else:
            self.fs.delete_file(self.tmp)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int):
    """Runs of whole rows (first, past) of about `size` bytes each; a longer row is alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def cut_points(df: DataFrame, column: str, parts: int) -> list[int]:
    """Up to parts - 1 ascending values that deal the rows by `column` into ranges of like size."""
    if parts < 2:
        return []
    found = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"]
    return sorted(set(found or []))


def range_of(column: Column, cuts: list[int]) -> Column:
    """The range (0 to len(cuts)) of a value: how many cut points are at or below it; null is in 0."""
    if not cuts:
        return F.lit(0)
    tree = lambda lo, hi: F.lit(lo) if lo == hi else F.when(column >= F.lit(cuts[(lo + hi) // 2]), tree((lo + hi) // 2 + 1, hi)).otherwise(tree(lo, (lo + hi) // 2))
    return tree(0, len(cuts))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running_sum(df: DataFrame, keys: list[str], order: list[str], bucket: str, size: str, out: str) -> DataFrame:
    """`out`: the sum of `size` over the rows of the same `keys` up to this one by (bucket, order).

    A window over (keys, bucket) adds within a bucket, and the buckets' totals, few and small, are
    added up on their own; so no key's rows meet in one task however many it has."""
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bucket).agg(F.sum(size).alias("_t")).withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    totals = totals.select(*[F.col(k).alias(f"_at_{k}") for k in (*keys, bucket)], "_before")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in (*keys, bucket)])
    joined = df.join(totals, same).select(*df.columns, "_before")
    return joined.withColumn(out, F.sum(size).over(within) + F.col("_before")).drop("_before")


BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64 for i below n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"], _powers["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE ** place up to each place, from which any stretch's hash follows."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][: len(data)], out=sums[1:])
    return sums


def stretch_hashes(sums: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each stretch, wherever it stands."""
    return mix((sums[ends] - sums[begins]) * powers(len(sums))[1][begins] + (ends - begins).astype(np.uint64))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), longs; root is its component's least node.

    Large-star and small-star steps (Kiveris et al. 2014) until the edges stay as they are. A node's
    least neighbour is summed up before the shuffle; the join that follows may split a hot node."""
    edges = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small_least, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).union(small_least.select("m", "b")).where("x <> y")
        old, edges = edges, saved(small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a"), F.col("a"))).groupBy("node").agg(F.min("root").alias("root"))


#: Bits of a filter of ids, 8 MB, made slice by slice.
FILTER_BITS, FILTER_SLICES = 1 << 26, 64


def filter_place(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bit for each hash of the ids: FILTER_BITS bits, whatever the input. What fails it is not among
    them; what passes may be."""
    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(FILTER_BITS // FILTER_SLICES, bool)
        bits[(frame["place"] % (FILTER_BITS // FILTER_SLICES)).to_numpy()] = True
        return pd.DataFrame({"slice": [int(frame["place"].iloc[0] // (FILTER_BITS // FILTER_SLICES))], "bits": [zstandard.compress(np.packbits(bits).tobytes())]})

    out = np.zeros((FILTER_SLICES, FILTER_BITS // FILTER_SLICES // 8), np.uint8)
    places = ids.select(filter_place(column).alias("place")).distinct().withColumn("slice", F.floor(F.col("place") / (FILTER_BITS // FILTER_SLICES)))
    for row in places.groupBy("slice").applyInPandas(gather, "slice long, bits binary").collect():
        out[row["slice"]] = np.frombuffer(zstandard.decompress(row["bits"]), np.uint8)
    return out.reshape(-1)


def in_filter(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


def hash_sample(df: DataFrame, column: str, n: int) -> DataFrame:
    """About n rows of df, those of the least hashes of `column`; only hashes are compared for it, so
    no rows but the sample's leave their place."""
    h = F.xxhash64(column)
    last = df.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return df.limit(0) if last is None else df.where(h <= last).limit(2 * n)
