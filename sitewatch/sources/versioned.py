"""Tables of slices by key under a log of commits, for streams that merge and for rebuilds that replace.

A table at `path` is path/data/<writer>-<uuid>/slice=<n>/ and path/log/<number>.json. A log entry names the folder of
every slice and the last batch of each writer. It is written beside the log and renamed into place after all
slices are written, so a reader, who takes the newest entry, sees all of a batch or nothing of it. The rename
fails where the number is taken: of two writers at once one must begin anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Slices of a table.
SLICES = 64
#: Commits a writer tries before it gives up to others.
TRIES = 10


@dataclass
class Entry:
    """A commit: its number, the folder of each slice that has rows, the columns, the last batch of each writer."""

    number: int = -1
    slices: dict[str, str] = field(default_factory=dict)
    schema: str | None = None
    batches: dict[str, int] = field(default_factory=dict)


class Taken(Exception):
    """Another writer has made the commit of this number."""


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop's objects."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def log(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the commits, ascending."""
    fs, p = hadoop(spark, f"{path}/log")
    if not fs.exists(p):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def entry(spark: SparkSession, path: str, number: int | None = None) -> Entry:
    """The newest commit, or that of a number; an empty one before the first."""
    numbers = log(spark, path)
    if not numbers:
        return Entry()
    fs, p = hadoop(spark, f"{path}/log/{(numbers[-1] if number is None else number):012d}.json")
    stream = fs.open(p)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Entry(**json.loads(text))


def commit(spark: SparkSession, path: str, new: Entry) -> None:
    """Puts a log entry in its place, or raises Taken."""
    jvm = spark.sparkContext._jvm
    fs, temporary = hadoop(spark, f"{path}/log/_{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    try:
        out.write(bytearray(json.dumps(new.__dict__).encode()))
    finally:
        out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/log/{new.number:012d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(fs.makeQualified(temporary), fs.makeQualified(target), options)
    except Py4JJavaError as e:
        fs.delete(temporary, False)
        if "FileAlreadyExists" in str(e.java_exception):
            raise Taken(f"{path}: commit {new.number}") from None
        raise


def rows_of(spark: SparkSession, path: str, of: Entry, slices: list[int] | None = None) -> DataFrame | None:
    """The rows of a commit, of some slices or of all; None where there are none."""
    folders = [f"{path}/{at}" for s, at in sorted(of.slices.items()) if slices is None or int(s) in slices]
    return spark.read.schema(of.schema).parquet(*folders) if folders else None


def current(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of a table as they are now, or were at a commit."""
    of = entry(spark, path, number)
    if of.schema is None:
        raise ValueError(f"nothing has been committed to {path}")
    found = rows_of(spark, path, of)
    return spark.createDataFrame([], of.schema) if found is None else found


def slice_of(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLICES)).cast("int")


def merged(old: DataFrame | None, batch: DataFrame, keys: list[str], newest: list[str], ignore: bool = False) -> DataFrame:
    """old with batch merged in: of each key the row that is last by `newest`; of equals the batch's. With `ignore`
    a key that old has stays as it is. Of equals within a batch the greatest row stays, so a replay chooses alike."""
    rows = batch.withColumn("_batch", F.lit(1))
    if old is not None:
        rows = rows.unionByName(old.withColumn("_batch", F.lit(0)))
    rank = [F.asc("_batch")] if ignore else []
    order = Window.partitionBy(*keys).orderBy(*rank, *[F.desc(c) for c in newest], F.desc("_batch"), *[F.desc(c) for c in batch.columns if c not in (*keys, *newest)])
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_batch").select(*batch.columns)


def committed(spark: SparkSession, path: str, change: Callable[[Entry], tuple[DataFrame, list[int]] | None], keys: list[str], writer: str = "", batch: int | None = None) -> bool:
    """Makes a commit: change(old) gives the new rows of the slices that it names, all of them, or None for nothing to
    do. A batch that the writer has committed already is left alone. Begins anew if another writer was quicker."""
    for _ in range(TRIES):
        old = entry(spark, path)
        if batch is not None and old.batches.get(writer, -1) >= batch:
            return False
        made = change(old)
        if made is None:
            return False
        rows, touched = made
        folder = f"data/{writer or 'w'}-{uuid.uuid4().hex[:16]}"
        rows.withColumn("slice", slice_of(keys)).write.partitionBy("slice").parquet(f"{path}/{folder}")
        fs, p = hadoop(spark, f"{path}/{folder}")
        there = {x.getPath().getName() for x in fs.listStatus(p)} if fs.exists(p) else set()
        slices = {s: at for s, at in old.slices.items() if int(s) not in touched} | {str(s): f"{folder}/slice={s}" for s in touched if f"slice={s}" in there}
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        try:
            commit(spark, path, Entry(old.number + 1, slices, schema, old.batches | ({writer: batch} if batch is not None else {})))
            return True
        except Taken:
            continue
    raise Taken(f"{path}: {TRIES} commits were taken by others")


def merge(path: str, batch: DataFrame, keys: list[str], newest: list[str], ignore: bool = False, writer: str = "", number: int | None = None) -> bool:
    """Merges rows into a table by merged(), in one commit; only the slices that the keys are in are rewritten."""
    spark = batch.sparkSession
    touched = sorted(r[0] for r in batch.select(slice_of(keys)).distinct().collect())  # SLICES at most

    def change(old: Entry):
        if not touched and old.schema is not None:
            return None
        before = rows_of(spark, path, old, touched) if touched else None
        return merged(before, batch, keys, newest, ignore), touched

    return committed(spark, path, change, keys, writer, number)


def merge_sink(path: str, keys: list[str], newest: list[str], ignore: bool = False, writer: str = "stream") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merge() of each micro-batch. A batch that runs again after its commit changes nothing, and one
    that failed before it has left nothing that a reader sees."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()  # its slices are looked up before it is merged
        try:
            merge(path, batch, keys, newest, ignore, writer, number)
        finally:
            batch.unpersist()

    return write


def replace(path: str, gone: Callable[[DataFrame], DataFrame], rows: DataFrame, keys: list[str]) -> bool:
    """Deletes and inserts in one commit: gone(current) are the rows that stay, rows are added. All slices are rewritten."""
    spark = rows.sparkSession

    def change(old: Entry):
        before = rows_of(spark, path, old)
        return (rows if before is None else gone(before).unionByName(rows)), list(range(SLICES))

    return committed(spark, path, change, keys)


def compacted(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Removes all but the last `keep` commits, and the folders that none of those names."""
    numbers = log(spark, path)
    for n in numbers[:-keep]:
        fs, p = hadoop(spark, f"{path}/log/{n:012d}.json")
        fs.delete(p, False)
    used = {at.rsplit("/", 1)[0] for n in numbers[-keep:] for at in entry(spark, path, n).slices.values()}
    kept = {at for n in numbers[-keep:] for at in entry(spark, path, n).slices.values()}
    fs, p = hadoop(spark, f"{path}/data")
    for x in fs.listStatus(p):
        folder = f"data/{x.getPath().getName()}"
        if folder not in used:
            fs.delete(x.getPath(), True)
            continue
        for y in fs.listStatus(x.getPath()):
            if y.getPath().getName().startswith("slice=") and f"{folder}/{y.getPath().getName()}" not in kept:
                fs.delete(y.getPath(), True)
