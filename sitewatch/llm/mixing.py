"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a keyed hash and laid end to end, again and again up to
REPEATS times. A document's virtual finish time is its source's words up to its end divided by the
source's target; the mix is the order of finish times, cut where its words reach the budget. mixed()
gives it in this order by a global range sort; for shares() only the range of finish times in which
the cut falls is sorted.

Sizes are runs of other than ASCII white space. Sources by code point, null last, weigh 5, 2, 1 and
again; a target above REPEATS times its source's size stops there and its excess is shared anew.

Defined cases: null text has size 0; null source is a source of its own; null doc_id is a value like
others; repeated rows count as often as they stand; an empty table, or one without words, takes
nothing, and documents without words aren't in the mix; other columns, whatever they are called, are
carried by mixed() and ignored by shares().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, running_sum, saved

WEIGHTS, REPEATS, SEED = (5, 2, 1), 3, "mix-1"
#: Rows that a range of the shuffle, and one of finish times, holds about.
ROWS_PER_BUCKET, ROWS_PER_RANGE = 500, 4000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, rank, target: a row for each source.

    Sources reach their limit in the order of limit over weight, so running sums in that order tell
    which do: those whose limit is at most their share of what the earlier ones leave."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long"))
    full = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = F.col("source_size") * REPEATS
    by_limit = Window.orderBy(limit / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.select("source", "source_size", "rank", "weight", F.sum("source_size").over(full).alias("budget"), F.sum("weight").over(full).alias("all"), F.coalesce(F.sum(limit).over(by_limit), F.lit(0)).alias("used"), F.coalesce(F.sum("weight").over(by_limit), F.lit(0)).alias("gone"))
    share = (F.col("weight") * (F.col("budget") - F.col("used"))).cast("double") / (F.col("all") - F.col("gone")).cast("double")
    capped = limit.cast("double") <= share
    # the first source that isn't capped sets the level for all after it
    in_order = Window.orderBy(limit / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, 0)
    level = F.min(F.when(~F.col("capped"), F.struct((limit / F.col("weight")).alias("at"), "rank", (F.col("budget") - F.col("used")).alias("left"), (F.col("all") - F.col("gone")).alias("rest")))).over(in_order)
    sources = sources.withColumn("capped", capped).withColumn("level", level)
    target = F.when(F.col("level").isNull(), limit.cast("double")).otherwise((F.col("weight") * F.col("level.left")).cast("double") / F.col("level.rest").cast("double"))
    return sources.select("source", "source_size", "rank", target.alias("target"), "budget")


def row_of(docs: DataFrame) -> Column:
    """A hash of what makes a document; rows equal in it are the same document again."""
    return F.xxhash64(docs["doc_id"], docs["source"], docs["text"])


def placed(docs: DataFrame) -> tuple[DataFrame, dict | None]:
    """doc_id, row, size, source_size, target, rank, key, total, budget of every document, and the last place
    within the budget."""
    base = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), words(docs["text"]).alias("size"), row_of(docs).alias("row"), F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")).alias("text_md5"))
    base = saved(base.withColumn("key", F.md5(F.concat_ws("|", F.lit(SEED), F.col("doc_id").cast("string"), "text_md5"))).drop("text_md5"), "sizes")
    found = saved(targets(base), "targets")
    n = base.count()
    hex_digits = 1
    while 16**hex_digits * ROWS_PER_BUCKET < n:
        hex_digits += 1
    rows = base.join(F.broadcast(found) if found.count() <= 100_000 else found, base.source.eqNullSafe(found.source)).select("doc_id", "row", "size", "key", "rank", "source_size", "target", "budget")
    rows = rows.withColumn("bucket", F.substring("key", 1, hex_digits))
    rows = saved(running_sum(rows, ["rank"], ["key", "size"], "bucket", "size", "total").drop("bucket"), "shuffled")
    return rows, cut_of(rows, max(1, n // ROWS_PER_RANGE))


def within(epoch: Column, cut: dict) -> Column:
    return place(epoch) <= F.struct(*[F.lit(cut[c]).cast(k) for c, k in PLACE])


def shares(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, times, taken of every document."""
    rows, cut = placed(docs)
    times = F.lit(0) if cut is None else sum(F.when(within(F.lit(e), cut) & (F.col("size") > 0), 1).otherwise(0) for e in range(REPEATS))
    return rows.select("doc_id", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).cast("long").alias("taken"))


PLACE = (("finish", "double"), ("rank", "int"), ("epoch", "int"), ("key", "string"), ("size", "long"))


def place(epoch: Column) -> Column:
    """Where a document's repeat number `epoch` stands in the mix."""
    finish = F.when(F.col("target") > 0, (F.col("total") + epoch.cast("long") * F.col("source_size")).cast("double") / F.col("target")).otherwise(F.lit(float("inf")))
    return F.struct(finish.alias("finish"), F.col("rank").cast("int").alias("rank"), epoch.cast("int").alias("epoch"), F.col("key").alias("key"), F.col("size").alias("size"))


def cut_of(rows: DataFrame, ranges: int):
    """The last place that is within the budget, or None. Up to the time at which a source runs out
    the words per unit of finish time are the same all along, so ranges of equal width are even."""
    events = rows.select("budget", F.explode(F.array(*[place(F.lit(e)) for e in range(REPEATS)])).alias("p")).where(F.col("p.finish") <= 3.0)
    events = events.withColumn("range", F.floor(F.col("p.finish") * ranges))
    totals = events.groupBy("range").agg(F.sum("p.size").alias("t"), F.first("budget").alias("budget"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("t").over(before), F.lit(0)))
    here = totals.where(F.col("before") <= F.col("budget")).orderBy(F.desc("range")).first()
    if here is None:
        return None
    order = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    within = events.where(F.col("range") == here["range"]).withColumn("sum", F.sum("p.size").over(order) + F.lit(here["before"]))
    last = within.where(F.col("sum") <= F.col("budget")).agg(F.max("p").alias("p")).first()["p"]
    return last or {"finish": here["range"] / ranges, "rank": -1, "epoch": -1, "key": "", "size": -1}


def mixed(docs: DataFrame) -> DataFrame:
    """The mix: docs with each row as often as it is taken, in the order of finish times over all sources."""
    rows, cut = placed(docs)
    if cut is None:
        return docs.limit(0)
    taken = rows.where("size > 0").select("row", F.explode(F.array(*[F.when(within(F.lit(e), cut), place(F.lit(e))) for e in range(REPEATS)])).alias("at")).where("at IS NOT NULL")
    # equal rows are one document here, which the places of all of them find
    whole = docs.select(row_of(docs).alias("m_row"), F.struct(*[docs[c] for c in docs.columns]).alias("m_doc")).dropDuplicates(["m_row"])
    out = whole.join(taken, F.col("m_row") == F.col("row")).orderBy("at", "m_row")
    return out.select(*[F.col("m_doc")[c].alias(c) for c in docs.columns])


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
