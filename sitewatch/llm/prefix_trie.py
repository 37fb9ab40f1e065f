"""The trie of conversations' beginnings, by blocks of turns first and turn by turn only where they part.

A node is a distinct sequence of first turns (role, text); its members are the conversations that begin with
it. Conversations are cut into blocks of BLOCK turns, and a block's end is named by a digest of all up to it:
128 bits, the exclusive or of two hashes of each turn and its place, so that a conversation's blocks need
no chain. Conversations are grouped by block ends. Where a group's followers aren't one and the same block,
the distinct blocks behind it (not the conversations) are refined turn by turn. From where a conversation
is alone in its group on, all its nodes are its own and are written down without any grouping.

What a node's subtree sums up follows from its members. A conversation c is the smallest member of the nodes
on its path from some depth on; let s be the words before that. A node's saved words are then the sum of
s over its members, but for the smallest, less the words before the node for each of them.

Null roles and texts are empty; turns are in order of turn (null first), role and text (its first 64
characters, then a hash); rows without a conv_id belong to no conversation and are left out; repeated rows
are turns of their own; other columns are ignored; no conversations give no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, saved

#: Turns of a block; blocks of a conversation, and turn numbers, that one window orders.
BLOCK, CHAPTER, SPAN = 4, 256, 1024
#: Conversations c - c % FAMILY share their first turns with c; at most HEAD of them.
FAMILY, HEAD = 20, 3
#: Bits of a conv_id within a chunk of ids, which is sorted and joined as one text.
CHUNK_BITS = 12
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(c, i, n, x, y, w): each turn's place from 1 on, how many its conversation has, two hashes of role and
    text, its words. Counted within ranges of turn numbers, whose totals are then added up."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.substring(text, 1, 64).alias("head"), F.xxhash64(role, text).alias("x"), F.xxhash64(F.lit("y"), text, role).alias("y"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("w"))
    rows = rows.withColumn("span", F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(1 << 62))))
    within, one = Window.partitionBy("c", "span").orderBy(F.asc_nulls_first("turn"), "role", "head", "x", "y"), Window.partitionBy("c")
    totals = rows.groupBy("c", "span").agg(F.count("*").alias("k")).withColumns({"n": F.sum("k").over(one), "before": F.coalesce(F.sum("k").over(one.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    ranked = rows.withColumn("r", F.row_number().over(within)).join(totals.drop("k"), ["c", "span"])
    return ranked.select("c", (F.col("r") + F.col("before")).alias("i"), "n", "x", "y", "w")


def shared_turns(c: str) -> Column:
    """How many first turns a conversation takes from its family's."""
    return F.crc32(F.col(c).cast("string").cast("binary")) % (HEAD + 1)


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns() of conversations that begin with turns of their family's (c - c % FAMILY), and (c, n) of all
    conversations, those without turns too. Of each family at most FAMILY rows meet a turn."""
    family = F.col("c") - F.col("c") % FAMILY
    heads = rows.where(F.col("i") <= HEAD).where(F.col("c") % FAMILY == 0).select(F.col("c").alias("f"), F.col("i").alias("fi"), "x", "y", "w")
    there = rows.where((F.col("i") == 1) & (F.col("c") % FAMILY == 0)).select(F.col("c").alias("f"), F.least("n", F.lit(HEAD)).alias("there"))

    def with_taken(r: DataFrame) -> DataFrame:
        r = r.withColumns({"h": shared_turns("c"), "family": family}).join(there, F.col("family") == F.col("f"), "left").drop("f")
        r = r.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
        return r.withColumn("n", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))

    convs = with_taken(rows.where("i = 1").select("c", "n"))
    own = with_taken(rows.where(F.col("i") > shared_turns("c"))).select("c", (F.col("taken") + F.col("i") - F.col("h")).alias("i"), "n", "x", "y", "w")
    begun = convs.join(heads, (F.col("family") == F.col("f")) & (F.col("fi") <= F.col("taken"))).select("c", F.col("fi").alias("i"), "n", "x", "y", "w")
    return own.unionByName(begun), convs.select("c", "n")


def blocks(rows: DataFrame) -> DataFrame:
    """(c, k, n, turns, pa, pb, pw, a, b, ended): blocks of BLOCK turns with what their turns hash to, the digest
    and the words up to before (p) and behind them, and whether the conversation ends there."""
    at = rows.select("c", "n", "i", F.floor((F.col("i") - 1) / BLOCK).alias("k"), F.xxhash64("i", "x", "y").alias("a"), F.xxhash64("y", "i", "x").alias("b"), "w")
    made = at.groupBy("c", "k").agg(F.max("n").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("w").alias("w"), F.array_sort(F.collect_list(F.struct("i", "a", "b", "w"))).alias("turns"))
    made = made.withColumn("chapter", F.floor(F.col("k") / CHAPTER))
    sums = {"a": F.bit_xor, "b": F.bit_xor, "w": F.sum}
    before = Window.partitionBy("c", "chapter").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("c").orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)
    chapters = made.groupBy("c", "chapter").agg(*[f(s).alias(s) for s, f in sums.items()]).select("c", "chapter", *[F.coalesce(f(s).over(earlier), F.lit(0)).alias(f"e{s}") for s, f in sums.items()])
    out = made.withColumns({f"p{s}": F.coalesce(f(s).over(before), F.lit(0)) for s, f in sums.items()}).join(chapters, ["c", "chapter"])
    out = out.withColumns({"pa": F.col("pa").bitwiseXOR(F.col("ea")), "pb": F.col("pb").bitwiseXOR(F.col("eb")), "pw": F.col("pw") + F.col("ew")})
    return out.select("c", "k", "n", F.transform("turns", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["w"].alias("w"))).alias("turns"), "pa", "pb", "pw", F.col("pa").bitwiseXOR(F.col("a")).alias("a"), F.col("pb").bitwiseXOR(F.col("b")).alias("b"), (F.col("pw") + F.col("w")).alias("words"), (F.col("k") * BLOCK + F.size("turns") == F.col("n")).alias("ended"))


#: SQL for the nodes of a block's turns: depth, digest, the parent's digest, the words before, whether it is the block's last.
STEPS = f"""inline(transform(sequence(1, size(turns)), j -> named_struct('depth', k * {BLOCK} + j,
  'a', pa ^ aggregate(slice(turns, 1, j), 0L, (s, t) -> s ^ t.a), 'b', pb ^ aggregate(slice(turns, 1, j), 0L, (s, t) -> s ^ t.b),
  'qa', pa ^ aggregate(slice(turns, 1, j - 1), 0L, (s, t) -> s ^ t.a), 'qb', pb ^ aggregate(slice(turns, 1, j - 1), 0L, (s, t) -> s ^ t.b),
  'before', pw + aggregate(slice(turns, 1, j - 1), 0L, (s, t) -> s + t.w), 'final', j = size(turns))))"""
WHOLE = ["k", "pa", "pb", "pw", "turns"]


def grouped(cut: DataFrame) -> DataFrame:
    """Distinct blocks behind a digest: n conversations, the smallest, how many end with it, and whether what is
    before it is shared (by two at least, or the root)."""
    groups = cut.groupBy(*WHOLE).agg(F.count("*").alias("n"), F.min("c").alias("c"), F.count_if("ended").alias("ends"))
    fold = lambda p, x: F.aggregate("turns", F.col(p), lambda s, t: s.bitwiseXOR(t[x]))
    groups = saved(groups.withColumns({"a": fold("pa", "a"), "b": fold("pb", "b")}), "blocks")
    full = groups.where(F.size("turns") == BLOCK).select((F.col("k") + 1).alias("_k"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("n").alias("_n"))
    found = groups.join(full, (F.col("k") == F.col("_k")) & (F.col("pa") == F.col("_a")) & (F.col("pb") == F.col("_b")), "left")
    return found.withColumn("shared", F.coalesce(F.col("_n") > 1, F.lit(True))).drop("_k", "_a", "_b", "_n")


def own_nodes(groups: DataFrame) -> DataFrame:
    """The nodes behind the block with which a conversation came to be alone."""
    rows = groups.where("NOT shared").selectExpr("c", "ends", STEPS)
    last = F.col("final") & (F.col("ends") > 0)
    return rows.select(
        F.col("c").alias("conv_id"), "depth", F.col("c").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("c").cast("string").cast("binary"), 256)).otherwise(EMPTY).alias("ends_sha256"))


KEY = ["depth", "a", "b"]


def named(df: DataFrame, prefix: str, *more: str) -> DataFrame:
    """df with its key renamed by a prefix, and the columns `more`."""
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in KEY], *more)


def on(prefix: str, depth: Column | None = None, a: str = "a", b: str = "b") -> Column:
    depth = F.col("depth") if depth is None else depth
    return (depth == F.col(f"{prefix}depth")) & (F.col(a) == F.col(f"{prefix}a")) & (F.col(b) == F.col(f"{prefix}b"))


def digests_of(ends: DataFrame) -> DataFrame:
    """(key, sha): the hash of the sorted ids that end at a node. Ids are sorted and joined within ranges; the
    ranges of a node with several pass one task in order, and are held one at a time."""
    parts = ends.groupBy(*KEY, F.shiftright("c", CHUNK_BITS).alias("range")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("text"))
    parts = saved(parts, "ends")
    many = parts.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")
    one = parts.join(named(many, "m_"), on("m_"), "left_anti").select(*KEY, F.sha2(F.col("text").cast("binary"), 256).alias("sha"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done = lambda: pa.RecordBatch.from_pydict({"depth": [now[0]], "a": [now[1]], "b": [now[2]], "sha": [state.hexdigest()]})
        for batch in batches:
            for depth, a, b, text in zip(*(batch.column(n).to_pylist() for n in (*KEY, "text"))):
                if now != (depth, a, b):
                    if now is not None:
                        yield done()
                    now, state = (depth, a, b), hashlib.sha256()
                    state.update(text.encode())
                else:
                    state.update(b"," + text.encode())
        if now is not None:
            yield done()

    rest = parts.join(named(many, "m_"), on("m_"), "left_semi").repartition(*KEY).sortWithinPartitions(*KEY, "range").select(*KEY, "text")
    return one.unionByName(rest.mapInArrow(fold, "depth long, a long, b long, sha string"))


def trie(conversations: DataFrame, with_family: bool = True) -> DataFrame:
    """The nodes of the trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. with_family: conversations are rebuilt() first."""
    rows = saved(turns(conversations), "turns")
    if with_family:
        rows, convs = rebuilt(rows)
    else:
        convs = rows.where("i = 1").select("c", "n")
    cut = saved(blocks(rows), "cut")
    groups = saved(grouped(cut), "groups")
    steps = groups.where("shared").selectExpr("n", "c", "ends", STEPS)
    nodes = steps.groupBy(*KEY, "qa", "qb", "before").agg(F.sum("n").alias("n_convs"), F.min("c").alias("conv_id"), F.sum(F.when(F.col("final"), F.col("ends")).otherwise(0)).alias("n_ends"))
    convs = saved(convs, "convs")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), F.count_if(F.col("n") == 0).alias("n_ends")).where("n_convs > 0").select(*[zero.alias(x) for x in (*KEY, "qa", "qb", "before")], "n_convs", "conv_id", "n_ends")
    nodes = saved(nodes.unionByName(root), "nodes")
    # a node that one conversation has alone at a block's end is continued in own_nodes()
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("n_depth"), F.col("qa").alias("n_a"), F.col("qb").alias("n_b")).agg(F.count("*").alias("n_below"))
    nodes = nodes.join(below, on("n_"), "left").drop("n_depth", "n_a", "n_b")
    alone = (F.col("n_convs") == 1) & (F.col("depth") % BLOCK == 0) & (F.col("n_ends") == 0) & (F.col("depth") > 0)
    nodes = saved(nodes.withColumn("n_children", F.coalesce("n_below", F.lit(0)) + alone.cast("long")).drop("n_below"), "nodes")

    # of each conversation: s, the words before it is the smallest; whether its end is a leaf that it stands for
    first = nodes.groupBy(F.col("conv_id").alias("r_c")).agg(F.min_by("before", "depth").alias("r_s"), F.max((F.col("n_children") == 0).cast("long")).alias("r_leaf"))
    first = saved(first, "first")
    alone_from = groups.where("shared AND n = 1").select(F.col("c").alias("l_c"), F.col("k").alias("l_k"))
    total = cut.where("ended").select(F.col("c").alias("t_c"), "words", "a", "b")
    about = convs.join(total, F.col("c") == F.col("t_c"), "left").join(alone_from, F.col("c") == F.col("l_c"), "left").join(first, F.col("c") == F.col("r_c"), "left")
    own = F.coalesce(F.col("n") > (F.col("l_k") + 1) * BLOCK, F.lit(False))
    about = about.select("c", "n", F.coalesce("r_s", "words", F.lit(0)).alias("s"), F.when(own, 1).otherwise(F.coalesce("r_leaf", F.lit(0))).cast("long").alias("leaf"), own.alias("own"), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"), "l_k")
    about = saved(about, "about")

    members = cut.select("c", *WHOLE).join(about.select(F.col("c").alias("m_c"), "s", "leaf", "l_k"), F.col("c") == F.col("m_c")).where("l_k IS NULL OR k <= l_k")
    sums = members.groupBy(*WHOLE).agg(F.sum("s").alias("s"), F.sum("leaf").alias("leaf")).selectExpr("s", "leaf", STEPS).groupBy(*KEY).agg(F.sum("s").alias("s"), F.sum("leaf").alias("leaf"))
    sums = sums.unionByName(about.agg(F.sum("s").alias("s"), F.sum("leaf").alias("leaf")).select(*[zero.alias(x) for x in KEY], "s", "leaf"))
    shas = digests_of(about.where("NOT own").select(F.col("n").alias("depth"), "a", "b", "c"))

    out = nodes.join(named(sums, "s_", "s", "leaf"), on("s_")).join(first.select("r_c", "r_s"), F.col("conv_id") == F.col("r_c"))
    out = out.join(named(nodes.select(*KEY, F.col("conv_id").alias("parent_conv_id")), "p_", "parent_conv_id"), on("p_", F.col("depth") - 1, "qa", "qb"), "left").join(named(shas, "e_", "sha"), on("e_"), "left")
    out = out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaf").alias("n_leaves"),
        (F.col("s") - F.col("r_s") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"), F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"))
    return out.unionByName(own_nodes(groups))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
