"""The corpus pipeline: five stages over documents, each of them one operator of sitewatch.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before
the next. All but the last return the columns of documents. Null, empty and very long texts, ties,
repeated rows and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.llm import common, jaccard_join, mixing, pieces, suffix_dedup, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the toxicity model doesn't reject, whatever other rows share their doc_id."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    key = suffix_dedup.key_of(docs)
    toxic = common.saved(toxicity.scored(docs.select(key.alias("doc_id"), "text"), model).where("predicted = 1").select(F.col("doc_id").alias("_toxic")).distinct(), "toxic")
    return docs.withColumn("_key", key).join(toxic, F.col("_key") == F.col("_toxic"), "left_anti").select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one, that of the smallest doc_id; rows without a doc_id come last."""
    docs = docs.select(*COLUMNS).withColumn("_key", suffix_dedup.key_of(docs))
    named = jaccard_join.near_duplicates(docs.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_named"), "component_id").distinct()
    rows = named.join(docs.select("_key", "doc_id").distinct(), F.col("_named") == F.col("_key"))
    kept = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("x")).select(F.col("x._key").alias("_kept"))
    return one_row_each(docs.join(common.saved(kept, "kept"), F.col("_key") == F.col("_kept"), "left_semi"))


def one_row_each(docs: DataFrame) -> DataFrame:
    """One of the rows that are equal in doc_id and text (in _key)."""
    if docs.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").limit(1).isEmpty():
        return docs.select(*COLUMNS)
    return docs.groupBy("_key").agg(F.min(F.struct(*COLUMNS)).alias("_x")).select("_x.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long strings that occur again; what then has no text is dropped. A cut may
    fall within a character, whose other bytes go as well."""
    rest = suffix_dedup.without_repeats(docs)
    return rest.where(F.length(F.trim("text")) > 0).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's share takes it, in the mix's order, which the files keep
    (by their numbers and the rows in them), though Spark may read them in another."""
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def with_place(docs: DataFrame) -> DataFrame:
    """docs with `place`, a text that sorts as the rows stand in numbered files; null if they come from elsewhere."""
    try:
        name, row = docs["_metadata.file_name"], docs["_metadata.row_index"]
        number = F.regexp_extract(name, r"^part-(\d+)-.*?-c(\d+)\.", 1), F.regexp_extract(name, r"^part-(\d+)-.*?-c(\d+)\.", 2)
        return docs.select(*COLUMNS, F.concat(F.lpad(number[0], 8, "0"), F.lit("."), F.lpad(number[1], 8, "0"), F.lit("."), F.lpad(row.cast("string"), 12, "0")).alias("place"))
    except AnalysisException:
        return docs.select(*COLUMNS, F.lit(None).cast("string").alias("place"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with what decodes from them; sorted by `place` the documents are in the mix's order."""
    out = pieces.round_trip(with_place(docs), pieces.model_path(), carry=("place",))
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "lossless", "place")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", one_of_near_copies),
    ("suffix dedup", cut_repeats),
    ("mixture", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: A learned model, iterative joins and a tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.saved(docs, name.replace(" ", "-"))
    return docs
