"""The queries of this subpackage and their SQL, for the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, jaccard_join, mixing, neighbours, oracle, pieces, piecewise, prefix_trie, spelling, suffix_dedup, token_files, toxicity, url_filter, warc
from .common import bounded_batches

OPERATORS = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_nn_descent": neighbours.op3_nn_descent,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_warc": warc.op5_warc,
    "op6_mixture": mixing.op6_mixture,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_piecewise_fingerprints": piecewise.op8_piecewise_fingerprints,
    "op9_chat": chat.op9_chat,
    "op10_token_files": token_files.op10_token_files,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_url_filter": url_filter.op12_url_filter,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}


def bounded(f: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {name: bounded(f) for name, f in OPERATORS.items()}

#: The others can't be said in SQL, or not in time over whole tables; their tests hold them against brute force.
ORACLE_SQL: dict[str, str] = dict(oracle.ORACLE_SQL)
