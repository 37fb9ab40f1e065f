"""The pipeline's stages against brute force, one after another, and rows that share or lack ids."""

import collections
import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, brute_mix, prose, utf

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = corpus_pipeline.common.new_folder(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if i < 4:
            assert set(docs.columns) == set(corpus_pipeline.COLUMNS)
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    assert docs.where("NOT lossless").count() == 0
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    assert docs.join(ids, "doc_id", "left_anti").count() == 0


def flagged(monkeypatch):
    """Toxicity by a word, so that brute force can say it."""
    monkeypatch.setattr(corpus_pipeline.toxicity, "fit", lambda docs, labels: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "scored", lambda docs, model: docs.select("doc_id", F.coalesce(F.contains("text", F.lit("bad")), F.lit(False)).cast("int").alias("predicted")))


def without_repeats(texts):
    count = collections.Counter(b[i : i + 200] for b in texts for i in range(len(b) - 199))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        out.append(np.frombuffer(b, np.uint8)[~gone].tobytes().decode(errors="ignore"))
    return out


def test_stages_are_what_brute_force_gives(spark, tmp_path, monkeypatch):
    flagged(monkeypatch)
    r = random.Random(4)
    base, passage = prose(r, 120), prose(r, 70)
    texts = [prose(r, r.randrange(3, 90)) for _ in range(25)] + [base, base, base + " more", f"{passage} {prose(r, 50)}", f"{prose(r, 50)} {passage}", f"{prose(r, 40)} bad {prose(r, 9)}", "é 中 🙂", "", None, "bad"]
    rows = [(i * 2, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()

    kept = [(i, t, s) for i, t, _, s, _ in rows if "bad" not in (t or "")]
    named = {i: c for i, _, c in brute_components([(i, t) for i, t, _ in kept])}
    kept = [(i, t, s) for i, t, s in kept if named[str(i)] == str(i)]
    cut = without_repeats([utf(t) for _, t, _ in kept])
    kept = [(i, t, s) for (i, _, s), t in zip(kept, cut) if t.strip()]
    import hashlib

    want = [(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in brute_mix(kept)]
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in got) == sorted(want) and all(r["lossless"] and len(r["ids"]) == 2 * r["n_tokens"] for r in got)


def test_the_mix_keeps_its_order(spark, sf_dir):
    """Read back from its files, by whatever order these are opened in, the mix has a place for every document."""
    r = random.Random(7)
    rows = [(i, prose(r, r.randrange(1, 400 if i % 7 == 0 else 9)), "en", "abc"[i % 3], 0) for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = [x["doc_id"] for x in corpus_pipeline.mix_sources(spark, docs, sf_dir).collect()]
    mix = corpus_pipeline.common.saved(corpus_pipeline.mix_sources(spark, docs, sf_dir), "mix")
    got = corpus_pipeline.encode_pieces(spark, mix, sf_dir).orderBy("place").collect()
    assert [x["doc_id"] for x in got] == want and len({x["place"] for x in got}) == len(want) > 100


def test_rows_stand_for_themselves(spark, sf_dir, monkeypatch):
    """Null and repeated doc_ids: a row goes for its own text only."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, a), (None, a + " more"), (None, b), (None, "bad"), (5, c), (5, d), (5, c), (5, "bad"), (7, d + " end")]
    docs = spark.createDataFrame([(*x, "en", "s", len(x[1])) for x in rows], SCHEMA)
    flagged(monkeypatch)
    clean = corpus_pipeline.common.saved(corpus_pipeline.drop_toxic(spark, docs, sf_dir), "clean")
    assert sorted(map(str, clean.select("doc_id", "text").collect())) == sorted(map(str, docs.where("text <> 'bad'").select("doc_id", "text").collect()))
    got = [(r["doc_id"], r["text"].removesuffix(" more")) for r in corpus_pipeline.one_of_near_copies(spark, clean, sf_dir).collect()]
    assert len(got) == 4 and set(got) == {(None, a), (None, b), (5, c), (5, d)}


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_tables(spark, sf_dir, monkeypatch, stage):
    """An empty table, nulls in every column, and columns beside those of documents."""
    flagged(monkeypatch)
    name, run = corpus_pipeline.STAGES[stage]
    odd = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (1, "", None, None, 0), (2, "w " * 9, None, "s", None)], SCHEMA).withColumns({"size": F.lit(1), "key": F.lit("k"), "row": F.lit(2), "node": F.lit(3), "_key": F.lit(4), "_toxic": F.lit(5), "_kept": F.lit(6), "place": F.lit(7)})
    out = run(spark, odd, sf_dir)
    assert 2 in {r["doc_id"] for r in out.collect()}
    assert run(spark, odd.where("false"), sf_dir).count() == 0
