"""Packed parts of a corpus: texts are read once, and sums and cosines are those of the vectors."""

import random

import numpy as np
import pyarrow as pa
import pytest
from provenant.operators import grams, retrieve
from provenant.plans.storage import Scratch
from pyspark.sql import functions as F


def corpus(spark, n=150, seed=3):
    rng = random.Random(seed)
    rows = [(i % 140, " ".join(f"Wörd{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randint(1, 50)))) for i in range(n)]
    # keys that come twice, a key that is null, texts without a word
    return spark.createDataFrame([*rows, (None, "the berth fee"), (None, "berth fee due"), (900, None), (901, ""), (902, "the a I")], "doc int, text string").repartition(2)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("words", [1, 400, 10**6])
def test_sums_and_cosines_are_those_of_the_vectors(spark, monkeypatch, words):
    docs = corpus(spark)
    monkeypatch.setattr(grams, "PART_WORDS", words)
    monkeypatch.setattr(grams, "ASKED", 3)
    # the plain way, with documents of one key as one
    counts = retrieve.tfidf_counts(docs, "doc", "text").groupBy("doc", "term").agg(F.sum("tf").alias("tf"))
    idf = retrieve.document_frequency(counts).select("term", retrieve.smooth_idf(F.lit(docs.count()), F.col("df")).alias("idf"))
    raw = counts.join(idf, "term").select("doc", "term", retrieve._tf_idf().alias("w"))
    want = rows(raw.groupBy("doc").agg(F.count("term").alias("n"), F.round(F.sum("w"), 8), F.round(F.max("w"), 8)), "*")
    with Scratch(spark) as tmp:
        got = rows(retrieve.tfidf_sums(docs, "doc", "text", tmp, passes=3), "doc", "n_terms", F.round("total", 8), F.round("top", 8))
    assert got == want and len(got) == 141
    q = docs.where("doc % 20 = 3").select(F.col("doc").alias("qid"), F.concat_ws(" ", "text", F.lit("unheard")).alias("question"))
    q = q.dropDuplicates(["qid"])
    scores = retrieve.cosine_scores(retrieve.question_vectors(q, idf), retrieve.unit(raw, "doc"), "doc").withColumn("score", F.round("score", 6))
    best = retrieve.tfidf_topk(q, docs, "doc", "text", 5, digits=6)
    assert rows(best, "qid", "doc", "score", "rank") == rows(retrieve.top_k(scores, 5, "qid", "doc"), "qid", "doc", "score", "rank")


def test_texts_are_read_once_however_many_rounds(spark, monkeypatch):
    docs = corpus(spark).dropDuplicates(["doc"])
    plans, table = [], Scratch.table
    monkeypatch.setattr(
        Scratch, "table", lambda self, df, *a, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or table(self, df, *a, **k)
    )
    with Scratch(spark) as tmp:
        assert retrieve.tfidf_sums(docs, "doc", "text", tmp, passes=6).count() == 141
    assert sum("regexp_extract_all" in p for p in plans) == 1
    plans.clear()
    q = docs.where("doc < 3").select(F.col("doc").alias("qid"), F.col("text").alias("question"))
    assert retrieve.tfidf_topk(q, docs, "doc", "text", 5).count() == 15
    assert sum("regexp_extract_all" in p for p in plans) == 2  # the documents, and the questions


def test_terms_of_one_hash_are_told_by_the_other():
    h, g, df = np.array([7, 7, 9], np.uint64), np.array([1, 2, 5], np.uint16), np.array([1, 1, 2], np.uint32)
    one = grams._packed(np.diff(h, prepend=np.uint64(0)), g, df)
    two = grams._packed(np.array([7], np.uint64), g[1:2], df[:1])
    asked = grams._packed(np.array([7], np.uint64), g[:1], df[:1] * 0)
    met = grams._met(pa.table({"chunk": [0, 1, -1], "piece": pa.array([4, 4, 4], pa.int32()), "packed": pa.array([one, two, asked], pa.binary())}), 1)
    read = [[x.tolist() for x in grams._unpacked(b)] for b in met.column("packed").to_pylist()]
    assert read == [[[1, 2, 2], [1, 0, 0]], [[2], [0]], [[1], [1]]]
