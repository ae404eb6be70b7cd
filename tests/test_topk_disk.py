"""Top-k without an index: what is dealt by term is small or deleted, and nothing is lost."""

import os
import random

from provenant.operators import retrieve
from provenant.plans import driver_queries
from provenant.plans.storage import Scratch
from pyspark.sql import functions as F


def corpus(spark, n=120, seed=6):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"word{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.randint(1, 60)))) for i in range(n)]
    docs = spark.createDataFrame([*rows, (n, None), (n + 1, "")], "doc int, text string")
    return docs, docs.where("doc % 20 = 3").select(F.col("doc").alias("qid"), F.col("text").alias("question"))


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_bm25_topk_deals_texts_once_by_key(spark, monkeypatch):
    docs, q = corpus(spark)
    plans, table = [], Scratch.table
    monkeypatch.setattr(
        Scratch, "table", lambda self, df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or table(self, df, *a, **k)
    )
    got = rows(retrieve.bm25_topk(q, docs, "doc", "text", 5, digits=9), "qid", "doc", "score", "rank")
    scores = retrieve.bm25_scores(q, retrieve.bm25_postings(docs, "doc", "text"), "doc")
    assert got == rows(retrieve.top_k(scores.withColumn("score", F.round("score", 9)), 5, "qid", "doc"), "qid", "doc", "score", "rank")
    assert plans and plans[-1].count("Exchange hashpartitioning(doc") == 1


def test_sums_in_rounds_are_those_of_the_vectors(spark):
    docs, _ = corpus(spark)
    v, _ = retrieve.tfidf_vectors(docs, "doc", "text")
    want = rows(v.groupBy("doc").agg(F.count("term").alias("n"), F.round(F.sum("w"), 6), F.round(F.max("w"), 6)), "*")
    for passes in (1, 3):
        with Scratch(spark) as tmp:
            s = retrieve.tfidf_sums(docs, "doc", "text", tmp, passes=passes)
            assert want == rows(s, "doc", "n_terms", F.round(F.col("total") / F.col("norm"), 6), F.round(F.col("top") / F.col("norm"), 6))
            assert len([x for x in os.listdir(tmp.path.removeprefix("file:"))]) == 1


def test_tfidf_topk_equals_the_vectors(spark):
    docs, q = corpus(spark)
    v, idf = retrieve.tfidf_vectors(docs, "doc", "text")
    scores = retrieve.cosine_scores(retrieve.question_vectors(q, idf), v, "doc").withColumn("score", F.round("score", 9))
    got = retrieve.tfidf_topk(q, docs, "doc", "text", 5, digits=9)
    assert rows(got, "qid", "doc", "score", "rank") == rows(retrieve.top_k(scores, 5, "qid", "doc"), "qid", "doc", "score", "rank")


def test_brief_tables_leave_no_shuffle(spark):
    with Scratch(spark) as tmp:
        before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
        t = tmp.table(spark.range(1_000).repartition(3, "id"), "t", brief=True)
        assert t.count() == 1_000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before


def test_large_corpora_are_dealt_in_more_rounds(spark, monkeypatch):
    docs, q = corpus(spark)
    names, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name, *a, **k: names.append(name) or table(self, df, name, *a, **k))
    chars = docs.agg(F.sum(F.char_length("text"))).first()[0]
    for run, each in ((retrieve.bm25_topk, ["best"]), (retrieve.tfidf_topk, ["best", "sums"])):
        found = {}
        for most in (chars, chars // 5):
            names.clear()
            monkeypatch.setattr(retrieve, "ROUND_CHARS", most)
            found[most] = rows(run(q, docs, "doc", "text", 5, digits=9), "qid", "doc", "score", "rank")
            assert most == chars or all(names.count(x) >= 5 for x in each)
        assert found[chars] == found[chars // 5] and found[chars]


def test_fused_ranks_are_the_same_in_rounds(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    want = rows(driver_queries.rrf_duplicate_keys(spark, sf), "*")
    monkeypatch.setattr(retrieve, "ROUND_CHARS", 100_000)
    names, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name, *a, **k: names.append(name) or table(self, df, name, *a, **k))
    assert rows(driver_queries.rrf_duplicate_keys(spark, sf), "*") == want and names.count("best") > 2 and want
