"""Fused ranks: what a text is split into is made once where it is dealt, not before as well."""

from provenant.operators import retrieve
from provenant.plans import driver_queries
from provenant.plans.storage import Scratch


def test_dealt_texts_are_split_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "berth fees, 3 days"), (2, None), (3, ""), (4, "fee of berths")], "doc int, text string")
    q = spark.createDataFrame([(7, "berth fee")], "qid int, question string")
    plans, table = {}, Scratch.table
    monkeypatch.setattr(
        Scratch, "table", lambda self, df, name, *a, **k: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and table(self, df, name, *a, **k)
    )
    got = retrieve.bm25_topk(q, docs, "doc", "text", 5, digits=6).collect()
    assert sorted(r["doc"] for r in got) == [1, 4]
    assert plans["best"].count("regexp_extract_all(lower(text") == 1
    assert sum("regexp_extract_all(lower(text" in x for x in plans["terms"].split("\n")) == 1


def test_duplicate_keys_read_texts_for_vectors_once(spark, monkeypatch):
    plans, table = [], Scratch.table
    monkeypatch.setattr(
        Scratch, "table", lambda self, df, *a, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or table(self, df, *a, **k)
    )
    out = driver_queries.rrf_duplicate_keys(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and sum(r"\p{L}" in p for p in plans) == 2  # the documents, and the questions
