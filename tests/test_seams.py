"""Parts that a user can hand in, files, and what is left behind."""

import gc
import io
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant import cli, sources
from provenant.functions import text as T
from provenant.operators import contradict, render, retrieve
from provenant.plans import engine, evaluate, sample
from provenant.plans.storage import Scratch


def letters():
    """A toy model: counts of letters."""
    def encode(texts):
        return np.array([[t.lower().count(c) + 1e-3 for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts])

    return encode


class Longest:
    """A scorer that likes long passages."""

    def score(self, pairs, index):
        return pairs.withColumn("score", F.least(F.char_length("passage") / 400, F.lit(1.0)))


def test_another_embedding(spark):
    encode = letters()
    model = retrieve.DenseEmbedding(encode)
    index = engine.build_index(sample.clauses(spark), sample.specs(spark), embedding=model)
    q = spark.createDataFrame(
        [("a", "slipway bookings", "slipway bookings"), ("b", "berth fee", "berth fee")],
        "qid string, question string, search string"
    )
    hits = engine.candidates(q, index, embedding=model).where("list_no = 0").collect()
    rows = index["clauses"].orderBy("pos").collect()
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    cosine = unit(encode(["slipway bookings", "berth fee"])) @ unit(
        encode([f"{r['section_title']}. {r['text']}" for r in rows])
    ).T
    for k, qid in enumerate("ab"):
        want = sorted(range(len(rows)), key=lambda i: (-cosine[k, i], i))[:12]
        assert [r["pos"] for r in sorted((h for h in hits if h["qid"] == qid), key=lambda h: h["rank"])] == want
    answers = engine.answer(sample.questions(spark), index, embedding=model)
    assert {r["decision"] for r in answers.collect()} <= {"ANSWER", "REFUSE", "CONFLICT"}


def test_another_scorer(spark):
    index = engine.build_index(sample.clauses(spark), sample.specs(spark))
    q = spark.createDataFrame([("a", "What sum is the berth fee due for each month?")], "qid string, question string")
    plain, other = (engine.evidence_items(q, index, scorer=s).orderBy("rank").collect() for s in (None, Longest()))
    assert plain[0]["citation"] == "§1.2.2" != other[0]["citation"]
    assert [r["score"] for r in other] == sorted((r["score"] for r in other), reverse=True)


def test_another_stop_list(spark, tmp_path):
    (tmp_path / "words").write_text("berth\nFee\n\n")
    words = sources.read_words(spark, str(tmp_path / "words"))
    assert words == ["berth", "fee"]
    docs = spark.createDataFrame([(0, "the berth fee rises"), (1, "the fee")], "pos int, text string")
    assert {
        r["term"] for r in retrieve.tfidf_counts(docs, "pos", "text", words).collect()
    } == {"the", "rises", "the rises"}
    assert docs.select(T.words("text", []).alias("w")).first()["w"] == ["the", "berth", "fee", "rises"]


def test_retrieval_without_an_index_is_that_of_one(spark):
    docs = spark.createDataFrame(
        [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 2 + i % 17))) for i in range(120)]
        + [(900, None), (901, "")],
        "doc_id long, text string"
    )
    q = spark.createDataFrame([("a", "w1 w2 w3 w3"), ("b", "w7 unheard"), ("c", "")], "qid string, question string")
    top = lambda s: sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in retrieve.top_k(s.withColumn("score", F.round("score", 9)), 5, "qid", "doc_id").collect())
    rows = lambda s: sorted((r["qid"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in s.collect())
    assert rows(retrieve.bm25_topk(q, docs, "doc_id", "text", 5, digits=9)) == top(
        retrieve.bm25_scores(q, retrieve.bm25_postings(docs, "doc_id", "text"), "doc_id")
    )
    v, idf = retrieve.tfidf_vectors(docs, "doc_id", "text")
    assert rows(retrieve.tfidf_topk(q, docs, "doc_id", "text", 5, digits=9)) == top(
        retrieve.cosine_scores(retrieve.question_vectors(q, idf), v, "doc_id")
    )


def test_dense_blocks(spark):
    """Blocks of questions, equal vectors and a zero vector."""
    rng = np.random.default_rng(3)
    e = rng.normal(size=(60, 4)).round(1)
    e[7], e[9], e[11] = e[5], e[5], 0
    v = spark.createDataFrame(
        [(i, [float(x) for x in r]) for i, r in enumerate(e)], "vec_id long, embedding array<float>"
    )
    q = v.where("vec_id % 3 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qe"))
    got = [
        {
            (r["qid"], r["rank"], r["vec_id"])
            for r in retrieve.dense_topk(q, v, "vec_id", "embedding", 4, digits=6, block=b).collect()
        }
        for b in (100, 6)
    ]
    e = e.astype(np.float32).astype(float)
    unit = e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-300)
    c = np.round(unit @ unit.T, 6)
    want = {
        (i, k + 1, j) for i in range(0, 60, 3)
        for k, j in enumerate([j for j in sorted(range(60), key=lambda j: (-c[i, j], j)) if j != i and c[i, j] > 0][:4])
    }
    assert got[0] == got[1] == want


def test_overlapping_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, sorted({f"t{k}" for k in rng.integers(0, 25, rng.integers(0, 12))})) for i in range(80)]
    got = {
        (r["a"], r["b"], round(r["jaccard"], 9))
        for r in contradict.overlapping(spark.createDataFrame(rows, "k long, t array<string>"), "k", "t").collect()
    }
    jac = lambda x, y: len({*x} & {*y}) / len({*x} | {*y}) if x and y else 0
    assert got == {(a, b, round(jac(s, t), 9)) for a, s in rows for b, t in rows if a < b and jac(s, t) >= 0.4}


def test_jurisdiction(spark):
    r = lambda *a: spark.range(1).select(render.refusal_text(F.lit("OUT_OF_SCOPE"), F.lit(None).cast("string"), *a).alias("t")).first()["t"]
    assert r().startswith("This question falls outside the policy manual,") and r("Harbour Office").startswith(
        "This question falls outside the Harbour Office policy manual,"
    )


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    sources.save_index(engine.build_index(sample.clauses(spark), sample.specs(spark)), str(tmp_path / "ix"))
    monkeypatch.setattr(
        "sys.stdin",
        io.StringIO(
            "\nWhat sum is the berth fee due for each month?\nverbose\nWhat is a working boat?\nquit\nnever read\n"
        )
    )
    assert cli.main([str(tmp_path / "ix")]) == 0
    out = capsys.readouterr().out
    assert "Berth fee — the sum due" in out and "Sources: §1.2.2" in out and "support_score" in out and "never" not in out


def test_report_of_questions_in_a_file(spark, tmp_path):
    (tmp_path / "q.json").write_text(
        '[{"id": "Q1", "category": "c", "question": "What is a working boat?", "expected_behavior": "answer", "expected_clauses": ["1.2.1"]}]'
    )
    cases = sources.read_questions(spark, str(tmp_path / "q.json"))
    a = engine.answer(
        cases.select(F.col("id").alias("qid"), "question"),
        engine.build_index(sample.clauses(spark), sample.specs(spark))
    )
    assert "| Q1 | c | answer | answer | PASS |" in evaluate.report(evaluate.grade(cases, a))


def test_nothing_is_left(spark):
    """Scratch tables go with their call, even a failing one, checkpoints with their plans."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    with pytest.raises(ValueError, match="stop"), Scratch(spark) as tmp:
        tmp.table(spark.range(5), "five")
        raise ValueError("stop")
    a = engine.answer(sample.questions(spark), engine.build_index(sample.clauses(spark), sample.specs(spark)))
    assert a.count()
    del a
    for _ in range(40):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        left = [f for d, _, fs in os.walk(where) for f in fs if f.startswith("part-")]
        if not left:
            break
        time.sleep(0.25)
    assert not left
