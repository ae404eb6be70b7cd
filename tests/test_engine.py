"""Behaviour of the whole plan over the sample manual."""

import pytest
from pyspark.sql import functions as F

from provenant import sources
from provenant.operators import contradict
from provenant.plans import engine, evaluate, sample


@pytest.fixture(scope="module")
def index(spark):
    return engine.build_index(sample.clauses(spark), sample.specs(spark))


@pytest.fixture(scope="module")
def answers(spark, index):
    return {r["qid"]: r for r in engine.answer(sample.questions(spark), index).collect()}


def test_clause_table(spark):
    rows = sample.clauses(spark).orderBy("pos").collect()
    ids = [r["clause_id"] for r in rows]
    assert len(ids) == len(set(ids)) == 21
    assert all(r["citation"] == "§" + r["clause_id"] and r["text"] and r["section_title"] for r in rows)
    by = {r["clause_id"]: r for r in rows}
    assert by["1.2.1"]["text"].startswith("Working boat — a vessel")
    assert "(a) the vessel" in by["2.1.1"]["text"] and "24 months" in by["2.1.1"]["text"]
    assert "| up to 6 m |" in by["6.6.1"]["text"]
    assert "consolidated" not in by["10.5.3"]["text"]


def test_versions(index):
    rows = {(r["clause_id"], r["is_amended_version"]): r for r in index["clauses"].collect()}
    assert len(rows) == 27
    assert "14 calendar days" in rows["4.3.2", True]["text"] and "10 calendar days" in rows["4.3.2", False]["text"]
    assert str(rows["4.3.2", False]["effective_to"]) == "2026-02-28" and rows["4.3.2", True]["effective_to"] is None
    assert "$1,225" in rows["6.6.1", True]["text"] and rows["10.5.3A", True]["section_title"] == "Length of suspension"


@pytest.mark.parametrize(("qid", "decision", "reason"), [
    ("direct", "ANSWER", None), ("out", "REFUSE", "INSUFFICIENT_EVIDENCE"),
    ("undated", "REFUSE", "MISSING_DATE_CONTEXT"), ("gap", "REFUSE", "AMBIGUOUS_POLICY"),
    ("bare", "REFUSE", "AMBIGUOUS_POLICY"),
])
def test_decisions(answers, qid, decision, reason):
    assert (answers[qid]["decision"], answers[qid]["reason"]) == (decision, reason)


def test_same_question_two_dates(answers):
    assert "10 calendar days" in answers["before"]["text"] and "14 calendar days" in answers["after"]["text"]
    assert "$120" in answers["towing_before"]["text"] and "$175" in answers["towing_after"]["text"]
    assert "Amendment No. 2026-01 §5.2" in answers["after"]["citations"]
    assert "§10.5.3A" in answers["rescue"]["citations"]
    assert "Amendment No. 2026-01 §5.3" in answers["span"]["citations"]


def test_refusals_escalate(answers):
    refused = [a for a in answers.values() if a["decision"] == "REFUSE"]
    assert refused and all(
        "Please consult the appropriate policy administrator" in a["text"] and not a["citations"] for a in refused
    )


def test_blank_question(spark, index):
    with pytest.raises(engine.EmptyQuestionError):
        engine.answer(spark.createDataFrame([("q", "  ")], "qid string, question string"), index)


def test_contradiction_sweep(spark, index):
    from provenant.operators import amend

    clauses = index["clauses"]
    found = contradict.contradictions(
        clauses.select(F.lit("all").alias("qid"), F.col("pos").alias("idx"), "clause_id", "text"), amend.latest(clauses)
    ).collect()
    pairs = {tuple(sorted((r["a_id"], r["b_id"]))) for r in found}
    assert ("4.3.2", "9.1.4") in pairs and ("4.3.2", "4.3.3") not in pairs and len(pairs) <= 3


def test_index_round_trip(spark, index, tmp_path):
    sources.save_index(index, str(tmp_path / "ix"))
    again = sources.load_index(spark, str(tmp_path / "ix"))
    assert again["clauses"].count() == index["clauses"].count()
    with pytest.raises(FileNotFoundError):
        sources.load_index(spark, str(tmp_path / "none"))


def test_manual_file(spark, tmp_path):
    with pytest.raises(sources.ManualNotFoundError, match="not found"):
        sources.read_manuals(spark, str(tmp_path / "none.md"))
    p = tmp_path / "manual.md"
    p.write_text(sample.MANUAL, encoding="utf-8")
    assert sources.clause_table(sources.read_manuals(spark, str(p))).count() == 21


def test_evaluation(spark, answers):
    cases = spark.createDataFrame(
        [
            ("direct", "d", "q", "answer", ["1.2.2"]), ("out", "o", "q", "refuse", None),
            ("gap", "g", "q", "answer", ["9.9.9"])
        ],
        "id string, category string, question string, expected_behavior string, expected_clauses array<string>"
    )
    a = spark.createDataFrame(
        [(k, v["decision"], v["citations"]) for k, v in answers.items()],
        "qid string, decision string, citations array<string>"
    )
    m = evaluate.metrics(evaluate.grade(cases, a)).first()
    assert (m["total_ok"], m["total_n"], m["citation_ok"], m["citation_n"]) == (2, 3, 1, 2)
    assert "2/3" in evaluate.report(evaluate.grade(cases, a))
