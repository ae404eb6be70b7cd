"""Grading answers against expected decisions and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grade(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, category, expected, actual, decision_ok, citations_ok, passed)."""
    j = cases.join(answers.select(F.col("qid").alias("id"), "decision", "citations"), "id", "left")
    wanted = F.transform(
        F.coalesce("expected_clauses", F.array().cast("array<string>")),
        lambda c: F.concat(F.lit("§"), F.ltrim(c, F.lit("§")))
    )
    ok = F.lower("decision") == F.lower("expected_behavior")
    held = F.size(F.array_except(wanted, F.coalesce("citations", F.array().cast("array<string>")))) == 0
    return j.select("id", "category", F.col("expected_behavior").alias("expected"), F.lower("decision").alias("actual"), F.coalesce(ok, F.lit(False)).alias("decision_ok"), held.alias("citations_ok"),
                    (F.size(wanted) > 0).alias("has_citations"), (F.coalesce(ok, F.lit(False)) & held).alias("passed"))


def metrics(graded: DataFrame) -> DataFrame:
    """One row: pass rate, and accuracy by expected behaviour and of citations."""
    rate = lambda c, among: (F.count_if(c & among).cast("long"), F.count_if(among).cast("long"))
    cols = []
    for name, c, among in (
        ("total", F.col("passed"), F.lit(True)), ("answer", F.col("decision_ok"), F.col("expected") == "answer"),
        ("refuse", F.col("decision_ok"), F.col("expected") == "refuse"),
        ("conflict", F.col("decision_ok"), F.col("expected") == "conflict"),
        ("citation", F.col("citations_ok"), F.col("has_citations")),
    ):
        hit, n = rate(c, among)
        cols += [hit.alias(f"{name}_ok"), n.alias(f"{name}_n")]
    return graded.agg(*cols)


def report(graded: DataFrame) -> str:
    """Markdown of the metrics and each case; a case is a row on the driver."""
    m = metrics(graded).first()
    out = [
        "# Evaluation", "",
        *(f"- {k}: {m[f'{k}_ok']}/{m[f'{k}_n']}" for k in ("total", "answer", "refuse", "conflict", "citation")), "",
        "| id | category | expected | actual | result |", "|---|---|---|---|---|"
    ]
    out += [f"| {r['id']} | {r['category']} | {r['expected']} | {r['actual']} | {'PASS' if r['passed'] else 'FAIL'} |" for r in graded.orderBy("id").toLocalIterator()]
    return "\n".join(out) + "\n"
