"""The command line: build an index, ask it, grade it.

    python -m provenant.cli ingest MANUALS INDEX_DIR [AMENDMENTS]
    python -m provenant.cli INDEX_DIR                 questions from standard input, one a line
    python -m provenant.cli evaluate INDEX_DIR QUESTIONS REPORT
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import sources
from .config import from_env
from .plans import evaluate
from .plans.engine import answer, build_index, evidence_items


def ingest(spark: SparkSession, manuals: str, path: str, amendments: str | None = None) -> int:
    """An index of manuals and amendments, in a folder."""
    try:
        clauses = sources.clause_table(sources.read_manuals(spark, manuals))
    except sources.ManualNotFoundError as e:
        print(f"ERROR: {e}", file=sys.stderr)
        return 1
    specs = sources.read_amendments(spark, amendments) if amendments else None
    index = build_index(clauses, specs, from_env())
    by = index["clauses"].agg(
        F.count_if(~F.col("is_amended_version")), F.count_distinct("part_number"), F.count_if("is_amended_version")
    ).first()
    if not by[0]:
        print("ERROR: no clauses were found; check the headings of the manual", file=sys.stderr)
        return 1
    sources.save_index(index, path)
    print(f"{by[0]} clauses in {by[1]} parts, {by[2]} amended versions; index in {path}")
    return 0


def grade(spark: SparkSession, path: str, questions: str, report: str) -> int:
    """Answers every question of a file and writes what came of it."""
    cases = sources.read_questions(spark, questions)
    answers = answer(cases.select(F.col("id").alias("qid"), "question"), sources.load_index(spark, path), from_env())
    graded = evaluate.grade(cases, answers).checkpoint()
    with open(report, "w", encoding="utf-8") as f:
        f.write(evaluate.report(graded))
    m = evaluate.metrics(graded).first()
    print(f"{m['total_ok']}/{m['total_n']} passed; report in {report}")
    return 0 if m["total_ok"] == m["total_n"] else 1


def ask(spark: SparkSession, path: str) -> int:
    index, verbose, s = sources.load_index(spark, path), False, from_env()
    for line in map(str.strip, sys.stdin):
        if line.lower() in ("exit", "quit"):
            break
        if line.lower() == "verbose":
            verbose = not verbose
            continue
        if not line:
            continue
        q = spark.createDataFrame([("q", line)], "qid string, question string")
        r = answer(q, index, s).first()
        if verbose:
            for note in r["notes"]:
                print(f"  [date] {note}")
            print(f"  [hits] vector={r['n_vector']} bm25={r['n_bm25']} fused={r['n_fused']}")
            evidence_items(q, index, s).orderBy("rank").show(truncate=60)
        print(r["text"] + ("\n\nSources: " + ", ".join(r["citations"]) if r["citations"] else ""), flush=True)
    return 0


def main(argv: list[str]) -> int:
    if not argv:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("provenant").getOrCreate()
    command, rest = (argv[0], argv[1:]) if argv[0] in ("ingest", "evaluate") else ("ask", argv)
    return {"ingest": ingest, "evaluate": grade, "ask": ask}[command](spark, *rest)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
