"""As-of joins over chains of amendments, notes, provisions, and the commands."""

import io
import json
import random
from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import functions as F

from provenant import cli
from provenant.config import Settings
from provenant.operators import temporal
from provenant.plans import sample

SET = Settings()
CLAUSES = "clause_id string, is_amended_version boolean, date_condition_type string, effective_from date, amendment_id string, pos int"
CTX = "qid string, ctx struct<change_date:date,determination_date:date,claim_date:date,period_start:date,has_any_date:boolean,spans_boundary:boolean>"
HITS = "qid string, clause_id string, pos int, score double, rank int"


def ctx(qid, day=None, change=None, spans=False):
    return qid, (change, day, None, None, bool(day or change), spans)


def test_asof_join(spark):
    """Spans of any length, dates before, between and behind them, many buckets."""
    rng, day = random.Random(3), lambda k: date(2000, 1, 1) + timedelta(k)
    rows = [(f"k{rng.randrange(5)}", True, "determination_date", day(rng.randrange(3000)), "a", i) for i in range(60)]
    rows += [("k1", True, "determination_date", rows[0][3], "a", 100 + i) for i in range(3)]  # one day, several versions
    rows += [("k9", False, None, None, None, 200)]
    dates = [(i, f"k{rng.randrange(10)}", day(rng.randrange(-200, 6000)) if rng.random() < 0.9 else None) for i in range(300)]
    q = spark.createDataFrame(dates, "qid int, clause_id string, day date")
    spans = temporal.validity(spark.createDataFrame(rows, CLAUSES))

    def by_hand(k, d):
        past = [(r[3], r[5]) for r in rows if r[0] == k and r[1] and d is not None and r[3] <= d]
        return max(past)[1] if past else None

    for size in (1, 30, 366, 100_000):
        got = {r["qid"]: r["v_pos"] for r in temporal.asof_join(q, spans, "clause_id", "day", bucket_days=size).collect()}
        assert got == {i: by_hand(k, d) for i, k, d in dates}
    assert temporal.asof_join(q.limit(0), spans, "clause_id", "day").count() == 0
    assert temporal.asof_join(q, spans.limit(0), "clause_id", "day").where("v_pos is null").count() == 300


def chain(spark):
    rows = [("4.1", False, None, None, None, 0), ("5.1", False, None, None, None, 1)]
    rows += [("4.1", True, "determination_date", date(y, 3, 1), f"{y}-01", 10 + y - 2024) for y in (2024, 2025, 2026)]
    return spark.createDataFrame(rows, CLAUSES)


def test_three_amendments(spark):
    """Each date gets the version in force; the default sees the last one only."""
    days = {"a": date(2023, 5, 1), "b": date(2024, 3, 1), "c": date(2025, 2, 28), "d": date(2025, 3, 1), "e": date(2030, 1, 1), "f": None}
    contexts = spark.createDataFrame([ctx(q, d) for q, d in days.items()], CTX)
    hits = spark.createDataFrame([(q, c, 0, 0.5, 1 + (c == "5.1")) for q in days for c in ("4.1", "5.1")], HITS)
    out = lambda s: {
        r["qid"]: (r["pos"], r["use_amended"], r["transitional"])
        for r in temporal.resolve(hits, contexts, chain(spark), s).where("clause_id = '4.1'").collect()
    }
    cite = lambda y: f"Amendment No. {y}-01 §5.1"
    assert out(replace(SET, version_chain=True)) == {
        "a": (0, False, cite(2024)), "b": (10, True, cite(2024)), "c": (10, True, cite(2024)), "d": (11, True, cite(2025)),
        "e": (12, True, cite(2026)), "f": (0, False, None)
    }
    assert {q: v[0] for q, v in out(SET).items()} == {"a": 0, "b": 0, "c": 0, "d": 0, "e": 12, "f": 0}
    other = temporal.resolve(hits, contexts, chain(spark), replace(SET, version_chain=True)).where("clause_id = '5.1'")
    assert {(r["pos"], r["has_versions"]) for r in other.collect()} == {(0, False)}


def test_notes(spark):
    """Missing dates, versions by rank, and the apportionment of a spanning period."""
    contexts = spark.createDataFrame([ctx("a", date(2026, 4, 1), spans=True), ctx("b"), ctx("c", date(2026, 1, 2))], CTX)
    hits = spark.createDataFrame([(q, "4.1", 0, 0.5, 1) for q in "abc"], HITS)
    one = chain(spark).where("effective_from is null or effective_from > '2026-01-01'")
    got = temporal.notes(temporal.resolve(hits, contexts, one), contexts, one, hits)
    assert {r["qid"]: r["notes"] for r in got.collect()} == {
        "a": ["Using post-amendment version of §4.1 (effective 1 March 2026).",
              "Claim period spans 1 March 2026. Under Amendment No. 2026-01 §5.3, the applicable figures are those in force on "
              "each day of the period, and the award is apportioned accordingly under §7.4.3."],
        "b": ["§4.1 was amended by Amendment No. 2026-01 effective 1 March 2026. Applicability depends on determination date."],
        "c": ["Using pre-amendment version of §4.1 (for date 2026-01-02)."],
    }


def test_provisions_stay(spark):
    """A provision that is hit twice stays twice; a clause does not."""
    contexts = spark.createDataFrame([ctx("a", date(2026, 4, 1))], CTX)
    hits = spark.createDataFrame(
        [("a", c, 7, 0.9 - i / 10, i + 1) for i, c in enumerate(["A2026-01-5.1", "5.1", "A2026-01-5.1", "5.1"])], HITS
    )
    got = temporal.ordered(temporal.resolve(hits, contexts, chain(spark))).orderBy("rank")
    assert [r["clause_id"] for r in got.collect()] == ["5.1", "A2026-01-5.1", "A2026-01-5.1"]


def test_commands(spark, tmp_path, monkeypatch, capsys):
    """From a manual and amendments in files to answers and a graded report."""
    (tmp_path / "m.md").write_text(sample.MANUAL)
    (tmp_path / "a.json").write_text(json.dumps([sample.AMENDMENT], default=str))
    (tmp_path / "q.json").write_text(json.dumps([
        {"id": "Q1", "category": "c", "question": "What is a working boat?", "expected_behavior": "answer", "expected_clauses": ["1.2.1"]},
        {"id": "Q2", "category": "c", "question": "What is a working boat?", "expected_behavior": "refuse", "expected_clauses": []},
    ]))
    ix = str(tmp_path / "ix")
    assert cli.main(["ingest", str(tmp_path / "none.md"), ix]) == 1
    assert cli.main(["ingest", str(tmp_path / "m.md"), ix, str(tmp_path / "a.json")]) == 0
    said = capsys.readouterr()
    assert "ERROR: manual not found" in said.err and "amended versions; index in" in said.out
    assert cli.main(["evaluate", ix, str(tmp_path / "q.json"), str(tmp_path / "r.md")]) == 1
    report = (tmp_path / "r.md").read_text()
    assert "| Q1 | c | answer | answer | PASS |" in report and "| Q2 | c | refuse | answer | FAIL |" in report
    assert "1/2 passed" in capsys.readouterr().out
    monkeypatch.setattr("sys.stdin", io.StringIO("What is a working boat?\n"))
    assert cli.main([ix]) == 0 and "Sources: §1.2.1" in capsys.readouterr().out
    assert cli.main([]) == 2
    assert spark.read.parquet(f"{ix}/clauses").where(F.col("is_amended_version")).count() > 0
