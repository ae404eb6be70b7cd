import datetime as dt

from pyspark.sql import functions as F

from provenant.config import Settings, from_env
from provenant.functions import dates as D
from provenant.functions import text as T
from provenant.operators import amend, evidence, render, retrieve, segment


def one(spark, c, text="x", **cols):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(c.alias("r")).first()["r"]


def test_tokens_and_stems(spark):
    assert one(
        spark, T.tokens("t"), "Policies, boxes §4.3.2 4,000 determinations passed glass"
    ) == ["policy", "box", "§4.3.2", "4", "000", "determination", "pass", "glass"]


def test_spans(spark):
    got = one(spark, T.spans("t", r"\d+"), "12 ab 345 6")
    assert [(m["start"], m["end"]) for m in got] == [(0, 2), (6, 9), (10, 11)]
    assert one(spark, T.spans("t", r"\d+"), "none") == []


def test_claims(spark):
    got = one(spark, T.claims("t"), "within 1,200 calendar days, extended to 3 weeks or 5 per cent")
    assert [(c["value"], c["unit"], c["has_modifier"]) for c in got] == [("1200", "day", False), ("3", "week", True), ("5", "percent", True)]


def test_citations(spark):
    assert one(
        spark, T.citations("t"), "See §4.3.2 and Amendment No. 2026-01 §10.5.3A, §9.1.4"
    ) == ["4.3.2", "10.5.3A", "9.1.4"]


def test_dates(spark):
    d = lambda *a: dt.date(*a)
    assert one(
        spark, D.dates("t"), "from February 20, 2026 to 2026-03-05 or 31/01/2026, 2026-02-30"
    ) == [d(2026, 3, 5), d(2026, 2, 20), d(2026, 1, 31)]
    assert one(spark, D.dates("t"), "20 February 2026") == [d(2026, 2, 20), d(2026, 2, 15)]
    assert one(spark, D.dates("t"), "by March 1") == [d(2026, 3, 1)]
    assert one(
        spark, D.without_dates("t"), "What is due for a change occurring on 20 February 2026?"
    ) == "What is due for a change ?"


def test_fusion(spark):
    rows = [
        ("q", 0, 1, "a", 0, 0.9, "vector"), ("q", 0, 2, "b", 1, 0.8, "vector"), ("q", 1, 1, "b", 1, 5.0, "bm25"),
        ("q", 1, 2, "c", 2, 4.0, "bm25")
    ]
    got = retrieve.fuse(
        spark.createDataFrame(
            rows, "qid string, list_no int, rank int, clause_id string, pos int, score double, retriever string"
        )
    ).orderBy("rank").collect()
    assert [r["clause_id"] for r in got] == ["b", "a", "c"] and got[0]["retriever"] == "hybrid"


def test_fragments(spark):
    assert one(
        spark, segment.fragments("t", 10), "aaaa\n\nbbbb\n\ncccc\n\n" + "d" * 30
    ) == ["aaaa\n\nbbbb", "cccc", "d" * 30]


def test_replacements_are_literal(spark):
    assert one(spark, amend.replaced_table("t", F.lit("| $1 |")), "x\n| a |\n|---|\n| 1 |\ny") == "x\n| $1 |y"
    assert one(spark, amend.replaced_first("t", F.lit("$5"), F.lit("$6")), "$5 and $5") == "$6 and $5"
    assert one(spark, amend.replaced_all("t", F.lit("5"), F.lit("6")), "**5** or 5") == "**6** or 6"


def test_deferrals(spark):
    assert one(spark, evidence.deferral_targets("t"), "it is dealt with separately (see §7.1)") == ["7.1", "7.1"]
    assert one(spark, evidence.bare_deferral("t"), "it is addressed separately.") is True
    assert one(
        spark, evidence.preceding_condition("t", F.lit("7.1")), "If so, for a child (see §7.1)"
    ) == " for a child "


def test_citation_check(spark):
    lookup = spark.createDataFrame(
        [("4.3.2", "4.3", None), ("6.1.1", "6.1", None)],
        "clause_id string, section_number string, amendment_paragraph string"
    )
    a = spark.createDataFrame(
        [
            ("bad", "by §99.9.9", ["4.3.2"]), ("other", "by §6.1.1", ["4.3.2"]), ("none", "nothing", ["4.3.2"]),
            ("ok", "by §4.3.2", ["4.3.2"])
        ],
        "qid string, text string, supporting array<string>"
    )
    got = {r["qid"]: r for r in render.validate_citations(a, lookup).collect()}
    assert got["bad"]["invalid"] == ["99.9.9"] and got["other"]["unsupported"] == ["6.1.1"]
    assert got["none"]["valid"] and got["ok"]["valid"] and not got["bad"]["valid"] and "does not exist" in got["bad"]["issues"][0]


def test_settings():
    s = from_env(
        {
            "PROVENANT_RRF_K": "30", "PROVENANT_BM25_B": "bad", "PROVENANT_LLM_ENABLED": "Yes",
            "PROVENANT_BOUNDARY": "2027-01-01"
        }
    )
    assert (s.rrf_k, s.bm25_b, s.llm_enabled, s.boundary) == (30, Settings().bm25_b, True, dt.date(2027, 1, 1))


def test_bm25_by_hand(spark):
    import math

    docs = spark.createDataFrame([(0, "cat cat dog"), (1, "dog bird"), (2, "fish")], "pos int, text string")
    got = {(r["pos"], r["term"]): r["w"] for r in retrieve.bm25_postings(docs, "pos", "text").collect()}
    want = math.log(1 + (3 - 1 + 0.5) / 1.5) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2))
    assert abs(got[0, "cat"] - want) < 1e-12


def test_amended_rows_are_numbered_in_order(spark):
    rows = [
        ("A2", 1, 9000, "1"), ("A1", None, 9000, "2"), ("A1", 5, 9000, "1"), ("A1", 4, 9000, "1"), (None, 7, 9000, "1"),
        ("A1", 4, 9000, "0")
    ]
    df = spark.createDataFrame(rows, "amendment_id string, pos int, order int, amendment_paragraph string")
    got = amend.numbered(df, rows=2).orderBy("_at").collect()
    assert [r["_at"] for r in got] == list(range(6))
    assert [(r["amendment_id"], r["pos"], r["amendment_paragraph"]) for r in got] == [
        (None, 7, "1"), ("A1", 4, "0"), ("A1", 4, "1"), ("A1", 5, "1"), ("A1", None, "2"), ("A2", 1, "1")]
    assert amend.numbered(df.limit(0)).count() == 0
