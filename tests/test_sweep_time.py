"""The sweep reads a text once, in batches, with the results of the column expressions."""

import random

from provenant.functions import text as T
from provenant.operators import contradict
from provenant.plans.storage import Scratch
from pyspark.sql import functions as F

COLUMNS = ("qid", "a_id", "b_id", "unit", "value_a", "value_b")
ODD = [
    None, "", "Charges, 5 DAYS, stations; taxes & boxes", "increased to 3 days or 1,200 per cent", "ſ 3 dayſ 7 İdays", "§4.2 ties 30calendar  weeks",
    "５ days", "12 12 classes passed 7%", "fees within 3 days\n4 weeks 2.5 years", "rather than 9 Months and 8 months", "K 5 weeKs Σ ΑΣ x",
]


def swept(df, columns=COLUMNS):
    none = df.sparkSession.createDataFrame([], "qid int, a_id string, b_id string")
    return sorted(map(tuple, contradict.mismatched(df, none, columns=columns, few=1).select(*COLUMNS).collect()))


def versions(spark, n=260, seed=8):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(9)]
    rows = [(
        rng.randrange(2), i // 2, f"{rng.randrange(60)}",
        " ".join(rng.sample(words, rng.randint(2, 7))) + rng.choice([" 3 days", " 4 days", " 2 weeks or 3 days", " increased to 9 days", " 3 days or 5 days", ""])
    ) for i in range(n)]
    return spark.createDataFrame(rows, "qid int, idx int, clause_id string, text string")


def test_tokens_and_figures_are_those_of_the_expressions(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    for r in df.select("t", F.lower("t").alias("low"), T.content_tokens("t").alias("w"), T.claims("t").alias("c")).collect():
        assert contradict._contents(r["low"]) == (r["w"] or []), r["t"]
        plain = [(x["value"], x["unit"]) for x in r["c"] or [] if not x["has_modifier"]]
        assert contradict._plain_figures(r["t"], contradict.DEFAULTS.modifier_window) == plain, r["t"]


def test_batches_find_what_expressions_find(spark):
    df = versions(spark)
    want = swept(df, contradict.FINDING)  # has texts, so it goes by expressions
    assert len(want) > 50 and swept(df) == want
    struct = df.withColumn("idx", F.struct(F.when(F.col("idx") % 5 > 0, F.col("idx") % 5).alias("x"), F.col("idx").cast("string").alias("y")))
    assert swept(struct) == swept(struct, contradict.FINDING)


def test_few_bits_of_hashes_lose_nothing(spark, monkeypatch):
    df = versions(spark)
    want = swept(df)
    monkeypatch.setattr(contradict, "HASHES", 3)
    assert swept(df) == want


def test_no_pair_reads_its_texts_again(spark, monkeypatch):
    plans, table = [], Scratch.table

    def kept(self, df, name, *a, **k):
        if name == "findings":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return table(self, df, name, *a, **k)

    monkeypatch.setattr(Scratch, "table", kept)
    assert swept(versions(spark)) and plans and "regexp_extract_all" not in "".join(plans)
