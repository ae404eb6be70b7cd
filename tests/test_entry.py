"""The driver's entry points, and parity with SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
FAST = [
    "stem_vocab", "clause_refs", "numeric_claims", "segment_lines", "substitute_first", "bm25_topk",
    "rrf_duplicate_keys", "dates_all", "date_context", "asof_version", "support_margin", "deferral_targets",
    "assertion_mismatch", "validate_citations"
]


def rows(df):
    df = df[sorted(df.columns)]
    show = lambda v: None if v is None or v != v else str(v)[:10] if hasattr(v, "year") else round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "item") else v
    return sorted(repr([show(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", FAST)
def test_parity(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_oracle_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
