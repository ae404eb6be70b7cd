"""The stages, one after another, over the driver's small tables."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
    assert seen[0] >= seen[1] >= seen[3] >= seen[4] > 0 and seen[1] == seen[2]
    kept = {
        r["doc_id"] for r in spark.read.parquet(str(tmp_path / "benchmark_decontamination")).select("doc_id").collect()
    }
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == kept


LABELS = [(i, i % 2, i % 3 == 0) for i in range(40)]
ROWS = [
    (i, f"document number {i} has a few words of its own, as {i * i} and {i * 7} are\nand a second line")
    for i in range(40)
] + [(41, None), (42, ""), (None, "no id at all"), (None, None), (7, "again the id of another"), (43, "long " * 50_000)]


def small(spark, sf, rows):
    """A folder of tables, documents with names that the stages use themselves."""
    docs = spark.createDataFrame(
        [(*r, "en", "s", 5, "x", 1, 0.5, "y", "z", 3) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars int, _keys string, n_lines int, score double, `_pv` string, item_id string, `a.b` int"
    )
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(
        [(i, q, int(t)) for i, q, t in LABELS], "doc_id long, quality int, toxic int"
    ).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(
        [(1, "a benchmark item of ten words or so that leaks"), (2, None)], "item_id long, text string"
    ).write.parquet(f"{sf}/benchmark.parquet")


@pytest.mark.parametrize("rows", [[], ROWS])
def test_stages_take_odd_tables(spark, tmp_path, rows):
    sf = str(tmp_path / "sf")
    small(spark, sf, rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i + 1 < len(corpus_pipeline.STAGES):
            if name != "line_dedup":
                assert out.columns == docs.columns, name
            out.write.parquet(f"{sf}/{name}")
            assert out.count() <= docs.count()
    assert out.count() >= (0 if not rows else 1)


def left(spark) -> list[str]:
    """Files of the operators' own tables that are still there."""
    import gc
    import time

    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    for _ in range(40):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        files = [os.path.join(d, f) for d, _, fs in os.walk(where) for f in fs if f.startswith("part-")]
        if not files:
            return []
        time.sleep(0.25)
    return files


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize(
    "name", ["op1_sharding", "op5_ngram_join", "op6_packing", "op8_toxicity", "op10_line_dedup", "pipeline"]
)
def test_no_table_is_left(spark, tmp_path, name):
    """What a query wrote on its way is gone once its result is written and let go."""
    out = entry.queries()[name](spark, SF)
    out.write.parquet(str(tmp_path / "out"))
    del out
    assert not left(spark)


def test_names():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
