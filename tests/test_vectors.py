"""The vector index against exhaustive comparison."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant.operators import retrieve, vectors

SF = "/root/testdata/sf0.1"


def clustered(n=3000, groups=40, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(groups, dim))
    v = c[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * 0.35
    return [(i, [float(x) for x in r]) for i, r in enumerate(np.round(v, 2))]


SCHEMA = "key long, vector array<double>"


def listed(df, key="key"):
    return sorted((r["qid"], r["rank"], r[key], round(r["score"], 6)) for r in df.collect())


def recall(got, want):
    a, b = ({(x[0], x[2]) for x in rows} for rows in (got, want))
    return len(a & b) / len(b)


def test_recall_and_exact(spark, tmp_path):
    df = spark.createDataFrame(clustered(), SCHEMA)
    asked = df.where("key % 20 = 0").select(F.col("key").alias("qid"), F.col("vector").alias("qe"))
    want = listed(retrieve.dense_topk(asked, df, "key", "vector", 12, digits=6))
    index, counted = vectors.VectorIndex.build(df, "key", "vector", str(tmp_path)), {}
    assert index.rows.count() == df.count() and index.rows.select("key").distinct().count() == df.count()
    got = listed(index.topk(asked, 12, digits=6, counted=counted))
    assert recall(got, want) >= 0.9 and counted["compared"] < 0.35 * counted["pairs"]
    exact = {}
    assert listed(vectors.VectorIndex(spark, str(tmp_path)).topk(asked, 12, digits=6, exact=True, counted=exact)) == want
    assert exact["compared"] < exact["pairs"]


def test_hot_cell_and_odd_rows(spark, tmp_path):
    """A third of all rows are one vector: its cell is dealt over pieces; ties go to the
    lower key. Null and zero vectors, null keys and blocks of questions."""
    rows = clustered(600) + [(10_000 + i, [1.0] * 16) for i in range(300)]
    rows += [(20_000, None), (None, [1.0] * 16), (20_001, [0.0] * 16)]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame(
        [(-1, [1.0] * 16), (-2, [0.0] * 16), (5, rows[5][1]), (-3, None), (10_001, [1.0] * 16)], "qid long, qe array<double>"
    )
    index = vectors.VectorIndex.build(df, "key", "vector", str(tmp_path), piece_rows=100)
    assert index.cells.agg(F.max("pieces")).first()[0] >= 3
    good = df.where("key is not null and vector is not null")
    want = listed(retrieve.dense_topk(asked.where("qe is not null"), good, "key", "vector", 5, digits=6))
    for block in (1, 4_000):
        assert listed(index.topk(asked, 5, digits=6, exact=True, block=block)) == want
    assert [r[2] for r in want if r[0] == -1] == [10_000, 10_001, 10_002, 10_003, 10_004]


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([(1, [1.0])], "qid long, qe array<double>")
    assert vectors.VectorIndex.build(df, "key", "vector", str(tmp_path)).topk(asked, 3).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_recall_on_the_tables(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qe"))
    want = listed(retrieve.dense_topk(asked, e, "vec_id", "embedding", 12, digits=6), "vec_id")
    index, counted = vectors.VectorIndex.build(e, "vec_id", "embedding", str(tmp_path)), {}
    probes = index.probes_for(0.93)
    got = listed(index.topk(asked, 12, digits=6, probes=probes, counted=counted))
    print(probes, recall(got, want), counted)
    assert recall(got, want) >= 0.9 and counted["compared"] < counted["pairs"]
    assert listed(index.topk(asked, 12, digits=6, exact=True)) == [(q, r, k, s) for q, r, k, s in want]
