"""The index in files against exhaustive scoring."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from provenant.operators import postings, retrieve

SF = "/root/testdata/sf0.01"


def corpus(n=600, seed=3, words=400):
    """Words of a Zipf law, with plurals that stems join."""
    rng = random.Random(seed)
    pick = lambda k: [f"word{int(words * rng.random() ** 4)}{rng.choice(['', 's'])}" for _ in range(k)]
    return [(i, " ".join(pick(rng.randint(3, 60)))) for i in range(n)]


def rounded(df, digits=6):
    return sorted((r["qid"], r["key"], round(r["score"], digits), r["rank"]) for r in df.collect())


def exhaustive(questions, docs, k):
    return rounded(retrieve.bm25_topk(questions, docs, "key", "text", k, digits=6))


@pytest.fixture(scope="module")
def small(spark):
    rows = [*corpus(), (900, None), (901, ""), (902, "word0 word0 word0"), (903, "§ 4.1.2"), (904, "word1"), (905, "word1")]
    asked = [("a", "word0 word399 word3"), ("b", "word0"), ("c", "nothing known"), ("d", "word1s word1"), ("e", "")]
    asked += [(f"q{i}", t) for i, t in corpus(30, 9)]
    return (
        spark.createDataFrame(rows, "key long, text string").repartition(3),
        spark.createDataFrame(asked, "qid string, question string")
    )


@pytest.mark.parametrize("k,seed_rows", [(3, 1), (12, 200), (1000, 5000)])
def test_topk_is_exhaustive(spark, small, tmp_path, k, seed_rows):
    docs, asked = small
    index = postings.LexicalIndex.build(docs, "key", "text", str(tmp_path))
    got = postings.LexicalIndex.open(spark, str(tmp_path)).topk(asked, k, digits=6, seed_rows=seed_rows)
    assert rounded(got) == exhaustive(asked, docs, k)
    assert index.stats()[0] == docs.count()


def test_upkeep_is_a_rebuild(spark, small, tmp_path):
    """Insert, amend and delete, then compaction: as if built from what is left."""
    docs, asked = small
    rows = {r["key"]: r["text"] for r in docs.collect()}
    first = spark.createDataFrame([(k, t) for k, t in rows.items() if k % 3], "key long, text string")
    second = spark.createDataFrame([(k, t) for k, t in rows.items() if k % 3 == 0], "key long, text string")
    changed = {k: f"word0 {t} amended{k % 4}" for k, t in rows.items() if k % 10 == 4}
    left = {k: changed.get(k, t) for k, t in rows.items() if k % 7}
    made = lambda d: spark.createDataFrame(list(d.items()), "key long, text string")
    index = postings.LexicalIndex.build(first, "key", "text", str(tmp_path / "a")).insert(second)
    index = index.amend(made(changed)).delete(made({k: "" for k in rows if k % 7 == 0}))
    index = index.delete(made({k: "" for k in rows if k % 7 == 0}))  # once more: nothing is left to delete
    want = sorted((r["key"], r["term"], round(r["w"], 9)) for r in retrieve.bm25_postings(made(left), "key", "text").collect())
    compacted = index.compact(str(tmp_path / "b"))
    for it in (index, postings.LexicalIndex.open(spark, str(tmp_path / "a")), compacted):
        assert sorted((r["key"], r["term"], round(r["w"], 9)) for r in it.postings().collect()) == want
        assert rounded(it.topk(asked, 5, digits=6)) == exhaustive(asked, made(left), 5)
    assert len(compacted.parts) == 1 and len(index.parts) == 6


def test_update_touches_its_ranges_only(spark, tmp_path):
    """A deletion reads the blocks of ranges with such documents, and writes the terms
    of these documents."""
    docs = spark.createDataFrame([(i, f"common own{i}") for i in range(3 * postings.RANGE)], "key long, text string").coalesce(1)
    index = postings.LexicalIndex.build(docs, "key", "text", str(tmp_path)).delete(docs.where("key = 5"))
    terms = {r["term"]: r["df"] for r in spark.read.parquet(f"{tmp_path}/000001-gone/terms").collect()}
    assert terms == {"common": 1, "own5": 1}
    assert {r["term"]: r["df"] for r in index.terms().where("term in ('common', 'own5', 'own6')").collect()} == {
        "common": 3 * postings.RANGE - 1, "own6": 1
    }


def test_no_segment_half_written(spark, small, tmp_path):
    docs, asked = small
    index = postings.LexicalIndex.build(docs, "key", "text", str(tmp_path))
    os.makedirs(tmp_path / "000001-added" / "blocks")
    assert postings.LexicalIndex.open(spark, str(tmp_path)).parts == index.parts
    assert postings.LexicalIndex.open(spark, str(tmp_path / "none")).topk(asked, 3).count() == 0


def test_hot_terms_are_split(spark, tmp_path):
    """On a Zipf corpus a block never has more than a range, and the blocks of the
    most frequent term lie in many tasks' files."""
    n = 6 * postings.RANGE
    docs = spark.range(0, n, 1, 1).selectExpr("id as key", "concat('the ', 'w', floor(pow(rand(1), 4) * 500)) as text")
    postings.LexicalIndex.build(docs, "key", "text", str(tmp_path))
    blocks = spark.read.parquet(f"{tmp_path}/000000-added/blocks")
    assert blocks.agg(F.max("n")).first()[0] <= postings.RANGE
    assert blocks.where("term = 'the'").count() == 6
    shares = [r["n"] for r in blocks.repartition(4, "term", "range").groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect()]
    assert max(shares) <= 2 * sorted(shares)[len(shares) // 2]


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_blocks_skipped(spark, tmp_path):
    """On the driver's texts, whole passages as questions: equal rows, fewer blocks."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("key"), "text")
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    bits, postings.RANGE_BITS, postings.RANGE = postings.RANGE_BITS, 5, 32
    try:
        index = postings.LexicalIndex.build(docs, "key", "text", str(tmp_path / "narrow"))
        for k, most in ((1, 0.75), (12, 0.97)):
            counted = {}
            got = rounded(index.topk(asked, k, digits=6, seed_rows=200, counted=counted))
            assert got == exhaustive(asked, docs, k)
            print(k, counted)
            assert counted["pairs_read"] < most * counted["pairs"]
    finally:
        postings.RANGE_BITS, postings.RANGE = bits, 1 << bits


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_blocks_are_small(spark, tmp_path):
    """Less than half of the bytes of plain postings."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.col("doc_id").alias("key"), "text")
    postings.LexicalIndex.build(docs, "key", "text", str(tmp_path / "index"))
    retrieve.bm25_postings(docs, "key", "text").sortWithinPartitions("term").write.parquet(str(tmp_path / "plain"))
    assert 2 * size_of(tmp_path / "index" / "000000-added" / "blocks") < size_of(tmp_path / "plain")


def test_terms_prune_by_hand():
    """The bound holds for any mean length."""
    rng, s = random.Random(1), postings.DEFAULTS
    part = lambda f, dl, mean: f * (s.bm25_k1 + 1) / (f + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * dl / mean))
    groups = defaultdict(list)
    for _ in range(3000):
        f = rng.randint(1, 20)
        groups[rng.randrange(100)].append((f, f * rng.uniform(1, 30)))
    for rows in groups.values():
        top, ratio = max(f for f, _ in rows), min(dl / f for f, dl in rows)
        for mean in (1.0, 37.5, 900.0):
            k, b = s.bm25_k1, s.bm25_b
            bound = (k + 1) / (1 + k * (1 - b) / top + k * b * ratio / mean)
            assert all(part(f, dl, mean) <= bound * (1 + 1e-12) for f, dl in rows)
