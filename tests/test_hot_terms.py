"""Terms as uneven as words are: what is shuffled by term is even, and nothing is lost."""

import numpy as np
from provenant.operators import retrieve
from pyspark.sql import functions as F

PARTS = 16


def zipf(spark, docs=4_000, vocabulary=20_000):
    rng = np.random.default_rng(3)
    p = 1 / np.arange(1, vocabulary + 1)
    words = rng.choice(vocabulary, (docs, 60), p=p / p.sum())
    rows = [(i, " ".join(f"w{x}x" for x in row)) for i, row in enumerate(words.tolist())]
    return spark.createDataFrame(rows, "doc int, text string")


def sizes(df):
    """Rows that each task of a join by term would read."""
    n = [r[1] for r in df.repartition(PARTS, "term").groupBy(F.spark_partition_id()).count().collect()]
    return sorted(n + [0] * (PARTS - len(n)))


def test_no_task_of_a_term_join_reads_over_twice_the_median(spark):
    docs = zipf(spark)
    counts = retrieve.stemmed(docs, "doc", "text").groupBy("doc", "term").agg(F.count(F.lit(1)).alias("f"))
    df = retrieve.document_frequency(counts)
    most, least = retrieve.by_frequency(df, 4_096)
    plain, even = sizes(counts), sizes(retrieve.rare_postings(counts, most))
    assert plain[-1] > 1.3 * plain[PARTS // 2]  # the corpus is uneven
    assert even[-1] <= 1.2 * even[PARTS // 2] and sum(even) < 0.6 * sum(plain)
    # what stays is bounded by the number of frequent terms
    n = sum(plain)
    assert 0 < most.count() <= 4_096 and most.agg(F.min("df")).first()[0] >= n / 4_096
    assert least.agg(F.max("df")).first()[0] < n / 4_096 and most.count() + least.count() == df.count()


def test_every_posting_meets_its_term_once(spark):
    docs = zipf(spark, 300, 2_000)
    counts = retrieve.stemmed(docs, "doc", "text").groupBy("doc", "term").agg(F.count(F.lit(1)).alias("f"))
    df = retrieve.document_frequency(counts)
    want = sorted(map(tuple, counts.join(df, "term").select("doc", "term", "f", "df").collect()))
    for hot in (1, 50, 1_000_000):
        got = retrieve.join_terms(counts, df, hot).select("doc", "term", "f", "df").collect()
        assert sorted(map(tuple, got)) == want
    assert retrieve.join_terms(counts.limit(0), df.limit(0)).count() == 0
