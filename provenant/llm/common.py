"""What the operators of this subpackage share: written tables, bounded labelled samples, distributed ranks and connected components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..plans.storage import Scratch, shared_dir  # noqa: F401
from ..plans.storage import cut as checkpointed


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with."""
    name = "_pv"
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"
    return name


def map_rows(
    docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType
) -> DataFrame:
    """``mapInArrow`` over all columns, whatever their names: inside, the columns of
    what comes and of what is returned are called c0, c1 and so on."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    inside = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    return plain.mapInArrow(run, inside).toDF(*schema.names)


def texts(column, rows: int = 500):
    """The values of an Arrow column, a slice at a time: a batch may hold many
    long texts, and only a slice of them is copied into Python."""
    for i in range(0, len(column), rows):
        yield from column.slice(i, rows).to_pylist()


def crc_mod(id_col: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")) % n


def order_hash(*cols: Column, seed: int = 0) -> Column:
    """A seeded, uniform, unsigned 32-bit number: decides samples and buckets."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 32)


def labelled_sample(docs: DataFrame, label: str, classes: dict, per_class: int, total: int, *keep: Column) -> DataFrame:
    """At most ``total`` rows, about ``per_class`` of each label, chosen by a hash.

    ``classes`` has the number of rows of each label. Rows whose hash falls
    under their label's share are kept, so one pass is enough, and the top
    ``total`` by hash bound what reaches the driver.
    """
    share = F.lit(0)
    for value, n in classes.items():
        share = F.when(
            F.col(label) == F.lit(value), F.lit(int(min(1.0, per_class / max(1, n)) * 2**32))
        ).otherwise(share)
    h = order_hash(F.col("doc_id"), seed=7)
    return docs.where(h < share).select(*keep, h.alias("_h")).orderBy("_h").limit(total).drop("_h")


def bucket_rows(n: int, least: int) -> int:
    """Rows that a bucket of ``n`` rows should hold: their root, so that neither a
    bucket nor the number of buckets grows as fast as the rows do."""
    return max(least, math.isqrt(max(0, n)))


def salted_rank(
    df: DataFrame, by: list[str], order: list[str], bucket: str, rank: str, total: str | None = None
) -> DataFrame:
    """0-based rank in ``by`` ordered by (``bucket``, ``order``).

    ``bucket`` is an integer column that splits every group over tasks; only
    one (group, bucket) is sorted in a task, and the offsets come from counts
    that are aggregated before they are shuffled.
    """
    counts = df.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    counts = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    if total:
        counts = counts.withColumn(total, F.sum("_n").over(w))
    own = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, bucket).orderBy(*order)))
    out = own.join(counts.drop("_n"), [*by, bucket])
    return out.withColumn(rank, F.col("_off") + F.col("_rn") - 1).drop("_off", "_rn")


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, n: str, total: int, parts: int = 1024) -> DataFrame:
    """``rows`` joined with ``per_key``, which has one row a key; ``n`` is its
    number of rows, and ``total`` all of them. A key that holds more than a
    ``parts``-th of the rows is sent about, and its rows stay where they are:
    there are fewer than ``parts`` such keys, at any size. The others are
    dealt by key. Rows of a null key find no partner."""
    least = max(1, total // parts)
    hot = F.broadcast(per_key.where(F.col(n) > least))
    rest = rows.join(F.broadcast(per_key.where(F.col(n) > least).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(per_key.where(F.col(n) <= least), key))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of an edge list: rows (node, component), component
    the smallest node reachable. Alternating large-star and small-star steps;
    no component and no adjacency list is ever gathered in one task (the rows
    of a node with very many neighbours are not dealt by node), and every round
    is written to the shared folder."""
    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    with Scratch(edges.sparkSession) as tmp:
        e = edges.select(
            F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v")
        ).where("u <> v").distinct()
        last = tmp.table(e, "edges")
        was = mark(last)
        while was[0]:
            both = last.unionByName(last.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(
                F.min("v").alias("m"), F.count(F.lit(1)).alias("n")
            ).withColumn("m", F.least("m", "u"))
            large = spread_join(both.where("v > u"), low, "u", "n", 2 * was[0])
            large = tmp.table(
                large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges"
            )
            low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
            small = spread_join(large, low, "u", "n", 2 * was[0]).select("v", "m").where("v <> m").select(
                F.col("v").alias("u"), F.col("m").alias("v")
            )
            now = tmp.table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
            tmp.drop(last)
            tmp.drop(large)
            last, old, was = now, was, mark(now)
            if was == old:
                break
        tops = last.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return checkpointed(last.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops))
