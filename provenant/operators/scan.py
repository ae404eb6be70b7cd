"""Running state over rows that are too many for one task: an associative two-level scan.

Rows of a key are dealt in chunks. The state at the end of each chunk is an
aggregate, of which a key has one row a chunk; what went before a chunk is the
running state of these few rows; and within a chunk a plain window does the
rest. No task ever holds more than a chunk of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4_096


def before(chunks: DataFrame, key: str, chunk: str, sums: list[str], lasts: list[str] = (), own: list[str] = ()) -> DataFrame:
    """(_k, _c, ..) of (key, chunk, ..), a row a chunk: the sums of all earlier chunks,
    the last value that is not null in any of them, and columns of the chunk's own."""
    w = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.select(
        F.col(key).alias("_k"), F.col(chunk).alias("_c"), *own,
        *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.last(c, ignorenulls=True).over(w).alias(f"_before_{c}") for c in lasts],
    )


def with_before(rows: DataFrame, key: str, chunk: str, prior: DataFrame) -> DataFrame:
    """``rows`` beside what went before their chunk; a null key is a key."""
    return rows.join(prior, F.col(key).eqNullSafe(F.col("_k")) & F.col(chunk).eqNullSafe(F.col("_c"))).drop("_k", "_c")


def numbered(rows: DataFrame, key: str, chunk: Column, order: list[str], name: str) -> DataFrame:
    """``rows`` numbered from 1 within ``key`` by ``order``; ``chunk`` must not fall as the order rises."""
    rows = rows.withColumn("_chunk", chunk)
    counts = rows.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(*order))
    own = with_before(rows.withColumn("_place", place), key, "_chunk", before(counts, key, "_chunk", ["n"]))
    return own.withColumn(name, F.col("_before_n") + F.col("_place")).drop("_chunk", "_place", "_before_n")
