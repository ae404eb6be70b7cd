"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded digest inside their stratum, get the fractional
rank ``(rank + u) / n`` there (``u`` a fixed offset of the stratum, so that
many small strata do not all meet at one place), are put in order of that
fraction, and the order is cut into shards whose row counts differ by at most
one. Every prefix of the order, hence every shard, matches the mixture.

Defined cases: a null stratum is a stratum of its own; a null text has no
bytes (size 16, crc 0); a null or repeated id is an ordinary row, ties are
broken by digest, id, crc and size; an empty table gives no rows; a very long
text is one row of its size; only the named columns are read, so further
columns never clash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_rows, checkpointed, salted_rank


def _u32(hex_digest):
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long")


def interleave(
    docs: DataFrame, n_shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text",
    stratum_col: str = "source", seed: int = 20, rows_per_bucket: int = 500,
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("")).alias("_s"),
        F.md5(
            F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), "UTF-8")
        ).alias("_k"),
    )
    n = docs.count()
    buckets = max(1, math.ceil(n / bucket_rows(n, rows_per_bucket)))
    base = base.withColumn("_b", F.floor(_u32(F.col("_k")) * F.lit(buckets) / F.lit(2**32)).cast("int"))
    order = ["_k", "doc_id", "text_crc32", "size"]
    ranked = salted_rank(base, ["_s"], order, "_b", "_r", "_ns")
    start = _u32(F.md5(F.encode("_s", "UTF-8"))) / F.lit(float(2**32))
    ranked = ranked.withColumn("_f", (F.col("_r") + start) / F.col("_ns")).drop("_r", "_ns", "_b")
    ranked = checkpointed(ranked)
    ranked = ranked.withColumn("_g", F.least(F.floor(F.col("_f") * buckets), F.lit(buckets - 1)).cast("int"))
    placed = salted_rank(ranked, [], ["_f", "_s", *order], "_g", "_p")
    shard = F.expr(f"(_p * {n_shards}L) div {max(n, 1)}L")
    first = F.expr(f"(_sh * {max(n, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return placed.withColumn("_sh", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.col("_sh").cast("int").alias("shard"), (F.col("_p") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
