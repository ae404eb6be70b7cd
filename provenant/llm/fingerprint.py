"""Document fingerprints: threshold-scaled sketches, in DataFrame functions only.

The sketch of a text is every 64-bit hash of its five-word shingles that lies
in the lowest 1/8 of the hash space (a fixed fraction, the same for every
document), so sketches of different documents are comparable and the sketch
of a union is the union of sketches: containment of a short document in a very
long one needs no more than the two sketches.

A short text may have no hash that low. Its sketch is empty, like that of no
text: it says nothing, its containment is unknown (null), and it adds nothing to
a union. A fingerprint is the sketch, or, if that is empty, ``=`` and a hash of
the words, so that equal texts have equal fingerprints and unlike ones do not;
two fingerprints without sketches are alike if they are equal.

Defined cases: a null text counts as empty; a text of fewer than five words
is one shingle; equal texts have equal sketches; letter case and the kind of
white space do not matter; an empty table gives no rows; a repeated id is a
row of its own, and rows with one id are ordered by their text; a very long
text is one row like any other; internal column names are free of the input's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_rows, free_name

FRACTION_BITS = 3  # the lowest 2**-3 of all hashes is kept
WORDS = 5
BLANK = " \t\n\x0b\x0c\r"


def with_sketch(
    df: DataFrame, text: str, out: str, words: int = WORDS, fraction_bits: int = FRACTION_BITS
) -> DataFrame:
    """``df`` with the sketch (sorted ``array<long>``) of column ``text`` and, as
    ``out`` with ``_whole`` behind it, a hash of all its words."""
    bound = -(2**63) + 2 ** (64 - fraction_bits)
    own = free_name(df)
    # a word is hashed once, and a shingle from the hashes of its words
    df = df.withColumn(
        f"{own}_w",
        F.transform(F.split(F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(BLANK)), r"\s+"), lambda w: F.xxhash64(w))
    )
    at = F.sequence(F.lit(0), F.greatest(F.size(f"{own}_w") - words, F.lit(0)))
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(f"{own}_w"), i + k) for k in range(words)]))
    df = df.withColumn(out, F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < F.lit(bound)))))
    return df.withColumn(f"{out}_whole", F.xxhash64(f"{own}_w")).drop(f"{own}_w")


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Estimated Jaccard similarity of two sketches, 0 to 1; null if both are empty."""
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: str | Column, b: str | Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has, 0 to 1; null if ``a`` is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: str | Column, b: str | Column) -> Column:
    """The sketch of two documents taken together."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: str, b: str) -> Column:
    """How alike two fingerprints are, 0 to 1: that of the sketches, or whether the
    texts are equal where both sketches are empty. Null sketches are not alike."""
    same = (F.col(f"{a}_whole") == F.col(f"{b}_whole")).cast("double")
    return F.coalesce(jaccard(a, b), same, F.lit(0.0))


def as_text(sketch: str) -> Column:
    """A fingerprint as text."""
    hashes = F.array_join(F.transform(sketch, lambda h: F.hex(h)), ".")
    return F.when(F.size(sketch) > 0, hashes).otherwise(F.concat(F.lit("="), F.hex(f"{sketch}_whole")))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sketch) of every document."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
    return with_sketch(d, "_t", "sketch").select("doc_id", "sketch")


def _bucket_of(value: Column, firsts: list[int]) -> Column:
    """How many of the sorted ``firsts`` are at most ``value``: two levels of
    search, so a row costs about twice the root of their number."""
    step = max(1, math.isqrt(len(firsts)))
    blocks = [firsts[i : i + step] for i in range(0, len(firsts), step)]
    heads = F.array(*[F.lit(b[0]) for b in blocks])
    inner = F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks])
    block = F.size(F.filter(heads, lambda x: x <= value))
    at = F.size(
        F.filter(F.coalesce(F.try_element_at(inner, block), F.array().cast("array<bigint>")), lambda x: x <= value)
    )
    return F.when(block <= 0, F.lit(0)).otherwise((block - 1) * step + at)


def edited_pairs(docs: DataFrame, *, rows_per_bucket: int = 2_000) -> DataFrame:
    """Every document beside its edited text and its successor by ascending id,
    with the sketches of the two documents.

    One exchange of the texts: rows go to buckets of consecutive ids whose
    first ids are quantiles of the id column (a number for each bucket reaches
    the driver), and the first row of each bucket is also sent, as a guard row,
    to the end of the bucket before it. Texts are sketched after the exchange,
    so each is sketched once, and a guard once more.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, low = docs.agg(F.count(F.lit(1)), F.min("doc_id")).first()
    buckets = max(1, math.ceil(n / bucket_rows(n, rows_per_bucket)))
    firsts = [low] if low is not None else []
    if buckets > 1 and firsts:
        cuts = [i / buckets for i in range(1, buckets)]
        firsts = sorted({low, *docs.agg(F.percentile_approx("doc_id", cuts, max(10_000, 10 * buckets))).first()[0]})
    last = len(firsts)  # bucket 0 holds the null ids, if any
    nulls = last > 0 and docs.where("doc_id is null").limit(1).count() > 0
    if last == 0:
        rows = d.withColumn("_b", F.lit(0)).withColumn("_g", F.lit(0))
        rows = rows.unionByName(rows.withColumn("_g", F.lit(1)))
    else:
        own = d.withColumn(
            "_b", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_bucket_of(F.col("doc_id"), firsts))
        ).withColumn("_g", F.lit(0))
        before = [(x, i if i else (0 if nulls else last)) for i, x in enumerate(firsts)]
        guards = F.broadcast(docs.sparkSession.createDataFrame(before, "_first long, _to int"))
        guard = d.join(guards, F.col("doc_id") == F.col("_first")).select(
            "doc_id", "text", F.col("_to").alias("_b"), F.lit(1).alias("_g")
        )
        rows = own.unionByName(guard)
        if nulls:
            rows = rows.unionByName(
                d.where("doc_id is null").select("doc_id", "text", F.lit(last).alias("_b"), F.lit(1).alias("_g"))
            )
    rows = with_sketch(rows.repartition("_b"), "text", "sketch")
    w = Window.partitionBy("_b").orderBy("_g", F.col("doc_id").asc_nulls_first(), "text")
    nxt = F.lead(F.struct("text", "sketch", "sketch_whole")).over(w)
    paired = rows.withColumn("_n", nxt).where("_g = 0")
    half = F.floor(F.char_length("text") / 2).cast("int")
    return paired.select(
        "doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), "sketch", "sketch_whole",
        F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"),
                 F.col("_n.text").substr(F.lit(1), half)).alias("edited"),
        F.col("_n.sketch").alias("next_sketch"), F.col("_n.sketch_whole").alias("next_sketch_whole"),
    )


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """The whole contract row of each document; see the module's docstring."""
    p = with_sketch(edited_pairs(docs), "edited", "edited_sketch")
    return p.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text("sketch").alias("fingerprint"), as_text("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"),
    )
