"""Readers and writers; every schema is given, none is inferred."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import scan
from ..operators import segment as seg


class ManualNotFoundError(FileNotFoundError):
    """The manual is missing or blank."""


class IndexNotFoundError(FileNotFoundError):
    """No index was saved in that folder."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_manuals(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of each file; any store that Spark reads."""
    if not any(c in path for c in "*{[") and not _exists(spark, path):
        raise ManualNotFoundError(f"manual not found: {path}")
    out = spark.read.text(path, wholetext=True).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"), F.col("value").alias("text")
    )
    if not out.where(F.regexp_replace("text", r"\s", "") != "").limit(1).count():
        raise ManualNotFoundError(f"manual not found or blank: {path}")
    return out


def read_manual_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_no, line) of each file, as :func:`segment.lines_of` numbers them,
    though no task reads a whole file: a split numbers its own lines, and what the
    splits before it hold, one row a split, is added. An empty file has no lines."""
    if not any(c in path for c in "*{[") and not _exists(spark, path):
        raise ManualNotFoundError(f"manual not found: {path}")
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    splits = rows.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    prior = scan.before(splits, "file", "split", ["n"], own=["first"])
    return scan.with_before(rows, "file", "split", prior).select(
        F.element_at(F.split("file", "/"), -1).alias("source"),
        (F.col("_before_n") + F.col("at") - F.col("first") + 1).alias("line_no"), "line"
    )


def clause_table(manuals: DataFrame) -> DataFrame:
    """The clause table of (source, text), positions counted from 0 by source."""
    return clauses_of_lines(seg.lines_of(manuals, "source", "text"))


def clauses_of_lines(lines: DataFrame) -> DataFrame:
    """The same of (source, line_no, line)."""
    c = seg.split_oversized(seg.segment(lines))
    c = scan.numbered(c, "source", F.floor(F.col("order") / scan.CHUNK), ["line_start", "order"], "_n")
    none = lambda t: F.lit(None).cast(t)
    return c.select(
        "clause_id", "citation", "part_number", "part_title", "section_number", "section_title", "text", "order",
        "line_start", "line_end", "source",
        none("date").alias("effective_from"), none("date").alias("effective_to"), none("string").alias("amendment_id"),
        none("string").alias("amendment_paragraph"),
        F.lit(False).alias("is_amended_version"), none("string").alias("date_condition_type"),
        (F.col("_n") - 1).cast("int").alias("pos"))


def amendments(spark: SparkSession, specs: Iterable[dict]) -> DataFrame:
    """Amendment specifications given in code."""
    rows = spark.createDataFrame([(json.dumps(s, default=str),) for s in specs], "j string")
    return rows.select(F.from_json("j", schemas.AMENDMENT).alias("s")).select("s.*")


def read_amendments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.AMENDMENT).json(path, multiLine=True)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.QUESTIONS).json(path, multiLine=True)


def read_words(spark: SparkSession, path: str) -> list[str]:
    """A word list, one word a line, as for the stopwords of the vector space."""
    return [w for r in spark.read.text(path).collect() if (w := r[0].strip().lower())]


def save_index(index: dict[str, DataFrame], path: str) -> None:
    for name, df in index.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that were saved there, whatever the embedding keeps."""
    if not _exists(spark, f"{path}/clauses"):
        raise IndexNotFoundError(f"no index in {path}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return {name: spark.read.parquet(f"{path}/{name}") for name in sorted(f.getPath().getName() for f in found)}
