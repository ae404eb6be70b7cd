"""Amendments: change rules laid over a clause table as effective-dated versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col

MARKDOWN_TABLE = r"\|[^\n]*\|\n(?:\|[^\n]*\|\n?)+"


def replaced_all(text: str | Column, find: str | Column, to: str | Column) -> Column:
    """Every literal occurrence, the bold form first."""
    t, f, r = col(text), col(find), col(to)
    bold = lambda x: F.concat(F.lit("**"), x, F.lit("**"))
    return F.replace(F.replace(t, bold(f), bold(r)), f, r)


def replaced_first(text: str | Column, find: str | Column, to: str | Column) -> Column:
    t, f, r = col(text), col(find), col(to)
    at = F.locate_col(f, t) if hasattr(F, "locate_col") else F.instr(t, f)
    return F.when(
        at > 0, F.concat(F.substring(t, F.lit(1), at - 1), r, F.substring(t, at + F.char_length(f), F.char_length(t)))
    ).otherwise(t)


def replaced_table(text: str | Column, table: str | Column) -> Column:
    """The first markdown table replaced, or the table appended."""
    t, n = col(text), col(table)
    old = F.regexp_extract(t, MARKDOWN_TABLE, 0)
    return F.when(old != "", replaced_first(t, old, n)).otherwise(F.concat(t, F.lit("\n\n"), n))


def _rules(specs: DataFrame, field: str) -> DataFrame:
    own = specs.select("amendment_id", "effective_date", "source_file", F.explode(field).alias("r"))
    return own.select("amendment_id", "effective_date", "source_file", "r.*")


def _stamp(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("source", F.col("source_file")).withColumn("amendment_id", F.col("_amendment"))
        .withColumn("amendment_paragraph", F.col("paragraph")).withColumn("is_amended_version", F.lit(True))
        .withColumn("effective_from", F.col("effective_date")).withColumn("date_condition_type", F.col("_condition"))
    )


def _for_join(rules: DataFrame) -> DataFrame:
    return rules.withColumnRenamed("amendment_id", "_amendment").withColumnRenamed(
        "date_condition_type", "_condition"
    ).withColumnRenamed("text", "_text")


def substitutions(clauses: DataFrame, specs: DataFrame) -> DataFrame:
    rules = _for_join(_rules(specs, "substitutions"))
    j = clauses.join(rules, F.col("clause_id") == F.col("target_clause_id"))
    text = F.when(
        F.col("replace_all"), replaced_all("text", "find_text", "replace_text")
    ).otherwise(replaced_first("text", "find_text", "replace_text"))
    return _stamp(j.withColumn("text", text)).select(*clauses.columns)


def table_replacements(clauses: DataFrame, specs: DataFrame) -> DataFrame:
    rules = _for_join(_rules(specs, "table_replacements"))
    j = clauses.join(rules, F.col("clause_id") == F.col("target_clause_id"))
    return _stamp(j.withColumn("text", replaced_table("text", "new_table"))).select(*clauses.columns)


def insertions(clauses: DataFrame, specs: DataFrame) -> DataFrame:
    """Inserted clauses; titles are those of the clause they follow."""
    rules = _for_join(_rules(specs, "insertions"))
    after = clauses.select(
        F.col("clause_id").alias("after_clause_id"), F.col("part_title").alias("_pt"),
        F.col("section_title").alias("_st")
    )
    j = rules.join(after, "after_clause_id", "left")
    own = {
        "clause_id": F.col("new_clause_id"), "citation": F.concat(F.lit("§"), "new_clause_id"), "text": F.col("_text"),
        "part_number": F.substring_index("after_clause_id", ".", 1),
        "section_number": F.substring_index("after_clause_id", ".", 2),
        "part_title": F.coalesce("_pt", F.lit("")), "section_title": F.coalesce("_st", F.lit("")), "order": F.lit(9000),
        "line_start": F.lit(0), "line_end": F.lit(0), "effective_to": F.lit(None).cast("date"),
    }
    for k, v in own.items():
        j = j.withColumn(k, v)
    return _stamp(j.withColumn("pos", F.lit(None).cast("int"))).select(*clauses.columns)


def transitional(clauses: DataFrame, specs: DataFrame) -> DataFrame:
    """Transitional provisions as clause rows; not part of :func:`versions` by default."""
    r = _rules(specs, "transitional_provisions")
    own = {
        "clause_id": F.concat(F.lit("A"), "amendment_id", F.lit("-"), "provision_id"),
        "citation": F.concat(F.lit("Amendment No. "), "amendment_id", F.lit(" §"), "provision_id"),
        "part_number": F.lit("0"), "part_title": F.concat(F.lit("Amendment No. "), "amendment_id"),
        "section_number": F.lit("5"), "section_title": F.lit("Transitional provision"),
        "order": F.lit(9100), "line_start": F.lit(0), "line_end": F.lit(0), "source": F.col("source_file"),
        "effective_from": F.col("effective_date"),
        "effective_to": F.lit(None).cast("date"), "amendment_paragraph": F.col("provision_id"),
        "is_amended_version": F.lit(False), "pos": F.lit(None).cast("int"),
    }
    for k, v in own.items():
        r = r.withColumn(k, v)
    return r.select(*clauses.columns)


def superseded(clauses: DataFrame, specs: DataFrame) -> DataFrame:
    """The originals; those a rule rewrites end the day before it takes effect."""
    hit = _rules(specs, "substitutions").select("target_clause_id", "effective_date").unionByName(
        _rules(specs, "table_replacements").select("target_clause_id", "effective_date")
    )
    last = hit.groupBy("target_clause_id").agg(F.max("effective_date").alias("_e"))
    j = clauses.join(last, F.col("clause_id") == F.col("target_clause_id"), "left")
    return j.withColumn("effective_to", F.coalesce(F.date_sub("_e", 1), "effective_to")).select(*clauses.columns)


def versions(clauses: DataFrame, specs: DataFrame, with_transitional: bool = False) -> DataFrame:
    """Originals and amended versions with ``pos``, the order in which they count."""
    new = substitutions(clauses, specs).unionByName(
        table_replacements(clauses, specs)
    ).unionByName(insertions(clauses, specs))
    if with_transitional:
        new = new.unionByName(transitional(clauses, specs))
    n = clauses.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("_n"))
    new = numbered(new).crossJoin(F.broadcast(n)).withColumn(
        "pos", (F.col("_n") + F.col("_at")).cast("int")
    ).drop("_n", "_at")
    return superseded(clauses, specs).unionByName(new)


def numbered(new: DataFrame, rows: int = 10_000) -> DataFrame:
    """Amended clauses with ``_at``, their place from 0 by amendment, clause, order and
    paragraph. Rows are ordered within an amendment and ``rows`` positions; what comes
    before these is summed from counts, a row for each."""
    at = F.coalesce("pos", F.lit(2**31 - 1))
    part = [F.col("amendment_id"), F.floor(at / rows).alias("_b")]
    counts = new.groupBy(*part).agg(F.count(F.lit(1)).alias("_m"))
    before = F.sum("_m").over(Window.orderBy("amendment_id", "_b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(
        F.col("amendment_id").alias("_a"), F.col("_b").alias("_c"), F.coalesce(before, F.lit(0)).alias("_off")
    )
    own = new.withColumn("_b", F.floor(at / rows))
    own = own.withColumn(
        "_rn", F.row_number().over(Window.partitionBy("amendment_id", "_b").orderBy(at, "order", "amendment_paragraph"))
    )
    met = own.join(counts, F.col("amendment_id").eqNullSafe(F.col("_a")) & (F.col("_b") == F.col("_c")))
    return met.withColumn("_at", F.col("_off") + F.col("_rn") - 1).select(*new.columns, "_at")


def latest(df: DataFrame, key: str = "clause_id", order: str = "pos") -> DataFrame:
    """The last row of each key."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_r"))
    return best.select(key, "_r.*").select(*df.columns)


def version_pairs(df: DataFrame) -> DataFrame:
    """(clause_id, original, amended): positions of the two versions of a clause."""
    return df.groupBy("clause_id").agg(
        F.max(F.when(~F.col("is_amended_version"), F.col("pos"))).alias("original"),
        F.max(F.when(F.col("is_amended_version"), F.col("pos"))).alias("amended")
    )
