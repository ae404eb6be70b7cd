"""Two-clock as-of join: which version of a clause answers a dated question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings

DEFAULTS = Settings()

#: Transitional paragraph that names the clock of a clause.
PARAGRAPHS = {"change_date": "5.2", "determination_date": "5.1", "spanning": "5.3"}


def relevant_date(condition: str | Column, ctx: str = "ctx") -> Column:
    """The event date that picks a clause's version: reporting clauses look at
    the change alone, all others at the first date that is known."""
    c = F.col(condition) if isinstance(condition, str) else condition
    f = lambda n: F.col(f"{ctx}.{n}")
    return F.when(c == "change_date", f("change_date")).otherwise(
        F.coalesce(f("determination_date"), f("change_date"), f("claim_date"), f("period_start"))
    )


def uses_amended(date: Column, effective: Column) -> Column:
    return F.coalesce(date >= effective, F.lit(False))


def first_per_key(hits: DataFrame, qid: str = "qid", key: str = "clause_id", rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(qid, key).orderBy(rank)
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def is_provision(clause_id: str | Column = "clause_id") -> Column:
    """Transitional provisions, which have no versions and stay however often they are hit."""
    return F.startswith(clause_id, F.lit("A")) & F.contains(clause_id, F.lit("-"))


def validity(clauses: DataFrame) -> DataFrame:
    """(clause_id, v_pos, v_amendment, v_from, v_to) of every amended version: each is in
    force until the next one of its clause is, the last without end (null). Of versions
    that take effect on one day the last counts."""
    own = Window.partitionBy("clause_id").orderBy("effective_from", "pos")  # amendments of one clause
    rows = clauses.where("is_amended_version and effective_from is not null").withColumn(
        "v_to", F.date_sub(F.lead("effective_from").over(own), 1)
    )
    return rows.select(
        "clause_id", F.col("pos").alias("v_pos"), F.col("amendment_id").alias("v_amendment"),
        F.col("effective_from").alias("v_from"), "v_to"
    ).where("v_to is null or v_to >= v_from")


def asof_join(
    rows: DataFrame, spans: DataFrame, key: str, date: str, start: str = "v_from", end: str = "v_to", bucket_days: int = 366
) -> DataFrame:
    """``rows`` with the columns of the span (of ``key``, from ``start`` to ``end``, a null
    end for none) that their date lies in; null where there is none.

    Spans are dealt over buckets of days, held to the dates that ``rows`` have, so
    that rows and spans meet by key and bucket: a key with many spans or dates is
    not compared as a whole.
    """
    bucket = lambda d: F.floor(F.unix_date(d) / bucket_days)
    held = rows.agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))  # one row
    near = spans.join(F.broadcast(held), (F.col(start) <= F.col("_hi")) & (F.coalesce(end, "_hi") >= F.col("_lo")))
    cut_spans = near.withColumn("_b", F.explode(F.sequence(
        bucket(F.greatest(start, "_lo")), bucket(F.least(F.coalesce(end, "_hi"), F.col("_hi")))
    ))).drop("_lo", "_hi").withColumnRenamed(key, "_k")
    mine = rows.withColumn("_b", bucket(F.col(date))).alias("r")
    in_force = (F.col(f"r.{date}") >= F.col(start)) & (F.col(end).isNull() | (F.col(f"r.{date}") <= F.col(end)))
    met = mine.join(cut_spans.alias("s"), (F.col(f"r.{key}") == F.col("_k")) & (F.col("r._b") == F.col("s._b")) & in_force, "left")
    return met.select("r.*", *[F.col(c) for c in spans.columns if c != key]).drop("_b")


def amended_versions(clauses: DataFrame) -> DataFrame:
    """(clause_id, original, amended, condition, effective, amendment_id) of amended clauses."""
    new = F.when(F.col("is_amended_version"), F.struct("pos", "date_condition_type", "effective_from", "amendment_id"))
    g = clauses.groupBy("clause_id").agg(
        F.max(F.when(~F.col("is_amended_version"), F.col("pos"))).alias("original"),
        F.max_by(new, F.when(F.col("is_amended_version"), F.col("pos"))).alias("n")
    )
    return g.where("n is not null").select(
        "clause_id", "original", F.col("n.pos").alias("amended"), F.col("n.date_condition_type").alias("condition"),
        F.col("n.effective_from").alias("effective"), F.col("n.amendment_id").alias("amendment")
    )


def resolve(hits: DataFrame, contexts: DataFrame, clauses: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Hits (qid, clause_id, pos, score, rank) with the version that applies.

    Adds ``pos`` (the version chosen), ``excluded_pos``, ``dated``, ``use_amended``,
    ``condition``, ``transitional`` (citation), ``note`` and ``kept``; a version
    keeps the score of the hit it replaces. A clause has an original and its last
    amended version; with ``version_chain`` every amended version counts, each from
    the day it takes effect to the day before the next.
    """
    h = first_per_key(hits.where(~is_provision())).unionByName(hits.where(is_provision()))
    h = h.join(contexts.select("qid", "ctx"), "qid").join(amended_versions(clauses), "clause_id", "left")
    h = h.withColumn("_date", relevant_date("condition"))
    date, new, known = F.col("_date"), F.col("amended").isNotNull(), F.col("_date").isNotNull()
    if s.version_chain:
        spans = validity(clauses)
        first = spans.groupBy("clause_id").agg(F.min_by("v_amendment", "v_from").alias("_first"))
        h = asof_join(h, spans, "clause_id", "_date").join(first, "clause_id", "left")
        for c, v in (("amended", "v_pos"), ("effective", "v_from"), ("amendment", "v_amendment")):
            h = h.withColumn(c, F.coalesce(v, "_first" if c == "amendment" else c))
        use = new & F.col("v_pos").isNotNull()
    else:
        use = new & uses_amended(date, F.col("effective"))
    para = F.when(
        F.col("condition") == "change_date", PARAGRAPHS["change_date"]
    ).otherwise(PARAGRAPHS["determination_date"])
    cite = F.concat(F.lit("Amendment No. "), "amendment", F.lit(" §"), para)
    day = F.date_format("effective", "d MMMM yyyy")
    note = F.when(
        use, F.concat(F.lit("Using post-amendment version of §"), "clause_id", F.lit(" (effective "), day, F.lit(")."))
    ).when(
        new & known, F.concat(
            F.lit("Using pre-amendment version of §"), "clause_id", F.lit(" (for date "), date.cast("string"),
            F.lit(").")
        ))
    w = Window.partitionBy("qid")
    other = F.max((F.col("clause_id") == s.suppressing_clause).cast("int")).over(w) == 1
    dropped = known & ~use & (F.col("condition") == "change_date") & (F.col("clause_id") == s.suppressed_clause) & other
    if s.strict_effective:
        dropped = dropped | (new & ~use & F.col("original").isNull())
    return h.select(
        "qid", "clause_id", F.col("pos").alias("hit_pos"),
        F.when(use, F.col("amended")).when(new, F.coalesce("original", "pos")).otherwise(F.col("pos")).alias("pos"),
        F.when(use, F.col("original")).when(new, F.col("amended")).alias("excluded_pos"), "score", "rank", "condition",
        new.alias("has_versions"),
        (new & known).alias("dated"), use.alias("use_amended"), F.when(new & known, cite).alias("transitional"), note.alias("note"), (
            ~F.coalesce(dropped, F.lit(False))
        ).alias("kept"))


def ordered(applicable: DataFrame) -> DataFrame:
    """Kept hits in their final order: provisions last, then by score."""
    meta = is_provision().cast("int")
    w = Window.partitionBy("qid").orderBy(meta, F.col("score").desc(), "rank")
    return applicable.where("kept").withColumn("rank", F.row_number().over(w))


def with_fallback(applicable: DataFrame, hits: DataFrame) -> DataFrame:
    """Questions with no applicable hit keep their unresolved ones."""
    lost = hits.join(applicable.select("qid").distinct(), "qid", "left_anti")
    return applicable.select("qid", "clause_id", "pos", "score", "rank").unionByName(
        lost.select("qid", "clause_id", "pos", "score", "rank")
    )


def missing_date(hits: DataFrame, contexts: DataFrame, clauses: DataFrame) -> DataFrame:
    """(qid, missing_type, missing_note) of undated questions that hit an amended clause."""
    h = hits.join(
        contexts.where(~F.col("ctx.has_any_date")).select("qid"), "qid"
    ).join(amended_versions(clauses), "clause_id")
    g = h.groupBy("qid").agg(F.min_by(F.struct("clause_id", "condition", "amendment", "effective"), "rank").alias("a"))
    reporting = F.col("a.condition") == "change_date"
    note = F.when(reporting, "The reporting period depends on when the change of circumstances occurred.").otherwise(
        F.concat(
            F.lit("§"), "a.clause_id", F.lit(" was amended by Amendment No. "), "a.amendment", F.lit(" effective "),
            F.date_format("a.effective", "d MMMM yyyy"), F.lit(". Applicability depends on determination date.")
        ))
    return g.select(
        "qid", F.when(reporting, "change_date").otherwise("determination_date").alias("missing_type"),
        note.alias("missing_note")
    )


def transitional_citations(resolved: DataFrame, contexts: DataFrame, clauses: DataFrame) -> DataFrame:
    """(qid, transitional): distinct citations in order of first use."""
    own = resolved.where("transitional is not null").groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "transitional"))).alias("t")
    )
    last = clauses.agg(F.max("amendment_id").alias("_a"))
    span = F.when(
        F.col("ctx.spans_boundary"),
        F.array(F.concat(F.lit("Amendment No. "), "_a", F.lit(" §" + PARAGRAPHS["spanning"])))
    ).otherwise(F.array().cast("array<string>"))
    j = contexts.join(own, "qid", "left").crossJoin(F.broadcast(last))
    mine = F.coalesce(F.transform("t", lambda x: x["transitional"]), F.array().cast("array<string>"))
    return j.select("qid", F.array_distinct(F.concat(mine, span)).alias("transitional"))


def notes(resolved: DataFrame, contexts: DataFrame, clauses: DataFrame, hits: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(qid, notes): what is to be said about dates, in order: the date that is missing,
    the versions chosen, and how a period that spans an amendment is apportioned."""
    missing = missing_date(hits, contexts, clauses).select("qid", "missing_note")
    own = resolved.where("note is not null").groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "note"))).alias("n")
    )
    last = clauses.agg(F.max("amendment_id").alias("_a"))
    spanning = F.concat(
        F.lit("Claim period spans "), F.date_format(F.lit(s.boundary), "d MMMM yyyy"), F.lit(". Under Amendment No. "), "_a",
        F.lit(f" §{PARAGRAPHS['spanning']}, the applicable figures are those in force on each day of the period, and the "
              f"award is apportioned accordingly under §{s.apportioning_clause}.")
    )
    j = contexts.join(missing, "qid", "left").join(own, "qid", "left").join(F.broadcast(last))  # one row
    each = F.concat(
        F.array("missing_note"), F.coalesce(F.transform("n", lambda x: x["note"]), F.array().cast("array<string>")),
        F.array(F.when(F.col("ctx.spans_boundary"), spanning))
    )
    return j.select("qid", F.array_compact(each).alias("notes"))
