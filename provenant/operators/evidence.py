"""Evidence tests: does what was retrieved establish the answer?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T

DEFAULTS = Settings()
INSUFFICIENT, AMBIGUOUS = "INSUFFICIENT_EVIDENCE", "AMBIGUOUS_POLICY"
# What a detail and a note say.
DETAIL_NONE = "No clause in the manual scored above the relevance threshold for this question."
DETAIL_WEAK = "The manual contains related content, but no retrieved clause clears the support threshold for a confident answer."
NOTE_BARE = " states the matter is addressed separately, but names no clause and no such provision was found elsewhere in the manual."
NOTE_MISSING = ", which does not exist in the manual."
NOTE_ELSEWHERE = ") does not actually address it."


def deferral_targets(c: str | Column, s: Settings = DEFAULTS) -> Column:
    """References close behind a deferral phrase, phrase by phrase."""
    c = T.col(c)
    low = F.lower(c)
    behind = lambda p: F.flatten(T.let(
        F.struct(T.spans(low, rf"\Q{p}\E").alias("found"), T.chunks(c).alias("parts")),
        lambda v: F.transform(
            v["found"], lambda m: T.clause_refs(T.near(v["parts"], m["start"], m["start"] + s.deferral_window))
        )
    ))
    return F.concat(*[F.when(F.contains(low, F.lit(p)), behind(p)).otherwise(F.array().cast("array<string>")) for p in T.DEFERRALS])


def bare_deferral(c: str | Column, s: Settings = DEFAULTS) -> Column:
    """Whether a phrase defers without a reference around its first place."""
    c = T.col(c)
    low = F.lower(c)
    out = F.lit(False)
    for p in T.BARE_DEFERRALS:
        at = F.instr(low, F.lit(p)) - 1
        out = out | ((at >= 0) & ~F.contains(T.window(c, at - 5, at + s.deferral_window), F.lit("§")))
    return out


def preceding_condition(c: str | Column, target: str | Column, s: Settings = DEFAULTS) -> Column:
    """The end of the sentence part before the first mention of a target."""
    c, target = T.col(c), T.col(target)
    at = F.instr(c, target) - 1
    part = F.regexp_replace(
        T.window(c, at - s.condition_look_back, at), r"(?i)\(?\s*(?:see|refer\s+to|under)\s*§?\s*$", ""
    )
    for sep in (r"\.", ";", ","):
        part = F.element_at(F.split(part, sep, -1), -1)
    return F.when(at >= 0, part).otherwise("")


def targets_of(refs: DataFrame, lookup: DataFrame, ref: str = "ref") -> DataFrame:
    """``refs`` with each clause (t_*) that a reference names: the clause of that
    id, or all clauses of that section if no clause has the id; null if neither."""
    t = lookup.select(
        F.col("clause_id").alias("t_id"), F.col("section_number").alias("t_section"),
        F.col("section_title").alias("t_title"), F.col("text").alias("t_text"), F.col("pos").alias("t_pos")
    )
    ids = t.select(F.col("t_id").alias("_k"), F.col("t_id").alias("_by"), "t_id", "t_title", "t_text", "t_pos")
    # a section's rows under its number, unless some clause has that id
    section = t.join(t.select(F.col("t_id").alias("t_section")), "t_section", "left_anti").select(
        F.col("t_section").alias("_k"), F.col("t_section").alias("_by"), "t_id", "t_title", "t_text", "t_pos"
    )
    return refs.join(ids.unionByName(section).drop("_by"), F.col(ref) == F.col("_k"), "left").drop("_k")


def check_deferrals(items: DataFrame, lookup: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Items (qid, question, pos, clause_id, text, ..) with ``unresolved`` and ``notes``."""
    base = items.withColumn("_targets", deferral_targets("text", s)).withColumn("_bare", bare_deferral("text", s))
    each = base.where(F.size("_targets") > 0).select(
        "qid", "pos", "clause_id", "text", T.content_tokens("question").alias("_q"),
        F.posexplode("_targets").alias("ord", "ref")
    )
    met = targets_of(each, lookup)
    toks = F.array_union(T.content_tokens("t_text"), T.content_tokens("t_title"))
    g = met.groupBy("qid", "pos", "ord", "ref").agg(
        F.first("clause_id").alias("clause_id"), F.first("text").alias("text"), F.first("_q").alias("_q"),
        F.max("t_id").alias("t_id"),
        F.array_distinct(
            F.flatten(F.collect_list(F.when(F.col("t_id").isNotNull(), toks)))
        ).alias("_t"), F.min_by("t_title", "t_pos").alias("t_title"))
    overlap = F.when(F.size("_q") == 0, 0.0).otherwise(F.size(F.array_intersect("_q", "_t")) / F.size("_q"))
    cond = F.array_except(T.content_tokens(preceding_condition("text", "ref", s)), T.texts(T.CONDITION_WORDS))
    guarded = (F.size(cond) > 0) & ~F.arrays_overlap(cond, "_q")
    known = F.col("t_id").isNotNull()
    fails = known & (overlap < s.deferral_overlap) & ~guarded
    note = F.when(~known, F.concat(F.lit("§"), "clause_id", F.lit(" refers to §"), "ref", F.lit(NOTE_MISSING))).when(
        fails, F.concat(
            F.lit("§"), "clause_id", F.lit(" defers to §"), "ref", F.lit(" for this point, but §"), "ref", F.lit(" ("),
            "t_title", F.lit(NOTE_ELSEWHERE)
        ))
    g = g.withColumn("_note", note).withColumn("_fails", fails)
    first = F.min(F.when(F.col("_fails"), F.col("ord"))).over(Window.partitionBy("qid", "pos"))
    g = g.withColumn("_first", first).where("_first is null or ord <= _first")
    judged = g.groupBy("qid", "pos").agg(
        F.max("_fails").alias("_failed"),
        F.array_sort(F.collect_list(F.when(F.col("_note").isNotNull(), F.struct("ord", "_note")))).alias("_notes")
    )
    bare = F.concat(F.lit("§"), "clause_id", F.lit(NOTE_BARE))
    none = F.array().cast("array<string>")
    alone = F.col("_bare") & (F.size("_targets") == 0)
    out = base.join(judged, ["qid", "pos"], "left")
    return out.withColumn("unresolved", F.coalesce("_failed", alone)).withColumn(
        "notes", F.when(alone, F.array(bare)).otherwise(
            F.coalesce(F.transform("_notes", lambda n: n["_note"]), none)
        )).drop("_targets", "_bare", "_failed", "_notes")


def judge(items: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Items (qid, score, unresolved, ..) with ``support_score``, ``guarded`` (an
    unresolved item is about as good as the best) and ``supporting``."""
    w = Window.partitionBy("qid")
    out = items.withColumn(
        "support_score", F.col("score") * F.when(F.col("unresolved"), s.unresolved_factor).otherwise(1.0)
    )
    out = out.withColumn("_s", ~F.col("unresolved") & (F.col("support_score") >= s.min_support))
    top = F.max("score").over(w)
    deferred = F.max(F.when(F.col("unresolved"), F.col("score"))).over(w)
    out = out.withColumn(
        "guarded", F.coalesce(deferred >= s.guard_share * top, F.lit(False))
    ).withColumn("_d", deferred)
    out = out.withColumn(
        "_s", F.col("_s") & (~F.col("guarded") | (F.col("score") > s.guard_margin * F.coalesce("_d", F.lit(0.0))))
    )
    best = F.max(F.when(F.col("_s"), F.col("support_score"))).over(w)
    many = F.count_if(F.col("_s")).over(w) > 1
    return out.withColumn(
        "supporting", F.col("_s") & (~many | (F.col("support_score") >= s.support_margin * best))
    ).drop("_s", "_d")


def relevant(hits: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    return hits.where(F.col("score") >= s.min_relevance)


def assess(questions: DataFrame, judged: DataFrame) -> DataFrame:
    """(qid, sufficient, reason, detail) of every question, also of those without evidence."""
    notes = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "notes"))), lambda x: x["notes"]))
    g = judged.groupBy("qid").agg(F.max("supporting").alias("_s"), F.max("unresolved").alias("_u"), notes.alias("_n"))
    out = questions.select("qid").join(g, "qid", "left")
    reason = F.when(F.col("_s").isNull(), INSUFFICIENT).when(~F.col("_s"), AMBIGUOUS)
    gap = F.when(F.size("_n") > 0, F.array_join(F.slice("_n", 1, 2), " "))
    detail = F.when(
        F.col("_s").isNull(), DETAIL_NONE
    ).when(~F.col("_s") & F.col("_u"), gap).when(~F.col("_s"), DETAIL_WEAK)
    return out.select(
        "qid", F.coalesce("_s", F.lit(False)).alias("sufficient"), reason.alias("reason"), detail.alias("detail")
    )
