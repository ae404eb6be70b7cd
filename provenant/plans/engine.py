"""The answering plan: a batch of questions through every operator at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import dates as D
from ..functions import text as T
from ..operators import amend, contradict, evidence, render, retrieve, temporal
from .storage import cut

DEFAULTS = Settings()


class EmptyQuestionError(ValueError):
    """A question has no text."""


def build_index(
    clauses: DataFrame, specs: DataFrame | None = None, s: Settings = DEFAULTS,
    embedding: retrieve.Embedding | None = None
) -> dict[str, DataFrame]:
    """All tables that answering needs, from originals and amendments. Another
    ``embedding`` than the default is handed to :func:`answer` too."""
    c = cut(amend.versions(clauses, specs) if specs is not None else clauses)
    docs = c.select(
        "pos", T.embed_text("section_title", "text").alias("text"),
        T.lexical_text("citation", "section_title", "text").alias("l"),
        F.concat_ws(" ", "section_title", "text").alias("p")
    )
    out = (embedding or retrieve.TfidfEmbedding()).index(docs.select("pos", "text"))
    out |= {"postings": retrieve.bm25_postings(docs, "pos", "l", s), "rerank_idf": retrieve.rerank_idf(docs, "p")}
    return {"clauses": c} | {name: cut(df) for name, df in out.items()}


def contexts(questions: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(qid, question, ctx, search): date contexts and date-stripped texts."""
    q = questions.select(
        "qid", F.regexp_replace("question", r"^\s+|\s+$", "").alias("question")
    ).withColumn("_d", D.dates("question", s))
    q = q.withColumn("ctx", D.context("question", F.col("_d"), s)).drop("_d")
    return q.withColumn(
        "search",
        F.when(F.col("ctx.cleaned_question") != "", F.col("ctx.cleaned_question")).otherwise(F.col("question"))
    )


def candidates(
    ctx: DataFrame, index: dict[str, DataFrame], s: Settings = DEFAULTS, embedding: retrieve.Embedding | None = None
) -> DataFrame:
    """Both retrievers' best hits: (qid, list_no, rank, pos, score, retriever)."""
    q = ctx.select("qid", F.col("search").alias("question"))
    vec = retrieve.top_k(
        (embedding or retrieve.TfidfEmbedding()).scores(q, index, s.retrieval_top_k), s.retrieval_top_k, "qid", "pos"
    )
    lex = retrieve.top_k(retrieve.bm25_scores(q, index["postings"], "pos"), s.retrieval_top_k, "qid", "pos")
    rows = lambda df, no, name: df.select("qid", F.lit(no).alias("list_no"), "rank", "pos", "score", F.lit(name).alias("retriever"))
    return rows(vec, 0, "vector").unionByName(rows(lex, 1, "bm25"))


def rerank(
    ctx: DataFrame, fused: DataFrame, index: dict[str, DataFrame], s: Settings = DEFAULTS,
    scorer: retrieve.Scorer | None = None
) -> DataFrame:
    """The best of the fused hits by relevance: (qid, clause_id, pos, score, rank)."""
    passage = index["clauses"].select("pos", F.concat_ws(" ", "section_title", "text").alias("passage"))
    pairs = fused.select("qid", "clause_id", "pos", F.col("rank").alias("_r")).join(passage, "pos").join(
        ctx.select("qid", F.col("search").alias("question")), "qid"
    )
    scored = (scorer or retrieve.LexicalScorer(s)).score(pairs, index).select("qid", "clause_id", "pos", "score", "_r")
    w = retrieve.Window.partitionBy("qid").orderBy(F.col("score").desc(), "_r")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= s.rerank_top_k).drop("_r")


Phrase = Callable[[DataFrame], DataFrame]


def answer(
    questions: DataFrame, index: dict[str, DataFrame], s: Settings = DEFAULTS, phrase: Phrase | None = None,
    embedding: retrieve.Embedding | None = None, scorer: retrieve.Scorer | None = None
) -> DataFrame:
    """(qid, question, decision, reason, text, citations, related, missing_type,
    transitional, n_vector, n_bm25, n_fused, notes) of every question of (qid, question).

    ``embedding`` and ``scorer`` may be others than the default ones.

    ``phrase`` may reword answers: it gets (qid, question, messages, supporting)
    and returns (qid, text); what cites anything but the evidence is discarded.
    """
    if questions.where(F.regexp_replace(F.coalesce("question", F.lit("")), r"\s", "") == "").limit(1).count():
        raise EmptyQuestionError("a question must not be empty")
    clauses = index["clauses"]
    lookup = cut(
        amend.latest(clauses).select(
            "clause_id", "citation", "section_number", "section_title", "text", "pos", "amendment_paragraph"
        )
    )
    ctx = cut(contexts(questions, s))
    ids = clauses.select("pos", "clause_id")
    hits = cut(candidates(ctx, index, s, embedding).join(ids, "pos"))
    fused_all = cut(retrieve.fuse(hits, s))
    fused = fused_all.where(F.col("rank") <= s.retrieval_top_k)
    ranked = cut(rerank(ctx, fused, index, s, scorer))
    resolved = cut(temporal.resolve(ranked, ctx, clauses, s))
    applied = cut(temporal.with_fallback(temporal.ordered(resolved), ranked))
    excluded = resolved.where("excluded_pos is not null").select("qid", "clause_id")
    body = clauses.select("pos", "citation", "section_title", "text", "is_amended_version")
    items = evidence.relevant(applied, s).join(body, "pos").join(ctx.select("qid", "question"), "qid")
    judged = cut(evidence.judge(cut(evidence.check_deferrals(items, lookup, s)), s))
    assessed = evidence.assess(ctx, judged)
    found = cut(contradict.contradictions(cut(contradict.expand(judged, lookup, excluded)), lookup, s))
    conflict = render.conflict_texts(found)
    # an undated question whose best clause has a date-dependent version
    undated = temporal.missing_date(ranked, ctx, clauses)
    versions = temporal.amended_versions(clauses).select("clause_id").withColumn("_v", F.lit(True))
    top = applied.where("rank = 1").where(
        F.col("score") >= s.min_relevance
    ).join(versions, "clause_id").select("qid", F.lit(True).alias("_top"))
    pick = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("rank", "text", "citation", "clause_id")))), lambda x: x)
    shown = judged.groupBy("qid").agg(pick(F.col("supporting")).alias("_own"), pick(F.lit(True)).alias("_all"))
    count = lambda df, name: df.groupBy("qid").agg(F.count(F.lit(1)).alias(name))
    j = ctx.join(assessed, "qid").join(shown, "qid", "left").join(
        conflict, "qid", "left"
    ).join(undated, "qid", "left").join(top, "qid", "left")
    j = j.join(temporal.transitional_citations(resolved, ctx, clauses), "qid", "left")
    j = j.join(temporal.notes(resolved, ctx, clauses, ranked, s), "qid", "left")
    for df, name in (
        (hits.where("list_no = 0"), "n_vector"), (hits.where("list_no = 1"), "n_bm25"), (fused_all, "n_fused")
    ):
        j = j.join(count(df, name), "qid", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    none = F.array().cast("array<string>")
    cited = lambda c: F.coalesce(F.transform(c, lambda x: x["citation"]), none)
    missing = F.col("missing_type").isNotNull() & F.coalesce("_top", F.lit(False))
    j = j.withColumn("_missing", missing).withColumn(
        "decision",
        F.when(missing, "REFUSE").otherwise(render.decision(F.col("conflict_text").isNotNull(), F.col("sufficient")))
    )
    j = j.withColumn(
        "reason",
        F.when(missing, "MISSING_DATE_CONTEXT").when(
            F.col("decision") == "CONFLICT", "CONFLICTING_POLICY"
        ).when(F.col("decision") == "REFUSE", F.col("reason"))
    )
    j = j.withColumn("_plain", F.when(F.col("decision") == "ANSWER", render.answer_text("_own")))
    if s.llm_enabled and phrase is not None:
        own = j.where("decision = 'ANSWER'").select(
            "qid", "question", render.prompt("question", "_own").alias("messages"),
            F.transform("_own", lambda x: x["clause_id"]).alias("supporting")
        )
        worded = phrase(own).select(
            "qid", T.without_thinking("text").alias("text")
        ).join(own.select("qid", "supporting"), "qid")
        good = render.validate_citations(worded, lookup).where("valid and size(checked) > 0").select("qid")
        j = j.join(
            worded.join(good, "qid", "left_semi").select("qid", F.col("text").alias("_worded")), "qid", "left"
        ).withColumn("_plain", F.coalesce("_worded", "_plain")).drop("_worded")
    text = F.when(F.col("decision") == "CONFLICT", F.col("conflict_text")).when(
        F.col("decision") == "REFUSE", render.refusal_text("reason", "detail", s.jurisdiction)
    ).otherwise(F.col("_plain"))
    citations = F.when(
        F.col("decision") == "CONFLICT", F.col("conflict_citations")
    ).when(F.col("decision") == "ANSWER", cited("_own")).otherwise(none)
    return j.select(
        "qid", "question", "decision", "reason", text.alias("text"),
        render.append_citations(citations, F.coalesce("transitional", none)).alias("citations"),
        F.when(
            F.col("_missing"), none
        ).otherwise(cited("_all")).alias("related"), "missing_type", F.coalesce(
            "transitional", none
        ).alias("transitional"), "n_vector", "n_bm25", "n_fused", "notes")


def evidence_items(
    questions: DataFrame, index: dict[str, DataFrame], s: Settings = DEFAULTS,
    embedding: retrieve.Embedding | None = None, scorer: retrieve.Scorer | None = None
) -> DataFrame:
    """The evidence table behind an answer, one row per judged clause."""
    clauses = index["clauses"]
    lookup = cut(amend.latest(clauses))
    ctx = cut(contexts(questions, s))
    hits = candidates(ctx, index, s, embedding).join(clauses.select("pos", "clause_id"), "pos")
    ranked = cut(rerank(ctx, retrieve.fuse(hits, s).where(F.col("rank") <= s.retrieval_top_k), index, s, scorer))
    applied = cut(temporal.with_fallback(temporal.ordered(temporal.resolve(ranked, ctx, clauses, s)), ranked))
    items = evidence.relevant(applied, s).join(
        clauses.select("pos", "citation", "section_title", "text"), "pos"
    ).join(ctx.select("qid", "question"), "qid")
    judged = evidence.judge(cut(evidence.check_deferrals(items, lookup, s)), s)
    state = F.when(F.col("unresolved"), "DEFERRED-UNRESOLVED").when(F.col("supporting"), "OK").otherwise("insufficient")
    return judged.select(
        "qid", "rank", "citation", "section_title", "score", "support_score", state.alias("state"), "notes"
    )
