"""Decisions, their texts, and the check of citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# What an answer that is no answer says.
ESCALATION = "Please consult the appropriate policy administrator or benefits supervisor."
REFUSALS = {
    "INSUFFICIENT_EVIDENCE": "I can't determine this from the policy manual.\n\nThe manual does not provide enough information to answer this question confidently.\n\n"
    + ESCALATION,
    "AMBIGUOUS_POLICY": "The policy manual contains related information, but it does not clearly establish the answer to this question.\n\nI cannot determine the correct interpretation from the manual alone.\n\n"
    + ESCALATION,
    "OUT_OF_SCOPE": "This question falls outside the {jurisdiction}policy manual, which is the only source this assistant is authorised to answer from.\n\n"
    + ESCALATION,
    "CITATION_UNVERIFIABLE": "I found a candidate answer, but could not verify its citation against the retrieved evidence, so I'm not returning it as a grounded answer.\n\n"
    + ESCALATION,
    "MISSING_DATE_CONTEXT": "The applicable reporting period depends on when the change of circumstances occurred.\n\nPlease provide the relevant date so I can determine which policy provision applies.\n\n"
    + ESCALATION,
}
CONFLICT_HEAD = "The policy manual contains conflicting provisions relevant to this question.\n\n"
CONFLICT_TAIL = "\n\nBecause these provisions conflict, the manual does not provide a single clear answer.\n\n" + ESCALATION


def decision(conflicts: Column, sufficient: Column) -> Column:
    return F.when(conflicts, "CONFLICT").when(sufficient, "ANSWER").otherwise("REFUSE")


def refusals(jurisdiction: str = "") -> dict[str, str]:
    """The texts, the manual named by whose it is, if that is given."""
    return {k: v.replace("{jurisdiction}", jurisdiction + " " if jurisdiction else "") for k, v in REFUSALS.items()}


def refusal_text(reason: str | Column, detail: str | Column, jurisdiction: str = "") -> Column:
    r, d = T.col(reason), T.col(detail)
    base = F.lit(REFUSALS["INSUFFICIENT_EVIDENCE"])
    for k, v in refusals(jurisdiction).items():
        base = F.when(r == k, v).otherwise(base)
    more = F.coalesce(d, F.lit("")) != ""
    return F.when(
        more & ~F.coalesce(r == "MISSING_DATE_CONTEXT", F.lit(False)), F.concat(base, F.lit("\n\n("), d, F.lit(")"))
    ).otherwise(base)


def answer_text(items: str | Column) -> Column:
    """From an array of (text, citation) in order: one text alone, or texts with citations."""
    a = T.col(items)
    parts = F.transform(a, lambda x: F.concat(T.cleaned(x["text"]), F.lit(" ["), x["citation"], F.lit("]")))
    return F.when(F.size(a) == 1, T.cleaned(F.element_at(a, 1)["text"])).otherwise(F.array_join(parts, "\n\n"))


def conflict_texts(findings: DataFrame) -> DataFrame:
    """(qid, text, citations): one block for each pair, in order of first finding."""
    key = F.array_sort(F.array("a_id", "b_id"))
    place = F.struct("stage", "o1", "o2", "o3", "o4")
    first = findings.groupBy("qid", key.alias("_k")).agg(
        F.min(place).alias("_p"), F.min_by(F.struct("a_id", "a_text", "b_id", "b_text"), place).alias("f")
    )
    block = F.concat(
        F.lit("§"), "f.a_id", F.lit(" states: "), T.cleaned("f.a_text"), F.lit("\n\n§"), "f.b_id", F.lit(" states: "),
        T.cleaned("f.b_text")
    )
    g = first.groupBy("qid").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "_p", block.alias("b"),
                    F.array(F.concat(F.lit("§"), "f.a_id"), F.concat(F.lit("§"), "f.b_id")).alias("c")
                )
            )
        ).alias("x")
    )
    body = F.array_join(F.transform("x", lambda x: x["b"]), "\n\n---\n\n")
    return g.select(
        "qid", F.concat(F.lit(CONFLICT_HEAD), body, F.lit(CONFLICT_TAIL)).alias("conflict_text"),
        F.array_distinct(F.flatten(F.transform("x", lambda x: x["c"]))).alias("conflict_citations")
    )


def validate_citations(
    answers: DataFrame, lookup: DataFrame, text: str = "text", supporting: str = "supporting"
) -> DataFrame:
    """``answers`` (qid, text, supporting: array of clause ids) with what the
    text cites, what of it exists nowhere and what the evidence does not hold."""
    cited = answers.select("qid", F.posexplode(T.citations(text)).alias("o", "ref"))
    ids = lookup.select(
        F.explode(
            F.array(
                "clause_id", "section_number", F.substring_index("clause_id", ".", 1),
                F.coalesce("amendment_paragraph", "clause_id")
            )
        ).alias("ref")
    ).distinct().withColumn("_known", F.lit(True))
    held = answers.select("qid", F.explode(supporting).alias("clause_id")).join(
        lookup.select("clause_id", "section_number", "amendment_paragraph"), "clause_id"
    )
    alike = F.array(
        "clause_id", "section_number", F.coalesce("amendment_paragraph", "clause_id"),
        F.coalesce(F.concat(F.lit("5."), "amendment_paragraph"), F.col("clause_id"))
    )
    held = held.select("qid", F.explode(alike).alias("ref")).distinct().withColumn("_held", F.lit(True))
    j = cited.join(ids, "ref", "left").join(held, ["qid", "ref"], "left")
    state = F.when(F.col("_known").isNull(), "invalid").when(F.col("_held").isNull(), "unsupported")
    pick = lambda x: F.transform(F.array_sort(F.collect_list(F.when(x, F.struct("o", "ref")))), lambda r: r["ref"])
    j = j.withColumn("_state", state)
    g = j.groupBy("qid").agg(
        pick(F.lit(True)).alias("checked"), pick(F.col("_state") == "invalid").alias("invalid"),
        pick(F.col("_state") == "unsupported").alias("unsupported")
    )
    none = F.array().cast("array<string>")
    out = answers.select("qid").join(g, "qid", "left").select(
        "qid", *[F.coalesce(c, none).alias(c) for c in ("checked", "invalid", "unsupported")]
    )
    issues = F.concat(
        F.transform(
            "invalid", lambda r: F.concat(F.lit("§"), r, F.lit(" does not exist in the policy manual or amendments."))
        ),
        F.transform(
            "unsupported",
            lambda r: F.concat(
                F.lit("§"), r,
                F.lit(" exists in the manual but was not part of the evidence retrieved and verified for this answer.")
            )
        ))
    return out.withColumn("valid", (F.size("invalid") == 0) & (F.size("unsupported") == 0)).withColumn("issues", issues)


def append_citations(citations: str | Column, more: str | Column) -> Column:
    """Citations with further ones behind them, only where there are any."""
    a, b = T.col(citations), T.col(more)
    return F.when(F.size(a) > 0, F.array_union(a, b)).otherwise(a)


def prompt(question: str | Column, items: str | Column) -> Column:
    """The message pair for an optional phrasing model."""
    context = F.array_join(
        F.transform(T.col(items), lambda x: F.concat(F.lit("["), x["citation"], F.lit("] "), T.cleaned(x["text"]))),
        "\n\n"
    )
    system = "Answer from the numbered policy evidence alone. Cite each clause that you use by its number. If the evidence does not answer the question, say so."
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(
            F.lit("user").alias("role"),
            F.concat(F.lit("Question: "), T.col(question), F.lit("\n\nEvidence:\n"), context).alias("content")
        ))
