"""Text expressions: tokens, stems, references, numeric claims, match positions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Settings

DEFAULTS = Settings()

# Patterns and word lists that results depend on.
TOKEN = r"[a-z0-9§]+(?:\.[a-z0-9]+)*"
NUMBER = r"\b\d[\d,]*\b"
RERANK_REF = r"§?\s*(\d+\.\d+\.\d+)"
CLAUSE_REF = r"§\s*(\d+\.\d+(?:\.\d+)?)"
CITATION = r"(?:Amendment\s+No\.\s*[\d-]+\s+)?§\s*(\d+(?:\.\d+)+(?:[A-Z])?|\d+\.\d+)"
UNIT_NUMBER = r"(?i)(\d[\d,]*)\s*(?:calendar\s+|business\s+|working\s+)?(day|days|week|weeks|month|months|year|years|per\s*cent|percent|%)"
ASSERTION_REF = r"(?i)(?:required|permitted|specified|provided|set out|established)\s+under\s+§\s*(\d+\.\d+(?:\.\d+)?)"
MODIFIERS = [
    "extended to", "extended when", "increased to", "increases to", "increase to", "reduced to", "reduces to",
    "in place of", "instead of", "rather than"
]
DEFERRALS = ["see §", "addressed separately", "dealt with separately", "treated separately", "provided for separately"]
BARE_DEFERRALS = ["addressed separately", "dealt with separately", "treated separately"]
EVIDENCE_STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "of", "to", "in", "on", "for", "and", "or",
    "if",
    "do", "does", "did", "what", "when", "how", "can", "could", "would", "should", "i", "my", "me", "it", "this",
    "that",
    "with", "as", "at", "by", "from", "not",
]
RERANK_STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "of", "to", "in", "on", "for", "and", "or",
    "if",
    "do", "does", "did", "what", "when", "how", "can", "could", "would", "should", "i", "my", "me", "it", "this",
    "that",
    "with", "as", "at", "by", "from", "have", "has", "had", "having", "they", "them", "their", "there", "many", "much",
    "long", "more", "most", "who", "whom", "whose", "which", "calder", "county", "manual",
]
CONDITION_WORDS = ["see", "refer", "under", "clause", "section", "case", "except", "in", "the", "of", "to", "for"]
#: Our own list of English function words, the default of the vector space; a longer
#: list, as libraries have it, is handed in (see :func:`provenant.sources.read_words`).
VECTOR_STOPWORDS = [
    "a", "about", "above", "after", "again", "against", "all", "also", "am", "an", "and", "any", "are", "as", "at",
    "be",
    "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "cannot", "could", "did",
    "do",
    "does", "doing", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have", "having", "he",
    "her",
    "here", "hers", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "itself", "just", "may", "me",
    "might",
    "more", "most", "must", "my", "no", "nor", "not", "of", "off", "on", "once", "only", "or", "other", "our", "out",
    "over",
    "own", "same", "shall", "she", "should", "so", "some", "such", "than", "that", "the", "their", "them", "then",
    "there",
    "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "us", "very", "was", "we", "were",
    "what", "when", "where", "which", "while", "who", "whom", "whose", "why", "will", "with", "would", "you", "your",
]
WORD = r"[\p{L}\p{N}_]{2,}"


def texts(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stem(t: Column) -> Column:
    """The first rule that fits; words of up to four characters stay."""
    n = F.char_length(t)
    cut = lambda k: F.substring(t, 1, n - k)
    return (
        F.when(n <= 4, t)
        .when(F.endswith(t, F.lit("ies")), F.concat(cut(3), F.lit("y")))
        .when(F.endswith(t, F.lit("ations")), cut(1))
        .when(F.endswith(t, F.lit("es")) & F.substring(t, n - 2, F.lit(1)).isin("s", "x", "z"), cut(2))
        .when(F.endswith(t, F.lit("ed")), cut(2))
        .when(F.endswith(t, F.lit("s")) & ~F.endswith(t, F.lit("ss")), cut(1))
        .otherwise(t)
    )


def raw_tokens(c: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(TOKEN), F.lit(0))


def tokens(c: str | Column) -> Column:
    """Stemmed tokens in text order."""
    return F.transform(raw_tokens(c), stem)


def rerank_tokens(c: str | Column) -> Column:
    """Stemmed, freed of stopwords, and stemmed again."""
    return F.transform(F.filter(tokens(c), lambda t: ~t.isin(RERANK_STOPWORDS)), stem)


def content_tokens(c: str | Column) -> Column:
    """Distinct stemmed tokens that are neither stopwords nor figures."""
    keep = lambda t: ~t.isin(EVIDENCE_STOPWORDS) & ~t.rlike("^[0-9]+$")
    return F.array_distinct(F.filter(tokens(c), keep))


def words(c: str | Column, stopwords: Sequence[str] = VECTOR_STOPWORDS) -> Column:
    """Words of the vector space, freed of stopwords."""
    w = F.regexp_extract_all(F.lower(col(c)), F.lit(WORD), F.lit(0))
    return F.filter(w, lambda t: ~t.isin(list(stopwords))) if stopwords else w


def word_grams(w: str | Column) -> Column:
    """Words and pairs of neighbouring words of an array of words."""
    w = col(w)
    pairs = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda t, i: F.concat_ws(" ", t, F.get(w, i + 1))
    )
    return F.concat(w, pairs)


def word_grams_of(w: str | Column, keep: Callable[[Column], Column]) -> Column:
    """Those of :func:`word_grams` whose first word is one to ``keep``; the pair that the
    last word lacks is null. Pairs that are not kept are not made."""
    w = col(w)
    own = F.transform(w, lambda t, i: F.when(keep(t), F.array(t, F.concat(t, F.lit(" "), F.get(w, i + 1)))))
    return F.flatten(F.filter(own, lambda x: x.isNotNull()))


def numbers(c: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(NUMBER), F.lit(0)))


def clause_refs(c: str | Column, pattern: str = CLAUSE_REF) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(1))


def citations(c: str | Column) -> Column:
    return F.regexp_extract_all(col(c), F.lit(CITATION), F.lit(1))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(a: Column, join: Callable[[Column, Column], Column], none: Column) -> Column:
    """Running totals of an array by ``join``, whose neutral value is ``none``: as many
    passes as the length has binary digits, each joining what lies 1, 2, 4 .. apart."""
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(a), F.lit(1)))).cast("int"))

    def step(acc: Column, k: Column) -> Column:
        n = F.size(acc)
        apart = F.least(F.call_function("shiftleft", F.lit(1), k), n)
        return F.zip_with(F.concat(F.array_repeat(none, apart), F.slice(acc, F.lit(1), n - apart)), acc, join)

    return F.aggregate(passes, a, step)


def spans(c: str | Column, pattern: str, groups: int = 0) -> Column:
    """Matches as structs (start, end, text, g1 ..), 0-based, end exclusive.

    There is no function for match positions; they are running totals of the
    lengths of the pieces between matches and of the matches themselves.
    """
    c = col(c)
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    caught = [F.regexp_extract_all(c, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(1, groups + 1)]
    pieces = F.struct(found.alias("text"), F.split(c, pattern, -1).alias("gaps"), *caught)

    def placed(p: Column) -> Column:
        both = F.zip_with(
            F.slice(p["gaps"], F.lit(1), F.size(p["text"])), p["text"], lambda x, y: F.char_length(x) + F.char_length(y)
        )
        ends = running(both, lambda x, y: x + y, F.lit(0)).alias("end")
        rows = F.arrays_zip(ends, p["text"].alias("text"), *[p[f"g{g}"].alias(f"g{g}") for g in range(1, groups + 1)])
        return F.transform(rows, lambda m: F.struct(
            (m["end"] - F.char_length(m["text"])).alias("start"), m["end"], m["text"],
            *[m[f"g{g}"] for g in range(1, groups + 1)]
        ))

    return let(pieces, placed)


def window(c: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of a text, both ends held to the text."""
    lo = F.greatest(start, F.lit(0))
    return F.substring(c, lo + 1, F.greatest(end - lo, F.lit(0)))


CHUNK = 256


def chunks(c: str | Column) -> Column:
    """A text in parts of equal length, for :func:`near`."""
    return F.regexp_extract_all(col(c), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def near(parts: Column, start: Column, end: Column) -> Column:
    """:func:`window` of a text in parts: its cost does not grow with the text."""
    lo = F.greatest(start, F.lit(0))
    first = F.floor(lo / CHUNK).cast("int")
    n = F.greatest(F.floor((end - 1) / CHUNK).cast("int") - first + 1, F.lit(0))
    return window(F.array_join(F.slice(parts, first + 1, n), ""), lo - first * CHUNK, end - first * CHUNK)


def unit_family(u: str | Column) -> Column:
    u = F.replace(F.lower(col(u)), F.lit(" "))
    known = F.when(F.startswith(u, F.lit("day")), "day")
    for k in ("week", "month", "year"):
        known = known.when(F.startswith(u, F.lit(k)), k)
    return known.when(u.isin("percent", "%"), "percent").otherwise(u)


def claims(c: str | Column, s: Settings = DEFAULTS) -> Column:
    """Numbers with a unit: structs (value, unit, has_modifier, context)."""
    c = col(c)

    def told(v: Column) -> Column:
        def one(m: Column) -> Column:
            before = F.lower(near(v["parts"], m["start"] - s.modifier_window, m["start"]))
            modified = F.exists(texts(MODIFIERS), lambda p: F.contains(before, p))
            return F.struct(
                F.replace(m["g1"], F.lit(",")).alias("value"), unit_family(m["g2"]).alias("unit"),
                modified.alias("has_modifier"), F.trim(near(v["parts"], m["start"] - 40, m["end"] + 10)).alias("context")
            )

        return F.transform(v["found"], one)

    return let(F.struct(spans(c, UNIT_NUMBER, 2).alias("found"), chunks(c).alias("parts")), told)


def cleaned(c: str | Column) -> Column:
    """Without bold marks, runs of blanks and blank lines."""
    plain = F.regexp_replace(col(c), r"\*\*(.*?)\*\*", "$1")
    lines = F.transform(
        F.split(plain, r"\r\n|[\n\r]", -1),
        lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"^\s+|\s+$", "")
    )
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def without_thinking(c: str | Column) -> Column:
    """A model's answer without its marked reasoning, closed or cut off."""
    closed = F.trim(F.regexp_replace(col(c), r"(?s)<think>.*?</think>", ""))
    return F.trim(F.regexp_replace(closed, r"(?s)<think>.*", ""))


def embed_text(title: str | Column, text: str | Column) -> Column:
    return F.concat_ws(". ", col(title), col(text))


def lexical_text(citation: str | Column, title: str | Column, text: str | Column) -> Column:
    return F.concat_ws(" ", col(citation), col(title), col(text))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b)))
