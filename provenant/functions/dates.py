"""Dates in questions: families of notations, the event a date means, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Settings
from .text import col

DEFAULTS = Settings()

# Month names and the patterns of each notation.
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
SHORT_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec"]
_LONG, _SHORT = "|".join(MONTHS), "|".join(SHORT_MONTHS)
_TAIL = r"(?:\s*,?\s*|\s+)(\d{4})\b"
ISO = r"\b(\d{4})-(\d{2})-(\d{2})\b"
DMY = rf"(?i)\b(\d{{1,2}})\s+({_LONG})" + _TAIL
MDY = rf"(?i)\b({_LONG})\s+(\d{{1,2}})(?:st|nd|rd|th)?" + _TAIL
SHORT_MDY = rf"(?i)\b({_SHORT})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?" + _TAIL
SLASH = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
MONTH_YEAR = rf"(?i)\b({_LONG})\s+(\d{{4}})\b"
SHORT_MONTH_YEAR = rf"(?i)\b({_SHORT})\.?\s+(\d{{4}})\b"
MONTH_DAY = rf"(?i)\b({_LONG})\s+(\d{{1,2}})(?:st|nd|rd|th)?\b(?!\s*,?\s*\d{{4}})"
CHANGE = [
    r"change[sd]?\s+(on|in|of|occurring)", r"(income|circumstances?)\s+(changed|change[sd]?)\s+(on|in)",
    r"report\w*\s+(a|the)?\s*change",
    r"change\s+of\s+circumstances", r"change\s+occur", r"reported?\s+(a|the)?\s*change",
    r"reporting\s+(deadline|period|requirement)",
    r"how\s+(many|long)\s+.*days?\s+.*report",
]
DETERMINATION = [
    r"determination\s+(made|on|in|dated)", r"(assessed|decided|determined)\s+(on|in)", r"disregard\s+(for|in|on)",
    r"earnings?\s+disregard", r"income\s+threshold", r"sanction"
]
PERIOD = [r"(claim|period)\s+(cover|span|from|running)", r"(from|between)\s+.*\s+(to|through|and)\s+", r"spanning"]
REPORT = r"(?i)report|reporting|days?\s+.*report"
_ANY = _LONG + "|" + _SHORT
_DATE = rf"(?:\d{{1,2}}\s+(?:{_ANY})\.?,?\s+\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}|(?:{_ANY})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}})"
DATE_PHRASE = rf"(?i)\b(?:occurring\s+on|made\s+on|dated|as\s+of|running\s+from|from|through)\s+{_DATE}\b|\b(?:on)\s+{_DATE}\b|\b{_DATE}\b"


def month_number(name: str | Column) -> Column:
    """1 to 12 for a month's name or abbreviation, null for anything else."""
    key = F.rtrim(F.lower(col(name)), F.lit("."))
    out = F.lit(None).cast("int")
    for i, m in enumerate(MONTHS, 1):
        out = F.when(key.isin(m.lower(), m[:3].lower(), *(["sept"] if i == 9 else [])), i).otherwise(out)
    return out


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string")), "yyyy-M-d")


def _family(c: Column, pattern: str, groups: int, make) -> Column:
    parts = [F.regexp_extract_all(c, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
    made = F.transform(parts[0], lambda first, i: make(first, *[F.get(p, i) for p in parts[1:]]))
    return F.filter(made, lambda d: d.isNotNull())


def families(c: str | Column, s: Settings = DEFAULTS) -> dict[str, Column]:
    """Dates of each notation, in the order in which notations count."""
    c = col(c)
    number = lambda x: x.cast("int")
    return {
        "iso": _family(c, ISO, 3, lambda y, m, d: _day(y, number(m), number(d))),
        "dmy": _family(c, DMY, 3, lambda d, m, y: _day(y, month_number(m), number(d))),
        "mdy": _family(c, MDY, 3, lambda m, d, y: _day(y, month_number(m), number(d))),
        "short_mdy": _family(c, SHORT_MDY, 3, lambda m, d, y: _day(y, month_number(m), number(d))),
        "slash": _family(
            c, SLASH, 3,
            lambda a, b, y: F.when(
                number(a) > 12, _day(y, number(b), number(a))
            ).otherwise(_day(y, number(a), number(b)))
        ),
        "month_year": _family(c, MONTH_YEAR, 2, lambda m, y: _day(y, month_number(m), F.lit(s.mid_month))),
        "short_month_year": _family(c, SHORT_MONTH_YEAR, 2, lambda m, y: _day(y, month_number(m), F.lit(s.mid_month))),
        "month_day": _family(
            c, MONTH_DAY, 2, lambda m, d: _day(F.lit(str(s.default_year)), month_number(m), number(d))
        ),
    }


def dates(c: str | Column, s: Settings = DEFAULTS) -> Column:
    """Distinct dates, by notation first and place second."""
    return F.array_distinct(F.concat(*families(c, s).values()))


def any_of(c: Column, patterns: list[str]) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def date_type(c: str | Column) -> Column:
    q = F.lower(col(c))
    return F.when(any_of(q, CHANGE), "change_date").when(
        any_of(q, DETERMINATION), "determination_date"
    ).when(any_of(q, PERIOD), "period").otherwise("unspecified")


def without_dates(c: str | Column) -> Column:
    out = F.regexp_replace(col(c), DATE_PHRASE, "")
    for pattern, to in ((r"\s{2,}", " "), (r",\s*\?", "?"), (r"\bfor\s*\?", "?"), (r"\bfor\s*,", "")):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def context(question: str | Column, found: Column, s: Settings = DEFAULTS) -> Column:
    """The date context of a question whose dates are ``found``.

    Fields: claim_date (never set), change_date, determination_date,
    period_start, period_end, date_type, date_type_explicit, spans_boundary,
    has_any_date, primary_date, cleaned_question.
    """
    q = col(question)
    kind, first, second = date_type(q), F.try_element_at(found, F.lit(1)), F.try_element_at(found, F.lit(2))
    some, none = F.size(found) > 0, F.lit(None).cast("date")
    report = q.rlike(REPORT)
    is_change = some & ((kind == "change_date") | ((kind == "unspecified") & report))
    is_determination = some & ((kind == "determination_date") | ((kind == "unspecified") & ~report))
    is_period = some & (kind == "period")
    change, determination = F.when(is_change, first), F.when(is_determination, first)
    start, end = F.when(is_period, first), F.when(is_period, second)
    return F.struct(
        none.alias("claim_date"), change.alias("change_date"), determination.alias("determination_date"),
        start.alias("period_start"), end.alias("period_end"), kind.alias("date_type"),
        (some & (kind != "unspecified")).alias("date_type_explicit"),
        F.coalesce((start < F.lit(s.boundary)) & (end >= F.lit(s.boundary)), F.lit(False)).alias("spans_boundary"),
        F.coalesce(change, determination, start, end).isNotNull().alias("has_any_date"),
        F.coalesce(change, determination, none, start).alias("primary_date"),
        F.when(some, without_dates(q)).otherwise(q).alias("cleaned_question"),
    )
