"""SQL text of the expressions, for checking the operators on another engine."""

from __future__ import annotations

from ..functions import dates as D
from ..functions import text as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words: list[str]) -> str:
    return ", ".join(lit(w) for w in words)


def stem(t: str) -> str:
    return (
        f"CASE WHEN length({t}) <= 4 THEN {t} WHEN {t} LIKE '%ies' THEN left({t}, length({t}) - 3) || 'y' WHEN {t} LIKE '%ations' THEN left({t}, length({t}) - 1) "
        f"WHEN {t} LIKE '%es' AND substr({t}, length({t}) - 2, 1) IN ('s', 'x', 'z') THEN left({t}, length({t}) - 2) WHEN {t} LIKE '%ed' THEN left({t}, length({t}) - 2) "
        f"WHEN {t} LIKE '%s' AND {t} NOT LIKE '%ss' THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def raw_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(T.TOKEN)}, 0)"


def tokens(x: str) -> str:
    return f"list_transform({raw_tokens(x)}, lambda t: {stem('t')})"


def rerank_tokens(x: str) -> str:
    return f"list_transform(list_filter({tokens(x)}, lambda t: t NOT IN ({listed(T.RERANK_STOPWORDS)})), lambda t: {stem('t')})"


def content_tokens(x: str) -> str:
    return f"list_sort(list_distinct(list_filter({tokens(x)}, lambda t: t NOT IN ({listed(T.EVIDENCE_STOPWORDS)}) AND NOT regexp_matches(t, '^[0-9]+$'))))"


def words(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), {lit(T.WORD)}, 0), lambda t: t NOT IN ({listed(T.VECTOR_STOPWORDS)}))"


def grams(w: str) -> str:
    return f"list_concat({w}, list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"


def numbers(x: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({x}, {lit(T.NUMBER)}, 0)))"


def unit_family(u: str) -> str:
    v = f"replace(lower({u}), ' ', '')"
    return f"CASE WHEN {v} LIKE 'day%' THEN 'day' WHEN {v} LIKE 'week%' THEN 'week' WHEN {v} LIKE 'month%' THEN 'month' WHEN {v} LIKE 'year%' THEN 'year' WHEN {v} IN ('percent', '%') THEN 'percent' ELSE {v} END"


def start_of(text: str, pattern: str, i: str) -> str:
    """0-based start of the i-th match (i from 1), from the pieces between matches."""
    gaps, found = f"string_split_regex({text}, {lit(pattern)})", f"regexp_extract_all({text}, {lit(pattern)}, 0)"
    total = lambda a: f"coalesce(list_sum(list_transform({a}, lambda z: length(z))), 0)"
    return f"CAST({total(f'{gaps}[1:{i}]')} + {total(f'{found}[1:{i} - 1]')} AS BIGINT)"


def window(x: str, start: str, end: str) -> str:
    lo = f"greatest({start}, 0)"
    return f"substr({x}, CAST({lo} + 1 AS BIGINT), CAST(greatest({end} - {lo}, 0) AS BIGINT))"


def modified(before: str) -> str:
    return "(" + " OR ".join(f"contains({before}, {lit(p)})" for p in T.MODIFIERS) + ")"


def month(m: str) -> str:
    return f"list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(left({m}, 3)))"


def day(y: str, m: str, d: str) -> str:
    return f"CAST(try_strptime({y} || '-' || {m} || '-' || {d}, '%Y-%m-%d') AS DATE)"


def family(x: str, pattern: str, groups: int, made: str) -> str:
    """Dates of one notation; ``made`` says them with a, b and c for the groups."""
    for g, name in zip(range(1, groups + 1), "abc", strict=False):
        made = made.replace(f"<{name}>", f"regexp_extract_all({x}, {lit(pattern)}, {g})[i]")
    return f"list_filter(list_transform(range(1, len(regexp_extract_all({x}, {lit(pattern)}, 1)) + 1), lambda i: {made}), lambda d: d IS NOT NULL)"


def families(x: str) -> dict[str, str]:
    yearless = D.MONTH_DAY.split("(?!")[0]
    rest = f"regexp_replace({x}, {lit(yearless[:-2] + '[ ,]*[0-9]{4}')}, ' ', 'g')"
    return {
        "iso": family(x, D.ISO, 3, day("<a>", "<b>", "<c>")),
        "dmy": family(x, D.DMY, 3, day("<c>", month("<b>"), "<a>")),
        "mdy": family(x, D.MDY, 3, day("<c>", month("<a>"), "<b>")),
        "short_mdy": family(x, D.SHORT_MDY, 3, day("<c>", month("<a>"), "<b>")),
        "slash": family(
            x, D.SLASH, 3,
            f"CASE WHEN CAST(<a> AS INT) > 12 THEN {day('<c>', '<b>', '<a>')} ELSE {day('<c>', '<a>', '<b>')} END"
        ),
        "month_year": family(x, D.MONTH_YEAR, 2, day("<b>", month("<a>"), "'15'")),
        "short_month_year": family(x, D.SHORT_MONTH_YEAR, 2, day("<b>", month("<a>"), "'15'")),
        "month_day": family(rest, yearless, 2, day("'2026'", month("<a>"), "<b>")),
    }


def shown(dates: str) -> str:
    return f"array_to_string(list_transform({dates}, lambda d: strftime(d, '%Y-%m-%d')), ',')"


def any_of(x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {lit(p)})" for p in patterns) + ")"


def date_type(x: str) -> str:
    low = f"lower({x})"
    return f"CASE WHEN {any_of(low, D.CHANGE)} THEN 'change_date' WHEN {any_of(low, D.DETERMINATION)} THEN 'determination_date' WHEN {any_of(low, D.PERIOD)} THEN 'period' ELSE 'unspecified' END"


def without_dates(x: str) -> str:
    out = f"regexp_replace({x}, {lit(D.DATE_PHRASE)}, '', 'g')"
    for p, r in ((r"\s{2,}", " "), (r",\s*\?", "?"), (r"\bfor\s*\?", "?"), (r"\bfor\s*,", "")):
        out = f"regexp_replace({out}, {lit(p)}, {lit(r)}, 'g')"
    return f"trim({out})"
