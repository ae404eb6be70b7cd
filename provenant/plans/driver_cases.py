"""Driver queries whose expected rows are stated by hand, and of files and texts.

The sample manual's answers are told as values, not computed: the SQL says what
the text of the manual and the rules of the operators come to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources
from ..config import Settings
from ..functions import text as T
from ..operators import amend, evidence, render
from . import driver_queries as Q
from . import engine, evaluate, sample
from . import sql as S
from .driver_queries import joined, query, sql_values, table
from .storage import Scratch, cut

# ---------------------------------------------------------------- whole answers

REPORT_10 = "A holder must report a change of ownership to the harbour office within 10 calendar days of the change."
REPORT_14 = REPORT_10.replace("10 calendar", "14 calendar")
LATE_30 = "A notice given after the 30 days required under §4.3 is late, and a change of ownership reported late incurs a penalty."
LATE_14 = LATE_30.replace("30 days", "14 days")
FEE = "Berth fee — the sum due for each month in which a berth is held."
TABLE = "The monthly berth fee is set by length:\n| Length | Fee |\n|---|---|\n| up to 6 m | $1,180 |\n| over 6 m | $1,460 |"
RELIEF = "In setting the berth fee, the first $120 of monthly towing income is disregarded."
GAP = "§2.1.2 defers to §7.1 for this point, but §7.1 (Slipway bookings) does not actually address it."
BARE = "§2.1.3 states the matter is addressed separately, but names no clause and no such provision was found elsewhere in the manual."
A51, A52, A53 = (f"Amendment No. 2026-01 §5.{i}" for i in (1, 2, 3))
SPAN_Q = "What is the monthly berth fee by length for a claim period running from 15 February 2026 to 15 March 2026?"
#: kind, question, decision, reason, text, citations; the first two are asked on an order's own date.
CASES = [
    (0, None, "ANSWER", None, REPORT_10, f"§4.3.2; {A52}"),
    (1, None, "ANSWER", None, f"{REPORT_14} [§4.3.2]\n\n{LATE_14} [§9.1.4]", f"§4.3.2; §9.1.4; {A52}"),
    (2, "What sum is the berth fee due for each month?", "ANSWER", None, FEE, "§1.2.2"),
    (
        3, "How many days does a holder have to report a change of ownership?", "REFUSE", "MISSING_DATE_CONTEXT",
        render.REFUSALS["MISSING_DATE_CONTEXT"], ""
    ),
    (
        4, "Which choir performs the opera on Friday evening?", "REFUSE", "INSUFFICIENT_EVIDENCE",
        f"{render.REFUSALS['INSUFFICIENT_EVIDENCE']}\n\n({evidence.DETAIL_NONE})", ""
    ),
    (
        5, "Are apprentice skippers enrolled at the navigation school admitted?", "REFUSE", "AMBIGUOUS_POLICY",
        f"{render.REFUSALS['AMBIGUOUS_POLICY']}\n\n({GAP})", ""
    ),
    (
        6, "May a visiting yacht raft alongside a berth holder?", "REFUSE", "AMBIGUOUS_POLICY",
        f"{render.REFUSALS['AMBIGUOUS_POLICY']}\n\n({BARE})", ""
    ),
    (7, "Which notice is late and incurs a penalty, for a determination made on 3 January 2026?", "CONFLICT", "CONFLICTING_POLICY",
     f"{render.CONFLICT_HEAD}§9.1.4 states: {LATE_30}\n\n§4.3.2 states: {REPORT_14}{render.CONFLICT_TAIL}", f"§9.1.4; §4.3.2; {A51}"),
    (8, SPAN_Q, "ANSWER", None, f"{TABLE} [§6.6.1]\n\n{RELIEF} [§6.4.1]", f"§6.6.1; §6.4.1; {A51}; {A53}"),
]
_ASKED = "How many days does a holder have to report a change of ownership occurring on "
_CASES = sql_values(CASES, "kind, question, decision, reason, text, citations")


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, CAST(date_trunc('month', CAST(o_orderdate AS DATE) + INTERVAL 360 MONTH) AS DATE) AS d FROM orders),
w AS (SELECT o_orderkey, d, CASE WHEN k = 0 AND d >= DATE '2026-03-01' THEN 1 WHEN k = 0 THEN 0 ELSE k + 1 END AS kind FROM o)
SELECT o_orderkey, coalesce(c.question, {S.lit(_ASKED)} || strftime(d, '%-d %B %Y') || '?') AS question, decision, reason, text, citations FROM w JOIN (SELECT * FROM {_CASES}) c USING (kind)""")
def answer_batch(spark, sf):
    """Every order asks one of eight questions, one of them on its own date; each
    distinct question is answered once and the answers are joined back."""
    index = engine.build_index(sample.clauses(spark), sample.specs(spark))
    day = F.trunc(F.add_months("o_orderdate", F.lit(360)), "month")
    ask = F.concat(F.lit(_ASKED), F.date_format(day, "d MMMM yyyy"), F.lit("?"))
    for kind, text, *_ in CASES[2:]:
        ask = F.when(F.col("o_orderkey") % 8 == kind - 1, text).otherwise(ask)
    orders = table(spark, sf, "orders").select("o_orderkey", ask.alias("question"))
    a = engine.answer(orders.select("question").distinct().withColumn("qid", F.md5("question")), index)
    return orders.join(a.drop("qid"), "question").select(
        "o_orderkey", "question", "decision", "reason", "text", joined(F.col("citations"), "; ").alias("citations")
    )


_VIEW = [
    ("fee", 1, "§1.2.2", "OK", ""), ("fee", 2, "§10.5.2", "insufficient", ""), ("fee", 3, "§2.1.1", "insufficient", ""),
    ("fee", 4, "§6.6.1", "insufficient", ""), ("fee", 5, "§6.4.1", "insufficient", ""),
    ("gap", 1, "§2.1.2", "DEFERRED-UNRESOLVED", GAP),
    ("bare", 1, "§2.1.3", "DEFERRED-UNRESOLVED", BARE), ("bare", 2, "§2.1.1", "insufficient", ""),
    ("bare", 3, "§2.1.2", "insufficient", ""),
    ("both", 1, "§9.1.4", "OK", ""), ("both", 2, "§9.1.1", "OK", ""),
]


@query(f"""SELECT o_orderkey, CAST(rank AS INTEGER) AS rank, citation, state, notes
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'fee' WHEN 1 THEN 'gap' WHEN 2 THEN 'bare' ELSE 'both' END AS qid FROM orders) JOIN {sql_values(_VIEW, 'qid, rank, citation, state, notes')} USING (qid)""")
def evidence_view(spark, sf):
    """Every order asks one of four questions; what stands behind the answer, the
    evidence that was weighed and its state, is made once a question and joined back."""
    asked = {"fee": 2, "gap": 5, "bare": 6, "both": 7}
    place = F.array(*[F.lit(CASES[k][1]) for k in asked.values()])
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.element_at(place, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("question")
    )
    q = orders.select("question").distinct().withColumn("qid", F.md5("question"))
    e = engine.evidence_items(q, engine.build_index(sample.clauses(spark), sample.specs(spark)))
    return orders.withColumn("qid", F.md5("question")).join(e, "qid").select(
        "o_orderkey", "rank", "citation", "state", joined(F.col("notes")).alias("notes")
    )


# ---------------------------------------------------------------- files

_MANUAL = "'# Part ' || n_nationkey || ' — ' || n_name || chr(10) || chr(10) || '## ' || n_nationkey || '.1 About ' || n_name || chr(10) || chr(10) || '**' || n_nationkey || '.1.1** ' || n_name || ' pays.' || chr(10) || chr(10) || '(a) at once' || chr(10)"


@query("""SELECT n_nationkey || '.1.1' AS clause_id, 'About ' || n_name AS section_title, n_name AS part_title, n_name || ' pays.' || chr(10) || chr(10) || '(a) at once' AS text,
CAST(8 * n_nationkey + 5 AS INTEGER) AS line_start, CAST(n_nationkey AS INTEGER) AS pos FROM nation""")
def manual_file(spark, sf):
    """A manual with a part for each nation, written as a file, read back and segmented."""
    with Scratch(spark) as tmp:
        parts = F.transform(
            F.array_sort(F.collect_list(F.struct("n_nationkey", F.expr(_MANUAL).alias("t")))), lambda x: x["t"]
        )
        table(spark, sf, "nation").agg(joined(parts, "\n").alias("value")).coalesce(1).write.text(f"{tmp.path}/manual")
        c = sources.clause_table(sources.read_manuals(spark, f"{tmp.path}/manual"))
        return cut(c.select("clause_id", "section_title", "part_title", "text", "line_start", "pos"))


@query("""SELECT 'Q' || n_nationkey AS id, n_name AS category, 'What of ' || n_name || '?' AS question, CASE WHEN n_regionkey = 0 THEN 'refuse' ELSE 'answer' END AS expected_behavior,
CASE WHEN n_regionkey = 0 THEN NULL ELSE n_regionkey || '.1.1' END AS clauses FROM nation""")
def questions_file(spark, sf):
    """Evaluation questions as one JSON array, written and read back."""
    row = F.struct(
        F.expr("'Q' || n_nationkey").alias("id"), F.col("n_name").alias("category"),
        F.expr("'What of ' || n_name || '?'").alias("question"),
        F.when(F.col("n_regionkey") == 0, "refuse").otherwise("answer").alias("expected_behavior"), F.when(
            F.col("n_regionkey") != 0, F.array(F.expr("n_regionkey || '.1.1'"))
        ).alias("expected_clauses"))
    with Scratch(spark) as tmp:
        table(spark, sf, "nation").agg(
            F.to_json(F.collect_list(row)).alias("value")
        ).coalesce(1).write.text(f"{tmp.path}/questions")
        q = sources.read_questions(spark, f"{tmp.path}/questions")
        return cut(
            q.select(
                "id", "category", "question", "expected_behavior",
                F.array_join("expected_clauses", " ").alias("clauses")
            )
        )


_PART_CONDITION = "CASE WHEN p_size % 2 = 0 THEN 'change_date' ELSE 'determination_date' END"


@query(f"""SELECT {Q._OF_PART} AS amendment, '2.' || p_partkey AS paragraph, CAST(p_partkey AS VARCHAR) AS target, 'Fee' AS find, 'Charge ' || p_name AS replacement, p_size % 3 = 0 AS everywhere,
{_PART_CONDITION} AS condition, {Q._PART_DAY} AS effective_date FROM part""")
def amendment_rules(spark, sf):
    """The rules of amendments that were read from JSON files, a rule for each part."""
    with Scratch(spark) as tmp:
        specs = Q.amendments_of_parts(spark, sf, f"{tmp.path}/amendments")
        rule = specs.select("amendment_id", "effective_date", F.explode("substitutions").alias("r"))
        return cut(rule.select(
            F.col("amendment_id").alias("amendment"), F.col("r.paragraph").alias("paragraph"),
            F.col("r.target_clause_id").alias("target"), F.col("r.find_text").alias("find"),
            F.col("r.replace_text").alias("replacement"), F.col("r.replace_all").alias("everywhere"),
            F.col("r.date_condition_type").alias("condition"), "effective_date"
        ))


@query(f"""SELECT 'A' || {Q._OF_PART} || '-5.' || p_partkey AS clause_id, 'Amendment No. ' || {Q._OF_PART} || ' §5.' || p_partkey AS citation, 'For ' || p_name AS text,
{_PART_CONDITION} AS condition, {Q._PART_DAY} AS effective_from FROM part""")
def transitional_rows(spark, sf):
    with Scratch(spark) as tmp:
        t = amend.transitional(Q._clauses_of_parts(spark, sf), Q.amendments_of_parts(spark, sf, f"{tmp.path}/amendments"))
        return cut(t.select(
            "clause_id", "citation", "text", F.col("date_condition_type").alias("condition"), "effective_from"
        ))


_SAVED = """SELECT CAST(p_partkey AS VARCHAR) AS clause_id, false AS is_amended_version, p_type AS section_title, 'Fee of ' || p_size || ' days' AS text FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), true, p_type, 'Charge of ' || p_size || ' days' FROM part WHERE p_partkey BETWEEN 1 AND 40 UNION ALL SELECT '7A', true, p_type, 'inserted' FROM part WHERE p_partkey = 7"""


@query(
    f"SELECT clause_id, is_amended_version, text, CAST(len(list_distinct({S.tokens('lexical')})) AS BIGINT) AS n_terms FROM (SELECT *, '§' || clause_id || ' ' || section_title || ' ' || text AS lexical FROM ({_SAVED}))"
)
def index_saved_and_loaded(spark, sf):
    """The index of a clause for each part, with amendments, written, read back and looked into."""
    with Scratch(spark) as tmp:
        sources.save_index(
            engine.build_index(Q._clauses_of_parts(spark, sf), Q._rules_of_parts(spark)), f"{tmp.path}/index"
        )
        index = sources.load_index(spark, f"{tmp.path}/index")
        n = index["postings"].groupBy("pos").agg(F.count(F.lit(1)).alias("n_terms"))
        return cut(index["clauses"].join(n, "pos").select("clause_id", "is_amended_version", "text", "n_terms"))


# ---------------------------------------------------------------- texts

_GRADED = "g AS (SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS id, CASE n_nationkey % 3 WHEN 0 THEN 'answer' WHEN 1 THEN 'refuse' ELSE 'conflict' END AS e, CASE WHEN n_regionkey % 2 = 0 THEN 'answer' ELSE 'refuse' END AS a, n_nationkey % 2 = 0 AS has, n_nationkey % 4 <> 0 AS held FROM nation)"
_RATES = " || ".join(
    f"'- {k}: ' || count(*) FILTER (WHERE {ok}) || '/' || count(*) FILTER (WHERE {among}) || chr(10)" for k, ok, among in (
        ("total", "e = a AND (NOT has OR held)", "true"), ("answer", "e = a AND e = 'answer'", "e = 'answer'"),
        ("refuse", "e = a AND e = 'refuse'", "e = 'refuse'"),
        ("conflict", "e = a AND e = 'conflict'", "e = 'conflict'"), ("citation", "has AND held", "has")))


@query(f"""WITH {_GRADED} SELECT '# Evaluation' || chr(10) || chr(10) || {_RATES} || chr(10) || '| id | category | expected | actual | result |' || chr(10) || '|---|---|---|---|---|' || chr(10)
|| string_agg('| ' || id || ' | c | ' || e || ' | ' || a || ' | ' || CASE WHEN e = a AND (NOT has OR held) THEN 'PASS' ELSE 'FAIL' END || ' |', chr(10) ORDER BY id) || chr(10) AS report FROM g""")
def report_text(spark, sf):
    """The report of an evaluation with a case for each nation."""
    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    name = F.concat(F.lit("n"), F.lpad(k.cast("string"), 2, "0"))
    want = F.when(k % 3 == 0, "answer").when(k % 3 == 1, "refuse").otherwise("conflict")
    cases = n.select(
        name.alias("id"), F.lit("c").alias("category"), want.alias("expected_behavior"),
        F.when(k % 2 == 0, F.array(F.lit("1.1.1"))).alias("expected_clauses")
    )
    answers = n.select(
        name.alias("qid"), F.when(F.col("n_regionkey") % 2 == 0, "ANSWER").otherwise("REFUSE").alias("decision"),
        F.when(k % 4 != 0, F.array(F.lit("§1.1.1"))).otherwise(F.array(F.lit("§2.1.1"))).alias("citations")
    )
    return spark.createDataFrame([(evaluate.report(evaluate.grade(cases, answers)),)], "report string")


@query("""SELECT o_orderkey, 'Question: Why ' || o_orderpriority || '?' || chr(10) || chr(10) || 'Evidence:' || chr(10) || string_agg('[§' || l_partkey || '] The ' || l_returnflag || ' rate' || chr(10) || 'is ' || l_suppkey, chr(10) || chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS content
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority""")
def prompt_messages(spark, sf):
    """What a phrasing model would be asked: the question, and the cleaned evidence with its citations."""
    text = F.expr("'  The **' || l_returnflag || '**   rate' || chr(10) || chr(10) || 'is ' || l_suppkey")
    item = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", text.alias("text"),
        F.concat(F.lit("§"), F.col("l_partkey").cast("string")).alias("citation")
    )
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(item)).alias("i")
    ).join(table(spark, sf, "orders"), "o_orderkey")
    m = render.prompt(F.concat(F.lit("Why "), "o_orderpriority", F.lit("?")), F.col("i"))
    return g.select("o_orderkey", F.element_at(m, 2)["content"].alias("content"))


# ---------------------------------------------------------------- deferrals

_ASK = "CASE o_orderkey % 3 WHEN 0 THEN 'Who must pay within how many days?' WHEN 1 THEN 'Which choir performs the late opera?' ELSE 'Which choir performs the opera?' END"
_WHERE = S.window("t", "place - 80", "place")
_LAST = rf"list_extract(string_split(list_extract(string_split(list_extract(string_split(regexp_replace({_WHERE}, '(?i)\(?\s*(?:see|refer\s+to|under)\s*§?\s*$', ''), '.'), -1), ';'), -1), ','), -1)"
_NO = f"[{S.listed(T.CONDITION_WORDS)}]"
_TITLED = Q._LOOKUP.replace("AS section, 'Pay", "AS section, p_type AS title, 'Pay")


@query(f"""WITH {_TITLED}, x AS (SELECT o_orderkey AS qid, o_orderkey % 4 AS k, {Q._DEFER} AS t, {S.content_tokens(_ASK)} AS q, (o_custkey % 9 + 1) || '.' || (o_orderkey % 5) AS r, '3.2.' || (o_custkey % 7) AS r2 FROM orders),
d AS (SELECT qid, t, q, 1 AS ord, CASE k WHEN 0 THEN r ELSE r2 END AS ref FROM x WHERE k IN (0, 2) UNION ALL SELECT qid, t, q, 2, '5.1' FROM x WHERE k = 2),
ids AS (SELECT clause_id AS key, title, text, pos FROM lk UNION ALL SELECT section, title, text, pos FROM lk),
m AS (SELECT d.qid, d.ord, d.ref, any_value(d.t) AS t, any_value(d.q) AS q, count(ids.key) > 0 AS known, min_by(ids.title, ids.pos) AS title,
  list_distinct(flatten(list(CASE WHEN ids.key IS NULL THEN [] ELSE {S.content_tokens('ids.text')} || {S.content_tokens('ids.title')} END))) AS toks FROM d LEFT JOIN ids ON ids.key = d.ref GROUP BY 1, 2, 3),
c AS (SELECT *, len(list_intersect(q, toks)) / len(q) AS overlap, list_filter({S.content_tokens(_LAST)}, lambda w: NOT list_contains({_NO}, w)) AS cond FROM (SELECT *, instr(t, ref) - 1 AS place FROM m)),
f AS (SELECT *, known AND overlap < 0.15 AND NOT (len(cond) > 0 AND NOT list_has_any(cond, q)) AS fails FROM c),
u AS (SELECT *, min(CASE WHEN fails THEN ord END) OVER (PARTITION BY qid) AS first FROM f),
n AS (SELECT qid, bool_or(fails) AS unresolved, coalesce(string_agg(CASE WHEN NOT known THEN '§own refers to §' || ref || {S.lit(evidence.NOTE_MISSING)} WHEN fails THEN '§own defers to §' || ref || ' for this point, but §' || ref || ' (' || title || {S.lit(evidence.NOTE_ELSEWHERE)} END, '; ' ORDER BY ord), '') AS notes
  FROM u WHERE first IS NULL OR ord <= first GROUP BY qid)
SELECT x.qid, CASE WHEN k = 1 THEN true ELSE coalesce(n.unresolved, false) END AS unresolved, CASE WHEN k = 1 THEN '§own' || {S.lit(evidence.NOTE_BARE)} ELSE coalesce(n.notes, '') END AS notes FROM x LEFT JOIN n USING (qid)""")
def deferrals_checked(spark, sf):
    """Clauses that defer to others which speak of the question, or do not, or do not exist."""
    items = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("qid"), F.expr(_ASK).alias("question"), F.lit(1).alias("pos"),
        F.lit("own").alias("clause_id"), F.expr(Q._DEFER).alias("text")
    )
    out = evidence.check_deferrals(items, Q._lookup(spark, sf), Settings())
    return out.select("qid", "unresolved", joined(F.col("notes"), "; ").alias("notes"))
