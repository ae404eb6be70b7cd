"""Segmentation of clause-structured documents into the clause table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import col
from . import scan
from .scan import CHUNK

DEFAULTS = Settings()

# What begins or ends a clause.
PART = r"^#\s*Part\s+(\d+)\s*[—-]\s*(.+?)\s*$"
SECTION = r"^##\s*(\d+\.\d+)\s+(.+?)\s*$"
CLAUSE = r"^\*\*(\d+\.\d+\.\d+)(?:\s+([^*]+?))?\*\*\s*(.*)$"
RULE = r"^-{3,}\s*$"
STRIP = r"^\s+|\s+$"


def line_kind(line: str | Column) -> Column:
    """``part``, ``section``, ``rule``, ``clause`` or ``text``."""
    c = col(line)
    return F.when(c.rlike(PART), "part").when(
        c.rlike(SECTION), "section"
    ).when(c.rlike(RULE), "rule").when(c.rlike(CLAUSE), "clause").otherwise("text")


def first_line(line: str | Column) -> Column:
    """A marker line's text, the defined term put back before it."""
    c = col(line)
    term, rest = F.regexp_extract(c, CLAUSE, 2), F.regexp_extract(c, CLAUSE, 3)
    return F.when(term != "", F.regexp_replace(F.concat_ws(" ", term, rest), STRIP, "")).otherwise(rest)


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): the lines of every text, numbered from 1."""
    body = F.regexp_replace(F.regexp_replace(F.col(text), r"\r\n?", "\n"), r"\n$", "")
    return df.select(
        F.col(key), F.posexplode(F.split(body, "\n", -1)).alias("_i", "line")
    ).select(key, (F.col("_i") + 1).alias("line_no"), "line")


def segment(lines: DataFrame, key: str = "source", chunk: int = CHUNK) -> DataFrame:
    """Clauses of every document of (key, line_no, line), lines numbered from 1.

    Markers, headings and rules begin islands, headings are carried forward, and
    islands that begin with a marker are the clauses. The lines of a document are
    dealt in chunks of ``chunk``: counts and headings of the earlier chunks come
    from one row a chunk, so that one very long manual is spread over as many
    tasks as many short ones. A clause is a row, and must fit one.
    """
    line = F.regexp_replace("line", r"\s+$", "")
    rows = lines.select(key, "line_no", line.alias("line")).withColumn("_kind", line_kind("line")).withColumn(
        "_chunk", F.floor((F.col("line_no") - 1) / chunk)
    )
    heading = lambda kind, pattern: F.when(F.col("_kind") == kind, F.struct(
        F.regexp_extract("line", pattern, 1).alias("number"), F.regexp_extract("line", pattern, 2).alias("title")
    ))
    kinds = {"part": heading("part", PART), "section": heading("section", SECTION)}
    starts, markers = F.count_if(F.col("_kind") != "text"), F.count_if(F.col("_kind") == "clause")
    ends = rows.groupBy(key, "_chunk").agg(
        starts.alias("starts"), markers.alias("markers"),
        *[F.max_by(h, F.when(h.isNotNull(), F.col("line_no"))).alias(kind) for kind, h in kinds.items()]
    )
    prior = scan.before(ends, key, "_chunk", ["starts", "markers"], ["part", "section"])
    w = Window.partitionBy(key, "_chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "*", starts.over(w).alias("_starts"), markers.over(w).alias("_markers"),
        *[F.last(h, ignorenulls=True).over(w).alias(f"_{kind}") for kind, h in kinds.items()]
    )
    carried = lambda kind, field: F.coalesce(
        F.coalesce(f"_{kind}", f"_before_{kind}")[field], F.lit("")
    ).alias(f"{kind}_{field}")
    rows = scan.with_before(rows, key, "_chunk", prior).select(
        key, "line_no", "line", "_kind", (F.col("_before_starts") + F.col("_starts")).alias("_island"),
        (F.col("_before_markers") + F.col("_markers")).cast("int").alias("order"),
        carried("part", "number"), carried("part", "title"), carried("section", "number"), carried("section", "title"),
    )
    marker = F.col("_kind") == "clause"
    own = F.when(marker, first_line("line")).otherwise(F.col("line"))
    whole = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", own.alias("t")))), lambda x: x["t"]), "\n"
    )
    out = rows.groupBy(key, "_island").agg(
        F.max(F.when(marker, F.regexp_extract("line", CLAUSE, 1))).alias("clause_id"),
        F.min("part_number").alias("part_number"), F.min("part_title").alias("part_title"),
        F.min("section_number").alias("section_number"), F.min("section_title").alias("section_title"),
        F.regexp_replace(whole, STRIP, "").alias("text"), F.min("order").alias("order"),
        F.min("line_no").cast("int").alias("line_start"), F.max("line_no").cast("int").alias("line_end"),
    )
    return out.where("clause_id is not null and text <> ''").drop("_island").withColumn(
        "citation", F.concat(F.lit("§"), "clause_id")
    )


def fragments(text: str | Column, limit: int = DEFAULTS.max_clause_chars) -> Column:
    """Greedy packing of paragraphs into pieces of at most ``limit`` characters;
    a longer paragraph is a piece of its own."""
    parts = F.split(col(text), "\n\n", -1)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(acc: Column, p: Column) -> Column:
        full = (acc["buf"] != "") & (F.char_length(acc["buf"]) + F.char_length(p) + 2 > limit)
        joined = F.when(acc["buf"] != "", F.concat(acc["buf"], F.lit("\n\n"), p)).otherwise(p)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, p).otherwise(joined).alias("buf")
        )

    end = lambda a: F.when(a["buf"] != "", F.concat(a["done"], F.array(a["buf"]))).otherwise(a["done"])
    return F.transform(F.aggregate(parts, start, step, end), lambda x: F.regexp_replace(x, STRIP, ""))


def split_oversized(clauses: DataFrame, limit: int = DEFAULTS.max_clause_chars) -> DataFrame:
    """Clauses longer than ``limit`` become several rows of the same identity."""
    pieces = F.when(F.char_length("text") <= limit, F.array("text")).otherwise(fragments("text", limit))
    return clauses.withColumn("text", F.explode(pieces))


def metadata(df: DataFrame) -> Column:
    """Descriptive map of a clause row; optional keys only where they have a value."""
    names = {c for c in df.columns}
    opt = lambda c: F.col(c).cast("string") if c in names else F.lit(None).cast("string")
    pairs = {
        "source": opt("source"), "clause": F.col("citation"), "clause_id": F.col("clause_id"),
        "section": F.col("section_number"),
        "section_title": F.col("section_title"),
        "part": F.concat(F.lit("Part "), "part_number", F.lit(" — "), "part_title"),
        "amendment_id": opt("amendment_id"), "effective_from": opt("effective_from"),
        "effective_to": opt("effective_to"),
    }
    return F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


def full_reference() -> Column:
    return F.concat(F.lit("§"), "clause_id", F.lit(" ("), "section_title", F.lit(")"))
