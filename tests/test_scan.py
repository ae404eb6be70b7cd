"""One long manual over many tasks: the same clauses as from a plain loop over its lines."""

import re

from provenant import sources
from provenant.operators import scan, segment
from pyspark.sql import functions as F


def manual(n: int) -> list[str]:
    """Lines with headings far apart, rules, blank lines and clauses of several lines."""
    out = []
    for i in range(n):
        kind = i % 23
        if i % 501 == 7:
            out.append(f"# Part {i // 501} — Title {i}")
        elif i % 97 == 11:
            out.append(f"## {i // 97}.{i % 9} Section {i}")
        elif kind in (3, 9, 15):
            out.append(f"**{i // 97}.{i % 9}.{i}**" + (f" text {i}  " if kind == 3 else ""))
        elif kind == 20 and i % 2:
            out.append("---")
        else:
            out.append("" if kind in (5, 9) else f"words of line {i}")
    return out


def by_loop(lines: list[str]) -> list[tuple]:
    part, section, open_one, found, order = ("", ""), ("", ""), None, [], 0

    def close():
        if open_one and (text := "\n".join(open_one["t"]).strip()):
            found.append((open_one["id"], *open_one["part"], *open_one["section"], text, open_one["order"], open_one["at"], open_one["to"]))

    for no, line in enumerate((x.rstrip() for x in lines), 1):
        p, s, c = (re.match(x, line) for x in (segment.PART, segment.SECTION, segment.CLAUSE))
        if p or s or c or re.match(segment.RULE, line):
            close()
            open_one = None
        if p:
            part = p.groups()
        elif s:
            section = s.groups()
        elif c:
            order += 1
            first = f"{c[2]} {c[3]}".strip() if c[2] else c[3]
            open_one = {"id": c[1], "part": part, "section": section, "t": [first], "order": order, "at": no, "to": no}
        elif open_one:
            open_one["t"].append(line)
            open_one["to"] = no
    close()
    return found


COLUMNS = ("clause_id", "part_number", "part_title", "section_number", "section_title", "text", "order", "line_start", "line_end")


def test_chunks_do_not_show(spark):
    lines = manual(3_000)
    want = sorted(by_loop(lines))
    assert len(want) > 300
    docs = spark.createDataFrame([("a", "\n".join(lines)), (None, "\n".join(lines)), ("empty", ""), ("none", None)], "source string, text string")
    rows = segment.lines_of(docs, "source", "text")
    for chunk in (1, 7, 500, 100_000):
        got = segment.segment(rows, chunk=chunk).select("source", *COLUMNS).collect()
        for source in ("a", None):
            assert sorted(tuple(r)[1:] for r in got if r[0] == source) == want, chunk
        assert {r[0] for r in got} == {"a", None}


def test_a_long_manual_is_read_in_splits_and_spread_over_tasks(spark, tmp_path):
    lines = manual(60_000)
    (tmp_path / "long.md").write_text("\n".join(lines) + "\n")
    (tmp_path / "short.md").write_bytes("\r\n".join(lines[:50]).encode())
    (tmp_path / "void.md").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = sources.read_manual_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = sorted((r.line_no, r.line) for r in rows.where("source = 'long.md'").collect())
        assert got == list(enumerate(lines, 1))
        # the most rows that one window holds is a chunk
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        parts = rows.withColumn("c", F.floor((F.col("line_no") - 1) / scan.CHUNK)).where("source = 'long.md'")
        assert parts.groupBy("c").count().agg(F.max("count")).first()[0] == scan.CHUNK
        held = segment.segment(rows).groupBy(F.spark_partition_id()).count().count()
        assert held > 1
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        c = sources.clauses_of_lines(rows).where("source = 'long.md'").select(*COLUMNS, "pos").collect()
        want = by_loop(lines)
        assert sorted(tuple(r)[:-1] for r in c) == sorted(want)
        place = {r.line_start: r.pos for r in c}
        assert [place[w[7]] for w in want] == list(range(len(want)))
        whole = sources.clause_table(sources.read_manuals(spark, str(tmp_path)))
        cols = ["source", *COLUMNS, "pos"]
        assert sorted(map(tuple, whole.select(*cols).collect())) == sorted(map(tuple, sources.clauses_of_lines(rows).select(*cols).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_numbers_run_on_over_chunks(spark):
    rows = spark.createDataFrame([(k, i) for k in ("a", "b", None) for i in range(1, 100)], "k string, i int")
    got = scan.numbered(rows, "k", F.floor(F.col("i") / 8), ["i"], "n").collect()
    assert len(got) == 297 and all(r.n == r.i for r in got)
