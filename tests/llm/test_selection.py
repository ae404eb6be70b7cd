"""Quality rules, hard negatives and the filter audit against brute force."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provenant.llm import filter_audit, hardneg, repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- quality rules

def longest_by_hand(ws):
    def common(i, j):
        k = 0
        while j + k < len(ws) and ws[i + k] == ws[j + k]:
            k += 1
        return k
    out = [0] * len(ws)
    for i in range(len(ws)):
        for j in range(i + 1, len(ws)):
            k = common(i, j)
            out[i], out[j] = max(out[i], k), max(out[j], k)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4))
def test_longest_repeats(documents):
    words = np.array([w for d in documents for w in d], np.int64)
    got = repetition.longest_repeats(words, np.cumsum([len(d) for d in documents]))
    assert got.tolist() == [x for d in documents for x in longest_by_hand(d)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=40))
def test_maximal_repeats(ws):
    """What begins at these places, with these lengths, is neither part of a longer
    repeat to the left nor to the right."""
    own = repetition.longest_repeats(np.array(ws, np.int64), np.array([len(ws)]))
    times = lambda s: sum(ws[i:i + len(s)] == s for i in range(len(ws) - len(s) + 1))
    for i in repetition.maximal(own, np.zeros(1, np.int64)):
        s = ws[i:i + own[i]]
        assert times(s) > 1 and times(ws[i:i + own[i] + 1]) == 1 or i + own[i] == len(ws)
        assert i == 0 or times(ws[i - 1:i + own[i]]) == 1


def window_cover(ws, k):
    grams = [tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)]
    many, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if many[g] > 1:
            hit |= set(range(i, i + k))
    return len(hit)


def rules_by_hand(text):
    text = text or ""
    ws = WORD.findall(text)
    lines, dup = [x for x in text.split("\n") if WORD.search(x)], 0
    dup = len(lines) - len(set(lines))
    short = window_cover(ws, 3)
    base = len(ws) < 50 or 100 * short > 50 * len(ws)
    longest, covered = max(longest_by_hand(ws), default=0), window_cover(ws, 8)
    kept = not base and 100 * covered <= 30 * len(ws) and longest <= 100
    return (
        len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, short, base, kept, covered, longest
    )


def rule_texts():
    rng = random.Random(4)
    word = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    out = [None, "", " \t\n", "é # <x>\n\x0b\na\na \na", "one " * 200, word(49), word(60)]
    for _ in range(40):
        parts = [word(rng.randint(5, 60)) for _ in range(3)]
        parts += rng.sample(parts, rng.randint(0, 2))
        rng.shuffle(parts)
        out.append(rng.choice(["\n", " ", "\r\n", " "]).join(parts))
    body, more = word(120), word(500)
    return [*out, f"{body} {more} {body}", f"{more} {' '.join(body.split()[:100])} x {body}", *out[:9]]


def test_quality_rules(spark):
    rows = [(i if i % 9 else None, t, "clash", -1) for i, t in enumerate(rule_texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, c0 string, kept long")
    got = repetition.assess(df, chunk_words=300).toPandas()
    assert list(got.columns)[:2] == ["doc_id", "c0"] and len(got) == len(rows)
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered", "longest"]
    key = lambda x: repr([v.item() if hasattr(v, "item") else v for v in x])
    assert sorted(map(key, got[cols].to_numpy().tolist())) == sorted(key(rules_by_hand(t)) for _, t, *_ in rows)
    by_id = {r["doc_id"]: r for r in got.to_dict("records") if r["doc_id"] == r["doc_id"]}
    assert sum(not r["base_failed"] and not r["kept"] for r in by_id.values()) > 2
    for i, t, *_ in rows:
        if i and t:
            spans = [t[s["start"]:s["end"]] for s in by_id[i]["repeats"]]
            assert sum(len(WORD.findall(s)) for s in spans) == by_id[i]["covered"]


def test_quality_rules_long_and_empty(spark):
    same, own = " ".join(["a b c"] * 100_000), " ".join(f"x{i}" for i in range(300_000))
    df = spark.createDataFrame([(1, same), (2, own), (3, own + " " + own)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in repetition.assess(df).collect()}
    assert (got[1]["longest"], got[1]["covered"]) == (299_997, 300_000)
    assert got[2]["kept"] and got[2]["longest"] == 0
    assert (got[3]["longest"], got[3]["kept"]) == (300_000, False)
    assert repetition.assess(df.limit(0)).count() == 0


# ---- hard negatives

def mined_by_hand(rows, every=50):
    seen = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own = ((label + 1) % 10 if i % 7 == 0 else label, [float(np.floor(256 * float(x))) for x in v])
        seen[i] = min(own, seen.get(i, own))
    width = max((len(v) for _, v in seen.values()), default=0)
    pad = {i: np.array(v + [0.0] * (width - len(v))) for i, (_, v) in seen.items()}
    out = []
    for a in seen:
        if a % every:
            continue
        by = sorted((-int(pad[a] @ pad[i]), i) for i in seen if i != a)
        for s, p in [x for x in by if seen[x[1]][0] == seen[a][0]][:5]:
            fit = [x for x in by if seen[x[1]][0] != seen[a][0] and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n) in enumerate(fit)]
    return sorted(out)


def vector_rows(n=900, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    v = np.round(centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 8)) * 0.4, 1).astype(np.float32)
    rows = [(int(i), [float(x) for x in v[i]], int(rng.integers(0, 10))) for i in range(n)]
    rows += [(n + k, rows[0][1], k % 10) for k in range(120)]  # one vector many times: ties
    rows += [(None, rows[1][1], 1), (5000, None, 1), (5050, [1.0, None] + [0.0] * 6, 1), (5100, [float("nan")] * 8, 1)]
    rows += [(5150, [float("inf")] * 8, 1), (5200, rows[3][1], None), (5250, [], 3), (5300, [0.5, -2.0], 3)]
    return rows + rows[100:130]  # repeated rows


VECTORS = "vec_id long, embedding array<float>, label int, id string, v int"


def test_hard_negatives(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], VECTORS)
    want = mined_by_hand(rows)
    for setting in ({}, {"rows_per_part": 200, "block": 7, "tree_rows": 150, "leaf": 4}):
        got = hardneg.mine(df, **setting)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(tuple(r) for r in got.collect()) == want
    assert len(want) > 200
    assert hardneg.mine(df.limit(0)).count() == 0


def test_ball_tree_leaves_out():
    """On clustered vectors most rows are never compared, and the best are right."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 60
    x = np.floor(centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16)) * 4)
    ids = rng.permutation(8000)
    q = x[:60]
    for lo, hi in ((-np.inf, np.inf), (50_000.0, 60_000.0)):
        s = hardneg.Search(ids[:60], np.zeros(60, int), q, np.full(60, lo), np.full(60, hi), 5, True)
        s.over(hardneg.BallTree(ids, x, 32), 0)
        who, found, score = s.found()
        for i in range(60):
            all_ = q[i] @ x.T
            order = sorted((-v, j) for v, j in zip(all_, ids, strict=True) if lo <= v <= hi and j != ids[i])[:5]
            assert sorted(zip(-score[who == i], found[who == i], strict=True)) == order
        assert s.skipped > 0.6 * s.seen


def test_scores_beyond_a_double(spark):
    rows = [(i, [3e38 * (1 if i % 3 else -1), 1e-3], 1 + i % 2) for i in range(0, 200, 5)]
    got = hardneg.mine(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert got.count() >= 0  # held to the ends of a long


# ---- filter audit

def audit_by_hand(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    low = {}
    for i, t, _ in docs:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    rows = []
    for i, t, part in docs:
        t = t or ""
        ws = WORD.findall(t)
        fails = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws),
                 "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t),
                 "E": i is not None and i > low[t]}
        rows.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, total = [r for r in rows if r[0] == part], Counter()
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                left = [r for r in own if not r[1] & before]
                here = [r for r in left if f in r[1]]
                total[f] += len(here)
                out.append([
                    part, "".join(order), k + 1, len(left) - len(here), len(here),
                    sum(f in r[1] and bool(r[1] & before) for r in own), sum(r[1] == {f} for r in own),
                    sum(r[2] for r in here), sum(r[3] for r in here), f
                ])
        for r in out:
            if r[0] == part:
                r[9] = total[r[9]] if isinstance(r[9], str) else r[9]
    return sorted(map(tuple, out))


def audit_rows():
    rng = random.Random(8)
    texts = [None, "", "A B C", "# x", " \x0b\t"] + [
        "\n".join(rng.choice(["", "X", "é"]) + f"w{rng.randrange(k)}" for _ in range(rng.randint(80, 130)))
        + rng.choice(["", "", " |"]) for k in (20, 200, 5000) for _ in range(6)
    ]
    ids = list(range(70)) + [3, 3, 40, None, None]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", "", None])) for i in ids]
    return docs, [(rng.choice([None, *range(70)]), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(60)]


def test_filter_audit(spark):
    docs, labels = audit_rows()
    df = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, lang string, mask string, n int")
    lab = spark.createDataFrame([(*r, 0) for r in labels], "doc_id long, quality int, toxic int, n int")
    got = filter_audit.audit(df, lab)
    assert got.columns == [
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    ]
    assert sorted(tuple(r) for r in got.collect()) == audit_by_hand(docs, labels)
    assert filter_audit.audit(df.limit(0), lab).count() == 0
    assert filter_audit.audit(df, lab.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


@pytest.mark.parametrize("copies", [20_000])
def test_filter_audit_hot_text(spark, copies):
    """One text that nearly all rows share meets in no task as rows."""
    df = spark.range(copies).selectExpr("id as doc_id", "if(id % 100 = 0, concat('t', id), 'same text') as text", "'en' as lang")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    r = filter_audit.audit(df, lab).where("filter_order = 'EABCD' and step = 1").first()
    assert r["removed"] == copies - copies // 100 - 1
