"""Sharding and fingerprints against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from provenant.llm import fingerprint, sharding


def docs(spark, rows, schema="doc_id long, text string, source string, size string"):
    return spark.createDataFrame(rows, schema)


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [
        (
            i * 3, " ".join(rng.choices(words, k=rng.randint(1, 60))),
            "hot" if rng.random() < 0.4 else f"s{rng.randint(0, 6)}", "clash"
        )
        for i in range(n)
    ]
    return rows + [(5000, None, None, "x"), (5001, "", "s1", "x"), (5002, "same text", "s1", "x"), (5003, "same text", "s1", "x")]


def test_sharding_law(spark):
    rows = corpus()
    out = sharding.interleave(docs(spark, rows), 7, rows_per_bucket=50).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(7):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    text = {r[0]: r[1] or "" for r in rows}
    assert all(
        r["size"] == len(text[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        and r["law"] == "rows"
        for r in out
    )
    source = {r[0]: r[2] for r in rows}
    for k, n in Counter(source.values()).items():
        per = Counter(r["shard"] for r in out if source[r["doc_id"]] == k)
        assert all(abs(per[s] - n / 7) < 3 for s in range(7))


def test_sharding_is_the_stated_order(spark):
    """The same order by plain Python."""
    rows = corpus(120)
    out = {
        r["doc_id"]: (r["shard"], r["slot"])
        for r in sharding.interleave(docs(spark, rows), 5, rows_per_bucket=10).collect()
    }
    u32 = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    strata = {}
    for r in rows:
        strata.setdefault("=" + r[2] if r[2] is not None else "", []).append(r[0])
    place = []
    for s, ids in strata.items():
        ids.sort(key=lambda i: hashlib.md5(f"20:{i}".encode()).hexdigest())
        place += [((k + u32(s) / 2**32) / len(ids), s, hashlib.md5(f"20:{i}".encode()).hexdigest(), i) for k, i in enumerate(ids)]
    n = len(place)
    for p, (*_, i) in enumerate(sorted(place)):
        shard = p * 5 // n
        assert out[i] == (shard, p - -(-shard * n // 5))


def test_sharding_odd_rows(spark):
    rows = [
        (None, None, None, "x"), (None, "a", "s", "x"), (1, "x" * 100_000, "s", "x"), (1, "x" * 100_000, "s", "x"),
        (2, "", None, "x")
    ]
    out = sharding.interleave(
        docs(spark, rows).withColumn("shard", F.lit("clash")).withColumn("_k", F.lit(0)), 3
    ).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r[0], 16 + len(r[1] or "")) for r in rows)
    assert Counter(r["shard"] for r in out) == Counter({0: 2, 1: 2, 2: 1})


def test_sharding_empty(spark):
    assert sharding.interleave(docs(spark, []), 4).count() == 0


def test_edited_pairs(spark):
    rows = [r for r in corpus(150) if r[0] != 5000] + [(-4, "é" * 9, "a", "x")]
    random.Random(3).shuffle(rows)
    out = {r["doc_id"]: r for r in fingerprint.fingerprint_report(docs(spark, rows)).collect()}
    order = sorted((r[0], r[1]) for r in rows)
    assert len(out) == len(order)
    seen = {}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = out[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        for text, f in ((t, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert seen.setdefault(text, f) == f


def test_edited_pairs_over_many_buckets(spark):
    rows = [(i * i, f"text number {i} of many", "s", "x") for i in range(300)]
    few, many = (
        fingerprint.edited_pairs(
            docs(spark, rows), rows_per_bucket=k
        ).select("doc_id", "edited").orderBy("doc_id").collect()
        for k in (10_000, 7)
    )
    assert few == many


def test_edited_pairs_nulls_and_empty(spark):
    rows = [(None, "a b c d", "s", "x"), (3, "e f", "s", "x"), (9, None, "s", "x")]
    out = {r["doc_id"]: r["edited"] for r in fingerprint.edited_pairs(docs(spark, rows)).collect()}
    assert out == {None: "a b e f"[:4] + "e f", 3: "e ", 9: ""}
    assert fingerprint.edited_pairs(docs(spark, [])).count() == 0
    assert [r["edited"] for r in fingerprint.edited_pairs(docs(spark, [(1, "abcd", "s", "x")])).collect()] == ["abab"]


def chained(values, seed=42):
    """What xxhash64 makes of a row of long values."""
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed)
    return seed


def by_hand(text, words=5, bits=3):
    """(sketch, hash of all words) as signed numbers."""
    w = [
        xxhash.xxh64_intdigest(x.encode(), 42) for x in (text or "").strip(" ").lower().split()
    ] or [xxhash.xxh64_intdigest(b"", 42)]
    hashes = {chained(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    return sorted(h for h in map(signed, hashes) if h < -(2**63) + 2 ** (64 - bits)), signed(chained(w))


def test_sketch_is_the_stated_one(spark):
    rows = [
        (i, t, "s", "x") for i, (_, t, *_) in enumerate(corpus(200))
    ] + [(900, "A b\tC  d\ne f", "s", "x"), (901, "one", "s", "x"), (902, "word " * 30_000, "s", "x")]
    d = docs(spark, rows).withColumn("_pv_w", F.lit("taken")).withColumn("_pv_h", F.lit(1))
    out = fingerprint.with_sketch(d, "text", "k").collect()
    assert out[0].asDict().keys() == {*d.columns, "k", "k_whole"} and all(r["_pv_w"] == "taken" for r in out)
    text = {r[0]: r[1] for r in rows}
    assert {r["doc_id"]: (r["k"], r["k_whole"]) for r in out} == {i: by_hand(t) for i, t in text.items()}


def test_report_is_the_stated_one(spark):
    rows = [r for r in corpus(120) if r[0] != 5000]
    out = {r["doc_id"]: r for r in fingerprint.fingerprint_report(docs(spark, rows)).collect()}
    order = sorted((r[0], r[1]) for r in rows)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        a, b, c = (by_hand(x) for x in (t, t[: len(t) - half] + nxt[:half], nxt))
        alike = lambda x, y: len({*x[0]} & {*y[0]}) / len({*x[0]} | {*y[0]}) if x[0] or y[0] else float(x[1] == y[1])
        assert out[i]["near_edited"] == pytest.approx(alike(a, b)) and out[i]["near_next"] == pytest.approx(alike(a, c))
        shown = ".".join(f"{h % 2**64:X}" for h in a[0]) or f"={a[1] % 2**64:X}"
        assert out[i]["fingerprint"] == shown


def test_containment_of_short_texts(spark):
    """A short text's containment in a long one is 1 or unknown, never wrong; a union's sketch is the union of sketches."""
    rng = random.Random(3)
    long = [f"w{rng.randint(0, 10**6)}" for _ in range(407)]
    rows = [(i, " ".join(long[i : i + 7]), "s", "") for i in range(300)]
    big = fingerprint.with_sketch(docs(spark, [(1000, " ".join(long), "s", "")]), "text", "big").select("big")
    both = fingerprint.fingerprints(docs(spark, rows)).crossJoin(big).select(
        fingerprint.containment("sketch", "big").alias("c"),
        (fingerprint.merged("sketch", "big") == F.col("big")).alias("m")
    ).collect()
    assert {r["c"] for r in both} == {None, 1.0} and all(r["m"] for r in both)
    assert sum(r["c"] == 1.0 for r in both) > 60


def test_sketch_estimates(spark):
    rng = random.Random(5)
    a = [f"t{rng.randint(0, 10**6)}" for _ in range(6000)]
    rows = [
        (1, " ".join(a), "s", ""), (2, " ".join(a[:3000]), "s", ""),
        (3, " ".join(f"z{i}" for i in range(3000)), "s", "")
    ]
    f = fingerprint.fingerprints(docs(spark, rows)).alias("f")
    p = f.join(f.withColumnRenamed("doc_id", "other").withColumnRenamed("sketch", "o"), F.lit(True))
    got = {
        (r[0], r[1]): r
        for r in p.select(
            "doc_id", "other", fingerprint.jaccard("sketch", "o"), fingerprint.containment("sketch", "o")
        ).collect()
    }
    assert abs(got[1, 2][2] - 0.5) < 0.1 and got[2, 1][3] > 0.95 and got[1, 3][2] < 0.02 and got[1, 1][2] == 1


def test_white_space_at_the_ends(spark):
    """Blanks, tabs and newlines around and between words make no difference."""
    texts = ["one two three four five six", "\n one\ttwo three\r\nfour five six \x0b", "\t\none two  three four five six\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = fingerprint.with_sketch(rows, "t", "s", words=3, fraction_bits=1).collect()
    assert len({(tuple(r["s"]), r["s_whole"]) for r in got}) == 1
