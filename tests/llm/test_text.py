"""Line dedup, decontamination, n-gram join and packing against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant.llm import decontam, linededup, ngram_join, packing
from provenant.llm.common import components, spread_join

SCHEMA = "doc_id long, text string, _keys string, n_lines long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)


# ---- line dedup

def by_hand(rows, min_docs=5, min_chars=40):
    held = defaultdict(set)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [
            x for x in lines
            if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and i != max(held[key(x)]))
        ]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def line_rows(n=60, seed=2):
    rng = random.Random(seed)
    common = [f"A line number {k} that Very many documents share in full é" for k in range(6)]
    rows = []
    for i in range(n):
        lines = [f"own {i} {j}" for j in range(rng.randint(0, 3))] + rng.sample(common, rng.randint(0, 3))
        lines = [
            x.upper() if rng.random() < 0.1 and "é" not in x else f" \t{x}\r" if rng.random() < 0.3 else x
            for x in lines
        ]
        lines += lines[-1:] if rng.random() < 0.3 else []
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return [*rows, (900, None), (901, ""), (902, "x" * 50_000 + "\n" + common[0])]


def test_line_dedup(spark):
    rows = line_rows()
    got = {
        r["doc_id"]: (r["text"] or "", r["n_lines"], r["n_dropped"])
        for r in linededup.deduplicate_lines(docs(spark, rows)).collect()
    }
    assert got == by_hand(rows)
    assert linededup.deduplicate_lines(docs(spark, [])).count() == 0


def texts_of(df):
    return {r["doc_id"]: (r["text"] or "", r["n_lines"], r["n_dropped"]) for r in df.collect()}


def state(ix):
    stored = defaultdict(list)
    for r in ix.filters.collect():
        stored[r["shard"]].append(linededup.CuckooFilter(data=bytes(r["filter"])))
    held = {s: linededup.ShardFilter(p).held() for s, p in stored.items()}
    return sorted(
        map(tuple, ix.refs.collect()), key=repr
    ), sorted(map(tuple, ix.held.collect()), key=repr), {s: h for s, h in held.items() if h}


@pytest.mark.parametrize("with_text", [True, False])
def test_line_index_is_reversible(spark, with_text):
    rows = line_rows()
    gone = docs(spark, rows[40:])
    first = linededup.LineIndex.build(docs(spark, rows[:40]), shard_rows=20)
    assert first.bits > 0
    grown = first.insert(gone)
    assert texts_of(grown.apply(docs(spark, rows))) == by_hand(rows)
    assert grown.insert(gone).rows == grown.rows  # what is there already does not count again
    back = grown.delete(gone if with_text else gone.select("doc_id"))
    assert state(back) == state(first) and back.rows == first.rows
    assert texts_of(back.apply(docs(spark, rows[:40]))) == by_hand(rows[:40])
    first.close()


def test_line_index_touches_its_shards_only(spark):
    rows = [
        (i, "\n".join(f"line number {k % 400:>4} of a long list of long lines" for k in range(i, i + 20)))
        for i in range(300)
    ]
    first = linededup.LineIndex.build(docs(spark, rows), shard_rows=200)
    grown = first.insert(docs(spark, [(1000, rows[7][1].split("\n")[0])]))
    assert first.bits >= 4
    for table in (grown._held, grown._refs, grown._filters):
        assert len(table.parts) == 2 and len(table.parts[0][1]) == 1  # one shard replaced
        shard = table._shard(grown.bits)
        assert {r[0] for r in table.parts[1][0].select(shard).distinct().collect()} <= table.parts[0][1]
    assert texts_of(
        grown.apply(docs(spark, [*rows, (1000, rows[7][1].split("\n")[0])]))
    ) == by_hand([*rows, (1000, rows[7][1].split("\n")[0])])
    first.close()


def test_line_index_grows(spark):
    """Shards split, tables are compacted, filters get further parts."""
    rows = [
        (i, "\n".join(f"line {k:>6} is one of very many long lines here" for k in range(i % 40 * 10, i % 40 * 10 + 12)))
        for i in range(400)
    ]
    ix = first = linededup.LineIndex.build(docs(spark, rows[:40]), shard_rows=400)
    for k in range(40, 400, 120):
        ix = ix.insert(docs(spark, rows[k : k + 120]))
    assert ix.bits > first.bits
    assert texts_of(ix.apply(docs(spark, rows))) == by_hand(rows)
    first.close()


def test_line_dedup_hot_line_nulls_and_repeated_rows(spark):
    line = "a line that a third of all documents hold, word for word"
    rows = [
        (i, line + f"\nand {i}") for i in range(3000)
    ] + [(None, line), (None, line), (7, line + "\nand 7"), (8, None)]
    got = Counter(
        (r["doc_id"], r["text"], r["n_lines"], r["n_dropped"])
        for r in linededup.deduplicate_lines(docs(spark, rows)).collect()
    )
    want = Counter((i, f"and {i}", 2, 1) for i in range(2999))
    want += Counter({(2999, rows[2999][1], 2, 0): 1, (None, "", 1, 1): 2, (7, "and 7", 2, 1): 1, (8, None, 1, 0): 1})
    assert got == want


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    f = linededup.ShardFilter.of(keys)
    assert f.contains(keys).all()
    other = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    assert f.contains(other).mean() < 0.01
    again = linededup.ShardFilter([linededup.CuckooFilter(data=p.to_bytes()) for p in f.parts])
    for k in keys[:1000]:
        again.delete(int(k))
    assert again.contains(keys[1000:]).all() and again.contains(keys[:1000]).mean() < 0.05
    for k in keys[:1000]:
        again.insert(int(k))
    assert again.held() == f.held()
    small = linededup.ShardFilter([linededup.CuckooFilter(64)])  # opens further parts
    for k in keys:
        small.insert(int(k))
    assert len(small.parts) > 1 and small.contains(keys).all()
    for k in keys:
        small.delete(int(k))
    assert not small.held()


# ---- decontamination

def test_leaks(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    item = [(k, " ".join(rng.choices(words, k=30))) for k in range(6)] + [(6, None), (7, ""), (8, "three short words")]
    toks = [x[1].split() if x[1] else [] for x in item]
    rows = [
        (0, " ".join(rng.choices(words, k=400))), (1, "before " + item[0][1].upper() + " after"),
        (2, " ".join(toks[1][15:] + ["x"] * 5 + toks[1][:15])),
        (3, " ".join(toks[2][:10])), (4, None), (5, ""), (6, "say three short words again"),
        (7, " ".join(toks[3] * 50)), (1, "nothing"), (None, item[4][1]),
    ]
    bench = spark.createDataFrame(item, "item_id long, text string")
    for block in (10, 2_000_000):
        got = {
            (r["doc_id"], r["item_id"]): r["coverage"]
            for r in decontam.leaks(docs(spark, rows), bench, block_tokens=block).collect()
        }
        assert got == {(1, 0): 1.0, (2, 1): 1.0, (6, 8): 1.0, (7, 3): 1.0, (None, 4): 1.0}
    kept = decontam.decontaminate(docs(spark, rows), bench, block_tokens=10)
    assert kept.columns == docs(spark, []).columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 3, 4, 5]
    assert decontam.leaks(docs(spark, []), bench).count() == 0 and decontam.leaks(
        docs(spark, rows), bench.limit(0)
    ).count() == 0


def greedy(a, b, width):
    """String tiling as defined: the longest unmarked match first."""
    ma, mb, out = [False] * len(a), [False] * len(b), 0
    while True:
        best = (width - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < width:
            return out
        for k in range(best[0]):
            ma[best[1] + k] = mb[best[2] + k] = True
        out += best[0]


def test_tiles():
    rng = np.random.default_rng(6)
    for _ in range(150):
        a, b = rng.integers(0, 3, 14), rng.integers(0, 3, 25)
        pairs = np.array([(i, j) for i in range(12) for j in range(23) if (a[i : i + 3] == b[j : j + 3]).all()])
        if not len(pairs):
            continue
        runs = decontam.runs_of(pairs[:, 0], pairs[:, 1], 3)
        found = decontam.tiles(len(a), runs, 3)
        assert all((a[i : i + n] == b[j : j + n]).all() for i, j, n in found)
        for side in (0, 1):
            cells = [f[side] + k for f in found for k in range(f[2])]
            assert len(cells) == len(set(cells))
        assert sum(n for *_, n in found) == greedy(a.tolist(), b.tolist(), 3)


def test_leaks_are_those_of_brute_force(monkeypatch):
    """All pairs of short texts of few words, in chunks of few places too."""
    rng = random.Random(11)
    items = [(k, rng.choices("abcd", k=rng.randint(2, 14))) for k in range(25)]
    for chunk in (500_000, 3):
        monkeypatch.setattr(decontam._Index, "CHUNK", chunk)
        index = decontam._Index(items, 3)
        for _ in range(40):
            doc = rng.choices("abcde", k=rng.randint(1, 40))
            want = {k: greedy(t, doc, min(3, len(t))) / len(t) for k, t in items}
            got = {k: c for k, c, _ in index.leaks(" ".join(doc), 0.5)}
            assert got == {k: c for k, c in want.items() if c >= 0.5}


def test_a_shared_passage_costs_no_pairs(monkeypatch):
    """Items that a passage cannot make a leak are never tiled, however often it is told."""
    passage = "ten words that very many items of the benchmark share"
    items = [(k, (passage + f" q{k} " + " ".join(f"w{k}x{j}" for j in range(40))).split()) for k in range(20_000)]
    index = decontam._Index(items, 5)
    calls = []
    tiled = index._tiled
    monkeypatch.setattr(index, "_tiled", lambda *a: (calls.append(1), tiled(*a))[1])
    text = " ".join([passage] * 20 + ["and", "more"]) + " " + " ".join(items[3][1])
    assert [k for k, *_ in index.leaks(text, 0.5)] == [3] and len(calls) == 1


def test_one_word_said_very_often():
    import tracemalloc

    index = decontam._Index([(0, ["so"] * 200)], 5)
    tracemalloc.start()
    assert list(index.leaks("so " * 20_000, 0.5)) == [(0, 1.0, 1)]
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


# ---- n-gram join

def brute(rows, words, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(words, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and den * len(s & t) >= num * len(s | t):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows(seed=7):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(12):
        base = rng.choices(words, k=rng.choice([6, 12, 30, 80, 200]))
        for _ in range(rng.randint(2, 14)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append(" ".join(t).upper() if rng.random() < 0.1 else "\n".join(t))
    passage = " ".join(rng.choices(words, k=60))
    rows += [passage + " " + " ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(25)]
    rows += ["", None, "one", "one", "one two", "  ", "a b c", "A  b\tc", "x " * 20_000]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("words", "num"), [(3, 90), (5, 80)])
def test_ngram_join(spark, words, num):
    rows = near_rows()
    got = {
        r["doc_id"]: (r["n_shingles"], r["component_id"])
        for r in ngram_join.join(docs(spark, rows), words=words, num=num).collect()
    }
    assert got == brute(rows, words, num, 100)


def test_ngram_join_nulls_and_empty(spark):
    assert ngram_join.join(docs(spark, [])).count() == 0
    got = ngram_join.join(
        docs(
            spark,
            [(None, "a b c d e f"), (4, "a b c d e f"), (4, "q r s t u v"), (8, "q r s t u v"), (9, "a b c d e f")]
        )
    ).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter(
        {(None, None): 1, (4, 4): 2, (8, 4): 1, (9, 4): 1}
    )


@pytest.mark.parametrize("num", [50, 60, 66, 100])
def test_ngram_join_at_other_thresholds(spark, num):
    rng = random.Random(num)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(30):
        base = rng.choices(words, k=rng.choice([5, 9, 20, 45, 90]))
        keep = rng.randint(len(base) * max(num - 8, 1) // 100, len(base))
        rows += [base, base[:keep], base[len(base) - keep :], base[:keep] + rng.choices(words, k=rng.randint(0, 4))]
    rows = list(enumerate(" ".join(r) for r in rows))
    got = {
        r["doc_id"]: (r["n_shingles"], r["component_id"])
        for r in ngram_join.join(docs(spark, rows), words=1, num=num).collect()
    }
    assert got == brute(rows, 1, num, 100)


def test_bands_refuse_what_they_cannot_do():
    for num in (0, -1, 101):
        with pytest.raises(ValueError, match="similarity"):
            ngram_join.Bands(num, 100)


def test_ngram_blocks_and_salts(spark, monkeypatch):
    """Blocks of two sets and pieces spread over many salts give the same components."""
    rows = near_rows(8)
    links, stars = ngram_join.links, ngram_join.stars
    monkeypatch.setattr(ngram_join, "links", lambda *a: links(*a, block=2))
    monkeypatch.setattr(ngram_join, "stars", lambda *a: stars(*a, per_salt=3, sample=1, heavy=50))
    got = {
        r["doc_id"]: (r["n_shingles"], r["component_id"])
        for r in ngram_join.join(docs(spark, rows), words=3, num=90).collect()
    }
    assert got == brute(rows, 3, 90, 100)
    monkeypatch.setattr(ngram_join, "links", lambda *a: links(*a, block=1_000, block_bytes=1_000))
    got = {
        r["doc_id"]: (r["n_shingles"], r["component_id"])
        for r in ngram_join.join(docs(spark, rows), words=5, num=80).collect()
    }
    assert got == brute(rows, 5, 80, 100)


def test_sets_of_one_name_are_candidates(spark):
    """Where the short names of different sets clash, no link can be lost."""
    classes = spark.createDataFrame(
        [(c, c, s1, c, 9) for c, s1 in enumerate([5, 5, 6, 7, 8, 8, 8])], "cid long, rep long, s1 long, s2 long, n long"
    )
    star = spark.createDataFrame([(6, 8)], "u long, v long")
    got = {r["cid"]: r["g"] for r in ngram_join.grouped(classes, star).collect()}
    assert got == {0: 5, 1: 5, 2: 6, 4: 6, 5: 6, 6: 6}


def test_rows_with_one_id(spark):
    """Any order of rows gives the same components, and one row of each stays."""
    a, b = "a b c d e f g h i j k l m n o p q r s t", "some other words that stand in quite another text of this table here"
    rows = [(1, a), (1, b), (2, b + " more")]
    for order in (rows, rows[::-1], [rows[1], rows[2], rows[0]]):
        got = {(r["doc_id"], r["component_id"]) for r in ngram_join.join(docs(spark, order), words=3, num=80).collect()}
        assert got == {(1, 1), (2, 1)}
    rows = [(1, a), (1, a), (5, a), (3, b), (3, ""), (4, ""), (None, a), (None, a), (6, None), (6, None)]
    kept = ngram_join.one_of_each(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({1: 1, 3: 1, 4: 1, None: 2, 6: 1})
    assert ngram_join.one_of_each(docs(spark, [])).count() == 0


def test_pigeonhole_never_misses():
    rng = np.random.default_rng(2)
    for num in (50, 60, 66, 80, 90):
        bands = ngram_join.Bands(num, 100)
        for _ in range(150):
            n = int(rng.integers(2, 400))
            s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            d = bands.allowed(len(s))
            out, add = int(rng.integers(0, min(d, len(s) - 1) + 1)), int(rng.integers(0, d + 1))
            t = np.unique(np.concatenate([rng.permutation(s)[out:], rng.integers(0, 2**63, add).astype(np.uint64)]))
            both = len(np.intersect1d(s, t))
            if both * 100 >= num * (len(s) + len(t) - both) and len(s) + len(t) != 2 * both:
                assert len(np.intersect1d(bands.keys(s), bands.keys(t)))


def test_components(spark):
    edges = [(5, 1), (1, 9), (9, 12), (20, 21), (21, 22), (22, 23), (23, 24), (24, 20), (30, 30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 5: 1, 9: 1, 12: 1, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}


# ---- packing

def test_components_with_hubs(spark):
    """A chain of stars: nodes that hold far more than a 1024th of the edges."""
    edges = [(hub, hub + k) for hub in (1, 1501, 3001) for k in range(1, 1500)] + [(1600, 3200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: 1 if n <= 1500 else 1501 for e in edges for n in e}


def test_spread_join(spark):
    rows = spark.createDataFrame(
        [(k, i) for k in range(40) for i in range(1 + 90 * (k == 3))] + [(None, 7)], "k long, i long"
    )
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    want = sorted(map(tuple, rows.join(sizes, "k").collect()))
    for parts in (1, 10, 1024):
        assert sorted(
            map(tuple, spread_join(rows, sizes, "k", "n", 131, parts).select("k", "i", "n").collect())
        ) == want
    assert not spread_join(rows.limit(0), sizes.limit(0), "k", "n", 0).count()


def test_packing_round_trip(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rng = random.Random(9)
    texts = [
        " ".join(
            rng.choices(
                ["the", "thinble", "Öre", "x1", "a\n", "\n\nb", "  two", "tab\t", "don't", "…"], k=rng.randint(0, 700)
            )
        )
        for _ in range(60)
    ] + [None, "", " ", "\n", "word " * 3000, "a  \n \n b"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    out = packing.pack(docs(spark, rows), rows_per_bucket=7).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    bins = defaultdict(list)
    for r in out:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and len(part) == r["length"]
        assert r["piece"] == 0 or r["length"] == 1024
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    for i, n in Counter(i for i, _ in rows).items():
        assert sum(r["length"] for r in out if r["doc_id"] == i) == n * len(ids[i])
    assert len(bins) <= -(-sum(r["length"] for r in out) // 1024) + 1
    assert packing.pack(docs(spark, [])).count() == 0


def test_packing_ids_of_the_vocabularys_own_tokens(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    rows = [
        (i, f"before {t} after  {t}{t} x") for i, t in enumerate(special)
    ] + [(90, "<|end of text|> <|endoftext"), (91, " ".join(special))]
    got = {r["doc_id"]: r for r in packing.pack(docs(spark, rows)).collect()}
    assert special
    for i, t in rows:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert (got[i]["length"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_plan_fills_bins():
    rng = random.Random(10)
    counts = Counter(rng.randint(1, 1024) for _ in range(4000))
    lines = packing.plan(counts, 1024)
    for length, n in counts.items():
        mine = sorted(x[1:3] for x in lines if x[0] == length)
        assert mine[0][0] == 0 and mine[-1][1] == n and all(p[1] == q[0] for p, q in zip(mine, mine[1:], strict=False))
    bins = []  # first fit decreasing, one item at a time
    for length in sorted(counts.elements(), reverse=True):
        at = next((i for i, room in enumerate(bins) if room >= length), None)
        if at is None:
            bins.append(1024 - length)
        else:
            bins[at] -= length
    assert max(x[3] + (x[2] - x[1]) // x[4] for x in lines) <= len(bins)


def test_hash_of_texts(spark):
    t = docs(spark, line_rows())
    n = t.select(
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("h")
    ).where(F.col("h") == hashlib.sha256(b"").hexdigest()).count()
    assert n >= 2


@pytest.mark.parametrize("n", [50, 50_000])
def test_every_dropped_line_was_reported_by_a_filter(spark, n):
    """At every size all holders are asked: without filters nothing is dropped, and a key
    that most rows hold is dealt over slices of its shard."""
    df = spark.range(n).selectExpr(
        "id as doc_id", "concat('a line that most documents have, of more than forty', '\n', 'one of a few lines, also longer than "
        "forty, number ', id % 7, '\n', id) as text"
    )
    index = linededup.LineIndex.build(df, lasting=False)
    lost = index.drops().selectExpr("sum(size(_keys))").first()[0]
    assert lost == (n - 1) + (n - 7)
    index._filters = linededup._Table(index.store, "filters", [(index.filters.limit(0), set())])
    assert index.drops().count() == 0
    index.close()
