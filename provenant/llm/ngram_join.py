"""N-gram Jaccard join by parity sketches.

Documents are sets of word shingles. Two sets link when their Jaccard
similarity is at least ``num / den``; then at most ``(den - num) / num`` of the
larger one's size differs between them. Shingles are dealt by hash to P pieces, and each piece
holds the XOR of its shingles' codes: the parity bits of a very wide sketch.
A shingle that only one set has changes one piece, so the number of pieces
that differ never exceeds the symmetric difference, and with more pieces than
that some piece must agree (pigeonhole). P follows the size band; a set joins
its own band and every lower one that a partner's size may lie in.

Which pieces are sent: they are ordered by the number of shingles in them,
heaviest first, and only the first d + 1 go out, d the largest difference
allowed. That is exact. Let p be the first agreeing piece in that order: an
agreeing piece has the same content, hence the same place in both orders, so
all pieces before p differ, in either document, and there are at most d.
Light pieces, which unlike texts would share by chance, are not sent.

Sets that share a piece are candidates; their candidate components are found
first (a star per piece, so a piece held by many costs one row each, not all
pairs), and inside a component the bit sketches' Hamming distance, a lower
bound of the symmetric difference, rejects most pairs before the exact sets
are compared. Pairs already connected are not compared again: the result is
components, and every link between different ones is found. A component of
more than ``block`` sets (or ``block_bytes``) is first cut into blocks by two
different hashes, and sets meet within their blocks only: a cluster of near
copies becomes one component by that, at two rows a set. Only where components
remain apart, blocks of sizes that can link meet each other.

Equal sets are one class with a number of its own; classes, not documents, are
joined. Candidate search knows a set by the first 64 bits of its digest, and
sets that agree there are candidates of each other, so a clash costs work but
loses nothing. Pieces held by very many are found on a sample and spread; that
moves work, never results.

Defined cases: null or empty texts (no word) have an empty set, link with
nothing and are their own component; a text with fewer words than a shingle
is one shingle; equal sets always link; rows that share an id, whatever their
texts, are linked through it; a null id is its own component (null); an empty
table gives no rows; a very long text is one set, held whole by one task at a
time; only ``doc_id`` and ``text`` are read, so no further column can clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, components, free_name, order_hash, spread_join, texts

BAND, SLACK = 1.5, 1.15  # ratio of a band's sizes; pieces made for each one sent
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Codes(dict):
    """64-bit code by word (bytes)."""

    def __missing__(self, word):
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 200_000:
            self.clear()
        self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _B
    return (x ^ x >> np.uint64(29)) * _A


def shingles(text: str | None, words: int, codes: _Codes) -> np.ndarray:
    """Sorted 64-bit codes of the distinct shingles. bytes.lower() lower-cases
    A-Z only and bytes.split() cuts at [\\x20\\x09-\\x0D] only."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(codes.__getitem__, w), np.uint64, len(w))
    k = min(words, len(w))
    s = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        s = _mix(s * _A + h[i : len(h) - k + 1 + i])
    return np.unique(s)


def digest(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Bands:
    """Size bands, and how many pieces and differences each allows."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the similarity must be over 0 and at most 1")
        self.num, self.den = num, den

    def of(self, n: int) -> int:
        b = int(math.log(n) / math.log(BAND))
        while self.first(b + 1) <= n:
            b += 1
        while self.first(b) > n:
            b -= 1
        return b

    def first(self, band: int) -> int:
        return math.ceil(BAND**band - 1e-9)

    def allowed(self, n: int, largest: int | None = None) -> int:
        """Most elements by which a linked partner (of at most ``largest``) can differ."""
        other = n * self.den // self.num if largest is None else min(largest, n * self.den // self.num)
        return (self.den - self.num) * (n + other) // (self.den + self.num)

    def pieces(self, band: int) -> int:
        return int(SLACK * (self.allowed(self.first(band + 1) - 1) + 1)) + 2

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The keys that a set sends."""
        n = len(s)
        band, out = self.of(n), []
        least = max(1, -(-n * self.num // self.den))  # a partner has at least so many
        places = [(band, None)] + [(at, self.first(at + 1) - 1) for at in range(band - 1, self.of(least) - 1, -1)]
        for at, largest in places:
            if not self.allowed(n, largest):
                continue  # only equal sets link, and those are one class
            total = self.pieces(at)
            piece = (_mix(s + np.uint64(at)) % np.uint64(total)).astype(np.int64)
            parity = np.zeros(total, np.uint64)
            np.bitwise_xor.at(parity, piece, _mix(s ^ _B))
            weight = np.bincount(piece, minlength=total)
            first = np.argsort(-weight, kind="stable")[: self.allowed(n, largest) + 1]
            out.append(_mix(_mix(parity[first]) + first.astype(np.uint64) * np.uint64(1024) + np.uint64(at)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, s1, s2): size and digest of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for b in batches:
            n, s1, s2 = [], [], []
            for t in texts(b.column(1)):
                s = shingles(t, words, codes)
                x, y = digest(s)
                n.append(len(s)), s1.append(x), s2.append(y)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in (n, s1, s2))], names=["doc_id", "n", "s1", "s2"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long")


def keys_of(docs: DataFrame, words: int, bands: Bands) -> DataFrame:
    """(key, s1) for each piece sent; a task sends an equal set once (as many
    as it can remember), so a group of copies sends few rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sent = _Codes(), set()
        for b in batches:
            keys, who = [], []
            size = 0
            for t in texts(b.column(0)):
                s = shingles(t, words, codes)
                if not len(s) or (both := digest(s)) in sent:
                    continue
                if len(sent) >= 200_000:
                    sent.clear()
                sent.add(both)
                k = bands.keys(s).view(np.int64)
                keys.append(k), who.append(np.full(len(k), both[0], np.int64))
                size += len(k)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys)), pa.array(np.concatenate(who))], names=["key", "s1"]
                    )
                    keys, who, size = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.concatenate(who))], names=["key", "s1"]
                )

    return docs.select("text").mapInArrow(run, "key long, s1 long")


def stars(
    docs: DataFrame, words: int, bands: Bands, tmp: Scratch, per_salt: int = 20_000, sample: int = 64,
    heavy: int = 10_000
) -> DataFrame:
    """(u, v): every set beside the smallest set that shares one of its pieces.

    The heaviest pieces are looked for in about one of ``sample`` documents; at
    most ``heavy`` of them are salted, about ``per_salt`` rows a salt. What is not
    among these holds less than a ``heavy``-th of the rows. The choice moves work
    only, never results.
    """
    keys = keys_of(docs, words, bands)
    part = keys_of(docs.where(order_hash(F.col("doc_id"), seed=5) % sample == 0), words, bands).groupBy("key").count()
    least = max(2, per_salt // (10 * sample))
    hot = [
        (r[0], -(-r[1] * sample // per_salt))
        for r in part.where(F.col("count") >= least).orderBy(F.desc("count"), "key").limit(heavy).collect()
    ]
    if hot:
        table = F.broadcast(keys.sparkSession.createDataFrame(hot, "key long, _salts int"))  # at most `heavy` rows
        salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.shiftright("s1", 8), F.col("_salts"))).otherwise(-1)
        rows = keys.join(table, "key", "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    else:
        rows = keys.withColumn("_salt", F.lit(-1))
    low = F.min("s1").over(Window.partitionBy("key", "_salt"))
    star = rows.withColumn("_m", low).where("_m <> s1 or _salt >= 0")
    star = tmp.table(star, "stars") if hot else star
    out = star.where("_m <> s1").select(F.col("_m").alias("u"), F.col("s1").alias("v"))
    if hot:
        tops = star.where("_salt >= 0").groupBy("key", "_salt").agg(F.min("_m").alias("t"))
        out = out.unionByName(
            tops.withColumn(
                "m", F.min("t").over(Window.partitionBy("key"))
            ).where("t <> m").select(F.col("m").alias("u"), F.col("t").alias("v"))
        )
    return out.distinct()


def _linked(left: list, right: list | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links (of class numbers) that connect the sets of one block, or of two, as
    far as they are not connected already. A set is (number, known component,
    sorted array of codes)."""
    rows = left + (right or [])
    n = np.array([len(s) for *_, s in rows])
    bits = 1 << max(9, min(16, int(math.log2(4 * n.max())) + 1))
    sketch = np.zeros((len(rows), bits // 64), np.uint64)
    for i, (*_, s) in enumerate(rows):
        at = (_mix(s + np.uint64(77)) & np.uint64(bits - 1)).astype(np.int64)
        np.bitwise_xor.at(sketch[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    first: dict[int, int] = {}
    root = [first.setdefault(c, i) for i, (_, c, _) in enumerate(rows)]

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(len(left) if right else len(rows)):
        lo = len(left) if right else i + 1
        # sum of sizes bounds the difference: d <= (den - num) (a + b) / (den + num)
        other = n[lo:]
        near = np.flatnonzero((np.minimum(other, n[i]) * den >= num * np.maximum(other, n[i])))
        if not len(near):
            continue
        dist = np.bitwise_count(sketch[lo + near] ^ sketch[i]).sum(1)
        ok = dist * (den + num) <= (den - num) * (other[near] + n[i])
        for j in (lo + near[ok][np.argsort(dist[ok], kind="stable")]).tolist():
            if find(i) == find(j):
                continue
            a, b = rows[i][2], rows[j][2]
            both = len(np.intersect1d(a, b, assume_unique=True))
            if both * den >= num * (len(a) + len(b) - both):
                root[find(j)] = find(i)
                out.append((rows[i][0], rows[j][0]))
    return out


def _meet(pairs: DataFrame, by: list[str], bands: Bands) -> DataFrame:
    """(u, v) of the blocks that ``by`` names; ``own`` is a row's block, in order of
    its value the first or the second of two."""
    num, den = bands.num, bands.den

    def link(table: pa.Table) -> pa.Table:
        rows = [
            (own, c, k, np.frombuffer(x, np.uint64))
            for own, c, k, x in zip(*(table[x].to_pylist() for x in ("own", "cid", "known", "codes")), strict=True)
        ]
        rows.sort(key=lambda r: r[:2])
        sides = [[r[1:] for r in rows if r[0] == own] for own in sorted({r[0] for r in rows})]
        whole = bool(table["alone"][0].as_py())
        found = _linked(sides[0], None if whole else sides[1], num, den) if whole or len(sides) == 2 else []
        return pa.table(
            {"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([y for _, y in found], pa.int64())}
        )

    return pairs.groupBy(*by).applyInArrow(link, "u long, v long")


def grouped(classes: DataFrame, star: DataFrame) -> DataFrame:
    """Classes (cid, rep, s1, s2, n) with their candidate component ``g``; those
    without a candidate are left out."""
    groups = components(star).select(F.col("node").alias("s1"), F.col("component").alias("g"))
    # different sets with one name: candidates even if no piece says so
    twins = classes.groupBy("s1").agg(
        F.count(F.lit(1)).alias("k")
    ).where("k > 1").select("s1").join(groups, "s1", "left_anti")
    groups = groups.unionByName(twins.select("s1", F.col("s1").alias("g")))
    return classes.join(groups, "s1").select("cid", "rep", "s1", "s2", "n", "g")


def links(
    docs: DataFrame, classes: DataFrame, words: int, bands: Bands, tmp: Scratch, block: int = 256,
    block_bytes: int = 16 << 20
) -> DataFrame:
    """(u, v): links between classes (their numbers) that connect what is linked."""
    members = tmp.table(grouped(classes, tmp.table(stars(docs, words, bands, tmp), "candidates")), "members")
    sizes = members.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t"))
    blocks = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("t") * 8 / block_bytes)).cast("int").alias("blocks")
    members = spread_join(members, sizes, "g", "m", members.count()).where("m > 1").select(
        "cid", "rep", "s1", "s2", "n", "g", blocks
    )
    members = tmp.table(members, "members")
    mine = docs.select(
        F.col("doc_id").cast("long").alias("rep"), "text"
    ).join(members.select("rep"), "rep", "left_semi")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for b in batches:
            rep, s1, s2, out, size = [], [], [], [], 0
            for i, t in zip(b.column(0).to_pylist(), texts(b.column(1), 100), strict=True):
                s = shingles(t, words, codes)
                x, y = digest(s)
                rep.append(i), s1.append(x), s2.append(y), out.append(s.tobytes())
                size += s.nbytes
                if size > block_bytes:
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c, pa.int64()) for c in (rep, s1, s2)), pa.array(out, pa.binary())],
                        names=["rep", "s1", "s2", "codes"]
                    )
                    rep, s1, s2, out, size = [], [], [], [], 0
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in (rep, s1, s2)), pa.array(out, pa.binary())],
                names=["rep", "s1", "s2", "codes"]
            )

    sets = mine.mapInArrow(load, "rep long, s1 long, s2 long, codes binary").join(members, ["rep", "s1", "s2"])  # of rows with one id, the class's own
    sets = tmp.table(sets.dropDuplicates(["rep", "s1", "s2"]).select("cid", "n", "g", "blocks", "codes"), "class-sets")
    once = sets.withColumn(
        "h", F.explode(F.when(F.col("blocks") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    )
    once = once.withColumn("b", F.pmod(F.xxhash64("cid", "h"), F.col("blocks")).cast("int"))
    once = once.select(
        "g", "h", "b", "cid", F.col("cid").alias("known"), F.lit(0).alias("own"), F.lit(True).alias("alone"), "codes"
    )
    found = tmp.table(_meet(once, ["g", "h", "b"], bands), "links")
    if sets.where("blocks > 1").limit(1).count():
        found = found.unionByName(
            tmp.table(_across(sets.where("blocks > 1"), found, bands, tmp, block, block_bytes), "links")
        )
    return found


def _across(sets: DataFrame, found: DataFrame, bands: Bands, tmp: Scratch, block: int, block_bytes: int) -> DataFrame:
    """Links between what is not connected yet in the groups of many sets. A group
    is cut by size, a band's width the largest ratio of linked sizes, and bands
    into blocks; a block meets those of its band and of the band above."""
    total = sets.count()
    known = sets.select("cid", "g", "n").join(components(found), F.col("cid") == F.col("node"), "left").select(
        "cid", "g", "n", F.coalesce("component", "cid").alias("known")
    )
    known = tmp.table(
        known.withColumn("band", F.floor(F.log("n") / math.log(bands.den / bands.num * 1.0001 + 1e-9)).cast("int")),
        "known"
    )
    state = known.groupBy("g").agg(F.count(F.lit(1)).alias("m"), (F.min("known") < F.max("known")).alias("apart"))
    apart = spread_join(known.drop("n"), state, "g", "m", total).where("apart").select("cid", "known", "band")
    rows = sets.select("cid", "g", "n", "codes").join(apart, "cid").withColumn("gb", F.struct("g", "band"))
    size = known.groupBy("g", "band").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t"))
    size = size.withColumn(
        "own_n", F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("t") * 8 / block_bytes)).cast("int")
    )
    w = Window.partitionBy("g").orderBy("band")  # a row for each band of a group
    beside = lambda c, d: F.when(c("band").over(w) == F.col("band") + d, c("own_n").over(w)).otherwise(0)
    size = size.withColumn("above_n", beside(F.lead, 1)).withColumn("below_n", beside(F.lag, -1))
    size = tmp.table(size.select(F.struct("g", "band").alias("gb"), "m", "own_n", "above_n", "below_n"), "bands")
    rows = spread_join(rows, size, "gb", "m", total).withColumn(
        "b", F.pmod(F.xxhash64("cid"), F.col("own_n")).cast("int")
    )
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda band, lo, band2, hi, own: F.struct(band.alias("band"), lo.alias("lo"), band2.alias("band2"), hi.alias("hi"), F.lit(own).alias("own"))
    at, b = F.col("band"), F.col("b")
    meets = F.concat(
        F.transform(
            upto("own_n"),
            lambda c: F.struct(
                at.alias("band"), F.least(b, c).alias("lo"), at.alias("band2"), F.greatest(b, c).alias("hi"),
                F.when(b <= c, 0).otherwise(1).alias("own")
            )
        ),
        F.transform(
            upto("above_n"), lambda c: pair(at, b, at + 1, c, 0)
        ), F.transform(upto("below_n"), lambda c: pair(at - 1, c, at, b, 1)))
    pairs = rows.withColumn("p", F.explode(meets)).select("g", "p.*", "cid", "known", "codes")
    return _meet(
        pairs.withColumn("alone", F.expr("band = band2 and lo = hi")), ["g", "band", "lo", "band2", "hi"], bands
    )


def join(docs: DataFrame, *, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every document.

    ``class_id`` is the smallest id with the same set, ``component_id`` the
    smallest reachable by links of similarity ``num / den`` or more.
    """
    bands = Bands(num, den)
    with Scratch(docs.sparkSession) as tmp:
        own = tmp.table(sets_of(docs, words), "sets")
        real = own.where("n > 0 and doc_id is not null")
        classes = real.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")).withColumn(
            "cid", F.monotonically_increasing_id()
        )
        classes = tmp.table(classes, "classes")  # written, so the numbers stay
        found = links(docs.where("doc_id is not null"), classes, words, bands, tmp)
        again = tmp.table(real.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "repeated")
        rows = again.agg(F.sum("k")).first()[0]
        if rows:  # rows that share an id link their classes
            ids = real.join(classes, ["n", "s1", "s2"]).select("doc_id", "cid")
            low = ids.groupBy("doc_id").agg(F.min("cid").alias("low")).join(again, "doc_id")
            found = found.unionByName(
                spread_join(ids, low, "doc_id", "k", rows).select(F.col("low").alias("u"), F.col("cid").alias("v"))
            )
        comps = components(found).withColumnRenamed("node", "cid")
        least = classes.join(comps, "cid").groupBy("component").agg(
            F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("m")
        )
        named = spread_join(comps, least, "component", "m", classes.count()).select("cid", "component_id")
        named = classes.join(named, "cid", "left").select(
            "n", "s1", "s2", "rep", F.coalesce("component_id", "rep").alias("component_id")
        )
        out = own.join(named, ["n", "s1", "s2"], "left")
        mine = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id"))
        return checkpointed(
            out.select(
                "doc_id", F.col("n").alias("n_shingles"), mine("rep").alias("class_id"),
                mine("component_id").alias("component_id")
            )
        )


def one_of_each(docs: DataFrame, *, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row, of the smallest id, of each component; of rows with
    that one id, the one whose values have the smallest hash. Rows without an id stay."""
    j = join(docs, words=words, num=num, den=den)
    name = free_name(docs)
    other = j.where("doc_id <> component_id").select(F.col("doc_id").alias(name))
    again = j.where("doc_id is not null").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("k")
    ).where("k > 1").select(F.col("doc_id").alias(name))
    again = checkpointed(again)
    if not again.limit(1).count():
        return docs.join(other, F.col("doc_id") == F.col(name), "left_anti")
    one = docs.join(
        again, F.col("doc_id") == F.col(name), "left_semi"
    ).join(other, F.col("doc_id") == F.col(name), "left_anti")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = one.groupBy("doc_id").agg(
        F.min_by(row, F.struct(F.xxhash64(F.to_json(row)), F.to_json(row))).alias(name)
    ).select(f"{name}.*")
    return docs.join(other.unionByName(again), F.col("doc_id") == F.col(name), "left_anti").unionByName(one)
