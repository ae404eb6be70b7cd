"""Reversible line deduplication: sharded cuckoo filters over exact counts.

``LineIndex`` keeps three tables, each cut into shards by the leading bits of a
key's hash. ``holders`` has a row for each (key, document); ``refs`` has, for each
key, the exact number of documents that hold it and the largest such id;
``filters`` has the cuckoo filters of a shard with the keys that are held by at
least ``min_docs`` documents. Inserting documents adds holders, deleting
documents takes them away again, and keys whose count crosses the threshold
enter or leave the filter of their shard, so the state after a deletion is that
of an index which never saw the document. Only the shards of keys that came or
went are read and written again; when shards have twice the rows that they
should, each is cut in two (rows stay where they are: a shard is a range of
hashes).

What a document loses: holders, reference counts and the filter of a shard meet
in one task (the filter first, then the counts, then the holders one batch
after another). Every holder is asked of the filter; what the filter reports is
settled by the counts, so the result is exact, and what it does not report is
kept. No filter is collected. A shard that a frequent key swells is cut into
slices by document: each slice has its part of the holders, and the shard's
filter and counts, which are small, go to every slice.

A key is the line stripped of ``[\\x20\\x09-\\x0D]`` and with A-Z lower-cased; it
is held as its 128-bit digest. A key of at least ``min_chars`` code points
loses all its lines except those of the largest id that holds it.

Defined cases: a null or empty text is one empty line; a null id holds lines
like any other and is the smallest id; several lines of one document with
one key count as one holder and stay or go together; an empty table gives no
rows; rows with the same id are one document to the counts; a very long text or
line is handled whole; input columns named ``n_lines`` or ``n_dropped`` are
replaced, all others pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bucket_rows, checkpointed, free_name, texts

STRIP = " \t\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(65, 91)}
SLOTS, KICKS, LOAD = 4, 500, 0.85


class CuckooFilter:
    """Four-slot cuckoo filter of 16-bit fingerprints with partial-key displacement."""

    def __init__(self, capacity: int = 0, data: bytes | None = None):
        if data is not None:
            self.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        else:
            size = 1 << max(1, math.ceil(math.log2(max(1, capacity) / (SLOTS * LOAD))))
            self.table = np.zeros((size, SLOTS), np.uint16)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = keys.astype(np.uint64)
        mask = np.uint64(len(self.table) - 1)
        tag = ((k >> np.uint64(40)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        a = k & mask
        b = a ^ (tag.astype(np.uint64) * np.uint64(0x5BD1E995) & mask)
        return tag, a.astype(np.int64), b.astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        tag, a, b = self._places(keys)
        return (self.table[a] == tag[:, None]).any(1) | (self.table[b] == tag[:, None]).any(1)

    def insert(self, key: int) -> bool:
        tag, a, b = (x[0] for x in self._places(np.array([key], np.uint64)))
        mask = len(self.table) - 1
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = tag
                return True
        at, before = int(b), self.table.copy()
        for i in range(KICKS):
            slot = i % SLOTS
            tag, self.table[at, slot] = self.table[at, slot], tag
            at ^= int(tag) * 0x5BD1E995 & mask
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = tag
                return True
        self.table = before
        return False

    def delete(self, key: int) -> bool:
        tag, a, b = (x[0] for x in self._places(np.array([key], np.uint64)))
        for at in (a, b):
            held = np.flatnonzero(self.table[at] == tag)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def held(self) -> list[tuple[int, int]]:
        """What is stored, as (tag, lesser place) in order: the same for the same
        keys, however they came and whatever was there between."""
        at, slot = np.nonzero(self.table)
        tag = self.table[at, slot].astype(np.int64)
        other = at ^ (tag * 0x5BD1E995 & len(self.table) - 1)
        return sorted(zip(tag.tolist(), np.minimum(at, other).tolist(), strict=True))

    def to_bytes(self) -> bytes:
        return self.table.tobytes()


class ShardFilter:
    """The filters of a shard, all of one size: a key that finds no room opens a
    further one, and a key can be deleted from whichever holds its tag."""

    LEAST, PARTS = 64, 4  # room of the smallest; a shard of more parts is built anew

    def __init__(self, parts: list[CuckooFilter]):
        self.parts = parts

    @classmethod
    def of(cls, keys: np.ndarray) -> ShardFilter:
        f = cls([CuckooFilter(max(cls.LEAST, len(keys)))])
        for k in keys:
            f.insert(int(k))
        return f

    def contains(self, keys: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(keys), bool)
        for p in self.parts:
            hit |= p.contains(keys)
        return hit

    def insert(self, key: int) -> None:
        if any(p.insert(key) for p in self.parts):
            return
        self.parts.append(CuckooFilter(data=bytes(self.parts[0].table.nbytes)))
        self.parts[-1].insert(key)

    def delete(self, key: int) -> None:
        any(p.delete(key) for p in self.parts)

    def held(self) -> list[tuple[int, int]]:
        return sorted(x for p in self.parts for x in p.held())


def line_key(line: str) -> str:
    return line.strip(STRIP).translate(_LOWER)


def _digest(key: str) -> tuple[int, int]:
    d = hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


HOLDERS = "k1 long, k2 long, doc_id long"
FILTERS = "shard int, part int, filter binary"


def holders(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(k1, k2, doc_id), once for each long line of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, ids = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                keys = {
                    k for line in (text or "").split("\n")
                    if len(line) >= min_chars and len(k := line_key(line)) >= min_chars
                }
                for k in keys:
                    x, y = _digest(k)
                    k1.append(x)
                    k2.append(y)
                ids += [doc] * len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (k1, k2, ids)], names=["k1", "k2", "doc_id"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, HOLDERS)


def _refs(held: DataFrame) -> DataFrame:
    return held.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keep_doc"))


def shard_of(key: str | Column, bits: int) -> Column:
    """The leading ``bits`` bits of a hash."""
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


class _Table:
    """Rows by shard, in parts written one after another: a later part has all
    rows of the shards that it replaces in the earlier ones."""

    PARTS, DEAD = 8, 4096  # beyond so many parts, or shards replaced, all is written anew

    def __init__(self, store: Scratch, name: str, parts: list[tuple[DataFrame, set[int]]]):
        self.store, self.name, self.parts = store, name, parts

    def _shard(self, bits: int) -> Column:
        return F.col("shard") if self.name == "filters" else shard_of("k2", bits)

    def read(self, bits: int, shards: set[int] | None = None) -> DataFrame:
        out = None
        for df, dead in self.parts:
            if dead:
                df = df.where(~self._shard(bits).isin(sorted(dead)))
            if shards is not None:
                df = df.where(self._shard(bits).isin(sorted(shards)))
                if self.name != "filters" and bits and len(shards) <= 64:  # as ranges, which the files' statistics serve
                    width = 1 << (64 - bits)
                    sign = lambda x: x - 2**64 if x >= 2**63 else x
                    near = F.lit(False)
                    for s in sorted(shards):
                        near = near | F.col("k2").between(sign(s * width), sign(s * width + width - 1))
                    df = df.where(near)
            out = df if out is None else out.unionByName(df)
        return out

    def replaced(self, bits: int, shards: set[int], rows: DataFrame) -> _Table:
        """The table whose rows of ``shards`` are ``rows``."""
        order = "shard" if self.name == "filters" else "k2"
        parts = [(df, dead | shards) for df, dead in self.parts]
        new = [*parts, (self.store.table(rows.sortWithinPartitions(order), self.name), set())]
        if len(new) > self.PARTS or sum(len(dead) for _, dead in new) > self.DEAD:
            whole = _Table(self.store, self.name, new).read(bits)
            new = [(self.store.table(whole.sortWithinPartitions(order), self.name), set())]
        return _Table(self.store, self.name, new)

    def split(self) -> _Table:
        """The same table for shards that are half as wide."""
        return _Table(
            self.store, self.name, [(df, {x for s in dead for x in (2 * s, 2 * s + 1)}) for df, dead in self.parts]
        )


class LineIndex:
    """Holders, reference counts and filters in the shared folder. An index is a
    value: inserting and deleting give another one, which shares the files of
    untouched shards; :meth:`close` deletes the files of them all."""

    def __init__(
        self, store: Scratch, held: _Table, refs: _Table, filters: _Table, bits: int, rows: int, min_docs: int,
        min_chars: int, shard_rows: int
    ):
        self.store, self._held, self._refs, self._filters, self.bits, self.rows = store, held, refs, filters, bits, rows
        self.min_docs, self.min_chars, self.shard_rows = min_docs, min_chars, shard_rows

    @classmethod
    def build(
        cls, docs: DataFrame, *, min_docs: int = 5, min_chars: int = 40, shard_rows: int = 20_000, lasting: bool = True
    ) -> LineIndex:
        """``lasting``: files are put in order of the shards, so that an update finds
        its own, and counts and filters are files too. An index that is read once
        needs neither: only its holders are written."""
        order = (lambda df: df.sortWithinPartitions("k2")) if lasting else (lambda df: df)
        # a document that repeats a line within itself has emitted it once;
        # distinct() joins rows that share an id
        store = Scratch(docs.sparkSession)
        try:
            return cls._made(store, docs, order, min_docs, min_chars, shard_rows, lasting)
        except BaseException:
            store.__exit__()
            raise

    @classmethod
    def _made(cls, store, docs, order, min_docs, min_chars, shard_rows, lasting) -> LineIndex:
        keep = store.table if lasting else (lambda df, name: df)
        held = store.table(order(holders(docs, min_chars).distinct()), "holders")
        refs = keep(order(_refs(held)), "refs")
        rows = held.count()
        bits = max(0, math.ceil(math.log2(max(1, rows) / bucket_rows(rows, shard_rows))))
        out = cls(
            store, _Table(store, "holders", [(held, set())]), _Table(store, "refs", [(refs, set())]),
            _Table(store, "filters", []), bits, rows, min_docs, min_chars, shard_rows
        )
        out._filters = _Table(store, "filters", [(keep(out._built(), "filters"), set())])
        return out

    def close(self) -> None:
        self.store.__exit__()

    @property
    def held(self) -> DataFrame:
        return self._held.read(self.bits)

    @property
    def refs(self) -> DataFrame:
        return self._refs.read(self.bits)

    @property
    def filters(self) -> DataFrame:
        return self._filters.read(self.bits)

    def _built(self, shards: set[int] | None = None) -> DataFrame:
        """Filters made from the counts, of some or all shards."""
        def build(pdf):
            import pandas as pd

            f = ShardFilter.of(np.sort(pdf["k1"].to_numpy().astype(np.uint64)))
            return pd.DataFrame(
                [(int(pdf["shard"].iloc[0]), i, p.to_bytes()) for i, p in enumerate(f.parts)],
                columns=["shard", "part", "filter"]
            )

        keys = self._refs.read(self.bits, shards).where(F.col("n_docs") >= self.min_docs).select(
            shard_of("k2", self.bits).alias("shard"), "k1"
        )
        return keys.groupBy("shard").applyInPandas(build, FILTERS)

    def _changed(self, shards: set[int], held: _Table, keys: DataFrame, rows: int) -> LineIndex:
        """The index with these holders, which differ in ``keys`` of ``shards`` only."""
        old = self._refs.read(self.bits, shards)
        fresh = self.store.table(_refs(held.read(self.bits, shards).join(keys, ["k1", "k2"], "left_semi")), "fresh")
        refs = self._refs.replaced(self.bits, shards, old.join(keys, ["k1", "k2"], "left_anti").unionByName(fresh))
        many = lambda df: df.where(F.col("n_docs") >= self.min_docs).select("k1", "k2")
        was, now = many(old.join(keys, ["k1", "k2"], "left_semi")), many(fresh)
        moves = now.join(was, ["k1", "k2"], "left_anti").withColumn("comes", F.lit(True)).unionByName(
            was.join(now, ["k1", "k2"], "left_anti").withColumn("comes", F.lit(False))
        )

        def update(moved, stored):
            import pandas as pd

            f = ShardFilter(
                [CuckooFilter(data=bytes(x)) for x in stored.sort_values("part")["filter"]]
                or [CuckooFilter(ShardFilter.LEAST)]
            )
            moved = moved.sort_values(["comes", "k1"])  # what leaves goes first
            for k, comes in zip(moved["k1"].to_numpy().astype(np.uint64), moved["comes"], strict=True):
                (f.insert if comes else f.delete)(int(k))
            shard = int((moved if len(moved) else stored)["shard"].iloc[0])
            return pd.DataFrame(
                [(shard, i, p.to_bytes()) for i, p in enumerate(f.parts)], columns=["shard", "part", "filter"]
            )

        moves = moves.select(shard_of("k2", self.bits).alias("shard"), "k1", "comes")
        stored = self._filters.read(self.bits, shards)
        filters = self._filters.replaced(
            self.bits, shards, moves.groupBy("shard").cogroup(stored.groupBy("shard")).applyInPandas(update, FILTERS)
        )
        out = LineIndex(
            self.store, held, refs, filters, self.bits, rows, self.min_docs, self.min_chars, self.shard_rows
        )
        while out.rows > 2 * bucket_rows(out.rows, self.shard_rows) << out.bits:
            out._held, out._refs, out.bits = out._held.split(), out._refs.split(), out.bits + 1
        if out.bits != self.bits:
            out._filters = _Table(self.store, "filters", [(self.store.table(out._built(), "filters"), set())])
            return out
        grown = {
            r[0]
            for r in filters.read(self.bits, shards).where(
                F.col("part") >= ShardFilter.PARTS
            ).select("shard").distinct().collect()
        }
        if grown:
            out._filters = filters.replaced(self.bits, grown, out._built(grown))
        return out

    def _shards(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(shard_of("k2", self.bits)).distinct().collect()}  # at most 2**bits numbers

    def insert(self, docs: DataFrame) -> LineIndex:
        new = self.store.table(holders(docs, self.min_chars).distinct(), "came")
        shards = self._shards(new)
        if not shards:
            return self
        own = self._held.read(self.bits, shards)
        new = self.store.table(_minus(new, own), "new")
        held = self._held.replaced(self.bits, shards, own.unionByName(new))
        return self._changed(shards, held, new.select("k1", "k2").distinct(), self.rows + new.count())

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents of these ids. If ``ids`` has their texts too, only
        the shards of their lines are read; else all holders are looked through."""
        if "text" in ids.columns:
            known = self.store.table(holders(ids, self.min_chars).distinct(), "went")
            shards = self._shards(known)
            gone = _common(self._held.read(self.bits, shards), known) if shards else known
        else:
            own = ids.select(F.col("doc_id").cast("long").alias("_gone")).distinct()
            gone = self.held.join(own, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_semi")
        gone = self.store.table(gone.select("k1", "k2", "doc_id"), "gone")
        shards = self._shards(gone)
        if not shards:
            return self
        held = self._held.replaced(self.bits, shards, _minus(self._held.read(self.bits, shards), gone))
        return self._changed(shards, held, gone.select("k1", "k2").distinct(), self.rows - gone.count())

    def drops(self) -> DataFrame:
        """(doc_id, _keys): the keys whose lines that document loses."""
        repeated = self.refs.where(F.col("n_docs") >= self.min_docs).select("k1", "k2", "keep_doc")
        shard = shard_of("k2", self.bits).alias("shard")
        room = bucket_rows(self.rows, self.shard_rows)
        # shards of more than twice their rows; each has more than ``room``, so there are
        # fewer than the root of all rows
        swollen = F.broadcast(
            self.held.groupBy(shard).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * room).select(
                "shard", F.ceil(F.col("n") / room).cast("int").alias("slices")
            )
        )
        cut_up = lambda df: df.join(swollen, "shard", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
        every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
        one = F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int").alias("slice")
        none = lambda t: F.lit(None).cast(t)
        rows = cut_up(self.filters).select(
            "shard", every, F.lit(0).alias("kind"), none("long").alias("k1"), none("long").alias("k2"),
            none("long").alias("doc_id"), "filter"
        )
        rows = rows.unionByName(cut_up(repeated.select(shard, "k1", "k2", F.col("keep_doc").alias("doc_id"))).select(
            "shard", every, F.lit(1).alias("kind"), "k1", "k2", "doc_id", none("binary").alias("filter")
        ))
        rows = rows.unionByName(cut_up(self.held.select(shard, "k1", "k2", "doc_id")).select(
            "shard", one, F.lit(2).alias("kind"), "k1", "k2", "doc_id", none("binary").alias("filter")
        ))
        lost = rows.repartition("shard", "slice").sortWithinPartitions("shard", "slice", "kind").mapInArrow(_settle, HOLDERS)
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("_keys"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``text`` cleaned, and ``n_lines`` and ``n_dropped`` added."""
        own = free_name(docs)
        keys = F.col(f"{own}_keys")
        drops = checkpointed(self.drops()).select(
            F.col("doc_id").alias(f"{own}_doc"), F.col("_keys").alias(f"{own}_keys")
        )
        names = [f"`{c}`" for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
        joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col(f"{own}_doc")), "left")
        out = joined.withColumn(f"{own}_c", _clean(self.min_chars)(F.when(keys.isNotNull(), F.col("text")), keys))  # other texts stay in the JVM
        pick = lambda plain, name: F.when(keys.isNull(), plain).otherwise(F.col(f"{own}_c.{name}")).alias(name)
        lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
        return out.select(
            *names, pick(F.col("text"), "text"), pick(lines, "n_lines"), pick(F.lit(0).cast("long"), "n_dropped")
        )


def _same(a: str, b: str) -> Column:
    return (
        F.col(f"{a}.k1") == F.col(f"{b}.k1")
    ) & (F.col(f"{a}.k2") == F.col(f"{b}.k2")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))


def _minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.alias("a").join(b.alias("b"), _same("a", "b"), "left_anti")


def _common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.alias("a").join(b.alias("b"), _same("a", "b"), "left_semi")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Holders that lose their lines. The rows of a slice of a shard come as its filters
    (kind 0), the counts of its repeated keys (1, the document to keep in ``doc_id``),
    and its holders (2); only the filters and repeated keys of one shard are held."""
    now, screen, keep = None, None, {}
    for b in batches:
        kind = b.column(2).to_numpy()
        of = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()])
        cuts = np.flatnonzero((np.diff(of) != 0).any(axis=0) | (np.diff(kind) != 0)) + 1
        lost = []
        for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(kind)], strict=True):
            if e == s:
                continue
            if tuple(of[:, s]) != now:
                now, screen, keep = tuple(of[:, s]), ShardFilter([]), {}
            part = b.slice(s, e - s)
            if kind[s] == 0:
                screen.parts += [CuckooFilter(data=bytes(x)) for x in part.column(6).to_pylist()]
            elif kind[s] == 1:
                keep.update(
                    zip(
                        zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True),
                        part.column(5).to_pylist(), strict=True
                    )
                )
            else:
                hit = part.filter(pa.array(screen.contains(part.column(3).to_numpy().astype(np.uint64))))
                k1, k2, doc = (hit.column(i).to_pylist() for i in (3, 4, 5))
                lost += [x for x in zip(k1, k2, doc, strict=True) if x[:2] in keep and keep[x[:2]] != x[2]]
        cols = list(zip(*lost, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["k1", "k2", "doc_id"])


def _clean(min_chars: int):
    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def clean(text, keys):
        import pandas as pd

        out = []
        for t, ks in zip(text, keys, strict=True):
            if ks is None or t is None:
                out.append((None, 1, 0))  # a null text is one line and stays null
                continue
            gone = {(int(k["k1"]), int(k["k2"])) for k in ks}
            lines = t.split("\n")
            kept = [
                x for x in lines if len(x) < min_chars or len(k := line_key(x)) < min_chars or _digest(k) not in gone
            ]
            out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    return clean


def deduplicate_lines(docs: DataFrame, *, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    index = LineIndex.build(docs, min_docs=min_docs, min_chars=min_chars, lasting=False)
    try:
        return index.apply(docs)
    finally:
        index.close()
