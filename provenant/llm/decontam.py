"""Benchmark decontamination by greedy string tiling.

A test item's tokens are compared with a document's by tiles: maximal runs of
equal tokens, at least ``min_match`` long, taken longest first and never
overlapping in either text (running Karp-Rabin over token ids: one rolling
hash finds the seeds, equal diagonals grow them into runs). The share of the
item's tokens that lie in tiles is its coverage, whatever the order in which
the document has the pieces. Items covered by at least ``threshold`` are leaks.

The benchmark is the query set: it is cut into blocks of at most
``block_tokens`` tokens, a block's seed index goes to the executors, and every
document passes every block. Only the item tokens are ever sent; documents
are neither shuffled nor gathered.

A seed that many items or many places of a document share: each distinct seed
of a document is met once with the items that have it, which bounds how much of
an item can be covered; only items that may reach the threshold get their pairs
of places, a chunk at a time, and keep them as runs on diagonals.

Defined cases: null or empty texts have no tokens and never match; an item of
fewer tokens than ``min_match`` leaks only where its whole token run occurs;
equal items are reported apiece; of equally long tiles the one of the least
place in the item, then in the document, comes first; an empty table on either
side gives no rows; rows with one id are reported once, with their largest
coverage; a very long text is read whole, one at a time; only ``doc_id`` and
``text`` are read, and :func:`decontaminate` passes all columns through.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts

MIN_MATCH, THRESHOLD, BLOCK_TOKENS = 5, 0.5, 2_000_000
tokens_of = re.compile(r"\w+").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``width`` ids, modulo 2**64."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    for k in range(width):
        h = h * _BASE + x[k : k + n]
    return h


Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def runs_of(pos: np.ndarray, spot: np.ndarray, width: int) -> Runs:
    """(item start, document start, length) of the maximal runs that equal windows
    of ``width`` tokens at these places make: neighbours on one diagonal."""
    diag = spot - pos
    order = np.lexsort((pos, diag))
    p, d = pos[order], diag[order]
    cut = np.flatnonzero((np.diff(p) != 1) | (np.diff(d) != 0)) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(p)] - 1
    return p[first], p[first] + d[first], p[last] - p[first] + width


def joined(parts: list[Runs], width: int) -> Runs:
    """Runs of several chunks of an item as one: those that a chunk's end cut are
    one run again."""
    a, b, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((a, b - a))
    a, b, n = a[order], b[order], n[order]
    whole = np.r_[True, (np.diff(b - a) != 0) | (a[1:] != a[:-1] + n[:-1] - width + 1)]
    first = np.flatnonzero(whole)
    last = np.r_[first[1:], len(a)] - 1
    return a[first], b[first], a[last] + n[last] - a[first]


def tiles(item_len: int, runs: Runs, width: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, document start, length).

    ``runs`` are maximal matches. The longest unmarked one is marked first (of
    equals that of the least item place, then document place), and what marks
    cut off re-enters with its shorter length.
    """
    heap = list(zip((-runs[2]).tolist(), runs[0].tolist(), runs[1].tolist(), strict=True))
    heapq.heapify(heap)
    in_item, in_doc, out = bytearray(item_len), set(), []
    left = item_len
    while heap and left:
        neg, a, b = heapq.heappop(heap)
        n = -neg
        free = [not in_item[a + i] and b + i not in in_doc for i in range(n)]
        if all(free):
            in_item[a : a + n] = b"\1" * n
            in_doc.update(range(b, b + n))
            out.append((a, b, n))
            left -= n
            continue
        start = None
        for i, ok in enumerate([*free, False]):
            if ok and start is None:
                start = i
            elif not ok and start is not None:
                if i - start >= width:
                    heapq.heappush(heap, (start - i, a + start, b + start))
                start = None
    return out


class _Index:
    """Seed windows of a block of items, by their rolling hash."""

    CHUNK = 500_000  # pairs of places held at a time

    def __init__(self, items: list[tuple[int, list[str]]], width: int):
        self.width, self.ids, self.vocabulary = width, [], {}
        for _, toks in items:
            self.ids.append(np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in toks], np.int64))
        self.names = [i for i, _ in items]
        self.by_width: dict[int, list[int]] = {}
        for k, x in enumerate(self.ids):
            if len(x):
                self.by_width.setdefault(min(width, len(x)), []).append(k)
        self.seeds = {}
        for w, ks in self.by_width.items():
            h = np.concatenate([rolling(self.ids[k], w) for k in ks])
            who = np.concatenate([np.full(len(self.ids[k]) - w + 1, k) for k in ks])
            at = np.concatenate([np.arange(len(self.ids[k]) - w + 1) for k in ks])
            order = np.argsort(h, kind="stable")
            self.seeds[w] = (h[order], who[order], at[order])

    def leaks(self, text: str, threshold: float) -> Iterator[tuple[int, float, int]]:
        toks = tokens_of(text.lower())
        doc = np.fromiter(map(self.vocabulary.get, toks, repeat(0)), np.int64, len(toks))
        known = doc > 0
        for w, (hashes, who, at) in self.seeds.items():
            if len(doc) < w:
                continue
            spots = np.flatnonzero(np.convolve(known, np.ones(w, np.int64), "valid") == w if w > 1 else known)
            if not len(spots):
                continue
            h = rolling(doc, w)[spots]
            order = np.argsort(h, kind="stable")
            h, spots = h[order], spots[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            lo, hi = np.searchsorted(hashes, h[first], "left"), np.searchsorted(hashes, h[first], "right")
            met = hi > lo
            if not met.any():
                continue
            # the items' windows that the document has, each once however often it has them
            lo, hi = lo[met], hi[met]
            from_, to = first[met], np.r_[first[1:], len(h)][met]
            many = hi - lo
            hit = np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            own = np.repeat(np.arange(len(lo)), many)
            item, pos = who[hit], at[hit]
            order = np.lexsort((pos, item))
            item, pos, own = item[order], pos[order], own[order]
            ends = np.r_[np.flatnonzero(np.diff(item)) + 1, len(item)]
            # tokens of the item that its windows reach; no tiling covers more
            reach = np.minimum(np.r_[np.where(np.diff(item) == 0, np.diff(pos), w), w], w)
            total = np.add.reduceat(reach, np.r_[0, ends[:-1]])
            for s, e, most in zip(np.r_[0, ends[:-1]], ends, total, strict=True):
                k = int(item[s])
                ids = self.ids[k]
                if most < threshold * len(ids):
                    continue
                found = self._tiled(ids, doc, pos[s:e], spots, from_[own[s:e]], to[own[s:e]], w)
                covered = sum(n for *_, n in found)
                if covered and covered >= threshold * len(ids):
                    yield self.names[k], covered / len(ids), len(found)

    def _tiled(self, ids, doc, pos, spots, from_, to, w) -> list[tuple[int, int, int]]:
        """Tiles of an item whose windows at ``pos`` meet the document's ``spots`` from
        ``from_`` to ``to``; their pairs are made a chunk at a time and kept as runs."""
        parts, window = [], np.arange(w)
        size = np.cumsum(to - from_)
        cuts = np.unique(np.searchsorted(size, np.arange(self.CHUNK, size[-1] + self.CHUNK, self.CHUNK), "left") + 1)
        for s, e in zip(np.r_[0, cuts[:-1]], np.minimum(cuts, len(pos)), strict=True):
            if e <= s:
                continue
            many = to[s:e] - from_[s:e]
            p = np.repeat(pos[s:e], many)
            d = spots[np.repeat(from_[s:e] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())]
            real = np.ones(len(p), bool)
            for i in window:  # settles equal hashes
                real &= ids[p + i] == doc[d + i]
            if real.any():
                parts.append(runs_of(p[real], d[real], w))
        return tiles(len(ids), joined(parts, w), w) if parts else []


_INDEXES: dict = {}


def _index(key: str, sent: Broadcast, width: int) -> _Index:
    """The index of a block, built once in a worker process."""
    if key not in _INDEXES:
        if len(_INDEXES) >= 4:
            _INDEXES.pop(next(iter(_INDEXES)))
        _INDEXES[key] = _Index(sent.value, width)
    return _INDEXES[key]


def _blocks(benchmark: DataFrame, block_tokens: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in blocks of bounded size (a block that one item exceeds has that
    item alone; six letters count as a token at least), streamed to the driver one
    item at a time."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        toks = tokens_of((r["text"] or "").lower())
        if not toks:
            continue
        cost = max(len(toks), len(r["text"]) // 6)
        if block and size + cost > block_tokens:
            yield block
            block, size = [], 0
        block.append((r["item_id"], toks))
        size += cost
    if block:
        yield block


LEAKS = "doc_id long, item_id long, coverage double, n_tiles int"


def leaks(
    docs: DataFrame, benchmark: DataFrame, *, min_match: int = MIN_MATCH, threshold: float = THRESHOLD,
    block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles) of every document that holds a test item."""
    spark = docs.sparkSession
    out = None
    for block in _blocks(benchmark, block_tokens):
        sent, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            index = _index(key, sent, min_match)
            for b in batches:
                rows = [
                    (doc, item, cover, n)
                    for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True)
                    if text
                    for item, cover, n in index.leaks(text, threshold)
                ]
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c, t)
                        for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)
                    ],
                    names=["doc_id", "item_id", "coverage", "n_tiles"]
                )

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, LEAKS)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], LEAKS)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "n_tiles")).alias("_m"))
    return best.select("doc_id", "item_id", "_m.coverage", "_m.n_tiles")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, min_match: int = MIN_MATCH, threshold: float = THRESHOLD,
    block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """``docs`` without the documents that hold a test item: one pass for each
    block, no shuffle; all columns pass through unchanged."""
    at = docs.columns.index("text")
    for block in _blocks(benchmark, block_tokens):
        sent, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            index = _index(key, sent, min_match)
            for b in batches:
                keep = [not t or next(index.leaks(t, threshold), None) is None for t in texts(b.column(at))]
                yield b.filter(pa.array(keep, pa.bool_()))

        docs = map_rows(docs, run, docs.schema)
    return docs
