"""Words and word pairs of a corpus in packed parts: texts are read once, whatever the corpus.

A part holds some documents. It is written as one row of postings, which name terms by their
place in the part, and as some rows of its terms, which are hashes in order, cut by value into
ranges. What is shuffled is terms of parts, not postings: a range meets its terms from all parts,
sums their document frequencies and sends these back, beside the number of each that a question
has. A term is known by 80 bits of hashes: of 10^9 different terms, any two are taken for one
with a chance of 4 in 10^7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.storage import Scratch, brief_shuffles

#: Words of a part, characters of text to a range of terms, questions that are compared at once.
PART_WORDS, RANGE_CHARS, ASKED = 1_500_000, 12_000_000, 20_000
PAIR, CHECK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, byte by byte of all their values, compressed."""
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), a.dtype.itemsize)]], np.int64).tobytes()
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays if len(a))
    return head + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def _unpacked(b: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(b, np.int64, 1)[0])
    shapes = np.frombuffer(b, np.int64, 2 * n, 8).reshape(n, 2)
    size, at, out = int(shapes.prod(axis=1).sum()), 0, []
    planes = np.frombuffer(pa.decompress(b[8 + 16 * n:], decompressed_size=size, codec="zstd"), np.uint8) if size else np.zeros(0, np.uint8)
    for k, width in shapes:
        own = np.ascontiguousarray(planes[at:at + k * width].reshape(width, k).T)
        out.append(own.reshape(-1).view(f"u{width}"))
        at += k * width
    return out


def _gaps(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    g = np.diff(x, prepend=0)
    g[starts] = x[starts]
    return g.astype(np.uint32)


def _ungapped(g: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.cumsum(g.astype(np.int64))
    lens = np.diff(np.r_[starts, len(g)])
    return total - np.repeat(total[starts] - g[starts], lens)


def _part(words: pa.Array, lens: np.ndarray, stop: pa.Array) -> tuple[np.ndarray, ...]:
    """Postings (number of terms of each document; places of terms; counts) and terms (hash,
    check, documents) of documents of these words; a null stands between texts of one."""
    d = words.dictionary_encode()
    codes = pc.fill_null(d.indices, -1).to_numpy().astype(np.int64)
    size = len(d.dictionary)
    kept = np.r_[~np.asarray(pc.is_in(d.dictionary, stop)), True]  # the last is that of nulls
    own = np.repeat(np.arange(len(lens)), lens)[kept[codes]]
    codes = codes[kept[codes]]
    beside = (own[1:] == own[:-1]) & (codes[1:] >= 0) & (codes[:-1] >= 0)
    pairs, inverse = np.unique(codes[:-1][beside] * size + codes[1:][beside], return_inverse=True)
    own = np.r_[own[codes >= 0], own[:-1][beside]]
    ids = np.r_[codes[codes >= 0], size + inverse]
    digests = b"".join(hashlib.blake2b(w.encode(), digest_size=16).digest() for w in d.dictionary.to_pylist())
    h, g = np.frombuffer(digests, np.uint64).reshape(size, 2).T
    x, y = np.divmod(pairs, size) if size else (pairs, pairs)
    h, g = np.r_[h, h[x] * PAIR + h[y] + CHECK], np.r_[g, g[x] * CHECK + g[y] + PAIR]
    present = np.flatnonzero(np.bincount(ids, minlength=len(h)))
    order = present[np.lexsort((g[present], h[present]))]
    rank = np.zeros(len(h), np.int64)
    rank[order] = np.arange(len(order))
    post, tf = np.unique(own * max(1, len(order)) + rank[ids], return_counts=True)
    doc, term = np.divmod(post, max(1, len(order)))
    return np.bincount(doc, minlength=len(lens)), term, tf, h[order], g[order].astype(np.uint16), np.bincount(term, minlength=len(order))


def _ranges(h: np.ndarray, ranges: int) -> np.ndarray:
    """Where the terms of each range begin among hashes in order, and their end."""
    of = (h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    return np.searchsorted(of, np.arange(ranges + 1, dtype=np.uint64))


def parts(
    docs: DataFrame, key: str, text: str, stopwords: Sequence[str], ranges: int, rounds: int, asked: bool = False
) -> DataFrame:
    """(part, chunk, piece, keys, packed): postings of a chunk of documents (piece -1), whose part
    is under 0, and its terms by piece. Rows of one key are one document."""
    words = docs.select(F.col(key).alias("k"), T.words(text, ()).alias("w"))
    with brief_shuffles(docs.sparkSession):
        once = docs.groupBy(key).count().where("count > 1").isEmpty()
    if not once:
        apart = lambda x: F.concat(F.coalesce(x, F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
        words = words.groupBy("k").agg(F.flatten(F.collect_list(apart(F.col("w")))).alias("w"))
    stop, per = list(stopwords), ranges // rounds

    def made(keys: pa.Array, words: pa.Array, lens: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        chunk = task << 24 | n
        terms, places, tf, h, g, df = _part(words, lens, pa.array(stop, pa.string()))
        some = terms[terms > 0]
        starts = np.cumsum(some) - some
        these = keys.filter(pa.array(terms > 0))
        post = _packed(some.astype(np.uint32), _gaps(places, starts), tf.astype(np.uint32))
        at = _ranges(h, ranges)
        df = df * (not asked)
        pieces = [p for p in range(ranges) if at[p] < at[p + 1]]
        sent = [_packed(np.diff(h[at[p]:at[p + 1]], prepend=np.uint64(0)), g[at[p]:at[p + 1]], df[at[p]:at[p + 1]].astype(np.uint32)) for p in pieces]
        if not len(some):
            return
        own = pa.ListArray.from_arrays(pa.array([0, len(these), *[len(these)] * len(pieces)], pa.int32()), these)
        yield pa.RecordBatch.from_arrays([
            pa.array([-1 - (task * 7 + n) % rounds, *[p // per for p in pieces]], pa.int32()),
            pa.array([-1 - chunk if asked else chunk] * (len(pieces) + 1), pa.int64()), pa.array([-1, *pieces], pa.int32()), own,
            pa.array([post, *sent], pa.binary())
        ], names=["part", "chunk", "piece", "keys", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, most, n = [], 0, 0
        for batch in batches:
            count = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            total, at = np.cumsum(count), 0
            while at < batch.num_rows:
                before = total[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(total, before + PART_WORDS - most, "right")))
                held.append((batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at).flatten(), count[at:end]))
                most, at = most + total[end - 1] - before, end
                if most >= PART_WORDS or at < batch.num_rows:
                    yield from made(*map(pa.concat_arrays, list(zip(*held, strict=True))[:2]), np.concatenate([x[2] for x in held]), n)
                    held, most, n = [], 0, n + 1
        if held:
            yield from made(*map(pa.concat_arrays, list(zip(*held, strict=True))[:2]), np.concatenate([x[2] for x in held]), n)

    kind = docs.schema[key].dataType.simpleString()
    return words.mapInArrow(run, f"part int, chunk long, piece int, keys array<{kind}>, packed binary")


def _met(rows: pa.Table, rounds: int) -> pa.Table:
    """The terms of one range of all chunks: their frequencies, and numbers of those asked for."""
    chunks, piece = rows.column("chunk").to_numpy(), rows.column("piece")[0].as_py()
    read = [_unpacked(b.as_buffer().to_pybytes()) for b in rows.column("packed")]
    h = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in read])
    g, own = np.concatenate([x[1] for x in read]), np.concatenate([x[2] for x in read])
    lens = np.array([len(x[0]) for x in read])
    asked = np.repeat(chunks < 0, lens)
    del read
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if (same & (g[order][1:] != g[order][:-1])).any():
        order = np.lexsort((g, h))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]
    starts = np.flatnonzero(new)
    df = np.add.reduceat(own[order].astype(np.int64), starts)
    wanted = np.logical_or.reduceat(asked[order], starts)
    number = np.where(wanted, np.cumsum(wanted), 0)
    group = np.cumsum(new) - 1
    df_of, number_of = np.empty(len(h), np.uint32), np.empty(len(h), np.uint32)
    df_of[order], number_of[order] = df[group], number[group]
    ends = np.cumsum(lens)
    return pa.table({
        "chunk": rows.column("chunk"), "piece": pa.array([piece] * len(chunks), pa.int32()),
        "packed": pa.array([_packed(df_of[e - n:e], number_of[e - n:e]) for e, n in zip(ends, lens, strict=True)], pa.binary())
    })


def _weighed(rows: pa.Table, n: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk the keys, where each document begins, weights, the terms' numbers (0: not
    asked for) and document frequencies."""
    piece = rows.column("piece").to_numpy()
    packed = rows.column("packed").combine_chunks()
    post = int(np.flatnonzero(piece < 0)[0])
    keys = rows.column("keys").combine_chunks()[post].values
    lens, gaps, tf = _unpacked(packed[post].as_buffer().to_pybytes())
    starts = (np.cumsum(lens, dtype=np.int64) - lens).astype(np.int64)
    terms = _ungapped(gaps, starts)
    told = [(int(piece[i]), *_unpacked(packed[int(i)].as_buffer().to_pybytes())) for i in np.argsort(piece) if piece[i] >= 0]
    df = np.concatenate([x[1] for x in told]).astype(np.float64)
    number = np.concatenate([np.where(x[2] > 0, x[0] << 32 | x[2].astype(np.int64), 0) for x in told])
    idf = np.log((n + 1) / (df + 1)) + 1
    return keys, starts, (1 + np.log(tf.astype(np.float64))) * idf[terms], number[terms], df[terms]


class Grams:
    """The parts of ``docs``, and of ``questions`` (qid, question, their columns), in ``tmp``."""

    def __init__(
        self, docs: DataFrame, key: str, text: str, tmp: Scratch, stopwords: Sequence[str], n: int, chars: int | None, rounds: int,
        questions: tuple[DataFrame, str, str] | None = None
    ):
        self.key, self.kind, self.tmp, self.n, self.rounds = key, docs.schema[key].dataType.simpleString(), tmp, n, rounds
        ranges = rounds * max(8, -(-(chars or 0) // (RANGE_CHARS * rounds)))
        self.made = tmp.table(parts(docs, key, text, stopwords, ranges, rounds), "parts", brief=True, by="part")
        self.asked, terms = None, self.made
        if questions:
            q, qid, question = questions
            self.qid, self.qkind = qid, q.schema[qid].dataType.simpleString()
            self.asked = tmp.table(parts(q, qid, question, stopwords, ranges, rounds, True), "asked", brief=True, by="part")
        for i in range(rounds):
            terms = self.made.where(F.col("part") == i).select("chunk", "piece", "packed")
            if self.asked:
                terms = terms.unionByName(self.asked.where(F.col("part") == i).select("chunk", "piece", "packed"))
            met = terms.groupBy("piece").applyInArrow(lambda t: _met(t, rounds), "chunk long, piece int, packed binary")
            # the round of a chunk, as parts has it
            own = F.when(F.col("chunk") < 0, -1).otherwise(
                F.pmod(F.shiftright("chunk", 24) * 7 + F.col("chunk").bitwiseAND(F.lit((1 << 24) - 1)), F.lit(rounds))
            )
            self.sums = tmp.table(met.withColumn("part", own.cast("int")), "sums", append=True, brief=True, by="part")

    def of_round(self, i: int, make: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        none = F.lit(None).cast(f"array<{self.kind}>").alias("keys")
        post = self.made.where(F.col("part") == -1 - i).select("chunk", "piece", "keys", "packed")
        told = self.sums.where(F.col("part") == i).select("chunk", "piece", none, "packed")
        return post.unionByName(told).groupBy("chunk").applyInArrow(make, schema)

    def totals(self, i: int, sums: Sequence[str]) -> DataFrame:
        """(key, sums .., norm) of the documents of a round."""
        n, kinds = self.n, {"n_terms": "long", "total": "double", "top": "double"}

        def make(rows: pa.Table) -> pa.Table:
            keys, starts, w, _, _ = _weighed(rows, n)
            made = {
                "n_terms": lambda: np.diff(np.r_[starts, len(w)]), "total": lambda: np.add.reduceat(w, starts),
                "top": lambda: np.maximum.reduceat(w, starts)
            }
            norm = np.maximum(np.sqrt(np.add.reduceat(w * w, starts)), 1e-12)
            return pa.table({"k": keys} | {c: pa.array(made[c]()) for c in sums} | {"norm": pa.array(norm)})

        out = self.of_round(i, make, ", ".join([f"k {self.kind}", *[f"{c} {kinds[c]}" for c in sums], "norm double"]))
        return out.withColumnRenamed("k", self.key)

    def query(self) -> DataFrame:
        """(q, number, w): unit vectors of the questions' terms that a document has."""
        n = self.n

        def make(rows: pa.Table) -> pa.Table:
            keys, starts, w, number, df = _weighed(rows, n)
            w = np.where(df > 0, w, 0.0)
            norm = np.maximum(np.sqrt(np.add.reduceat(w * w, starts)), 1e-12)
            own = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(w)]))
            kept = df > 0
            return pa.table({"q": keys.take(pa.array(own[kept])), "number": pa.array(number[kept]), "w": pa.array((w / norm[own])[kept])})

        none = F.lit(None).cast(f"array<{self.qkind}>").alias("keys")
        rows = self.asked.where("part < 0").select("chunk", "piece", "keys", "packed").unionByName(
            self.sums.where("part = -1").select("chunk", "piece", none, "packed")
        )
        return rows.groupBy("chunk").applyInArrow(make, f"q {self.qkind}, number long, w double")

    def none(self) -> DataFrame:
        """What no question makes of :meth:`best`."""
        return self.made.sparkSession.createDataFrame([], f"{self.qid} {self.qkind}, {self.key} {self.kind}, score double")

    def best(self, i: int, query: pa.Table, k: int, within: float) -> DataFrame:
        """(qid, key, score): of each chunk of a round the ``k`` best documents of each question
        of ``query``, and those as good but for ``within``."""
        d = query.column("q").combine_chunks().dictionary_encode()
        order = np.argsort(query.column("number").to_numpy(), kind="stable")
        known, at = np.unique(query.column("number").to_numpy()[order], return_index=True)
        q, w_q = d.indices.to_numpy()[order], query.column("w").to_numpy()[order]
        sent = self.made.sparkSession.sparkContext.broadcast((known, np.r_[at, len(order)], q, w_q, d.dictionary))
        n = self.n

        def make(rows: pa.Table) -> pa.Table:
            known, at, q, w_q, qids = sent.value
            keys, starts, w, number, _ = _weighed(rows, n)
            norm = np.maximum(np.sqrt(np.add.reduceat(w * w, starts)), 1e-12)
            own = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(w)]))
            place = np.minimum(np.searchsorted(known, number), len(known) - 1)
            hit = known[place] == number
            own, w, place = own[hit], w[hit], place[hit]
            out, many = [], max(1, 2_000_000 // len(qids))
            for a in range(0, len(starts), many):
                lo, hi = np.searchsorted(own, [a, a + many])
                docs, cells = min(many, len(starts) - a), 0
                cells = np.zeros(docs * len(qids))
                counts = np.diff(at)[place[lo:hi]]
                ends = np.cumsum(counts)
                x = lo
                while x < hi:  # some million products at once
                    y = max(x + 1, lo + int(np.searchsorted(ends, (ends[x - lo - 1] if x > lo else 0) + 2_000_000, "right")))
                    c = counts[x - lo:y - lo]
                    p = np.repeat(np.arange(x, y), c)
                    j = np.repeat(at[place[x:y]], c) + np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)
                    cells += np.bincount((own[p] - a) * len(qids) + q[j], w[p] * w_q[j], len(cells))
                    x = y
                s = cells.reshape(docs, len(qids)) / norm[a:a + docs, None]
                least = np.partition(s, -k, axis=0)[-k] - within if docs > k else np.zeros(len(qids))
                doc, asked = np.nonzero((s > 0) & (s >= least))
                out.append((doc + a, asked, s[doc, asked]))
            doc, asked, score = map(np.concatenate, zip(*out, strict=True))
            return pa.table({"q": qids.take(pa.array(asked)), "k": keys.take(pa.array(doc)), "score": pa.array(score)})

        return self.of_round(i, make, f"q {self.qkind}, k {self.kind}, score double").select(
            F.col("q").alias(self.qid), F.col("k").alias(self.key), "score"
        )
