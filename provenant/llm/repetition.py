"""Quality rules by suffix arrays: how much of a text repeats within it.

Documents are read as sequences of words (``[^\\x20\\x09-\\x0D]+``, case kept). A
task puts documents together until they have ``chunk_words`` words and builds
one suffix array for them by prefix doubling, in which suffixes of different
documents never compare equal; a document with more words is a chunk of its
own, so whole texts are read at any length. Ranks of each doubling step give
the longest common prefixes of neighbours. The greater of a suffix's two
neighbouring prefixes is the lcp interval it lies in: the longest substring
that begins there and occurs again. Those that the suffix one word earlier does
not contain are the maximal repeats. Repeats of at least ``min_words`` words are
united to spans, first occurrences included; a document fails if spans cover
more than ``max_covered`` percent of its words, or if a repeat has more than
``max_longest`` words. Nothing is shuffled.

Defined cases: a null, empty or blank text has no words, fails the base rules
and is not kept; null, repeated and tied ids are ordinary rows, each judged by
itself; an empty table gives no rows; only the named columns are read, so
further columns never clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from .common import free_name, map_rows, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICTS = ("base_failed", "kept")


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position, how many words the longest substring has that begins
    there and also begins elsewhere in the same document. ``ends`` has the
    documents' ends, ascending; the last is the number of words."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    end = ends[doc]
    key = doc.astype(np.int64) * (int(words.max()) + 1) + words
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)  # where in the suffix array a position's group of equals begins
    first = np.r_[True, key[sa][1:] != key[sa][:-1]]
    rank[sa] = np.flatnonzero(first)[np.cumsum(first) - 1]
    levels, width = [rank.astype(np.int32)], 1
    while True:
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(tied):
            break
        after = tied + width
        nxt = np.where(after < end[tied], rank[np.minimum(after, n - 1)] + 1, 0)
        by = rank[tied] * (n + 1) + nxt
        order = np.argsort(by, kind="stable")
        pos, by = tied[order], by[order]
        group = np.r_[True, rank[pos][1:] != rank[pos][:-1]]
        at = rank[pos] + np.arange(len(pos)) - np.flatnonzero(group)[np.cumsum(group) - 1]
        sa[at] = pos
        first = np.r_[True, by[1:] != by[:-1]]
        rank[pos] = at[np.flatnonzero(first)[np.cumsum(first) - 1]]
        levels.append(rank.astype(np.int32))
        width *= 2
    a, b = sa[:-1], sa[1:]
    lcp = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y, ranks = a + lcp, b + lcp, levels[level]
        inside = (x < end[a]) & (y < end[b])
        lcp[inside] += (ranks[x[inside]] == ranks[y[inside]]).astype(np.int64) << level
    out = np.zeros(n, np.int64)
    out[a] = lcp
    out[b] = np.maximum(out[b], lcp)
    return out


def maximal(repeats: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions at which a maximal repeat begins: not one that the repeat of the
    position before contains."""
    before = np.r_[0, repeats[:-1]]
    before[starts[starts < len(repeats)]] = 0
    return np.flatnonzero((repeats > 0) & (before != repeats + 1))


def united(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as starts and ends of disjoint ones."""
    if not len(starts):
        return starts, starts
    reach = np.maximum.accumulate(starts + lengths)
    new = np.r_[True, starts[1:] > reach[:-1]]
    return starts[new], np.r_[reach[:-1][new[1:]], reach[-1]]


def _lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n") if "\n" in text else ():
        if line.strip(BLANK):
            n += line in seen
            seen.add(line)
    return n


def _measure(chunk: list[tuple[str, list[str]]], min_words: int, short: int) -> Iterator[tuple]:
    """For each (text, words): (n_repeat_words, covered, longest, spans)."""
    ids: dict[str, int] = {}
    words = np.fromiter((ids.setdefault(w, len(ids)) for _, ws in chunk for w in ws), np.int64)
    ends = np.cumsum([len(ws) for _, ws in chunk])
    repeats = longest_repeats(words, ends)
    for (text, ws), hi in zip(chunk, ends, strict=True):
        own = repeats[hi - len(ws):hi]
        few = np.flatnonzero(own >= short)
        s, e = united(few, np.full(len(few), short))
        n_short = int((e - s).sum())
        top = maximal(own, np.zeros(1, np.int64))
        top = top[own[top] >= min_words]
        s, e = united(top, own[top])
        spans = []
        if len(s):
            at = [m.span() for m in WORD.finditer(text)]
            spans = [{"start": at[i][0], "end": at[j - 1][1]} for i, j in zip(s, e, strict=True)]
        yield n_short, int((e - s).sum()), int(own.max()) if len(own) else 0, spans


def assess(
    docs: DataFrame, *, text_col: str = "text", min_words: int = 8, max_covered: int = 30, max_longest: int = 100,
    least_words: int = 50, window: int = 3, max_window: int = 50, chunk_words: int = 100_000
) -> DataFrame:
    """``docs`` without the text, with the base counts, ``base_failed``, ``covered``
    (words in long repeats), ``longest`` (words), ``repeats`` (their spans in code
    points, end exclusive) and ``kept``. Columns of these names are replaced."""
    added = [StructField(c, LongType()) for c in COUNTS] + [
        StructField("base_failed", BooleanType()), StructField("covered", LongType()),
        StructField("longest", LongType()), StructField("repeats", ArrayType(SPAN)), StructField("kept", BooleanType())
    ]
    taken = {f.name for f in added}
    passed = [c for c in docs.columns if c != text_col and c not in taken]
    own = free_name(docs)
    read = docs.select(*[F.col(f"`{c}`") for c in passed], F.col(f"`{text_col}`").alias(f"{own}_t"))
    schema = StructType([*read.schema.fields[:-1], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(batch, lo, hi, chunk):
            rows = []
            for (text, ws), (n_short, covered, longest, spans) in zip(
                chunk, _measure(chunk, min_words, window), strict=True
            ):
                n = len(ws)
                base = n < least_words or 100 * n_short > max_window * n
                kept = not base and 100 * covered <= max_covered * n and longest <= max_longest
                rows.append((
                    n, sum(map(len, ws)), sum(text.count(c) for c in SYMBOLS), _lines(text), n_short, base, covered,
                    longest, spans, kept
                ))
            new = [
                pa.array(c, pa.bool_() if f.name in VERDICTS else pa.list_(
                    pa.struct([("start", pa.int64()), ("end", pa.int64())])
                ) if f.name == "repeats" else pa.int64())
                for c, f in zip(zip(*rows, strict=True), added, strict=True)
            ]
            cols = batch.slice(lo, hi - lo).columns[:-1] + new
            return pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])

        for batch in batches:
            lo, held, chunk = 0, 0, []
            for i, text in enumerate(texts(batch.column(batch.num_columns - 1), 100)):
                ws = WORD.findall(text or "")
                if chunk and held + len(ws) > chunk_words:
                    yield done(batch, lo, i, chunk)
                    lo, held, chunk = i, 0, []
                chunk.append((text or "", ws))
                held += len(ws)
            if chunk:
                yield done(batch, lo, lo + len(chunk), chunk)

    return map_rows(read, run, schema)
