"""Best-fit packing by minimum bin slack.

Every text becomes token ids plus an end id; what exceeds the sequence length
is cut into full pieces, the first piece taking the remainder. The pieces'
lengths are counted (at most ``capacity`` counters), and the plan is made on
those counters alone: per bin, the longest remaining length is fixed and a
bitset subset-sum over the available lengths finds the fullest feasible
combination, which is removed as often as the counters allow. The plan has a
few lines per length whatever the number of documents, is sent to the
executors, and pieces find their bin by their rank among the pieces of their
length; ranks are made in (length, bucket) groups, so one very common length
is spread over tasks.

Defined cases: a null text is empty (one end id); an empty table gives no
rows; equal rows are packed apiece; a null or repeated id is a row like any
other; pieces of one length are told apart by id, piece, start and checksum; a
very long text is encoded whole, one at a time; only ``doc_id`` and ``text`` are
read, so no further column can clash. Token ids are those of the public
vocabulary; the merge ranks are applied by the faster of two public libraries,
which give equal ids, and a text that tells one of the vocabulary's own tokens
goes to the library that knows them.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_rows, checkpointed, order_hash, salted_rank, texts

CAPACITY, END_ID = 1024, 2
_STATE: dict = {}


def _encoder(tokenizer: str | None):
    """text -> bytes of little-endian unsigned 32-bit ids."""
    if tokenizer not in _STATE:
        if tokenizer is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        else:
            path = tokenizer
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        whole = lambda t: array("I", slow.encode(t, add_special_tokens=False).ids).tobytes()
        if tokenizer is not None:
            _STATE[tokenizer] = whole
            return whole
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        special = [t.content for t in slow.get_added_tokens_decoder().values()]

        def ids(text: str) -> bytes:
            if any(t in text for t in special):  # the vocabulary's own tokens, told in a text, have ids of their own
                return whole(text)
            return array("I", fast(text)).tobytes()

        _STATE[tokenizer] = ids
    return _STATE[tokenizer]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _encoder(tokenizer)
        end = array("I", [end_id]).tobytes()
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                data = ids(text or "") + end
                n = len(data) // 4
                first = n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                for k in range(len(cuts) - 1):
                    s, e = cuts[k], cuts[k + 1]
                    for col, v in zip(out, (doc, k, s, e - s, zlib.crc32(data[4 * s : 4 * e])), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c, t)
                    for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Minimum bin slack over counted lengths.

    Lines (length, first rank, past rank, first bin, pieces per bin, offset):
    the ranks [first, past) of that length fill consecutive bins from the
    first bin, so many a bin, beginning at the offset.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    used = dict.fromkeys(left, 0)
    lines, bins = [], 0
    while left:
        big = max(left)
        take: dict[int, int] = {big: 1}
        room = capacity - big
        # bits[i]: the sums that the first i multiples can make
        steps: list[tuple[int, int]] = []
        bits = [1]
        full = (1 << (room + 1)) - 1
        for length in sorted((x for x in left if x <= room), reverse=True):
            many = min(left[length] - (length == big), room // length)
            k = 1
            while many > 0:
                k = min(k, many)
                steps.append((length, k))
                bits.append((bits[-1] | bits[-1] << (length * k)) & full)
                many -= k
                k *= 2
            if bits[-1] >> room & 1:
                break
        goal = bits[-1].bit_length() - 1
        for i in range(len(steps), 0, -1):
            if bits[i - 1] >> goal & 1:
                continue
            length, k = steps[i - 1]
            take[length] = take.get(length, 0) + k
            goal -= length * k
        times = min(left[x] // m for x, m in take.items())
        offset = 0
        for length in sorted(take, reverse=True):
            m = take[length]
            lines.append((length, used[length], used[length] + m * times, bins, m, offset))
            used[length] += m * times
            left[length] -= m * times
            if not left[length]:
                del left[length]
            offset += length * m
        bins += times
    return lines


def pack(
    docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None,
    rows_per_bucket: int = 500
) -> DataFrame:
    """Pieces with the sequence and the offset where each lies."""
    p = checkpointed(pieces(docs, capacity=capacity, end_id=end_id, tokenizer=tokenizer))
    counts = {r[0]: r[1] for r in p.groupBy("length").count().collect()}  # at most `capacity` rows
    lines = plan(counts, capacity)  # a few lines per length
    rows = bucket_rows(sum(counts.values()), rows_per_bucket)
    steps = p.sparkSession.createDataFrame(
        [(k, -(-n // rows)) for k, n in counts.items()] or [(0, 1)], "length long, _n int"
    )
    spread = p.join(F.broadcast(steps), "length")  # buckets of a length, by how common it is
    spread = spread.withColumn(
        "_b", F.floor(order_hash(F.col("doc_id"), F.col("piece"), seed=6) * F.col("_n") / 2**32).cast("int")
    ).drop("_n")
    ranked = salted_rank(spread, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "_b", "_r")
    steps = F.broadcast(
        p.sparkSession.createDataFrame(
            lines or [(0, 0, 0, 0, 1, 0)], "length long, _lo long, _hi long, _bin long, _m long, _off long"
        )
    )
    at = ranked.join(steps, "length").where("_r >= _lo and _r < _hi")
    return at.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("_bin + (_r - _lo) div _m").alias("sequence_id"),
        F.expr("_off + ((_r - _lo) % _m) * length").alias("offset"),
    )
