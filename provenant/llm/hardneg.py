"""Hard negatives by branch and bound over ball trees.

Vectors become integers and are dealt over partitions by id. A task orders its
rows by label and builds ball trees over ``leaf``-row leaves, one for each label
of each ``tree_rows`` rows that it reads. A ball with centre c and radius r
bounds every inner product of a query q with its points on both sides: q.c - |q|r
and q.c + |q|r. Anchors are sent in blocks of at most ``block`` vectors; a node
is left for an anchor when its bounds lie outside of the window of scores, or
its upper bound is strictly beneath the anchor's current k-th score (rows of
equal score are settled by id, so they are read). Two searches run: the
positives, the first rows of the anchor's own label; then, for the window that
each positive's score opens, the first rows of other labels within it. Every
task returns at most k rows for an anchor and window, and these are ranked again
by anchor.

Bounds are widened by a slack over the rounding error of the centres. Scores are
inner products of whole numbers, exact as long as sums stay under 2^53; greater
ones are the nearest doubles, held to the ends of a long.

Defined cases: rows with a null id, label or vector, or a component that is null
or not finite (256 times it, for doubles) take no part; a shorter vector counts as followed by zeros; rows that
share an id count once (the least by label, then vector); ties go to the smaller
id; an anchor without positives or a positive without negatives gives no rows;
an empty table gives no rows; only the named columns are read, so further
columns never clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, checkpointed

POINT = "id long, label long, v array<double>"
HIT = "anchor_id long, window_no int, id long, score long"
LONG = np.iinfo(np.int64)


class BallTree:
    """Balls over the rows of a matrix, split at the median of the widest direction."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = 64):
        self.order = np.arange(len(points))
        self.lo, self.hi, self.kids, centres, radii = [], [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            own = points[self.order[lo:hi]]
            centre = own.mean(axis=0)
            far = own - centre
            me = len(self.lo)
            self.lo.append(lo)
            self.hi.append(hi)
            self.kids.append([])
            centres.append(centre)
            radii.append(np.sqrt((far * far).sum(axis=1).max()))
            if parent >= 0:
                self.kids[parent].append(me)
            if hi - lo > leaf:
                a = far[((far * far).sum(axis=1)).argmax()]
                along = own @ a
                cut = np.argpartition(along, (hi - lo) // 2)
                self.order[lo:hi] = self.order[lo:hi][cut]
                mid = lo + (hi - lo) // 2
                todo += [(lo, mid, me), (mid, hi, me)]
        self.ids, self.points = ids[self.order], points[self.order]
        self.centres, self.radii = np.array(centres), np.array(radii)


class Best:
    """The k first (score, id) of each of many searches, higher scores and smaller ids first."""

    def __init__(self, n: int, k: int):
        self.k, self.kth = k, np.full(n, -np.inf)
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), LONG.max)

    def add(self, which: np.ndarray, ids: np.ndarray, scores: np.ndarray, fits: np.ndarray) -> None:
        """``scores`` has a row for each of ``which`` and a column for each id."""
        s = np.where(fits, scores, -np.inf)
        i = np.where(fits, ids, LONG.max)
        if s.shape[1] > self.k:  # a row's first k lie among those not beneath its k-th
            least = -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1]
            s = np.where(s >= least[:, None], s, -np.inf)
        s, i = np.concatenate([self.score[which], s], 1), np.concatenate([self.id[which], i], 1)
        order = np.lexsort((i, -s), axis=1)[:, :self.k]
        self.score[which], self.id[which] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.kth[which] = self.score[which][:, -1]


class Search:
    """Queries with windows of scores, and the best rows found for each so far."""

    SLACK = 1e-9

    def __init__(self, ids, labels, q, lo, hi, k: int, same: bool):
        self.ids, self.labels, self.q, self.lo, self.hi, self.same = ids, labels, q, lo, hi, same
        self.norm = np.sqrt((q * q).sum(axis=1))
        self.best = Best(len(ids), k)
        self.seen = self.skipped = 0  # rows of trees met and left out, for all queries

    def over(self, tree: BallTree, label: int) -> None:
        own = np.flatnonzero((self.labels == label) == self.same)
        if len(own):
            self._node(tree, 0, own)

    def _live(self, tree: BallTree, node: int, own: np.ndarray) -> np.ndarray:
        mid = self.q[own] @ tree.centres[node]
        reach = self.norm[own] * tree.radii[node]
        reach += self.SLACK * (np.abs(mid) + reach + self.norm[own] * np.sqrt((tree.centres[node] ** 2).sum()) + 1)
        top = mid + reach
        live = ~((top < self.best.kth[own]) | (top < self.lo[own]) | (mid - reach > self.hi[own]))
        n = tree.hi[node] - tree.lo[node]
        self.skipped += n * int((~live).sum())
        return own[live]

    def _node(self, tree: BallTree, node: int, own: np.ndarray) -> None:
        if node == 0:
            self.seen += len(tree.ids) * len(own)
        own = self._live(tree, node, own)
        if not len(own):
            return
        if tree.kids[node]:
            a, b = tree.kids[node]
            if (self.q[own] @ (tree.centres[b] - tree.centres[a])).sum() > 0:
                a, b = b, a
            self._node(tree, a, own)
            self._node(tree, b, own)
            return
        part = slice(tree.lo[node], tree.hi[node])
        ids, scores = tree.ids[part], self.q[own] @ tree.points[part].T
        fits = (scores >= self.lo[own, None]) & (scores <= self.hi[own, None])
        fits &= ids[None, :] != self.ids[own, None]
        some = fits.any(axis=1)
        if some.any():
            self.best.add(own[some], ids, scores[some], fits[some])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of all that is held."""
        q, place = np.nonzero(self.best.score > -np.inf)
        return q, self.best.id[q, place], self.best.score[q, place]


def _long(score: np.ndarray) -> np.ndarray:
    big = np.abs(score) >= 2.0**63
    return np.where(big, np.where(score > 0, LONG.max, LONG.min), np.where(big, 0, score).astype(np.int64))


def _padded(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def points(vectors: DataFrame, relabel: bool, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, v) of the rows that take part, components as whole numbers."""
    i, label, v = F.col(f"`{id_col}`").cast("long"), F.col(f"`{label_col}`").cast("long"), F.col(f"`{vector_col}`")
    scaled = F.transform(v, lambda x: x.cast("double") * 256)
    finite = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(i.isNotNull() & label.isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)))
    if relabel:
        label = F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)
    # floor gives a long; beyond 2^52 a double is a whole number already
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    return rows.select(i.alias("id"), label.alias("label"), whole.alias("v"))


def _trees(batches: Iterator[pa.RecordBatch], width: int, tree_rows: int, leaf: int) -> Iterator[tuple[int, BallTree]]:
    """(label, tree) over rows that come in order of label."""
    for b in batches:
        for at in range(0, b.num_rows, tree_rows):
            p = b.slice(at, tree_rows)
            ids, labels = p.column(0).to_numpy(), p.column(1).to_numpy()
            flat, size = p.column(2).flatten().to_numpy(), np.diff(p.column(2).offsets.to_numpy())
            if (size == width).all():
                v = flat.reshape(len(ids), width)
            else:
                v = _padded(np.split(flat, np.cumsum(size)[:-1]), width)
            for label in np.unique(labels):
                own = labels == label
                yield int(label), BallTree(ids[own], np.ascontiguousarray(v[own]), leaf)


def search(
    rows: DataFrame, anchors: DataFrame, *, k: int, same: bool, width: int, tmp: Scratch, block: int = 8_192,
    tree_rows: int = 4_096, leaf: int = 64
) -> DataFrame:
    """(anchor_id, window_no, id, score): the first ``k`` rows of ``rows`` (:data:`POINT`)
    for each row of ``anchors`` (id, label, v, window_no, lo, hi), of its label or of
    others, whose score is from ``lo`` to ``hi`` (null: no bound)."""
    spark = rows.sparkSession
    n = anchors.count()
    blocks = max(1, -(-n // block))
    numbered = anchors if blocks == 1 else tmp.table(
        anchors.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks))).repartitionByRange("b"), "anchors"
    )
    out = None
    for b in range(blocks):
        mine = numbered if blocks == 1 else numbered.where(F.col("b") == b)
        a = mine.select("id", "label", "v", "window_no", "lo", "hi").toPandas()  # about ``block`` rows
        inf = lambda c, x: a[c].astype("float64").fillna(x).to_numpy()
        sent = spark.sparkContext.broadcast((
            a["id"].to_numpy(np.int64), a["label"].to_numpy(np.int64), _padded(list(a["v"]), width),
            a["window_no"].to_numpy(np.int32), inf("lo", -np.inf), inf("hi", np.inf)
        ))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, labels, q, window, lo, hi = sent.value
            s = Search(ids, labels, q, lo, hi, k, same)
            for label, tree in _trees(batches, width, tree_rows, leaf):
                s.over(tree, label)
            who, found, score = s.found()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[who]), pa.array(window[who]), pa.array(found), pa.array(_long(score))],
                names=["anchor_id", "window_no", "id", "score"]
            )

        hits = tmp.table(rows.mapInArrow(run, HIT), f"hits-{same}", append=True)
        out = hits if out is None else out
        sent.unpersist()
    # parts of one table: what was appended after the first read is found by reading again
    out = spark.read.schema(out.schema).parquet(out._pv_path)
    w = Window.partitionBy("anchor_id", "window_no").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    anchor_every: int = 50, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95,
    relabel: bool = True, rows_per_part: int = 8_192, block: int = 8_192, tree_rows: int = 4_096, leaf: int = 64
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    with Scratch(vectors.sparkSession) as tmp:
        known = points(vectors, relabel, id_col, label_col, vector_col)
        n = vectors.count()  # parts grow with the root of all rows: each returns rows for every anchor
        dealt = known.repartition(max(1, -(-n // max(rows_per_part, 16 * math.isqrt(n)))), "id")
        once = Window.partitionBy("id").orderBy("label", "v")  # ids are dealt already: no further shuffle
        rows = dealt.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
        rows = tmp.table(rows.sortWithinPartitions("label", "id"), "points")
        width = rows.agg(F.max(F.size("v"))).first()[0] or 0
        anchors = rows.where(F.pmod("id", F.lit(anchor_every)) == 0)
        setting = {"width": width, "tmp": tmp, "block": block, "tree_rows": tree_rows, "leaf": leaf}
        none = F.lit(None).cast("long")
        positives = tmp.table(
            search(
                rows, anchors.select("*", F.lit(0).alias("window_no"), none.alias("lo"), none.alias("hi")),
                k=n_positives, same=True, **setting
            ), "positives"
        )
        part = lambda p: F.col("score").cast("decimal(20,0)") * F.lit(p).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)")
        opened = positives.select(
            F.col("anchor_id").alias("id"), F.col("rank").alias("window_no"), F.col("id").alias("positive_id"),
            F.col("score").alias("positive_score"),
            F.ceil(part(low)).cast("long").alias("lo"), F.floor(part(high)).cast("long").alias("hi")
        )
        windows = anchors.join(opened.where("lo <= hi"), "id")
        negatives = search(rows, windows, k=n_negatives, same=False, **setting)
        return checkpointed(negatives.select(
            F.col("anchor_id"), "window_no", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
        ).join(opened.select(F.col("id").alias("anchor_id"), "window_no", "positive_id", "positive_score"), ["anchor_id", "window_no"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
            "negative_score"
        ))
