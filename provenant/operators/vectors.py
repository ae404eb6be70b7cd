"""An inverted file for dense vectors: cells around trained centres, read by question.

Centres are trained in numpy by k-means on directions, over a sample of at most
``sample`` rows taken by a hash of the key; there are at most ``max_cells``. Every
row is then assigned to its nearest centre and lies in the files of its cell, and
a cell of more than ``piece_rows`` rows is dealt over pieces, so no task holds a
hot cell. A search compares a question with the rows of its ``probes`` nearest
cells. With ``exact`` it goes on to all cells that can still hold a better row: a
cell's radius is the widest angle of a row to the centre, so no row of it is
nearer to the question than the angle between them less the radius.

Keys and question ids are whole numbers; rows with a null key or vector take no
part; a zero vector is like none, and no hit; an empty index finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import Scratch, cut
from .retrieve import _best, top_k

HIT = "q long, d long, score double"
WIDER = 1e-9  # over the rounding of angles


def directions(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def matrix(column: pa.ListArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def train_centres(v: np.ndarray, cells: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of unit length; a cell that loses its rows starts again from a row."""
    v, rng = directions(v), np.random.default_rng(seed)
    centres = v[rng.choice(len(v), min(cells, len(v)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(v[i:i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(v), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        empty = np.linalg.norm(sums, axis=1) < 1e-12
        sums[empty] = v[rng.choice(len(v), int(empty.sum()))]
        centres = directions(sums)
    return centres


class VectorIndex:
    """Cells and rows in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.cells = spark.read.parquet(f"{path}/cells")

    @property
    def rows(self) -> DataFrame:
        """(key, vector, piece, cell); an empty index has no such files."""
        return self.spark.read.parquet(f"{self.path}/rows")

    @classmethod
    def build(
        cls, vectors: DataFrame, key: str, vector: str, path: str, cells: int | None = None, max_cells: int = 4_096,
        sample: int = 20_000, piece_rows: int = 50_000
    ) -> VectorIndex:
        spark = vectors.sparkSession
        own = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector")).where(
            "key is not null and vector is not null"
        )
        n = own.count()
        share = min(1.0, 1.2 * sample / max(1, n))
        hashed = F.shiftrightunsigned(F.xxhash64(F.lit(3), "key"), 32) < int(share * 2**32)
        some = own.where(hashed).limit(sample).toPandas()
        width = len(some["vector"].iloc[0]) if len(some) else 1
        known = np.array(list(some["vector"]), np.float64).reshape(-1, width)
        centres = train_centres(known, cells or min(max_cells, max(1, math.isqrt(n)))) if len(known) else np.ones((1, width))
        sent = spark.sparkContext.broadcast(centres)  # at most max_cells rows

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cos = directions(matrix(b.column(1))) @ sent.value.T
                at = cos.argmax(axis=1)
                angle = np.arccos(np.clip(cos[np.arange(len(at)), at], -1, 1))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(at.astype(np.int32)), pa.array(angle)], names=["key", "vector", "cell", "angle"]
                )

        kind = own.schema["vector"].dataType.simpleString()
        with Scratch(spark) as tmp:
            placed = tmp.table(own.mapInArrow(assign, f"key long, vector {kind}, cell int, angle double"), "placed")
            stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
            made = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
            whole = made.join(stats, "cell").withColumn("pieces", F.ceil(F.col("n") / piece_rows).cast("int"))
            whole.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
            pieces = F.broadcast(spark.read.parquet(f"{path}/cells").select("cell", "pieces"))
            dealt = placed.join(pieces, "cell").select(
                "key", "vector", "cell", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int").alias("piece")
            )
            dealt.repartition("cell", "piece").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        return cls(spark, path)

    def topk(
        self, asked: DataFrame, k: int, qid: str = "qid", vector: str = "qe", probes: int = 8, exact: bool = False,
        digits: int | None = None, block: int = 4_000, counted: dict | None = None
    ) -> DataFrame:
        """(qid, key, score, rank): the ``k`` rows of the highest cosine for each question
        but itself (an equal key). ``counted``, if given, is told how many pairs of a
        question and a row there are and how many were compared."""
        cells = self.cells.orderBy("cell").collect()  # at most max_cells
        ids = np.array([c["cell"] for c in cells], np.int32)
        if not len(ids):
            none = asked.select(F.col(qid).cast("long").alias(qid), F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("score"))
            return none.limit(0).withColumn("rank", F.lit(0))
        sent = self.spark.sparkContext.broadcast(
            (ids, np.array([c["centre"] for c in cells]), np.array([c["radius"] for c in cells]))
        )
        slack = 10.0**-digits if digits is not None else 0.0

        def choose(first: bool):
            """(q, cell) to compare: the nearest cells, or those further ones whose rows
            may reach the floor."""
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                own, centres, radius = sent.value
                for b in batches:
                    for at in range(0, b.num_rows, 1_000):
                        p = b.slice(at, 1_000)
                        cos = directions(matrix(p.column(1))) @ centres.T
                        near = np.zeros(cos.shape, bool)
                        best = np.argsort(-cos, axis=1, kind="stable")[:, :probes]
                        np.put_along_axis(near, best, True, axis=1)
                        if not first:
                            floor = p.column(2).to_numpy(zero_copy_only=False)
                            reach = np.cos(np.maximum(np.arccos(np.clip(cos, -1, 1)) - radius - WIDER, 0))
                            near = ~near & (reach + WIDER >= floor[:, None] - slack)
                        q, c = np.nonzero(near)
                        yield pa.RecordBatch.from_arrays(
                            [p.column(0).take(pa.array(q)), pa.array(own[c])], names=["q", "cell"]
                        )
            return run

        def compare(rows: pa.Table, questions: pa.Table) -> pa.Table:
            held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            if rows.num_rows and questions.num_rows:
                own, q = questions["q"].to_numpy(), directions(matrix(questions["v"]))
                for at in range(0, rows.num_rows, 2_000):
                    part = rows.slice(at, 2_000)
                    these = part["key"].to_numpy()
                    c = q @ directions(matrix(part["vector"])).T
                    c = np.round(c, digits) if digits is not None else c
                    c[own[:, None] == these] = -np.inf
                    least = np.partition(c, -k, axis=1)[:, -k] if c.shape[1] > k else np.full(len(own), -np.inf)
                    i, j = np.nonzero((c >= least[:, None]) & (c > 0))
                    held = _best(*(np.concatenate(x) for x in zip(held, (own[i], these[j], c[i, j]), strict=True)), k)
            return pa.table({"q": held[0], "d": held[1], "score": held[2]})

        with Scratch(self.spark) as tmp:
            q = tmp.table(asked.select(F.col(qid).cast("long").alias("q"), F.col(vector).alias("v")).where(
                "q is not null and v is not null"
            ), "asked")
            parts = max(1, -(-q.count() // block))
            pieces = F.broadcast(self.cells.select("cell", "pieces", "n"))

            def hits(pairs: DataFrame) -> DataFrame:
                wanted = [r[0] for r in pairs.select("cell").distinct().collect()]  # at most max_cells; prunes folders
                mine = pairs.join(q, "q").join(pieces, "cell").select(
                    "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"),
                    F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int").alias("part"), "q", "v"
                )
                rows = self.rows.where(F.col("cell").isin(wanted)).select(
                    "cell", "piece", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "key", "vector"
                )
                by = ["cell", "piece", "part"]
                return rows.groupBy(*by).cogroup(mine.groupBy(*by)).applyInArrow(compare, HIT)

            pairs = tmp.table(q.mapInArrow(choose(True), "q long, cell int"), "near")
            found = tmp.table(top_k(hits(pairs), k, "q", "d").drop("rank"), "hits")
            if exact:
                floor = found.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
                floor = q.join(floor, "q", "left").select(
                    "q", "v", F.when(F.col("n") >= k, F.col("least")).otherwise(0.0).alias("floor")
                )
                more = tmp.table(floor.mapInArrow(choose(False), "q long, cell int"), "further")
                found = found.unionByName(hits(more))
                pairs = pairs.unionByName(more)
            if counted is not None:
                done = pairs.join(pieces, "cell").agg(F.sum("n")).first()[0] or 0
                counted |= {"pairs": q.count() * sum(c["n"] for c in cells), "compared": done}
            return cut(top_k(found, k, "q", "d").select(F.col("q").alias(qid), F.col("d").alias("key"), "score", "rank"))

    def probes_for(self, least: float = 0.9, k: int = 12, questions: int = 200) -> int:
        """The number of probes, doubled from 8, at which ``least`` of the exact hits are
        found for at most ``questions`` rows of the index, taken by a hash of the key."""
        n = max(1, sum(r[0] for r in self.cells.select("n").collect()))
        share = F.shiftrightunsigned(F.xxhash64(F.lit(9), "key"), 32) < int(min(1.0, 1.2 * questions / n) * 2**32)
        some = cut(self.rows.where(share).limit(questions).select(F.col("key").alias("qid"), F.col("vector").alias("qe")))
        want = self.topk(some, k, exact=True).select("qid", "key")
        total, probes, cells = want.count(), 8, self.cells.count()
        while probes < cells:
            if self.topk(some, k, probes=probes).join(want, ["qid", "key"]).count() >= least * total:
                break
            probes *= 2
        return min(probes, cells)
