"""A BM25 index in files: blocks of postings, bounded skipping, upkeep by segments.

Documents are numbered, and their numbers cut into ranges of ``RANGE``. A block
has the postings of one term in one range, as arrays in order of the numbers
(which Parquet stores as deltas), with the bounds that skipping needs. A term
that every document has is so dealt over as many blocks, and tasks, as there are
ranges; no task ever holds a term as a whole. What depends on the whole corpus
(document frequencies, number and mean length) is not folded into the blocks, so
that documents may come and go without touching them:

* an index is a folder of segments; inserting writes one more, with blocks, terms
  and documents of its own;
* deleting writes a segment of corrections: the numbers that are gone, and how
  often each of their terms was theirs. Only ranges with such documents are read;
* amending is both at once; :meth:`LexicalIndex.compact` writes what is left as
  one segment. A segment counts once its last table is there.

A search goes in two steps. The terms of the highest bounds give some candidates,
whose exact k-th score is a floor. Then blocks and questions meet by range, where
a document lies as a whole: ranges whose blocks cannot reach the floor together
are left out, and so are, in the others, blocks of terms that no document needs to
reach it, unless a document found by other terms still can. A task returns at most
``k`` rows of a question and those equal to the last. The result is that of
:func:`retrieve.bm25_topk` over the same documents. A task holds a range: of very
long documents, fewer should make a range (``RANGE_BITS``).

Keys should be unique; every row is a document. A null text has no tokens and
does not count for the mean length; an empty index finds nothing.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..plans.storage import Scratch, cut
from .retrieve import bm25_idf, top_k

DEFAULTS = Settings()
RANGE_BITS, SEGMENT_BITS = 11, 50
TF_BITS = DL_BITS = 26  # a count is at most a length
RANGE = 1 << RANGE_BITS
#: Parquet's own delta encoding for whole numbers, and Bloom filters on terms.
PACKED = {
    "parquet.writer.version": "v2", "compression": "zstd", "parquet.bloom.filter.enabled#term": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.enable.dictionary#docs.list.element": "false",
}
FEW = 1_000  # so many distinct terms may stand in a filter that files are pruned by


def range_of(doc: str | Column) -> Column:
    return F.shiftright(T.col(doc), RANGE_BITS)


def tf_part(f: Column, dl: Column, mean: float, s: Settings) -> Column:
    return f * (s.bm25_k1 + 1) / (f + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * dl / mean))


def tf_bound(max_tf: str, min_ratio: str, mean: float, s: Settings) -> Column:
    """No posting with at most this count, and at least this ratio of its document's
    length to its count, has a greater :func:`tf_part`, whatever the mean length."""
    k, b = s.bm25_k1, s.bm25_b
    return (k + 1) / (1 + k * (1 - b) / F.col(max_tf) + k * b * F.col(min_ratio) / mean)


def blocks_of(numbered: DataFrame, text: str) -> DataFrame:
    """(term, range, n, max_tf, min_ratio, docs, tf, dl) of documents (doc, text).
    Texts are dealt by range, once; nothing else is shuffled."""
    dealt = numbered.select(range_of("doc").alias("range"), "doc", text).repartition("range")
    raw = dealt.select("range", "doc", T.raw_tokens(text).alias("_a"))
    each = raw.select("range", "doc", F.size("_a").alias("dl"), F.explode("_a").alias("_t")).select(
        "range", "doc", "dl", T.stem(F.col("_t")).alias("term")
    )
    return blocks_from(each.groupBy("range", "doc", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("f")))


def blocks_from(counts: DataFrame) -> DataFrame:
    """Blocks of (range, doc, dl, term, f). A group has at most ``RANGE`` rows, a posting
    is a number in it: its document's place, its count and its document's length."""
    place = F.col("doc").bitwiseAND(F.lit(RANGE - 1))
    long_one = F.raise_error(F.lit(f"a document has more than {2**DL_BITS - 1} tokens"))
    dl = F.when(F.col("dl") < 2**DL_BITS, F.col("dl").cast("long")).otherwise(long_one.cast("long"))
    number = F.shiftleft(place, TF_BITS + DL_BITS) + F.shiftleft(F.col("f").cast("long"), DL_BITS) + dl
    packed = counts.groupBy("range", "term").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.max("f").alias("max_tf"), F.min(F.col("dl") / F.col("f")).alias("min_ratio"),
        F.sort_array(F.collect_list(number)).alias("p")
    )
    part = lambda take: F.transform("p", lambda x: take(x).cast("int"))
    return packed.select(
        "term", "range", "n", "max_tf", "min_ratio", part(lambda x: F.shiftright(x, TF_BITS + DL_BITS)).alias("docs"),
        part(lambda x: F.shiftright(x, DL_BITS).bitwiseAND(F.lit(2**TF_BITS - 1))).alias("tf"),
        part(lambda x: x.bitwiseAND(F.lit(2**DL_BITS - 1))).alias("dl")
    )


class LexicalIndex:
    """Segments in a folder. An index is a value: what changes it returns another,
    and the segments before stay as they were."""

    def __init__(self, spark: SparkSession, path: str, parts: list[str]):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    # ---- files

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LexicalIndex:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []
        done = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/stats/_SUCCESS"))
        return cls(spark, path, [n for n in names if done(n)])

    def _write(self, df: DataFrame, part: str, name: str) -> DataFrame:
        out = f"{self.path}/{part}/{name}"
        df.write.mode("overwrite").options(**PACKED).parquet(out)  # what a lost run left of a part is replaced
        return self.spark.read.schema(df.schema).parquet(out)

    def _read(self, name: str, parts: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{p}/{name}") for p in parts])

    def _next(self, kind: str) -> str:
        return f"{int(self.parts[-1].split('-')[0]) + 1 if self.parts else 0:06d}-{kind}"

    @property
    def _added(self) -> list[str]:
        return [p for p in self.parts if p.endswith("-added")]

    @property
    def _gone(self) -> list[str]:
        return [p for p in self.parts if p.endswith("-gone")]

    # ---- upkeep

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str, path: str) -> LexicalIndex:
        return cls(docs.sparkSession, path, []).insert(docs, key, text)

    def insert(self, docs: DataFrame, key: str = "key", text: str = "text") -> LexicalIndex:
        part = self._next("added")
        start = int(part.split("-")[0]) << SEGMENT_BITS
        number = F.lit(start).cast("long") + F.monotonically_increasing_id()
        with Scratch(self.spark) as tmp:
            # numbers are written before they are used: a task that runs again reads the same
            numbered = tmp.table(docs.select(number.alias("doc"), F.col(key).alias("key"), F.col(text).alias("text")), "numbered")
            blocks = self._write(blocks_of(numbered, "text").sortWithinPartitions("term"), part, "blocks")
            rows = numbered.select("doc", "key", F.regexp_count(F.lower("text"), F.lit(T.TOKEN)).alias("dl"))
            rows = self._write(rows, part, "docs")
        return self._finished(part, blocks, rows)

    def _finished(self, part: str, blocks: DataFrame, rows: DataFrame) -> LexicalIndex:
        terms = blocks.groupBy("term").agg(
            F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_ratio").alias("min_ratio")
        )
        self._write(terms.sortWithinPartitions("term"), part, "terms")
        self._write(self._totals(rows), part, "stats")
        return LexicalIndex(self.spark, self.path, [*self.parts, part])

    @staticmethod
    def _totals(rows: DataFrame) -> DataFrame:
        whole = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
        return rows.agg(whole(F.count(F.lit(1)), "n"), whole(F.count("dl"), "n_dl"), whole(F.sum("dl"), "dl"))

    def delete(self, keys: DataFrame, key: str = "key") -> LexicalIndex:
        """Without the documents of these keys."""
        if not self._added:
            return self
        part = self._next("gone")
        named = keys.select(F.col(key).alias("key")).distinct()
        rows = self._write(self.docs().join(named, "key", "left_semi"), part, "docs")
        touched = rows.select(range_of("doc").alias("range")).distinct()
        theirs = self._postings(self._read("blocks", self._added).join(touched, "range", "left_semi"))
        terms = theirs.join(rows.select("doc"), "doc", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        self._write(terms, part, "terms")
        self._write(self._totals(rows), part, "stats")
        return LexicalIndex(self.spark, self.path, [*self.parts, part])

    def amend(self, docs: DataFrame, key: str = "key", text: str = "text") -> LexicalIndex:
        """With these texts in place of what their keys had."""
        return self.delete(docs, key).insert(docs, key, text)

    def compact(self, path: str) -> LexicalIndex:
        """What is left, as one segment of another folder."""
        out = LexicalIndex(self.spark, path, [])
        live = self._alive(self._postings(self._read("blocks", self._added)))
        blocks = out._write(blocks_from(live.select(range_of("doc").alias("range"), "doc", "dl", "term", "f")).sortWithinPartitions("term"), "000000-added", "blocks")
        return out._finished("000000-added", blocks, out._write(self.docs(), "000000-added", "docs"))

    # ---- what it says

    def docs(self) -> DataFrame:
        """(doc, key, dl) of the documents that are there."""
        return self._alive(self._read("docs", self._added))

    def _alive(self, df: DataFrame) -> DataFrame:
        return df.join(self._read("docs", self._gone).select("doc"), "doc", "left_anti") if self._gone else df

    def terms(self) -> DataFrame:
        """(term, df, max_tf, min_ratio); the bounds may be those of a document that is gone."""
        own = self._read("terms", self._added)
        if self._gone:
            minus = self._read("terms", self._gone).select("term", (-F.col("df")).alias("df"))
            none = lambda c: F.lit(None).cast(own.schema[c].dataType).alias(c)
            own = own.unionByName(minus.select("term", "df", none("max_tf"), none("min_ratio")))
        if len(self.parts) > 1:
            own = own.groupBy("term").agg(
                F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_ratio").alias("min_ratio")
            )
        return own.where("df > 0")

    def stats(self) -> tuple[int, float]:
        """Number of documents and their mean length."""
        n = n_dl = dl = 0
        for sign, parts in ((1, self._added), (-1, self._gone)):
            if parts:
                r = self._read("stats", parts).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_dl", "dl")]).first()
                n, n_dl, dl = n + sign * r[0], n_dl + sign * r[1], dl + sign * r[2]
        return n, dl / n_dl if n_dl and dl else 1.0

    @staticmethod
    def _postings(blocks: DataFrame, *more: str) -> DataFrame:
        each = blocks.select("term", "range", *more, F.explode(F.arrays_zip("docs", "tf", "dl")).alias("p"))
        doc = F.shiftleft(F.col("range"), RANGE_BITS) + F.col("p.docs")
        return each.select(doc.alias("doc"), "term", F.col("p.tf").alias("f"), F.col("p.dl").alias("dl"), *more)

    def postings(self, s: Settings = DEFAULTS) -> DataFrame:
        """(key, term, w) of all documents, as :func:`retrieve.bm25_postings` has them."""
        n, mean = self.stats()
        live = self._alive(self._postings(self._read("blocks", self._added)))
        w = bm25_idf(F.lit(n), F.col("df")) * tf_part(F.col("f"), F.col("dl"), mean, s)
        return live.join(self.terms().select("term", "df"), "term").join(self.docs().select("doc", "key"), "doc").select(
            "key", "term", w.alias("w")
        )

    # ---- search

    def topk(
        self, questions: DataFrame, k: int, s: Settings = DEFAULTS, qid: str = "qid", question: str = "question",
        digits: int | None = None, seed_rows: int = 1_000, block: int = 2_000, counted: dict | None = None
    ) -> DataFrame:
        """(qid, key, score, rank): the best ``k`` documents of each question. Terms of
        the highest bounds are read first until they have ``seed_rows`` postings; a task
        has the blocks of one range, and at most some ``block`` questions. ``counted``,
        if given, is told how many pairs of a question and a block there are, and how
        many were read for the second step."""
        if not self._added:
            none = questions.select(F.col(qid), F.lit(None).cast("string").alias("key"), F.lit(0.0).alias("score"))
            return none.limit(0).withColumn("rank", F.lit(0))
        n, mean = self.stats()
        slack = 10.0**-digits if digits is not None else 0.0
        with Scratch(self.spark) as tmp:
            asked = questions.select(F.col(qid).alias("q"), F.explode(F.array_distinct(T.tokens(question))).alias("term"))
            idf = bm25_idf(F.lit(n), F.col("df"))
            asked = tmp.table(
                asked.join(self.terms(), "term").select(
                    "q", "term", "df", idf.alias("idf"), (idf * tf_bound("max_tf", "min_ratio", mean, s)).alias("bound")
                ), "asked"
            )
            blocks = self._read("blocks", self._added)
            few = [r[0] for r in asked.select("term").distinct().limit(FEW + 1).collect()]
            if len(few) <= FEW:  # a filter that Bloom filters and statistics of the files serve
                blocks = blocks.where(F.col("term").isin(few))
            asked = tmp.table(self._judged(asked, blocks, k, mean, s, slack, seed_rows, tmp), "judged")
            # what a range can add at most, of all terms and of those that are looked up
            heads = blocks.select("term", "range", "max_tf", "min_ratio").join(
                asked.select("q", "term", "idf", "step", "floor"), "term"
            ).withColumn("ub", F.col("idf") * tf_bound("max_tf", "min_ratio", mean, s))
            rest = lambda n: F.coalesce(F.sum(F.when(F.col("step") >= n, F.col("ub"))), F.lit(0.0)).alias(f"rest{n}")
            reach = heads.groupBy("q", "range").agg(F.sum("ub").alias("top"), rest(1), rest(2), F.first("floor").alias("floor"))
            reach = reach.where("top >= floor").drop("top")
            live = tmp.table(
                heads.select("q", "range", "term", "idf", "step").join(reach, ["q", "range"]), "live"
            )
            parts = max(1, -(-asked.select("q").distinct().count() // block))
            every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
            wanted = blocks.join(live.select("term", "range").distinct(), ["term", "range"], "left_semi").select(
                "range", every, "term", "docs", "tf", "dl"
            )
            if self._gone:
                none = F.array().cast("array<int>")
                gone = self._read("docs", self._gone).groupBy(range_of("doc").alias("range")).agg(
                    F.collect_list(F.col("doc").bitwiseAND(F.lit(RANGE - 1)).cast("int")).alias("docs")
                )
                wanted = wanted.unionByName(gone.select(
                    "range", every, F.lit(None).cast("string").alias("term"), "docs", none.alias("tf"), none.alias("dl")
                ))
            mine = live.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int"))
            kind = asked.schema["q"].dataType.simpleString()
            run = _best_of_range(RANGE, RANGE_BITS, k, mean, s, slack)
            hits = wanted.groupBy("range", "part").cogroup(mine.groupBy("range", "part")).applyInArrow(
                run, f"q {kind}, doc long, s double"
            )
            hits = tmp.table(hits, "hits")
            if counted is not None:
                counted |= {"pairs": heads.count(), "pairs_read": int(hits.where("doc < 0").agg(F.sum("s")).first()[0] or 0)}
            score = F.round("s", digits) if digits is not None else F.col("s")
            out = hits.where("doc >= 0").join(self.docs().select("doc", "key"), "doc")
            return cut(top_k(out.select(F.col("q").alias(qid), "key", score.alias("score")), k, qid, "key"))

    def _judged(self, asked, blocks, k, mean, s, slack, seed_rows, tmp) -> DataFrame:
        """``asked`` with the floor of each question, a score that its k-th document
        reaches, and the step in which a term is read: 0 for terms that some document
        needs to reach the floor, 1 and 2 for those that candidates are looked up in,
        the weakest last."""
        weight = F.col("idf") * tf_part(F.col("f"), F.col("dl"), mean, s)
        strong = Window.partitionBy("q").orderBy(F.col("bound").desc(), "term")
        place = F.row_number().over(strong)
        ordered = asked.withColumn("first", (F.sum("df").over(strong) <= seed_rows) | (place == 1))
        seeds = ordered.where("first").select("q", "term", "idf")
        met = self._postings(blocks.join(seeds, "term"), "q", "idf")
        some = self._alive(met.groupBy("q", "doc").agg(F.sum(weight).alias("s")))
        some = tmp.table(
            top_k(some, 4 * k, "q", "doc", "s").select("q", "doc", "s", range_of("doc").alias("range")), "some"
        )
        at = F.array_position("docs", F.col("doc").bitwiseAND(F.lit(RANGE - 1)).cast("int")).cast("int")
        pick = lambda c: F.element_at(c, F.col("_i")).alias(c)
        want = some.join(ordered.where("not first").select("q", "term", "idf"), "q")
        more = want.join(blocks, ["term", "range"]).withColumn("_i", at).where("_i > 0").select(
            "q", "doc", "idf", pick("tf").alias("f"), pick("dl")
        ).groupBy("q", "doc").agg(F.sum(weight).alias("_m"))
        known = some.join(more, ["q", "doc"], "left").withColumn("s", F.col("s") + F.coalesce("_m", F.lit(0.0)))
        floor = top_k(known, k, "q", "doc", "s").where(F.col("rank") == k).select(
            "q", (F.col("s") * (1 - 1e-9) - slack).alias("floor")
        )
        reached = F.sum("bound").over(Window.partitionBy("q").orderBy("bound", "term"))
        step = F.when(F.col("floor").isNull() | (reached >= F.col("floor")), 0).when(2 * reached >= F.col("floor"), 1)
        return asked.join(floor, "q", "left").withColumn("step", step.otherwise(2)).withColumn(
            "floor", F.coalesce("floor", F.lit(0.0))
        )


def _best_of_range(size: int, bits: int, k: int, mean: float, s: Settings, slack: float):
    """Scores of the documents of one range, for a group of questions: the blocks of
    step 0 in full, the others only as long as a document can still reach the floor."""

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        hits_q, hits_doc, hits_s, read = [], [], [], 0
        kind = asked.schema.field("q").type
        names = blocks["term"].to_pylist()
        lists = {c: blocks[c].combine_chunks() for c in ("docs", "tf", "dl")} if blocks.num_rows else {}
        at = {t: i for i, t in enumerate(names) if t is not None}
        gone = [x for i, t in enumerate(names) if t is None for x in lists["docs"][i].as_py()]

        def part(row: int) -> tuple[np.ndarray, np.ndarray]:
            docs, f, dl = (lists[c][row].values.to_numpy(zero_copy_only=False) for c in ("docs", "tf", "dl"))
            return docs, f * (s.bm25_k1 + 1) / (f + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * dl / mean))

        decoded: dict[int, tuple] = {}
        asked = asked.sort_by([("q", "ascending"), ("step", "ascending")])
        q, step, term, idf = (asked[c].to_pylist() for c in ("q", "step", "term", "idf"))
        start = 0
        while start < len(q):
            end = start
            while end < len(q) and q[end] == q[start]:
                end += 1
            floor, rest = asked["floor"][start].as_py(), [asked[c][start].as_py() for c in ("rest1", "rest2")] + [0.0]
            score, live = np.zeros(size), None
            for now in (0, 1, 2):
                if live is not None and not live.any():
                    break
                for i in range(start, end):
                    if step[i] == now:
                        row = at[term[i]]
                        if row not in decoded:
                            decoded[row] = part(row)
                        docs, w = decoded[row]
                        score[docs] += idf[i] * w
                        read += 1
                if live is None:
                    live = score > 0
                    live[gone] = False
                live &= score + rest[now] >= floor
            found = np.flatnonzero(live)
            if len(found) > k:  # rows that may be equal to the k-th stay
                own = score[found]
                found = found[own >= np.partition(own, -k)[-k] * (1 - 1e-9) - slack]
            hits_q += [q[start]] * len(found)
            hits_doc.append(found)
            hits_s.append(score[found])
            start = end
        doc = np.concatenate(hits_doc) if hits_doc else np.zeros(0, np.int64)
        if len(q):
            doc = (asked["range"][0].as_py() << bits) + doc
        return pa.table({
            "q": pa.array([*hits_q, None], kind), "doc": pa.array(np.append(doc, -1).astype(np.int64)),
            "s": pa.array(np.append(np.concatenate(hits_s) if hits_s else np.zeros(0), float(read)))
        })

    return run
