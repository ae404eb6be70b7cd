"""Indexes as tables, and hybrid retrieval for a whole batch of questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..plans.storage import Scratch, cut
from . import grams

DEFAULTS = Settings()
#: A term with at least one in ``HOT`` of all postings is frequent; there are at most ``HOT``.
HOT = 65_536
#: Rounds over which the terms of a corpus are dealt, at least.
PASSES = 4
#: What is dealt of a corpus is dealt in a round for each so many characters of text, so that
#: the disk it takes at once does not grow with the corpus.
ROUND_CHARS = 400_000_000


def term_counts(docs: DataFrame, key: str, tokens: Column, many: str = "f") -> DataFrame:
    """(key, term, count) of every document."""
    return docs.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias(many))


def stemmed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dl, term): a row for each token, with its document's length."""
    raw = docs.select(key, T.raw_tokens(text).alias("_a"))
    return raw.select(
        key, F.size("_a").alias("dl"), F.explode("_a").alias("_t")
    ).select(key, "dl", T.stem(F.col("_t")).alias("term"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def by_frequency(terms: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The frequent and the rare rows of (term, df, ..). Frequent is what has at least
    one in ``hot`` of all postings, so that these are never more than ``hot`` rows."""
    known = terms.where("term is not null")  # as joins have it: counts are made by one plan for all
    n = known.agg(F.sum("df").alias("_n"))
    told = known.crossJoin(F.broadcast(n)).withColumn("_hot", F.col("df") * hot >= F.col("_n")).drop("_n")
    return told.where("_hot").drop("_hot"), told.where("not _hot").drop("_hot")


def rare_postings(counts: DataFrame, most: DataFrame) -> DataFrame:
    # not an anti join, which would be moved beneath the counting and have it done twice
    told = most.select("term", F.lit(True).alias("_hot"))
    return counts.join(F.broadcast(told), "term", "left").where("_hot is null").drop("_hot")


def join_terms(counts: DataFrame, terms: DataFrame, hot: int = HOT) -> DataFrame:
    """``counts`` of (.., term) beside the row of their term in (term, df, ..).

    Words are so uneven that few terms hold most postings. The frequent ones go to
    where the postings are: a table of at most ``hot`` rows, whatever the corpus. Only
    postings of the rare terms are shuffled by term, and none of these has enough to
    fill a task. It takes two passes over the counts, which pays where a whole corpus
    is indexed; with ``hot`` 0 it is a plain join, whose uneven tasks are left to be
    split as they run."""
    if not hot:
        return counts.join(terms, "term")
    most, least = by_frequency(terms, hot)
    return counts.join(F.broadcast(most), "term").unionByName(rare_postings(counts, most).join(least, "term"))


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def smooth_idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def bm25_weights(counts: DataFrame, docs: DataFrame, key: str, text: str, s: Settings, hot: int = 0) -> DataFrame:
    """(key, term, w) from (key, dl, term, f) of all documents that have these terms;
    number and mean length are those of all ``docs``, and ``hot`` is that of :func:`join_terms`."""
    stats = docs.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.regexp_count(F.lower(F.col(text)), F.lit(T.TOKEN))).alias("avg_dl")
    )
    df = counts.groupBy("term").agg(F.sum((F.col("f") > 0).cast("long")).alias("df"))
    j = join_terms(counts, df, hot).crossJoin(F.broadcast(stats))  # one row
    return j.select(key, "term", _bm25_weight(s).alias("w"))


def _bm25_weight(s: Settings) -> Column:
    """Of a row with ``f``, ``dl``, ``df``, ``n`` and ``avg_dl``."""
    mean = F.when(F.coalesce(F.col("avg_dl"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("avg_dl"))
    tf = F.col("f") * (s.bm25_k1 + 1) / (F.col("f") + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * F.col("dl") / mean))
    return bm25_idf(F.col("n"), F.col("df")) * tf


def bm25_postings(docs: DataFrame, key: str, text: str, s: Settings = DEFAULTS) -> DataFrame:
    """(key, term, w): what a term that a question has adds to a document's score.

    Everything that does not depend on the question is folded into one weight,
    so a question costs an equi-join on its terms and a sum.
    """
    counts = stemmed(docs, key, text).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("f"))
    return bm25_weights(counts, docs, key, text, s, HOT)


def _rounds(chars: int | None, least: int = 1) -> int:
    return max(least, -(-(chars or 0) // ROUND_CHARS))


def _in_round(c: str | Column, i: int, rounds: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(rounds)) == i if rounds > 1 else F.lit(True)


def bm25_topk(
    questions: DataFrame, docs: DataFrame, key: str, text: str, k: int, s: Settings = DEFAULTS, qid: str = "qid",
    question: str = "question", digits: int | None = None
) -> DataFrame:
    """The best ``k`` documents of each question, without an index. The frequencies of the
    questions' terms are counted first; then texts are dealt by key, once, and what a
    document scores with any question is made where its text is. Of a large corpus a part
    of the documents is dealt in each of some rounds, which leaves its best ``k``."""
    with Scratch(docs.sparkSession) as tmp:
        terms = questions.select(qid, F.explode(F.array_distinct(T.tokens(question))).alias("term"))
        # outer, for a condition on an array that is exploded would have it made twice; no term is null
        each = docs.select(F.explode_outer(F.array_distinct(T.tokens(text))).alias("term"))
        n, avg_dl, chars = docs.agg(
            F.count(F.lit(1)), F.avg(F.regexp_count(F.lower(F.col(text)), F.lit(T.TOKEN))), F.sum(F.char_length(text))
        ).first()
        df = document_frequency(each.join(terms.select("term").distinct(), "term", "left_semi"))
        stats = F.lit(n).cast("long").alias("n"), F.lit(avg_dl).cast("double").alias("avg_dl")
        known = tmp.table(df.select("*", *stats), "terms", brief=True)
        rounds = _rounds(chars)

        def best(i: int) -> DataFrame:
            own = docs.select(key, text).where(_in_round(key, i, rounds)).repartition(key)
            raw = own.select(key, T.raw_tokens(text).alias("_a"))
            each = raw.select(key, F.size("_a").alias("dl"), F.explode_outer("_a").alias("_t"))
            met = each.select(key, "dl", T.stem(F.col("_t")).alias("term")).join(known, "term", "left_semi")
            counts = met.groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("f"))
            w = counts.join(known, "term").select(key, "term", _bm25_weight(s).alias("w"))
            scores = w.join(terms, "term").groupBy(qid, key).agg(F.sum("w").alias("score"))
            return top_k(scores.withColumn("score", F.round("score", digits)) if digits else scores, k, qid, key)

        return _best_of_rounds(best, rounds, k, qid, key, tmp)


def _best_of_rounds(
    best: Callable[[int], DataFrame], rounds: int, k: int, qid: str, key: str, tmp: Scratch
) -> DataFrame:
    """The best ``k`` of each question from those of each round, which no key shares with another."""
    for i in range(rounds):
        out = tmp.table(best(i), "best", append=True, brief=True)
    return cut(out if rounds == 1 else tmp.table(top_k(out.drop("rank"), k, qid, key), "all", brief=True))


def tfidf_counts(docs: DataFrame, key: str, text: str, stopwords: Sequence[str] = T.VECTOR_STOPWORDS) -> DataFrame:
    """(key, term, tf) of words and word pairs. Texts are dealt by key, which is less
    than their terms, and nothing else need be for the counts."""
    own = docs.select(key, text).repartition(key)
    return term_counts(own.withColumn("_w", T.words(text, stopwords)), key, T.word_grams("_w"), "tf")


def _tf_idf() -> Column:
    return (1 + F.log("tf")) * F.col("idf")


def tfidf_vectors(
    docs: DataFrame, key: str, text: str, stopwords: Sequence[str] = T.VECTOR_STOPWORDS
) -> tuple[DataFrame, DataFrame]:
    """(key, term, w) unit vectors, and (term, idf) to weigh questions with."""
    counts = tfidf_counts(docs, key, text, stopwords)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    idf = document_frequency(counts).crossJoin(F.broadcast(n)).select(
        "term", smooth_idf(F.col("n"), F.col("df")).alias("idf")
    )
    return unit(counts.join(idf, "term").select(key, "term", _tf_idf().alias("w")), key), idf


def tfidf_sums(
    docs: DataFrame, key: str, text: str, tmp: Scratch, stopwords: Sequence[str] = T.VECTOR_STOPWORDS,
    passes: int = PASSES, sums: Sequence[str] = ("n_terms", "total", "top")
) -> DataFrame:
    """(key, n_terms, total, top, norm), or those of ``sums`` and the norm, of the vectors of
    :func:`tfidf_vectors` before they have unit length, without making them. The texts are read
    once and packed (:mod:`.grams`); their terms meet, and documents get their sums, in ``passes``
    rounds or, in a large corpus, in as many as keep a round small, so that only one round's
    shuffle is on disk at once."""
    n, chars = docs.agg(F.count(F.lit(1)), F.sum(F.char_length(text))).first()
    rounds = _rounds(chars, passes)
    with Scratch(docs.sparkSession) as parts:
        g = grams.Grams(docs, key, text, parts, stopwords, n, chars, rounds)
        for i in range(rounds):
            out = tmp.table(g.totals(i, sums), "sums", append=True, brief=True)
    return out


def tfidf_topk(
    questions: DataFrame, docs: DataFrame, key: str, text: str, k: int, qid: str = "qid", question: str = "question",
    stopwords: Sequence[str] = T.VECTOR_STOPWORDS, digits: int | None = None
) -> DataFrame:
    """The best ``k`` documents of each question by cosine, without an index. Documents and
    questions are read once and packed (:mod:`.grams`); what a document scores is made where its
    terms are, in rounds over the documents if they are many."""
    with Scratch(docs.sparkSession) as tmp:
        n, chars = docs.agg(F.count(F.lit(1)), F.sum(F.char_length(text))).first()
        rounds = _rounds(chars, PASSES)
        g = grams.Grams(docs, key, text, tmp, stopwords, n, chars, rounds, (questions, qid, question))
        query = tmp.table(g.query(), "query", brief=True)
        blocks = max(1, -(-query.select("q").distinct().count() // grams.ASKED))
        within = 10.0 ** -digits if digits is not None else 0.0

        def best(i: int) -> DataFrame:
            own = query.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i % blocks).toArrow()
            scores = g.best(i // blocks, own, k, within) if own.num_rows else g.none()
            return top_k(scores.withColumn("score", F.round("score", digits)) if digits else scores, k, qid, key)

        return _best_of_rounds(best, rounds * blocks, k, qid, key, tmp)


def unit(weights: DataFrame, key: str) -> DataFrame:
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weights.withColumn("w", F.col("w") / F.greatest(norm, F.lit(1e-12)))


def question_vectors(
    questions: DataFrame, idf: DataFrame, qid: str = "qid", text: str = "question",
    stopwords: Sequence[str] = T.VECTOR_STOPWORDS
) -> DataFrame:
    """Unit vectors of questions; terms that no document has are dropped."""
    counts = tfidf_counts(questions, qid, text, stopwords)
    return unit(counts.join(idf, "term").select(qid, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w")), qid)


def bm25_scores(
    questions: DataFrame, postings: DataFrame, key: str, qid: str = "qid", text: str = "question"
) -> DataFrame:
    """(qid, key, score): the sum over a question's distinct terms."""
    terms = questions.select(qid, F.explode(F.array_distinct(T.tokens(text))).alias("term"))
    return terms.join(postings, "term").groupBy(qid, key).agg(F.sum("w").alias("score"))


def cosine_scores(query: DataFrame, docs: DataFrame, key: str, qid: str = "qid") -> DataFrame:
    """(qid, key, score) of unit vectors in long form."""
    return query.select(qid, "term", F.col("w").alias("_q")).join(docs, "term").groupBy(qid, key).agg(
        F.sum(F.col("_q") * F.col("w")).alias("score")
    )


def _best(asked: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best rows of each question; ties go to the lower id."""
    order = np.lexsort((ids, -scores, asked))
    asked, ids, scores = asked[order], ids[order], scores[order]
    first = np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]]) if len(asked) else np.zeros(0, np.int64)
    place = np.arange(len(asked)) - np.repeat(first, np.diff(np.r_[first, len(asked)]))
    return asked[place < k], ids[place < k], scores[place < k]


def dense_topk(
    questions: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, qid: str = "qid", asked: str = "qe",
    digits: int | None = None, block: int = 4_000
) -> DataFrame:
    """(qid, key, score, rank): the ``k`` vectors of the highest cosine for each
    question but itself (an equal id). A block of questions, at most ``block``
    vectors, is sent to all tasks; a task multiplies its vectors by the block and
    keeps the best of each question, so what is shuffled is ``k`` rows of a
    question and task. The blocks' results are appended to one table."""
    spark = vectors.sparkSession
    blocks = max(1, -(-questions.count() // block))
    kept = vectors.select(F.col(key).cast("long"), F.col(vector).cast("array<double>"))
    with Scratch(spark) as tmp:
        out = None
        for b in range(blocks):
            rows = questions.select(
                F.col(qid).cast("long").alias("q"), F.col(asked).cast("array<double>").alias("v")
            ).where(F.pmod(F.xxhash64(qid), F.lit(blocks)) == b).collect()
            ids = np.array([r["q"] for r in rows], np.int64)
            m = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), -1)
            sent = spark.sparkContext.broadcast((ids, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                own, unit_q = sent.value
                held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                for batch in batches if len(own) else ():
                    for at in range(0, batch.num_rows, 2_000):
                        part = batch.slice(at, 2_000)
                        these = part.column(0).to_numpy()
                        e = part.column(1).flatten().to_numpy().reshape(len(these), -1)
                        c = unit_q @ (e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-300)).T
                        c = np.round(c, digits) if digits is not None else c
                        c[own[:, None] == these] = -np.inf
                        least = np.partition(c, -k, axis=1)[:, -k] if c.shape[1] > k else np.full(len(own), -np.inf)
                        q, d = np.nonzero((c >= least[:, None]) & (c > 0))
                        held = _best(
                            *(np.concatenate(x) for x in zip(held, (own[q], these[d], c[q, d]), strict=True)), k
                        )
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["q", "d", "score"])

            best = kept.mapInArrow(run, "q long, d long, score double").select(
                F.col("q").alias(qid), F.col("d").alias(key), "score"
            )
            best = top_k(best, k, qid, key)
            out = best if blocks == 1 else tmp.table(best, "best", append=True)
        return cut(out)


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(dot(a, a) == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(norms == 0, F.lit(1e-12)).otherwise(norms))


def top_k(scores: DataFrame, k: int, by: str, tie: str, score: str = "score") -> DataFrame:
    """The best ``k`` rows of each group with their rank; ties go to the lower ``tie``."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), tie)
    return scores.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col(score) > 0))


def fuse(
    ranked: DataFrame, s: Settings = DEFAULTS, qid: str = "qid", key: str = "clause_id", tie: str = "pos"
) -> DataFrame:
    """Reciprocal rank fusion of rows (qid, list_no, rank, key, pos, score, retriever).

    A key that stands in one list twice counts twice. The representative is
    the row with the highest original score, the earliest of equals; equal
    sums keep the order of first appearance.
    """
    first = F.struct("list_no", "rank")
    best = F.struct("score", (-F.col("list_no")).alias("l"), (-F.col("rank")).alias("r"))
    g = ranked.groupBy(qid, key).agg(
        F.sum(1 / (s.rrf_k + F.col("rank"))).alias("rrf"), F.max_by(F.col(tie), best).alias(tie),
        F.when(
            F.count_distinct("retriever") > 1, "hybrid"
        ).otherwise(F.min("retriever")).alias("retriever"), F.min(first).alias("_first"))
    w = Window.partitionBy(qid).orderBy(F.col("rrf").desc(), "_first")
    return g.withColumn("rank", F.row_number().over(w)).select(
        qid, key, tie, F.col("rrf").alias("score"), "retriever", "rank"
    )


def rerank_idf(docs: DataFrame, text: str) -> DataFrame:
    """(term, idf) over the distinct rerank tokens of all rows."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = docs.select(
        F.explode(F.array_distinct(T.rerank_tokens(text))).alias("term")
    ).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", smooth_idf(F.col("n"), F.col("df")).alias("idf"))


def default_idf(idf: DataFrame) -> DataFrame:
    """One row: the weight of a term that the corpus lacks."""
    return idf.agg(F.coalesce(F.max("idf"), F.lit(1.0)).alias("default_idf"))


def weighted_questions(questions: DataFrame, idf: DataFrame, qid: str = "qid", text: str = "question") -> DataFrame:
    """Questions with ``_terms`` (map of term to weight), ``_numbers`` and ``_refs``."""
    q = questions.select(qid, F.col(text).alias("_q"))
    terms = q.select(qid, F.explode(F.array_distinct(T.rerank_tokens("_q"))).alias("term"))
    w = terms.join(idf, "term", "left").crossJoin(F.broadcast(default_idf(idf))).select(
        qid, "term", F.coalesce("idf", "default_idf").alias("w")
    )
    maps = w.groupBy(qid).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "w")))).alias("_terms"))
    none = F.create_map().cast("map<string,double>")
    return q.join(maps, qid, "left").select(
        qid, F.coalesce("_terms", none).alias("_terms"), T.numbers("_q").alias("_numbers"),
        T.clause_refs("_q", T.RERANK_REF).alias("_refs")
    )


def relevance(passage: Column, clause_id: Column, s: Settings = DEFAULTS) -> Column:
    """Rerank score of a passage beside a row of :func:`weighted_questions`."""
    asked = F.map_keys("_terms")
    weight = lambda a: F.aggregate(F.transform(a, lambda t: F.element_at(F.col("_terms"), t)), F.lit(0.0), lambda x, y: x + y)
    shared = F.array_intersect(asked, T.rerank_tokens(passage))
    total = weight(asked)
    share = weight(shared) / F.when(total == 0, F.lit(1.0)).otherwise(total)
    share = F.when((F.size(shared) < 2) & (F.size(asked) > 1), F.lit(0.0)).otherwise(share)
    number = F.when(F.arrays_overlap("_numbers", T.numbers(passage)), s.number_bonus).otherwise(0.0)
    ref = F.when(F.array_contains("_refs", clause_id), s.clause_bonus).otherwise(0.0)
    return F.least(s.overlap_weight * share + number + ref, F.lit(1.0))


class Embedding(Protocol):
    """How texts become vectors. ``index`` makes the tables of a corpus (pos, text),
    by name; ``scores`` compares questions (qid, question) with them."""

    def index(self, docs: DataFrame) -> dict[str, DataFrame]: ...

    def scores(self, questions: DataFrame, tables: dict[str, DataFrame], k: int) -> DataFrame:
        """(qid, pos, score), at least the best ``k`` of each question."""


class TfidfEmbedding:
    """Words and word pairs; the default."""

    def __init__(self, stopwords: Sequence[str] = T.VECTOR_STOPWORDS):
        self.stopwords = stopwords

    def index(self, docs: DataFrame) -> dict[str, DataFrame]:
        vectors, idf = tfidf_vectors(docs, "pos", "text", self.stopwords)
        return {"vectors": vectors, "vector_idf": idf}

    def scores(self, questions: DataFrame, tables: dict[str, DataFrame], k: int) -> DataFrame:
        return cosine_scores(
            question_vectors(questions, tables["vector_idf"], stopwords=self.stopwords), tables["vectors"], "pos"
        )


class DenseEmbedding:
    """Vectors of a model that is handed in: ``encode`` gets a list of texts and
    returns a matrix with a row for each; it runs in the executors."""

    def __init__(self, encode: Callable[[list[str]], np.ndarray]):
        self.encode = encode

    def _vectors(self, df: DataFrame, key: str, text: str) -> DataFrame:
        encode = self.encode

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    p = b.slice(at, 256)
                    rows = np.asarray(encode([t or "" for t in p.column(1).to_pylist()]), np.float64)
                    yield pa.RecordBatch.from_arrays(
                        [p.column(0), pa.array(list(rows), pa.list_(pa.float64()))], names=["k", "v"]
                    )

        kind = df.schema[key].dataType.simpleString()
        return df.select(key, text).mapInArrow(run, f"k {kind}, v array<double>")

    def index(self, docs: DataFrame) -> dict[str, DataFrame]:
        return {
            "vectors": self._vectors(docs, "pos", "text").select(F.col("k").alias("pos"), F.col("v").alias("vector"))
        }

    def scores(self, questions: DataFrame, tables: dict[str, DataFrame], k: int) -> DataFrame:
        q = cut(self._vectors(questions, "qid", "question").withColumn("n", -1 - F.monotonically_increasing_id()))  # numbers that no position has
        best = dense_topk(
            q.select(F.col("n").alias("qid"), F.col("v").alias("qe")), tables["vectors"], "pos", "vector", k
        )
        return best.join(q.select(F.col("n").alias("qid"), F.col("k").alias("_q")), "qid").select(
            F.col("_q").alias("qid"), F.col("pos").cast("int").alias("pos"), "score"
        )


class Scorer(Protocol):
    """How a passage is judged beside a question: ``score`` gets (qid, question, pos,
    clause_id, passage, ..) and returns it with ``score`` from 0 to 1."""

    def score(self, pairs: DataFrame, index: dict[str, DataFrame]) -> DataFrame: ...


class LexicalScorer:
    """Weighted shared terms, figures and references; the default."""

    def __init__(self, s: Settings = DEFAULTS):
        self.s = s

    def score(self, pairs: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
        q = weighted_questions(pairs.select("qid", "question").distinct(), index["rerank_idf"])
        out = pairs.join(q, "qid").withColumn("score", relevance(F.col("passage"), F.col("clause_id"), self.s))
        return out.drop("_terms", "_numbers", "_refs")
