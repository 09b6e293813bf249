"""Evaluation of rankings against labelled queries."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scoring import B, K, reciprocal_rank
from lodestone.operators import retrieve, vector


def one_label(qrels: DataFrame) -> DataFrame:
    """(qid, doc_id): of several relevant pages of a query the largest doc_id."""
    return qrels.where("qid is not null and doc_id is not null").groupBy("qid").agg(F.max("doc_id").alias("doc_id"))


def reciprocal_ranks(hits: DataFrame, qrels: DataFrame, n: int = 10, all_labels: bool = False) -> DataFrame:
    """(qid, rr) of every labelled query; 0 where the relevant page is not among the first ``n`` hits. A page that comes
    repeatedly counts at its best rank. Of several labels of a query the largest page id holds, or, with ``all_labels``, the
    one ranked best."""
    ranks = hits.where(F.col("rank") <= n).select("qid", "doc_id", "rank")
    labels = qrels.where("qid is not null and doc_id is not null").select("qid", "doc_id").distinct() if all_labels else one_label(qrels)
    best = labels.join(ranks, ["qid", "doc_id"], "left").groupBy("qid").agg(F.min("rank").alias("rank"))
    return best.select("qid", reciprocal_rank(F.col("rank"), n).alias("rr"))


def mrr(hits: DataFrame, qrels: DataFrame, n: int = 10, all_labels: bool = False) -> DataFrame:
    """One row (queries, mrr): the mean over all labelled queries, misses included; null for none."""
    return reciprocal_ranks(hits, qrels, n, all_labels).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("rr"), 9).alias("mrr"))


class Evaluator(Protocol):
    """Whatever finds and ranks pages for a batch of queries: hits (qid, rank, doc_id, score)."""

    def collect_and_rank(self, queries: DataFrame, n: int) -> DataFrame: ...


class KeywordEvaluator:
    """Keyword search over an index, with the parameters of its ranking function."""

    def __init__(self, postings: DataFrame, lexicon: DataFrame, pages: DataFrame, conjunctive: bool = True, k: float = K, b: float = B) -> None:
        self.index, self.conjunctive, self.k, self.b = (postings, lexicon, pages), conjunctive, k, b

    def collect_and_rank(self, queries: DataFrame, n: int) -> DataFrame:
        return retrieve.search(queries, *self.index, self.conjunctive, n, self.k, self.b)


class VectorEvaluator:
    """Exact vector search; queries have (qid, embedding), the corpus (doc_id, embedding)."""

    def __init__(self, corpus: DataFrame) -> None:
        self.corpus = corpus

    def collect_and_rank(self, queries: DataFrame, n: int) -> DataFrame:
        return vector.top_k(queries, self.corpus, "qid", "doc_id", n).withColumnRenamed("item", "doc_id")


class RerankEvaluator:
    """A first stage, whose ``candidates`` best are put in order by a model that scores lists of (query, text)."""

    def __init__(self, first: Evaluator, texts: DataFrame, load: Callable, candidates: int = 32, batch: int = 224) -> None:
        self.first, self.texts, self.load, self.candidates, self.batch = first, texts, load, candidates, batch

    def collect_and_rank(self, queries: DataFrame, n: int) -> DataFrame:
        hits = self.first.collect_and_rank(queries, self.candidates)
        pairs = hits.join(queries.select("qid", "query").distinct(), "qid").join(self.texts.select("doc_id", "text"), "doc_id")
        scored = vector.score_batches(pairs, ["qid", "doc_id", "rank"], "query", "text", self.load, self.batch)
        return vector.rerank(scored, "score2", n=n).select("qid", F.col("rank2").alias("rank"), "doc_id", F.col("score2").alias("score"))


def evaluate(evaluator: Evaluator, queries: DataFrame, qrels: DataFrame, n: int = 10) -> DataFrame:
    """``mrr`` of the queries that have a label, as the evaluator answers them."""
    labelled = queries.join(one_label(qrels).select("qid"), "qid", "left_semi")
    return mrr(evaluator.collect_and_rank(labelled, n), qrels, n)
