"""Keyword retrieval for batches of queries. A single query is a batch of one.

Pages are spread over shards by their id. Every shard holds the weighted postings of its pages, answers all queries of a block
by itself, and hands on its best pages of each: postings are never multiplied by queries in a shuffle, and a term that
many queries and pages hold is spread over all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scoring import B, K, bm25
from lodestone.functions.text import query_key, query_terms
from lodestone.operators.index import corpus_stats
from lodestone.session import cut, shuffle_partitions

#: Queries that are answered in one pass over the shards; they travel to every shard, so this bounds what does.
BLOCK = 1 << 16
#: Where a block has at most so many terms they are named in the scans, which then read the lists of these terms only.
NAMED = 1000


def clean_queries(queries: DataFrame) -> DataFrame:
    """(qid, key, terms) of every distinct row with a qid; null queries have no terms and an empty key."""
    rows = queries.where("qid is not null").select("qid", F.coalesce("query", F.lit("")).alias("query")).distinct()
    return rows.select("qid", query_key(F.col("query")).alias("key"), query_terms(F.col("query")).alias("terms")).distinct()


def query_ids(queries: DataFrame) -> DataFrame:
    """(qid, kid): queries that are equal when cleaned share a ``kid``, the smallest qid among them. A qid with several
    texts has several."""
    rows = clean_queries(queries).select("qid", "key")
    return rows.join(rows.groupBy("key").agg(F.min("qid").alias("kid")), "key").select("qid", "kid").distinct()


def wanted_terms(queries: DataFrame) -> DataFrame:
    """(kid, term) of each distinct cleaned query: queries that are equal when cleaned are answered once."""
    keys = clean_queries(queries).groupBy("key").agg(F.min("qid").alias("kid"), F.first("terms").alias("terms"))
    return keys.select("kid", F.explode("terms").alias("term")).distinct()


def known_terms(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(kid, term, doc_cnt) of the terms that the lexicon holds. Unknown terms are dropped."""
    return wanted_terms(queries).join(lexicon.select("term", "doc_cnt"), "term").select("kid", "term", "doc_cnt")


def _blocks(queries: DataFrame, lexicon: DataFrame, strict: bool) -> Iterator[tuple[DataFrame, list[str] | None, pa.Table]]:
    """Blocks of queries: their terms with page counts (term, doc_cnt), the terms themselves where they are few, and a table
    (kid, term) sorted by both. A query with an unknown term drops out if ``strict``; the term alone does otherwise."""
    wanted = cut(wanted_terms(queries))
    spread = -(-wanted.select("kid").distinct().count() // BLOCK)
    for i in range(spread):
        part = wanted.where(F.pmod(F.xxhash64("kid"), F.lit(spread)) == i)
        terms = part.select("term").distinct()
        some = [r[0] for r in terms.limit(NAMED + 1).collect()]
        few = some if len(some) <= NAMED else None
        entries = cut((lexicon.where(F.col("term").isin(few)) if few is not None else lexicon).select("term", "doc_cnt").join(terms, "term"))
        known = part.join(entries, "term", "left").select("kid", "term", F.col("doc_cnt").isNotNull().alias("known"))
        if strict:
            known = known.withColumn("known", F.min("known").over(Window.partitionBy("kid")))
        # at most BLOCK queries
        yield entries, few, known.where("known").select("kid", "term").orderBy("kid", "term").toArrow()


def _shards(entries: DataFrame, few: list[str] | None, postings: DataFrame, weight: Column, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, w) of the postings of some terms, spread by doc_id. The scan is told the terms where they are few."""
    rows = postings.where(F.col("term").isin(few)) if few is not None else postings
    rows = rows.join(entries, "term")
    if pages is not None:
        stats = corpus_stats(pages).select(F.col("n").alias("__n"), F.col("avgdl").alias("__avg"))
        rows = rows.join(pages.select("doc_id", "term_cnt"), "doc_id").join(F.broadcast(stats))  # one row
    return rows.select("doc_id", "term", weight.alias("w")).repartition(shuffle_partitions(postings.sparkSession), "doc_id")


class _Shard:
    """The lists of one shard: for every term positions of pages and weights, in the order of pages."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        rows = list(batches)
        kinds = rows[0].schema if rows else pa.schema([("doc_id", pa.int64()), ("term", pa.string()), ("w", pa.float64())])
        table = pa.Table.from_batches(rows, kinds)
        coded = table["term"].combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        self.pages, place = np.unique(table["doc_id"].to_numpy(), return_inverse=True)
        order = np.lexsort((place, code))
        self.place, self.w = place[order], table["w"].to_numpy()[order]
        bounds = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
        self.at = {t: (a, b) for t, a, b in zip(coded.dictionary.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist())}
        self.sums, self.held = np.zeros(len(self.pages)), np.zeros(len(self.pages), bool)

    def match(self, terms: list[str], conjunctive: bool) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the pages that hold all (or any) of the terms, ascending, and their weights, summed in the order of
        the terms."""
        lists = [self.at.get(t) for t in terms]
        if conjunctive:
            if None in lists:
                return np.zeros(0, np.int64), np.zeros(0)
            a, b = min(lists, key=lambda x: x[1] - x[0])
            found = self.place[a:b]
            for a, b in lists:
                at = np.searchsorted(self.place[a:b], found)
                at[at == b - a] = 0
                found = found[self.place[a:b][at] == found]
            sums = np.zeros(len(found))
            for a, b in lists:
                sums += self.w[a:b][np.searchsorted(self.place[a:b], found)]
            return found, sums
        for a, b in (x for x in lists if x):
            self.sums[self.place[a:b]] += self.w[a:b]
            self.held[self.place[a:b]] = True
        found = np.flatnonzero(self.held)
        sums = self.sums[found]
        self.sums[found], self.held[found] = 0, False
        return found, sums


def _answers(known: pa.Table, conjunctive: bool, n: int):
    """For a shard: (kid, matches, top) of the queries with matching pages: their number, and the ``n`` best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(batches)
        kids, terms = known["kid"].to_numpy(), known["term"].to_pylist()
        starts = np.append(np.flatnonzero(np.diff(kids, prepend=kids[0] - 1)), len(kids)).tolist() if len(kids) else [0]
        out_kid, out_n, sizes, ids, scores = [], [], [], [], []
        for a, b in zip(starts[:-1], starts[1:]):
            found, sums = shard.match(terms[a:b], conjunctive)
            if not len(found):
                continue
            out_kid.append(kids[a])
            out_n.append(len(found))
            sums = np.copysign(np.floor(np.abs(sums) * 1e9 + 0.5) / 1e9, sums) + 0.0
            if len(found) > n:
                # what ties with the n-th stays in until ids decide; positions are in the order of ids
                keep = np.flatnonzero(sums >= -np.partition(-sums, n - 1)[n - 1]) if n else np.zeros(0, np.int64)
                keep = keep[np.argsort(-sums[keep], kind="stable")[:n]]
                found, sums = found[keep], sums[keep]
            sizes.append(len(found))
            ids.append(shard.pages[found])
            scores.append(sums)
        top = pa.StructArray.from_arrays([pa.array(np.concatenate(ids) if ids else [], pa.int64()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "score"])
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), top)
        yield pa.RecordBatch.from_arrays([pa.array(out_kid, pa.int64()), pa.array(out_n, pa.int64()), lists], ["kid", "matches", "top"])

    return run


def _over_blocks(queries: DataFrame, postings: DataFrame, lexicon: DataFrame, pages: DataFrame | None, conjunctive: bool, n: int, k: float, b: float, strict: bool) -> DataFrame:
    """(kid, matches, top) of every query and shard."""
    kind = "kid bigint, matches bigint, top array<struct<doc_id: bigint, score: double>>"
    weight = F.lit(0.0) if pages is None else bm25(F.col("freq"), F.col("doc_cnt"), F.col("term_cnt"), F.col("__n"), F.col("__avg"), k, b)
    out = postings.sparkSession.createDataFrame([], kind)
    for entries, few, known in _blocks(queries, lexicon, strict):
        out = out.unionByName(_shards(entries, few, postings, weight, pages).mapInArrow(_answers(known, conjunctive, n), kind))
    return out


def matches(queries: DataFrame, postings: DataFrame, lexicon: DataFrame, conjunctive: bool, strict: bool = False) -> DataFrame:
    """(kid, doc_id) of all pages that hold all (or any) of the known terms of a query."""
    found = _over_blocks(queries, postings, lexicon, None, conjunctive, 1 << 31, K, B, strict)
    return found.select("kid", F.explode("top.doc_id").alias("doc_id"))


def top_n(scored: DataFrame, n: int, key: str = "kid", item: str = "doc_id", by: str = "score") -> DataFrame:
    """The ``n`` best of every key by score descending, then item, with ``rank``; limited in the map tasks first."""
    if n < 1:
        raise ValueError("n must be positive")
    order = Window.partitionBy(key).orderBy(F.desc(by), item)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def search(queries: DataFrame, postings: DataFrame, lexicon: DataFrame, pages: DataFrame, conjunctive: bool, n: int = 10, k: float = K, b: float = B, strict: bool = False) -> DataFrame:
    """(qid, rank, doc_id, score): the ``n`` best pages of every query.

    Scores are summed in the order of terms and rounded to nine decimals before they are ranked. Terms that the lexicon
    does not hold are ignored, also where all terms are wanted (a query that has one finds nothing if ``strict``); a
    query without known terms has no row. Ties go to the smaller doc_id. Pages that the page table does not list are not
    found. ``k`` and ``b`` are the parameters of the ranking function.
    """
    if n < 1:
        raise ValueError("n must be positive")
    found = _over_blocks(queries, postings, lexicon, pages, conjunctive, n, k, b, strict)
    hits = top_n(found.select("kid", F.inline("top")), n)
    return query_ids(queries).join(hits, "kid").select("qid", "rank", "doc_id", "score")


def hit_freqs(hits: DataFrame, queries: DataFrame, postings: DataFrame) -> DataFrame:
    """``hits`` with ``freqs``: the terms of the query that the page holds, with their frequencies, in term order."""
    terms = clean_queries(queries).select("qid", F.explode("terms").alias("term")).distinct()
    # n hits of a query at most, so few rows meet the postings
    rows = hits.join(terms, "qid").join(postings.select("term", "doc_id", "freq"), ["term", "doc_id"])
    freqs = rows.groupBy("qid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("term", F.col("freq").cast("bigint").alias("freq")))).alias("freqs"))
    return hits.join(freqs, ["qid", "doc_id"])


def hit_counts(queries: DataFrame, postings: DataFrame, lexicon: DataFrame, conjunctive: bool, strict: bool = False) -> DataFrame:
    """(qid, hits): the number of all matching pages of every query, 0 where there is none."""
    found = _over_blocks(queries, postings, lexicon, None, conjunctive, 0, K, B, strict).groupBy("kid").agg(F.sum("matches").alias("hits"))
    return query_ids(queries).join(found, "kid", "left").select("qid", F.coalesce("hits", F.lit(0)).alias("hits"))


def answer_one(terms: list[str], postings: DataFrame, lexicon: DataFrame, pages: DataFrame, conjunctive: bool, n: int = 10, k: float = K, b: float = B, strict: bool = False) -> tuple[int, list[tuple[int, float]]]:
    """The number of matching pages and the ``n`` best (doc_id, score) for one query of cleaned terms. The terms are named in
    the scans of lexicon and postings, so over a term-sorted index only their lists are read."""
    entries = lexicon.where(F.col("term").isin(terms)).select("term", "doc_cnt")
    found = sorted({r[0] for r in entries.select("term").collect()})
    if not found or strict and len(found) < len(set(terms)):
        return 0, []
    known = pa.table({"kid": pa.array([0] * len(found), pa.int64()), "term": pa.array(found)})
    weight = bm25(F.col("freq"), F.col("doc_cnt"), F.col("term_cnt"), F.col("__n"), F.col("__avg"), k, b)
    kind = "kid bigint, matches bigint, top array<struct<doc_id: bigint, score: double>>"
    # n rows of every shard at most
    rows = _shards(entries, found, postings, weight, pages).mapInArrow(_answers(known, conjunctive, n), kind).collect()
    best = sorted(((x["doc_id"], x["score"]) for r in rows for x in r["top"]), key=lambda x: (-x[1], x[0]))
    return sum(r["matches"] for r in rows), best[:n]
