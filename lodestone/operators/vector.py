"""Exact vector search in blocks of queries, and second-stage ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut

#: Queries of a block; a block of vectors travels to the tasks, so this bounds its size.
BLOCK = 16_384
#: Rows of queries and of the corpus that are multiplied at once: 16 MB of products.
TILE = (1024, 2048)


def usable(df: DataFrame, id_col: str, vec: str = "embedding", dim: int | None = None) -> DataFrame:
    """(id, v array<float>): one row for each id whose vector is not null, zero, of another size, or with null or NaN."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<float>").alias("v")).where("id is not null and v is not null")
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(sound & (F.size("v") == dim if dim else F.size("v") > 0))
    return rows.groupBy("id").agg(F.max("v").alias("v"))


def cosine_matrix(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of all rows of ``q`` (unit vectors already) with all rows of ``x``."""
    return q @ (x / np.sqrt((x * x).sum(1))[:, None]).T


def dot_matrix(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return q @ x.T


class _Best:
    """The k best (item, score) of every query of a block, by rounded score, then the smaller item."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.parts, self.waiting = k, [], 0
        self.kth = np.full(queries, -np.inf)
        self.r, self.i, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, at: int, items: np.ndarray, s: np.ndarray) -> None:
        """Scores of the queries from ``at`` on with ``items``."""
        least = self.kth[at : at + len(s)]
        if s.shape[1] > self.k:
            least = np.maximum(least, np.partition(s, -self.k, axis=1)[:, -self.k])
        # what rounds to the same as the k-th stays in until ids decide
        r, c = np.nonzero(s >= (least - 2e-6)[:, None])
        self.parts.append((r + at, items[c], np.round(s[r, c], 6)))
        self.waiting += len(r)
        if self.waiting > 4 * self.k * len(self.kth) + 65_536:
            self.settle()

    def settle(self) -> None:
        r, i, s = (np.concatenate([a, *p]) for a, p in zip((self.r, self.i, self.s), zip(*self.parts))) if self.parts else (self.r, self.i, self.s)
        order = np.lexsort((i, -s, r))
        r, i, s = r[order], i[order], s[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < self.k
        full = place == self.k - 1
        self.kth[r[full]] = s[full]
        self.r, self.i, self.s, self.parts, self.waiting = r[keep], i[keep], s[keep], [], 0


def _score_block(ids: np.ndarray, q: np.ndarray, k: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(ids), k)
        for batch in batches:
            items = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(items), -1)
            for j in range(0, len(items), TILE[1]):
                part = x[j : j + TILE[1]].astype(np.float64)
                for at in range(0, len(ids), TILE[0]):
                    best.add(at, items[j : j + TILE[1]], score(q[at : at + TILE[0]], part))
        best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.r]), pa.array(best.i), pa.array(best.s)], ["qid", "item", "score"])

    return run


def top_k(queries: DataFrame, corpus: DataFrame, query_id: str, item_id: str, k: int = 32, vec: str = "embedding", dim: int | None = None, normalise: bool = True, score: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(qid, rank, item, score): the ``k`` best corpus vectors of every query by cosine (or inner product, or any ``score`` of
    two matrices of rows in double precision, where larger is better), exact.

    The queries go in blocks of BLOCK against the whole corpus, all blocks in one job; every task keeps k candidates per
    query, so k rows per task and query are shuffled. Scores are rounded to six decimals and ties go to the smaller id.
    Unusable vectors (see ``usable``) take no part.
    """
    score = score or (cosine_matrix if normalise else dot_matrix)
    q = cut(usable(queries, query_id, vec, dim))
    spread = -(-q.count() // BLOCK)
    c = usable(corpus, item_id, vec, dim)
    found = queries.sparkSession.createDataFrame([], "qid bigint, item bigint, score double")
    for p in range(spread):
        # about BLOCK queries
        rows = q.where(F.pmod(F.xxhash64("id"), F.lit(spread)) == p).toArrow()
        ids = rows["id"].to_numpy()
        x = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)
        if score is cosine_matrix:
            x = x / np.sqrt((x * x).sum(1))[:, None]
        found = found.unionByName(c.mapInArrow(_score_block(ids, x, k, score), "qid bigint, item bigint, score double"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "item")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "item", "score")


def rerank(candidates: DataFrame, second: Callable[[DataFrame], Column] | str, group: str = "qid", first: str = "rank", n: int | None = None) -> DataFrame:
    """``candidates`` with ``score2`` and ``rank2``: ordered by the second score, descending; equal scores keep the order
    of the first stage, and a null or NaN score comes last. ``second`` is a column's name or makes a Column (such as a
    pandas UDF of a model) from the DataFrame. The first stage's score is kept."""
    value = F.col(second) if isinstance(second, str) else second(candidates)
    rows = candidates.withColumn("score2", F.when(~F.isnan(value), value))
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last("score2"), first)
    rows = rows.withColumn("rank2", F.row_number().over(order))
    return rows.where(F.col("rank2") <= n) if n else rows


def encode_batches(df: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], list]], batch: int = 224, out: str = "embedding") -> DataFrame:
    """(key, out array<float>) of every row whose text is not null or empty, by a model that encodes lists of texts.

    ``load`` makes the model once in every task; ``batch`` texts go to it at a time. A vector may be any sequence of numbers.
    Other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                vectors = [[float(v) for v in x] for x in model(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32()))], [key, out])

    rows = df.select(F.col(key), F.col(text).alias("__text")).where("__text is not null and __text != ''")
    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, `{out}` array<float>")


def score_batches(pairs: DataFrame, keys: list[str], query: str, text: str, load: Callable[[], Callable[[list[tuple[str, str]]], list]], batch: int = 224, out: str = "score2") -> DataFrame:
    """(keys..., out double) of every row, by a model that scores lists of (query, text); a null query or text counts as
    empty. ``load`` and ``batch`` are as in ``encode_batches``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, n = load(), len(keys)
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                given = list(zip(*([x or "" for x in part.column(n + i).to_pylist()] for i in (0, 1))))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array([float(v) for v in model(given)], pa.float64())], [*keys, out])

    head = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.select(*keys, F.col(query).alias("__q"), F.col(text).alias("__t")).mapInArrow(run, f"{head}, `{out}` double")


def save_vectors(df: DataFrame, path: str, key: str, vec: str = "embedding") -> None:
    """Write (key, vec array<float>) as Parquet, in the order of the key; vectors of different sizes raise."""
    rows = df.select(key, F.col(vec).cast("array<float>").alias(vec))
    sizes = rows.where(F.col(vec).isNotNull()).agg(F.count_distinct(F.size(vec))).first()[0]
    if sizes > 1:
        raise ValueError("vectors of different sizes")
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def save_scores(df: DataFrame, path: str, group: str = "qid", item: str = "doc_id", score: str = "score") -> None:
    """Write (group, item, score double) as Parquet, sorted by group, best first."""
    rows = df.select(group, item, F.col(score).cast("double").alias(score))
    rows.repartitionByRange(group).sortWithinPartitions(group, F.desc(score), item).write.mode("overwrite").parquet(path)
