"""Most similar vectors for every vector, by cross-polytope hashing.

Unit vectors are padded to a power of two and pseudo-rotated by three rounds of random signs and fast Hadamard
transforms; the nearest signed axis among a block of coordinates is a hash. A table's bucket is one hash or, where the data
are too many for one, several joined, the last over fewer axes, so that the number of buckets follows the number of vectors
at any size. A vector lies in one bucket per table and looks into ``PROBES`` buckets, those nearest to it. The candidates
of a bucket are compared by matrix products, and the best are reranked in double precision. As buckets become finer, tables
are added: two for each doubling, so comparisons and copies of a vector grow with the logarithm of the data only.

Equal vectors are one class with one copy in the index, so any number of copies costs one vector; buckets of more than
``ROWS`` vectors are cut into chunks that every query of the bucket meets, so none is dropped. In its own bucket a vector
serves as entry and as query by one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.skew import join_hot
from lodestone.session import cut, shared_path, shuffle_partitions, side_session

#: Tables where there are at most 64 buckets; two more for each doubling of the buckets.
TABLES = 6
PROBES = 2
#: Vectors that a bucket holds on average at most.
FILL = 512
#: Vectors of a bucket that are compared in one task at once.
ROWS = 8192
#: Buckets that are cut into chunks, at most: the bound of what tells the tasks their chunks.
CHUNKED = 1 << 18
SEED = 20240229
#: Candidates whose single-precision cosine is this close to the k-th are reranked too.
SLACK = 2e-6


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, as two products with small Hadamard matrices, scaled to keep norms."""
    n = x.shape[1]
    bits = n.bit_length() - 1
    a, b = 1 << bits // 2, 1 << bits - bits // 2
    y = x.reshape(-1, b) @ _matrix(b)
    y = np.matmul(_matrix(a), y.reshape(-1, a, b))
    return y.reshape(-1, n) / np.float32(np.sqrt(n))


def _matrix(n: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


def table_codes(x: np.ndarray, tables: int, axes: list[int], probes: int, seed: int = SEED) -> np.ndarray:
    """Buckets of unit vectors: int64 of shape (vectors, tables, probes), the nearest first. ``axes`` gives the axes of each
    of the hashes that are joined.

    Axis i of a hash is 2i + 1, its opposite 2i. A bucket is the nearer, the less the coordinates of its axes fall short of
    the largest ones.
    """
    codes = np.empty((len(x), tables, probes), np.int64)
    size = max(*axes, 1 << (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), size), np.float32)
    padded[:, : x.shape[1]] = x
    turned: dict[tuple[int, int], np.ndarray] = {}

    def block(hash_no: int, table: int) -> np.ndarray:
        per = size // axes[hash_no]
        key = (hash_no, table // per)
        if key not in turned:
            for old in [k for k in turned if k[0] == hash_no]:
                del turned[old]
            y = padded
            for s in np.random.RandomState(seed + 10_007 * hash_no + key[1]).choice(np.array([-1, 1], np.float32), (3, size)):
                y = _hadamard(y * s)
            turned[key] = y
        return turned[key][:, table % per * axes[hash_no] : (table % per + 1) * axes[hash_no]]

    for t in range(tables):
        code, short = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.float32)
        for h, count in enumerate(axes):
            at, miss = _signed_axes(block(h, t), probes)
            code = (code[:, :, None] * (2 * count) + at[:, None, :]).reshape(len(x), -1)
            short = (short[:, :, None] + miss[:, None, :]).reshape(len(x), -1)
            best = np.argsort(short, axis=1, kind="stable")[:, :probes]
            code, short = np.take_along_axis(code, best, 1), np.take_along_axis(short, best, 1)
        codes[:, t] = code
    return codes


def _signed_axes(part: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``probes`` signed axes nearest to each row, and by how much their coordinates fall short of the largest. Opposite
    axes come behind all others, so that there are always enough."""
    every = np.concatenate([part, -part], 1)
    m = min(probes, every.shape[1])
    at = np.argpartition(-every, m - 1, axis=1)[:, :m] if m < every.shape[1] else np.tile(np.arange(m), (len(part), 1))
    value = np.take_along_axis(every, at, 1)
    order = np.argsort(-value, axis=1, kind="stable")
    at, value = np.take_along_axis(at, order, 1), np.take_along_axis(value, order, 1)
    n = part.shape[1]
    return np.where(at < n, 2 * at + 1, 2 * (at - n)).astype(np.int64), value[:, :1] - value


def axes_for(n: int, dim: int) -> list[int]:
    """Axes of the hashes of a table, so that its buckets (the product of twice the axes) hold at most FILL of ``n`` vectors
    on average: whole hashes over the padded dimension, and a last one over a power of two of axes; 4 at least."""
    top = 1 << max(2, (dim - 1).bit_length())
    axes, left = [], n / FILL
    while left > 2 * top:
        axes.append(top)
        left /= 2 * top
    last = 1 if axes else 4
    while 2 * last < left and last < top:
        last *= 2
    return [*axes, last] if left > 1 or not axes else axes


def tables_for(axes: list[int]) -> int:
    """Tables for buckets of this fineness."""
    buckets = 1.0
    for a in axes:
        buckets *= 2 * a
    return max(TABLES, TABLES + math.ceil(2 * math.log2(buckets / 64)))


def usable_vectors(df: DataFrame, id_col: str, vec: str, kind: str, dim: int) -> DataFrame:
    """(kind, id, vec binary): unit vectors as ``dim`` little-endian single floats, normalised in double precision.

    Rows with a null id, and null, zero, wrongly sized vectors or such that hold null, NaN or infinity are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            with np.errstate(all="ignore"):
                big = np.abs(flat).max(axis=1, initial=0.0)
                flat = flat / big[:, None]  # so that squares neither overflow nor vanish
                norm = np.sqrt((flat * flat).sum(axis=1))
                ok = np.isfinite(big) & (big > 0) & np.isfinite(norm)
            unit = np.ascontiguousarray((flat[ok] / norm[ok, None]).astype("<f4") + np.float32(0))
            ids = batch.column(0).filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(ids), pa.string()), ids, _binary(unit)], ["kind", "id", "vec"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<float>").alias("v"))
    rows = rows.where((F.size("v") == dim) & F.col("id").isNotNull() & ~F.array_contains("v", F.lit(float("nan")).cast("float")))
    return rows.mapInArrow(run, "kind string, id bigint, vec binary")


def _binary(x: np.ndarray) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def _floats(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a binary column without nulls."""
    column = column.cast(pa.binary()) if column.type != pa.binary() else column
    _, offsets, data = column.buffers()
    start = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, "<f4", len(column) * dim, int(start)).reshape(-1, dim)


def _hash(dim: int, tables: int, axes: list[int], probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _floats(batch.column(batch.schema.get_field_index("vec")), dim)
            parts = [table_codes(x[i : i + 2048], tables, axes, probes) for i in range(0, len(x), 2048)]
            codes = np.concatenate(parts).reshape(-1) if parts else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * (tables * probes), pa.array(codes))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "codes"])

    return run


def _search(dim: int, k: int):
    """Rows come sorted by (bucket, chunk), entries before the others in each; a group's entries are at most about ROWS. All
    rows of a group are queries, its entries too."""

    def best(e: tuple, q_class: pa.Array, q_vec: np.ndarray, q_no: np.ndarray) -> Iterator[pa.RecordBatch]:
        e_class, e_vec, e_min, e_no = e
        for at in range(0, len(q_vec), 512):
            x, no = q_vec[at : at + 512], q_no[at : at + 512]
            s = x @ e_vec.T
            s[no[:, None] == e_no[None, :]] = -9  # a vector's own class is added at the end
            if s.shape[1] > k:
                kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                r, c = np.nonzero((s >= (kth - SLACK)[:, None]) & (s > -8))
            else:
                r, c = np.nonzero(s > -8)
            if not len(r):
                continue
            exact = np.concatenate([np.einsum("ij,ij->i", x[r[i : i + 4096]].astype(np.float64), e_vec[c[i : i + 4096]].astype(np.float64)) for i in range(0, len(r), 4096)])
            exact = np.round(np.clip(exact, -1, 1), 6)
            order = np.lexsort((e_min[c], -exact, r))
            r, c, exact = r[order], c[order], exact[order]
            first = np.searchsorted(r, r)
            keep = np.arange(len(r)) - first < k
            r, c, exact = r[keep], c[keep], exact[keep]
            who, start = np.unique(r, return_index=True)
            # one row for each query, its best first
            near = pa.StructArray.from_arrays([pa.array(-exact), pa.array(e_min[c]), e_class.take(pa.array(c))], ["far", "c_min", "c"])
            lists = pa.ListArray.from_arrays(np.append(start, len(r)).astype(np.int32), near)
            yield pa.RecordBatch.from_arrays([q_class.take(pa.array(who + at)), lists], ["q", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, entries = None, [], None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal parts, entries
            if parts:
                entries = (pa.concat_arrays([p[0] for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3)))
                parts = []
                yield from best(entries, entries[0], entries[1], entries[3])

        for batch in batches:
            group = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            entry = batch.column(2).to_numpy(zero_copy_only=False)
            if not len(group):
                continue
            vec, mins = _floats(batch.column(5), dim), batch.column(4).fill_null(-1).to_numpy()
            no = batch.column(6).to_numpy()
            edge = np.flatnonzero((np.diff(group, axis=0) != 0).any(1) | (np.diff(entry.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(group)]):
                if here is None or tuple(group[a]) != here:
                    yield from close()
                    here, entries = tuple(group[a]), None
                if entry[a]:
                    parts.append((batch.column(3).slice(a, b - a), vec[a:b].copy(), mins[a:b].copy(), no[a:b].copy()))
                else:
                    yield from close()
                    if entries:
                        yield from best(entries, batch.column(3).slice(a, b - a), vec[a:b], no[a:b])
        yield from close()

    return run


def nearest_vectors(corpus: DataFrame, questions: DataFrame | None = None, corpus_id: str = "corpus_id", question_id: str = "qid", vec: str = "embedding", dim: int = 384, k: int = 5, tables: int | None = None, probes: int = PROBES) -> DataFrame:
    """(vec_kind, vec_id, corpus_id, cosine, rank): the ``k`` most similar corpus vectors of every usable vector.

    vec_kind is 'corpus' (the vector itself excluded, not its equals under other ids) or 'question'. The order is cosine
    rounded to six decimals, descending, then the smaller corpus_id. An id that comes repeatedly counts once per
    distinct vector. Unusable vectors (see ``usable_vectors``) take no part on either side; an empty corpus gives an
    empty table. The result is approximate: a neighbour is found where one of its ``tables`` buckets (by
    default as many as ``tables_for`` the data) is among the ``probes`` nearest of the vector; what is found is ranked exactly.
    """
    spark = corpus.sparkSession
    rows = usable_vectors(corpus, corpus_id, vec, "corpus", dim)
    if questions is not None:
        rows = rows.unionByName(usable_vectors(questions, question_id, vec, "question", dim))
    rows = rows.withColumn("class", F.unhex(F.md5("vec")))
    is_corpus = F.col("kind") == "corpus"
    classes = rows.groupBy("class").agg(F.min(F.when(is_corpus, F.col("id"))).alias("c_min"), F.first("vec").alias("vec"))
    members = rows.select("kind", "id", "class").dropDuplicates()
    members = cut(members)
    n = members.where(is_corpus).count()
    if not n:
        return spark.createDataFrame([], "vec_kind string, vec_id bigint, corpus_id bigint, cosine double, rank int")
    axes = axes_for(n, dim)
    tables = tables or tables_for(axes)
    # a number that stands for the class in comparisons, the same whenever a lost part is computed again
    hashed = classes.withColumn("no", F.xxhash64("class")).mapInArrow(_hash(dim, tables, axes, probes), "class binary, c_min bigint, vec binary, no bigint, codes array<bigint>")
    # written once; a session of its own drops the shuffle files of one table before the next begins
    at = shared_path(spark, "hashed")
    hashed.write.option("compression", "lz4").parquet(at)
    side = side_session(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")
    hashed = side.read.parquet(at)

    parts, found = shuffle_partitions(spark), []
    limit = max(ROWS, n // CHUNKED)  # so at most CHUNKED buckets of a table are over it
    sizes = hashed.where("c_min is not null").select(F.posexplode(F.expr(f"transform(sequence(0, {tables - 1}), t -> codes[t * {probes}])")).alias("t", "bucket"))
    over = sizes.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("t", "bucket", F.ceil(F.col("n") / limit).cast("int").alias("chunks"))
    over = cut(over)
    crowded = {r[0] for r in over.select("t").distinct().collect()}  # numbers of tables
    for t in range(tables):
        rows = hashed.select("class", "c_min", "vec", "no", F.posexplode(F.expr(f"slice(codes, {t * probes + 1}, {probes})")).alias("probe", "bucket"))
        own = F.lit(0)
        if t in crowded:
            mine = F.broadcast(over.where(F.col("t") == t).drop("t"))
            rows = rows.join(mine, "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
            own = F.pmod(F.col("no"), F.col("chunks")).cast("int")
            rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        else:
            rows = rows.withColumn("chunk", F.lit(0))
        # an entry serves in its own bucket and chunk, and looks into all
        entry = F.col("c_min").isNotNull() & (F.col("probe") == 0) & (F.col("chunk") == own)
        both = rows.select("bucket", "chunk", entry.alias("entry"), "class", "c_min", "vec", "no")
        both = both.repartition(min(parts * 4, 4096), "bucket", "chunk").sortWithinPartitions("bucket", "chunk", F.desc("entry"))
        near = shared_path(spark, "near")
        both.mapInArrow(_search(dim, k), "q binary, near array<struct<far: double, c_min: bigint, c: binary>>").write.parquet(near)
        found.append(spark.read.parquet(near))

    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    # at most k candidates of each table, probe and chunk meet; a class found repeatedly has the same cosine each time
    pairs = pairs.groupBy("q").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    fresh = F.filter("near", lambda x, i: (i == 0) | (F.get(F.col("near"), F.greatest(i - 1, F.lit(0)))["c"] != x["c"]))
    pairs = pairs.select("q", F.explode(F.slice(fresh, 1, k)).alias("x")).select("q", F.col("x.c").alias("c"), (-F.col("x.far")).alias("cos"))
    # of many equal vectors only the k + 1 smallest ids can be named: k, and one that may be the asking vector's own
    smallest = Window.partitionBy("class").orderBy("id")
    named = members.where(is_corpus).withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1).groupBy("class").agg(F.collect_list("id").alias("ids"))
    named = cut(named)
    own = named.select(F.col("class").alias("q"), F.col("ids"), F.lit(1.0).alias("cos"))
    lists = pairs.join(named, pairs["c"] == named["class"]).select("q", "ids", "cos").unionByName(own)
    lists = lists.select("q", F.explode("ids").alias("cid"), "cos").groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("far"), F.col("cid")))).alias("near"))
    lists = lists.select(F.col("q").alias("class"), F.slice("near", 1, k + 1).alias("near"))
    out = join_hot(members, lists, "class")
    others = F.filter("near", lambda x: (F.col("kind") != "corpus") | (x["cid"] != F.col("id")))
    out = out.select("kind", "id", F.posexplode(F.slice(others, 1, k)).alias("pos", "x"))
    return out.select(F.col("kind").alias("vec_kind"), F.col("id").alias("vec_id"), F.col("x.cid").alias("corpus_id"), (-F.col("x.far")).alias("cosine"), (F.col("pos") + 1).alias("rank"))
