"""Counts and weights of terms over a postings table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import ascii_lower
from lodestone.operators.skew import hot_of_counts, join_hot
from lodestone.session import cut

#: Entries of a block's local dictionary before its arrays are handed on; bounds a task's memory.
BLOCK_TERMS = 1 << 18
#: Identifiers of one range of the global dictionary.
RANGE = 1 << 16


def clean_postings(df: DataFrame) -> DataFrame:
    """(term, doc_id, freq bigint): one row per term and page.

    Rows with a null or blank term, a null page, or a null freq or one below 1 do not count; a row equal to another in
    term, doc_id, freq and block_no counts once; terms are compared without spaces at the ends and with ASCII letters
    in lower case; the freqs of one term in one page add up. Rows repeated in bulk are folded by the map tasks before
    anything is shuffled, however many copies of one row there are.
    """
    rows = df.select("term", "doc_id", "freq", "block_no").where("term is not null and doc_id is not null and freq >= 1")
    rows = rows.withColumn("__term", F.trim(ascii_lower(F.col("term")))).where("__term not rlike '^\\\\s*$'")
    rows = rows.groupBy("__term", "doc_id", "term", "freq", "block_no").agg(F.lit(1).alias("__one"))
    return rows.groupBy(F.col("__term").alias("term"), "doc_id").agg(F.sum("freq").cast("bigint").alias("freq"))


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: a local integer dictionary, and arrays of occurrences and presences by local id."""
    names = ["term", "occurrences", "pages"]
    ids: dict[str, int] = {}
    occ = np.zeros(1024, np.int64)
    seen = np.zeros(1024, np.int64)

    def flush() -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(list(ids), pa.string()), pa.array(occ[:n]), pa.array(seen[:n])], names)

    for batch in batches:
        coded = pc.dictionary_encode(batch.column(0))
        local = np.array([ids.setdefault(t, len(ids)) for t in coded.dictionary.to_pylist()], np.int64)
        if len(ids) > len(occ):
            occ, seen = (np.concatenate([x, np.zeros(max(len(ids), len(x)), np.int64)]) for x in (occ, seen))
        at = local[coded.indices.to_numpy(zero_copy_only=False)]
        # integers, so that sums beyond 2^53 stay exact
        np.add.at(occ, at, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
        seen[: len(ids)] += np.bincount(at, minlength=len(ids))
        if len(ids) >= BLOCK_TERMS:
            yield flush()
            ids.clear()
            occ[:], seen[:] = 0, 0
    if ids:
        yield flush()


def _range_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by term id: add up the block arrays, one range of identifiers at a time."""
    names = ["term_id", "term", "occurrences", "pages"]
    lo, occ, seen, terms = -1, np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64), {}

    def flush() -> pa.RecordBatch:
        at = np.array(sorted(terms), np.int64)
        out = [pa.array(at + lo), pa.array([terms[i] for i in at.tolist()], pa.string()), pa.array(occ[at]), pa.array(seen[at])]
        return pa.RecordBatch.from_arrays(out, names)

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        bounds = ids // RANGE * RANGE
        for start in np.unique(bounds).tolist():
            if start != lo:
                if terms:
                    yield flush()
                lo, terms = start, {}
                occ[:], seen[:] = 0, 0
            here = np.flatnonzero(bounds == start)
            part = batch.slice(int(here[0]), len(here))
            at = ids[here] - lo
            np.add.at(occ, at, part.column(2).to_numpy(zero_copy_only=False))
            np.add.at(seen, at, part.column(3).to_numpy(zero_copy_only=False))
            terms.update(zip(at.tolist(), part.column(1).to_pylist()))
    if terms:
        yield flush()


def term_counts(postings: DataFrame) -> DataFrame:
    """(term_id, term, occurrences, pages) of every distinct term of ``clean_postings`` rows.

    Each partition of postings is a block with a dictionary and count arrays of its own, so a term that holds a third of
    all rows sends one row per block. The blocks' terms meet by hash; every partition numbers its terms in byte order
    behind those of the partitions before, which gives the dense global dictionary 0..n-1, and the block arrays are
    summed by ranges of these identifiers. ``term_id`` depends on the partitioning, the counts do not. An empty table
    gives an empty table.
    """
    blocks = postings.select("term", "freq").mapInArrow(_block_counts, "term string, occurrences bigint, pages bigint")
    met = blocks.repartition("term").sortWithinPartitions("term")
    met = cut(met.withColumn("__part", F.spark_partition_id()))
    # one number per partition reaches the window
    sizes = met.groupBy("__part").agg(F.count_distinct("term").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("__part"), before.alias("__before"))
    dictionary = met.groupBy("__part", "term").agg(F.lit(1).alias("__one")).drop("__one")
    # partitions are bounded by the shuffle's advisory size, so each numbering is
    dictionary = dictionary.join(F.broadcast(offsets), "__part")
    numbered = dictionary.withColumn("term_id", F.row_number().over(Window.partitionBy("__part").orderBy("term")) - 1 + F.col("__before"))
    coded = met.join(numbered.select("__part", "term", "term_id"), ["__part", "term"])
    ranges = coded.select(F.col("term_id").cast("bigint"), "term", "occurrences", "pages").repartition(F.floor(F.col("term_id") / RANGE)).sortWithinPartitions("term_id")
    return ranges.mapInArrow(_range_sums, "term_id bigint, term string, occurrences bigint, pages bigint")


def page_count(page_table: DataFrame) -> DataFrame:
    """One row: N, the distinct non-null doc_ids."""
    return page_table.where("doc_id is not null").agg(F.count_distinct("doc_id").alias("n"))


def mark_terms(counts: DataFrame, page_table: DataFrame, rare_below: int = 3, common_above: float = 0.25) -> DataFrame:
    """``counts`` with ``mark``: 'rare' in fewer than ``rare_below`` pages, 'common' in more than ``common_above`` of the
    N pages of the page table, else null. A term that is both (a tiny table) is 'rare'."""
    n = F.broadcast(page_count(page_table))  # one row
    mark = F.when(F.col("pages") < rare_below, "rare").when(F.col("pages") > F.col("n") * F.lit(common_above), "common")
    return counts.join(n).withColumn("mark", mark).drop("n")


def against_lexicon(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``counts`` with ``lexicon_pages``, the sum of the lexicon's doc_cnt over its distinct rows of the term (null where
    it has none), and ``agrees``: whether it equals ``pages``. Blank and null terms of the lexicon are left out."""
    lex = lexicon.select("term", "ids_begin", "freqs_begin", "doc_cnt", "block_no").dropDuplicates()
    lex = lex.where("term is not null").withColumn("term", F.trim(ascii_lower(F.col("term")))).where("term not rlike '^\\\\s*$'")
    lex = lex.groupBy("term").agg(F.sum("doc_cnt").alias("lexicon_pages"))
    return counts.join(lex, "term", "left").withColumn("agrees", F.coalesce(F.col("lexicon_pages") == F.col("pages"), F.lit(False)))


def page_lengths(postings: DataFrame, page_table: DataFrame) -> DataFrame:
    """(doc_id, dl double, listed boolean, terms) of every page of either table: term_cnt or, where it is null, the sum of the
    page's freqs (0 if none). Of different term_cnt of one page the largest holds. ``listed``: in the page table; ``terms``: how many
    terms it has in the postings."""
    pages = page_table.where("doc_id is not null").groupBy("doc_id").agg(F.max("term_cnt").alias("__cnt"))
    sums = postings.groupBy("doc_id").agg(F.sum("freq").alias("__sum"), F.count(F.lit(1)).alias("terms"))
    both = pages.withColumn("listed", F.lit(True)).join(sums, "doc_id", "full")
    return both.select("doc_id", F.coalesce("__cnt", "__sum", F.lit(0)).cast("double").alias("dl"), F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("terms", F.lit(0)).alias("terms"))


def term_weights(df: DataFrame, page_table: DataFrame, k: float = 0.9, b: float = 0.4) -> DataFrame:
    """(doc_id, term, freq, df, score) of every term of every page: smoothed logarithmic inverse document frequency
    times saturated term frequency, normalised by the page's length over the mean length; rounded to six decimals.

    ``df`` counts the pages of a term, N and the mean length are those of the page table. A page outside the page table
    has the sum of its freqs as length. A term in more than N pages scores null, for its logarithm is undefined. The
    document frequencies return to the postings by a join that broadcasts the bounded list of hot terms and shuffles
    the rest; the lengths likewise by page. Which terms and pages are hot is read from the frequencies and lengths
    themselves; the cleaned postings are written once and read by all steps.
    """
    rows = cut(clean_postings(df))
    # the (term, page) rows are distinct, so their number is the document frequency
    dfs = cut(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    lengths = cut(page_lengths(rows, page_table))
    stats = lengths.where("listed").agg(F.count(F.lit(1)).cast("double").alias("__n"), F.avg("dl").alias("__avg"))
    counted = join_hot(rows, dfs, "term", hot=hot_of_counts(dfs, "term", "df"))
    joined = join_hot(counted, lengths.select("doc_id", "dl"), "doc_id", hot=hot_of_counts(lengths, "doc_id", "terms")).join(F.broadcast(stats))
    idf = F.ln((F.col("__n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    norm = F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("__avg")
    score = idf * F.col("freq") * F.lit(k + 1) / (F.col("freq") + F.lit(k) * norm)
    return joined.select("doc_id", "term", "freq", "df", F.round(score, 6).alias("score"))


def top_terms(weights: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` terms of every page with the highest score, ties to the smaller term in byte order, with ``rank``.
    The limit is applied before the shuffle, so a page that holds a third of all rows sends n rows per task."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "term")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
