"""Building, merging, writing and reading an inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import codec
from lodestone.functions.text import tokens


def token_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term) of every token; null and empty texts give no row."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokens(F.col(text))).alias("term"))


def term_freqs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The postings (term, doc_id, freq): one shuffle, with counts pre-aggregated in the map tasks."""
    return token_rows(docs, doc_id, text).groupBy("term", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("freq"))


def page_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", url: str = "url") -> DataFrame:
    """(doc_id, url, term_cnt): pages without text keep their row, with 0 terms. No shuffle."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(url).alias("url"), F.coalesce(F.size(tokens(F.col(text))), F.lit(0)).alias("term_cnt"))


def corpus_stats(pages: DataFrame) -> DataFrame:
    """One row: n, total_terms, avgdl (null for no pages)."""
    total = F.coalesce(F.sum("term_cnt"), F.lit(0)).cast("bigint")
    return pages.agg(F.count(F.lit(1)).alias("n"), total.alias("total_terms"), (total.cast("double") / F.when(F.count(F.lit(1)) > 0, F.count(F.lit(1)))).alias("avgdl"))


def lexicon(postings: DataFrame) -> DataFrame:
    """(term, doc_cnt) of postings that hold each (term, doc_id) once."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("doc_cnt"))


#: Range of doc_id of a block of a packed list: what bounds a row, whatever a term's frequency.
PAGES_PER_BLOCK = 1 << 20


def packed_blocks(postings: DataFrame, pages_per_block: int = PAGES_PER_BLOCK) -> DataFrame:
    """(term, block, doc_ids, freqs): the list of every term as parallel arrays in the order of doc_id, cut by ranges of
    doc_id, so that no row and no task holds more than a block of a list however frequent its term is."""
    lists = postings.groupBy("term", F.expr(f"doc_id div {pages_per_block}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "freq"))).alias("l"))
    return lists.select("term", "block", F.col("l.doc_id").alias("doc_ids"), F.col("l.freq").alias("freqs"))


def merge_blocks(raw: DataFrame) -> DataFrame:
    """Merge the blocks of a builder (term, doc_id, freq, block_no) into postings (term, doc_id, freq).

    Rows equal in all columns count once; null or empty terms, null pages and freqs that are null or below 1 are left
    out; one page's freqs of a term in different blocks add up. Terms are taken as they are.
    """
    rows = raw.select("term", "doc_id", "freq", "block_no").where("term is not null and term != '' and doc_id is not null and freq >= 1")
    # partitioned by the final key, both groupings need one shuffle
    rows = rows.repartition("term", "doc_id").groupBy("term", "doc_id", "freq", "block_no").agg(F.lit(1).alias("one"))
    return rows.groupBy("term", "doc_id").agg(F.sum("freq").cast("bigint").alias("freq"))


def merge_lexicon(raw: DataFrame) -> DataFrame:
    """(term, doc_cnt) over the distinct rows of a lexicon written block by block; null counts add nothing."""
    rows = raw.where("term is not null and term != ''").dropDuplicates()
    return rows.groupBy("term").agg(F.coalesce(F.sum("doc_cnt"), F.lit(0)).cast("bigint").alias("doc_cnt"))


def read_page_table(raw: DataFrame) -> DataFrame:
    """(doc_id, docno, url, term_cnt): one row for each page; repeated rows meet, a null term_cnt counts as 0."""
    pages = raw.where("doc_id is not null").groupBy("doc_id")
    return pages.agg(F.max("docno").alias("docno"), F.max("url").alias("url"), F.coalesce(F.max("term_cnt"), F.lit(0)).alias("term_cnt"))


def index_sizes(postings: DataFrame, pages_per_block: int = PAGES_PER_BLOCK) -> DataFrame:
    """(term, doc_cnt, delta_bytes, id_bytes, freq_bytes, raw_bytes) of the lists in variable-byte and plain form.

    Differences are taken inside blocks of each list; the one between two blocks comes from the blocks' ends, of which a
    list has few, so no task sees the whole list of a hot term."""
    order = Window.partitionBy("term", "block").orderBy("doc_id")
    rows = postings.withColumn("block", F.expr(f"doc_id div {pages_per_block}"))
    rows = rows.withColumn("gap", F.col("doc_id") - F.lag("doc_id").over(order))
    size = lambda c: F.sum(codec.vbyte_size(F.col(c).cast("bigint")))
    blocks = rows.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.coalesce(size("gap"), F.lit(0)).alias("gaps"), size("doc_id").alias("ids"), size("freq").alias("freqs"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    jump = F.col("lo") - F.coalesce(F.lag("hi").over(Window.partitionBy("term").orderBy("block")), F.lit(0))
    blocks = blocks.withColumn("gaps", F.col("gaps") + codec.vbyte_size(jump))
    total = lambda c, name: F.sum(c).cast("bigint").alias(name)
    return blocks.groupBy("term").agg(total("n", "doc_cnt"), total("gaps", "delta_bytes"), total("ids", "id_bytes"), total("freqs", "freq_bytes"), (4 * F.sum("n")).alias("raw_bytes"))


def write_index(docs: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write postings sorted by term, lexicon, page table and statistics under ``path`` as Parquet. Term-sorted files
    have narrow row-group statistics, so a query reads only the row groups of its terms."""
    spark = docs.sparkSession
    postings = term_freqs(docs)
    spread = postings.repartitionByRange(partitions, "term", "doc_id") if partitions else postings.repartitionByRange("term", "doc_id")
    spread.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    lexicon(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/lexicon")
    page_table(docs).write.mode("overwrite").parquet(f"{path}/page_table")
    corpus_stats(spark.read.parquet(f"{path}/page_table")).write.mode("overwrite").parquet(f"{path}/stats")


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "lexicon", "page_table", "stats")}
