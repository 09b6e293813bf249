"""Readers and writers of the text formats, and the Parquet forms they become.

Readers keep what they cannot parse apart (``valid`` or a count) and never guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.codec import delta, undelta, vbyte_decode, vbyte_encode
from lodestone.operators.index import packed_blocks
from lodestone.operators.ordinal import with_ordinals
from lodestone.session import cut

# fixed values: the tags of a record, in their order
RECORD = r"(?s)^\s*<DOC>\n<DOCNO>([^<]*)</DOCNO>\n<TEXT>\n([^\n]*)\n(.*?)\n?</TEXT>\n?\s*$"
RECORD_END = "</DOC>\n"


def parse_trec(records: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """(docno, url, text, valid) of records without their closing tag; blank ones are left out. A record with missing or
    misplaced tags has null columns and ``valid`` false. ``keep`` names columns that go along."""
    rows = records.where(F.col(value).isNotNull() & (F.trim(F.regexp_replace(value, r"\s+", " ")) != ""))
    # the last record of a file may keep its own closing tag
    body = F.regexp_replace(F.col(value), r"</DOC>\s*$", "")
    ok = F.coalesce(body.rlike(RECORD), F.lit(False))
    part = lambda i: F.when(ok, F.regexp_extract(body, RECORD, i))
    return rows.select(part(1).alias("docno"), part(2).alias("url"), part(3).alias("text"), ok.alias("valid"), *(keep or []))


def read_trec(spark: SparkSession, path: str) -> DataFrame:
    """(docno, url, text, valid) of plain or compressed files; plain files are read in splits."""
    return parse_trec(spark.read.text(path, lineSep=RECORD_END))


def read_trec_ordered(spark: SparkSession, path: str) -> DataFrame:
    """The sound records of ``read_trec`` with the ordinal ``doc_id`` in the order of file names and of records in each file.

    Splits are packed into tasks by size, so a record's place is its file, the begin of its split and its number there."""
    lines = spark.read.text(path, lineSep=RECORD_END)
    lines = lines.select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__no"))
    place = ["__file", "__split", "__no"]
    rows = parse_trec(lines, keep=place).where("valid")
    return with_ordinals(rows.repartitionByRange(*place).sortWithinPartitions(*place)).drop("valid", *place)


def trec_record(docno: Column, url: Column, text: Column) -> Column:
    """A record with its closing tag; null url and text become empty."""
    return F.concat(F.lit("<DOC>\n<DOCNO>"), docno, F.lit("</DOCNO>\n<TEXT>\n"), F.coalesce(url, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n</TEXT>\n</DOC>\n"))


def docno_ordinals(pages: DataFrame) -> DataFrame:
    """(docno, doc_id): of a docno that comes repeatedly the largest ordinal."""
    return pages.where("docno is not null").groupBy("docno").agg(F.max("doc_id").alias("doc_id"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query) of lines with a number, a tab and the rest."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where("value != ''").select(F.expr("try_cast(split(value, '\t', 2)[0] as bigint)").alias("qid"), F.get(parts, F.lit(1)).alias("query"))


def parse_qrels(lines: DataFrame, value: str = "value") -> DataFrame:
    """(qid, docno) of lines with four fields parted by white space; the first and third count."""
    parts = F.split(F.trim(value), r"\s+")
    return lines.where(F.size(parts) >= 3).select(F.get(parts, F.lit(0)).try_cast("bigint").alias("qid"), F.get(parts, F.lit(2)).alias("docno"))


def convert_qrels(qrels: DataFrame, ordinals: DataFrame, strict: bool = True) -> DataFrame:
    """(qid, doc_id): docno replaced by its ordinal. A label of an unknown docno drops out, or becomes 0 unless ``strict``."""
    joined = qrels.join(ordinals, "docno", "inner" if strict else "left")
    return joined.select("qid", F.coalesce("doc_id", F.lit(0)).alias("doc_id"))


def read_corpus_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(id, url, title, body) of tab-separated lines; quotes are ordinary characters."""
    return spark.read.csv(path, sep="\t", quote="", escape="", schema="id string, url string, title string, body string")


def corpus_map(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(corpus_id, doc_id): dense numbers of the documents with text, in the order of doc_id."""
    kept = docs.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(doc_id)
    return with_ordinals(kept.repartitionByRange(doc_id).sortWithinPartitions(doc_id), "corpus_id").select("corpus_id", doc_id)


def index_lines(postings: DataFrame, store_diff: bool = True) -> DataFrame:
    """(term, block, ids, freqs): the lines of a text index, a long list in several blocks; ids as differences inside the
    block unless ``store_diff`` is off."""
    lists = packed_blocks(postings)
    ids = delta(F.col("doc_ids")) if store_diff else F.col("doc_ids")
    join = lambda a: F.array_join(a.cast("array<string>"), " ")
    return lists.select("term", "block", join(ids).alias("ids"), join(F.col("freqs")).alias("freqs"))


def parse_index_lines(lines: DataFrame, store_diff: bool = True) -> DataFrame:
    """The inverse of ``index_lines``: postings (term, doc_id, freq). Lists of different lengths raise an error."""
    numbers = lambda c: F.split(c, " ").cast("array<bigint>")
    ids = undelta(numbers("ids")) if store_diff else numbers("ids")
    rows = lines.select("term", ids.alias("i"), numbers("freqs").alias("f"))
    rows = rows.withColumn("i", F.when(F.size("i") == F.size("f"), F.col("i")).otherwise(F.raise_error(F.lit("ids and freqs differ in number"))))
    return rows.select("term", F.explode(F.arrays_zip("i", "f")).alias("x")).select("term", F.col("x.i").alias("doc_id"), F.col("x.f").alias("freq"))


def index_bytes(postings: DataFrame, store_diff: bool = True) -> DataFrame:
    """(term, block, doc_cnt, ids binary, freqs binary): variable-byte lists, a long list in several blocks."""
    lists = packed_blocks(postings)
    ids = delta(F.col("doc_ids")) if store_diff else F.col("doc_ids")
    return lists.select("term", "block", F.size("doc_ids").cast("bigint").alias("doc_cnt"), vbyte_encode(ids).alias("ids"), vbyte_encode(F.col("freqs")).alias("freqs"))


def parse_index_bytes(rows: DataFrame) -> DataFrame:
    """The inverse of ``index_bytes``: postings (term, doc_id, freq)."""
    both = F.arrays_zip(undelta(vbyte_decode(F.col("ids"))).alias("i"), vbyte_decode(F.col("freqs")).alias("f"))
    return rows.select("term", F.explode(both).alias("x")).select("term", F.col("x.i").alias("doc_id"), F.col("x.f").alias("freq"))


def write_index_text(postings: DataFrame, path: str, store_diff: bool = True) -> None:
    """One line "term id id ..." and one "term freq freq ..." for each term and block, in two folders sorted by term and
    block; both have the same lines in the same files. A term with white space raises, for a blank ends it in the line."""
    sound = F.when(F.col("term").rlike(r"\s"), F.raise_error(F.lit("a term holds white space"))).otherwise(F.col("term"))
    lines = index_lines(postings.withColumn("term", sound), store_diff).repartitionByRange("term", "block").sortWithinPartitions("term", "block")
    lines = lines.select(F.concat_ws(" ", "term", F.col("ids")).alias("ids"), F.concat_ws(" ", "term", F.col("freqs")).alias("freqs"))
    lines = cut(lines)
    for name in ("ids", "freqs"):
        lines.select(name).write.mode("overwrite").text(f"{path}/{name}")


def read_index_text(spark: SparkSession, path: str, store_diff: bool = True) -> DataFrame:
    """Postings from the two folders of ``write_index_text``, paired file by file and line by line; a different number of
    files or different terms at one place raise."""

    def part(name: str) -> DataFrame:
        place = [F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).alias("file"), F.col("_metadata.file_block_start").alias("split")]
        rows = spark.read.option("wholetext", False).text(f"{path}/{name}").select("value", *place, F.monotonically_increasing_id().alias("no"))
        rows = rows.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("split", "no")))
        cells = F.split("value", " ", 2)
        return rows.select("file", "line", F.get(cells, F.lit(0)).alias(f"{name}_term"), F.get(cells, F.lit(1)).alias(name))

    paired_files(spark, path)
    both = part("ids").join(part("freqs"), ["file", "line"], "full")
    same = F.col("ids_term").eqNullSafe(F.col("freqs_term"))
    both = both.select(F.when(same, F.col("ids_term")).otherwise(F.raise_error(F.lit("ids and freqs do not pair"))).alias("term"), "ids", "freqs")
    return parse_index_lines(both, store_diff)


def paired_files(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """The files of ``path``/ids and ``path``/freqs, paired by their numbers; raises where their numbers differ."""
    found = []
    for name in ("ids", "freqs"):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
        found.append(sorted(s.getPath().toString() for s in listed if not s.getPath().getName().startswith(("_", "."))))
    if len(found[0]) != len(found[1]):
        raise ValueError(f"{len(found[0])} files of ids, {len(found[1])} of freqs")
    return list(zip(*found))


def write_lines(df: DataFrame, path: str, columns: list[str], sep: str = " ") -> None:
    """Page tables, lexicons and qrels as lines of fields."""
    df.select(F.concat_ws(sep, *(F.col(c).cast("string") for c in columns)).alias("value")).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str, schema: str, sep: str = " ") -> DataFrame:
    return spark.read.csv(path, sep=sep, schema=schema, quote="", escape="")
