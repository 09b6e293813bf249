"""Inverted indexes as binary files: a builder's blocks, and the merged index with a lexicon of byte offsets.

Fixed values of the formats: numbers are unsigned, 32 bits, little-endian (``bin``), or in variable-byte code (``vbyte``); a
list in a block is led by its number of values in 32 bits, and on the side of ids by its term and a blank. Ids in a block are
plain, in a merged index differences (unless told otherwise). Files are written and read through the file system that
their path names, in streams: a task holds one block of a list, or one list that was asked for, at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.codec import from_vbytes, to_vbytes
from lodestone.operators.index import packed_blocks
from lodestone.session import shuffle_partitions

CODECS = ("bin", "vbyte")


def _checked(codec: str) -> str:
    if codec not in CODECS:
        raise ValueError("the codec is bin or vbyte")
    return codec


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith(("file:", "hdfs:")) else f"file://{path}")


def encode_numbers(values: np.ndarray, codec: str) -> bytes:
    """The bytes of numbers from 0 to 2^32 - 1; others raise."""
    values = np.asarray(values, np.int64)
    if len(values) and (values.min() < 0 or values.max() >= 1 << 32):
        raise ValueError("a number does not fit 32 bits")
    return values.astype("<u4").tobytes() if codec == "bin" else to_vbytes(values)[0].tobytes()


def encode_lists(values: np.ndarray, starts: np.ndarray, codec: str) -> list[bytes]:
    """The bytes of each list of numbers; ``starts`` has where the lists begin in ``values``, and their end."""
    data = encode_numbers(values, codec)
    at = 4 * starts if codec == "bin" else np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) >= 128) + 1])[starts]
    return [data[a:b] for a, b in itertools.pairwise(at.tolist())]


def decode_numbers(data: bytes, codec: str, count: int) -> tuple[np.ndarray, int]:
    """The first ``count`` numbers, and the bytes they take."""
    if codec == "bin":
        return np.frombuffer(data, "<u4", count).astype(np.int64), 4 * count
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw >= 128)[:count]
    size = int(ends[-1]) + 1 if len(ends) else 0
    return from_vbytes(raw[:size], np.array([0, size]))[0], size


def write_merged(postings: DataFrame, path: str, codec: str = "vbyte", store_diff: bool = True, partitions: int | None = None) -> DataFrame:
    """Write postings (term, doc_id, freq; each pair once) as files ``ids-N`` and ``freqs-N`` under ``path`` and return the
    lexicon (term, part, ids_begin, freqs_begin, doc_cnt, ids_bytes, freqs_bytes), which is kept there as Parquet, sorted by term.

    Terms are spread by ranges. A list longer than a block may go on in the next file; each of its entries in the lexicon
    begins with a whole id. ``partitions`` = 1 gives one pair of files with one entry for each term. A file is written under a
    name of its attempt and moved when it is whole, so a repeated task replaces its own work.
    """
    _checked(codec)
    system, root = _open(path)
    system.create_dir(root, recursive=True)
    spread = ["term", "block"]
    lists = packed_blocks(postings)
    lists = (lists.repartitionByRange(partitions, *spread) if partitions else lists.repartitionByRange(*spread)).sortWithinPartitions(*spread)
    lists = lists.select(F.spark_partition_id().alias("part"), "term", "doc_ids", "freqs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(path)
        out, names = {}, ["term", "part", "ids_begin", "freqs_begin", "doc_cnt", "ids_bytes", "freqs_bytes"]
        at, term, row, last, rows = [0, 0], None, None, 0, []
        part = None
        for b in batches:
            for part, t, ids, freqs in zip(*(b.column(i).to_pylist() for i in range(4))):
                if not out:
                    out = {k: store.open_output_stream(f"{root}/_{k}-{part}.tmp") for k in ("ids", "freqs")}
                if t != term:
                    row, term, last = [t, part, at[0], at[1], 0, 0, 0], t, 0
                    rows.append(row)
                values = np.array(ids, np.int64)
                data = (encode_numbers(np.diff(values, prepend=last) if store_diff else values, codec), encode_numbers(np.array(freqs), codec))
                last = int(values[-1])
                row[4] += len(ids)
                for i, k in enumerate(("ids", "freqs")):
                    out[k].write(data[i])
                    at[i] += len(data[i])
                    row[5 + i] += len(data[i])
        for k, f in out.items():
            f.close()
            store.move(f"{root}/_{k}-{part}.tmp", f"{root}/{k}-{part}")
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, [pa.string(), pa.int32(), *[pa.int64()] * 5])], names)

    lexicon = lists.mapInArrow(run, "term string, part int, ids_begin bigint, freqs_begin bigint, doc_cnt bigint, ids_bytes bigint, freqs_bytes bigint")
    lexicon.write.mode("overwrite").parquet(f"{path}/lexicon")
    return postings.sparkSession.read.parquet(f"{path}/lexicon")


def read_merged(spark: SparkSession, path: str, terms: list[str] | None = None, codec: str = "vbyte", store_diff: bool = True) -> DataFrame:
    """Postings (term, doc_id, freq) of ``terms``, or of all: only the lexicon's entries of these terms and the bytes of
    their lists are read."""
    _checked(codec)
    lexicon = spark.read.parquet(f"{path}/lexicon")
    wanted = lexicon.where(F.col("term").isin(terms)) if terms is not None else lexicon
    if terms is not None:
        # lists of a few terms: a task for each, not one for the few bytes of their lexicon
        wanted = wanted.repartition("term", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(path)
        files: dict[str, object] = {}
        for b in batches:
            for term, part, ids_begin, freqs_begin, count, ids_bytes, freqs_bytes in zip(*(b.column(i).to_pylist() for i in range(7))):
                for name in (f"ids-{part}", f"freqs-{part}"):
                    if name not in files:
                        if len(files) > 16:
                            files.pop(next(iter(files))).close()
                        files[name] = store.open_input_file(f"{root}/{name}")
                ids = decode_numbers(files[f"ids-{part}"].read_at(ids_bytes, ids_begin), codec, count)[0]
                freqs = decode_numbers(files[f"freqs-{part}"].read_at(freqs_bytes, freqs_begin), codec, count)[0]
                if store_diff:
                    ids = np.cumsum(ids)
                for i in range(0, count, 1 << 16):
                    k = len(ids[i : i + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array([term] * k, pa.string()), pa.array(ids[i : i + k]), pa.array(freqs[i : i + k])], ["term", "doc_id", "freq"])

    return wanted.mapInArrow(run, "term string, doc_id bigint, freq bigint")


def lexicon_lines(lexicon: DataFrame) -> DataFrame:
    """(value): the lines "term ids_begin freqs_begin doc_cnt" of a lexicon."""
    return lexicon.select(F.concat_ws(" ", "term", F.col("ids_begin").cast("string"), F.col("freqs_begin").cast("string"), F.col("doc_cnt").cast("string")).alias("value"))


def page_lines(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(value): the lines "url term_cnt begin end" of a page table with offsets; nulls are empty or 0. ``keep`` names columns
    that go along."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return pages.select(*(keep or []), F.concat_ws(" ", F.coalesce("url", F.lit("")), number("term_cnt"), number("begin_pos"), number("end_pos")).alias("value"))


def write_blocks(postings: DataFrame, path: str, codec: str = "vbyte") -> None:
    """Write a builder's rows (term, doc_id, freq, block_no) as one pair of files for each block, ``NNN`` and ``NNN_freqs``,
    sorted by term. Rows with a null or empty term, null page, freq or block are left out; rows of one term and page stay as they
    are. A term with white space raises, for a blank ends it in the file."""
    _checked(codec)
    system, root = _open(path)
    system.create_dir(root, recursive=True)
    rows = postings.where("term is not null and term != '' and doc_id is not null and freq is not null and block_no is not null")
    rows = rows.withColumn("term", F.when(F.col("term").rlike(r"\s"), F.raise_error(F.lit("a term holds white space"))).otherwise(F.col("term")))
    # rows, not lists, are sorted: a batch of them is coded at once, and a list may go on in the next batch
    rows = rows.select("block_no", "term", F.col("doc_id").cast("bigint"), F.col("freq").cast("bigint")).repartition("block_no").sortWithinPartitions("block_no", "term", "doc_id", "freq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(path)
        here, out, done = None, [], []
        last, parts = None, ([], [])  # the list that may go on; what is not written yet of ids and freqs

        def put() -> None:
            if last:
                _, term, count, ids, freqs = last
                size = count.to_bytes(4, "little")
                parts[0].extend((term, b" ", size, *ids))
                parts[1].extend((size, *freqs))

        def write() -> None:
            for f, p in zip(out, parts):
                f.write(b"".join(p))
                p.clear()

        def close() -> None:
            write()
            for f, tail in zip(out, ("", "_freqs")):
                f.close()
                store.move(f"{root}/_{here:03d}{tail}.tmp", f"{root}/{here:03d}{tail}.{codec}")
            if out:
                done.append(here)

        for b in (x for x in batches if x.num_rows):
            nos, terms = b.column(0).to_numpy(), b.column(1).cast(pa.binary())
            begins = np.flatnonzero(np.concatenate([[True], (nos[1:] != nos[:-1]) | pc.not_equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False)]))
            starts = np.append(begins, b.num_rows)
            ids, freqs = (encode_lists(b.column(i).to_numpy(), starts, codec) for i in (2, 3))
            for no, term, count, i, f in zip(nos[begins].tolist(), terms.take(pa.array(begins)).to_pylist(), np.diff(starts).tolist(), ids, freqs):
                if last and (no, term) == (last[0], last[1]):
                    last[2] += count
                    last[3].append(i)
                    last[4].append(f)
                    continue
                put()
                last = [no, term, count, [i], [f]]
                if no != here:
                    close()
                    here, out = no, [store.open_output_stream(f"{root}/_{no:03d}{tail}.tmp") for tail in ("", "_freqs")]
            write()
        put()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32())], ["block_no"])

    rows.mapInArrow(run, "block_no int").collect()  # one number for each block


def block_files(path: str, codec: str = "vbyte") -> list[tuple[str, str]]:
    """The pairs of files of a folder of blocks, by name. A file without its partner raises."""
    system, root = _open(path)
    names = {f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(f".{_checked(codec)}")}
    tail = f"_freqs.{codec}"
    ids, freqs = sorted(n for n in names if not n.endswith(tail)), {n for n in names if n.endswith(tail)}
    partner = {n: n[: -len(codec) - 1] + tail for n in ids}
    if set(partner.values()) != freqs:
        raise ValueError(f"{len(ids)} files of ids, {len(freqs)} of freqs, or names that do not pair")
    return [(f"{root}/{n}", f"{root}/{partner[n]}") for n in ids]


#: Coded bytes of lists that are decoded at once.
DECODED_AT_ONCE = 1 << 20
_LOW = bytes(range(128))


def _lists_of(data: bytes, codec: str, named: bool) -> Iterator[tuple[bytes, int, bytes]]:
    """(term, number of values, bytes) of the lists in a file of a block; only files of ids name terms. A list that is cut
    short raises."""
    marks = np.flatnonzero(np.frombuffer(data, np.uint8) >= 128) if codec == "vbyte" else None
    at = seen = 0
    while at < len(data):
        blank = data.index(b" ", at) if named else at - 1
        begin = blank + 5
        count = int.from_bytes(data[blank + 1 : begin], "little")
        if marks is None:
            end = begin + 4 * count
        else:
            # marks in the term and the count end no value
            seen += len(data[at:begin].translate(None, _LOW)) + count
            end = begin if not count else int(marks[seen - 1]) + 1 if seen <= len(marks) else len(data) + 1
        if max(begin, end) > len(data):
            raise ValueError("a list is cut short")
        yield data[at : max(at, blank)], count, data[begin:end]
        at = end


def read_blocks(spark: SparkSession, path: str, codec: str = "vbyte") -> DataFrame:
    """The rows (term, doc_id, freq, block_no) of a folder of blocks, a pair of files in one task; block_no is the
    number in the name. Lists of different lengths raise."""
    found = block_files(path, codec)
    # the number is given: by their size, all names would go to one task
    pairs = spark.createDataFrame(found, "ids string, freqs string").repartition(max(1, min(len(found), shuffle_partitions(spark))))

    def rows(no: int, lists: list[tuple[bytes, int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        terms, sizes, *data = zip(*lists)
        terms, flat = pa.array(terms, pa.binary()).cast(pa.string()), np.repeat(np.arange(len(terms)), sizes)
        ids, freqs = (decode_numbers(b"".join(x), codec, len(flat))[0] for x in data)
        for i in range(0, len(flat), 1 << 16):
            at = flat[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(at)), pa.array(ids[i : i + len(at)]), pa.array(freqs[i : i + len(at)]), pa.array(np.full(len(at), no, np.int32))], ["term", "doc_id", "freq", "block_no"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(path)
        for b in batches:
            for ids_name, freqs_name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                no = int(ids_name.rsplit("/", 1)[-1].split(".")[0])
                # a block was written from one task's memory and fits one
                data, other = (store.open_input_file(n).readall() for n in (ids_name, freqs_name))
                lists, size = [], 0
                beside = _lists_of(other, codec, False)
                for term, count, ids in _lists_of(data, codec, True):
                    _, count2, freqs = next(beside, (b"", None, b""))
                    if count != count2:
                        raise ValueError("ids and freqs differ in number")
                    lists.append((term, count, ids, freqs))
                    size += len(ids) + len(freqs)
                    if size >= DECODED_AT_ONCE:
                        yield from rows(no, lists)
                        lists, size = [], 0
                if lists:
                    yield from rows(no, lists)

    return pairs.mapInArrow(run, "term string, doc_id bigint, freq bigint, block_no int")
