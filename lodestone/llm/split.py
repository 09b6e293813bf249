"""Splitting oversized texts at natural boundaries, with overlap."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Separator hierarchy, coarse to fine; a cut falls behind the match. Characters are the last resort.
SEPARATORS = (
    re.compile(r"\n[ \t]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?…؟۔।॥։።]+[\"'”’»)\]]*\s+|[。！？]+[”’」』）]*"),
    re.compile(r"\s+"),
)
#: Characters that never begin a piece: combining marks, variation selectors, joiners.
CLINGING = re.compile(r"[̀-ͯ҃-҉ً-ٟऺ-ॏัิ-ฺ็-๎‌‍︀-️\U0001f3fb-\U0001f3ff]")


def _last_cut(bounds: list[list[int]], level: int, low: int, high: int) -> int:
    """The last boundary of the coarsest level in (low, high], or 0."""
    if level == len(bounds):
        return 0
    at = bisect_right(bounds[level], high) - 1
    if at >= 0 and bounds[level][at] > low:
        return bounds[level][at]
    return _last_cut(bounds, level + 1, low, high)


def split_spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans [begin, end) of the pieces: each at most ``limit`` long, covering the text in order.

    A piece ends at the last boundary of the coarsest kind in its second half, else at the last boundary of the coarsest kind
    behind the piece before, else at ``limit``, or before the character that clings to what would follow. The next piece begins at the first word beginning within the last
    ``overlap`` characters of the piece.
    """
    size = len(text)
    if size <= limit:
        return [(0, size)] if size else []
    bounds = [[m.end() for m in sep.finditer(text)] for sep in SEPARATORS]
    spans, begin, done = [], 0, 0
    while True:
        high = begin + limit
        if high >= size:
            spans.append((begin, size))
            return spans
        end = _last_cut(bounds, 0, max(done, begin + limit // 2), high) or _last_cut(bounds, 0, done, high)
        if not end:
            end = high
            while end > done + 1 and CLINGING.match(text, end):
                end -= 1
        spans.append((begin, end))
        done = end
        words = bounds[-1]
        at = bisect_left(words, end - overlap)
        begin = words[at] if at < len(words) and words[at] < end else end - overlap
        while begin < end and CLINGING.match(text, begin):
            begin += 1


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """Pieces of every text above ``limit`` code points: keys..., body_no, piece_no, begin_pos, end_pos, overlap, piece.

    Texts at or under the limit, empty and null texts give no row: they need no cut. Rows equal in keys and text are cut
    once; different texts of one key are told apart by ``body_no``, from 1 in the order of their hashes. Other columns are
    left out. Positions count code points from 0. ``overlap`` must be below half the limit. Copies are folded in the map tasks, and found by their hashes.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be below half the limit")
    big = df.select(*(F.col(k) for k in keys), F.col(text).alias("__text")).where(F.length("__text") > limit)
    names = [f"__k{i}" for i in range(len(keys))]
    big = big.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), "__text", F.unhex(F.md5(F.col("__text").cast("binary"))).alias("__hash"))
    # of copies the first to come is kept, so only hashes are compared and counted; a key has few different texts
    once = big.groupBy(*names, "__hash").agg(F.first("__text").alias("__text"))
    big = once.withColumn("__no", F.row_number().over(Window.partitionBy(*names).orderBy("__hash")))
    big = big.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), F.col("__no").cast("int"), "__text")
    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{head}, body_no int, piece_no int, begin_pos bigint, end_pos bigint, overlap int, piece string"

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            cols: tuple[list, ...] = ([], [], [], [], [])
            for i, body in enumerate(batch.column(len(keys) + 1).to_pylist()):
                last = 0
                for no, (a, b) in enumerate(split_spans(body, limit, overlap), 1):
                    rows.append(i)
                    for c, v in zip(cols, (no, a, b, max(0, last - a), body[a:b])):
                        c.append(v)
                    last = b
            take = pa.array(rows, pa.int64())
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            arrays = [batch.column(k).take(take) for k in range(len(keys) + 1)] + [pa.array(c, t) for c, t in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, [*keys, "body_no", "piece_no", "begin_pos", "end_pos", "overlap", "piece"])

    return big.mapInArrow(cut_batches, schema)
