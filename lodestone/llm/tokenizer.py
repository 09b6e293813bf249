"""Encoding of a corpus with a public byte-level BPE tokenizer, and the way back."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary file lies on every machine; a parameter of all functions here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Texts handed to the library at once; bounds the memory of its intermediate objects.
SLICE = 128


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True  # what looks like a special token is plain text
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=1)
def byte_characters() -> dict[int, str]:
    """The byte-to-character table of byte-level BPE, from its rule: printable Latin-1 stands for itself, the remaining
    bytes take the characters from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> list[bytes]:
    back = {c: b for b, c in byte_characters().items()}
    vocab = _tokenizer(path).get_vocab(with_added_tokens=True)
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return table


def decode_one(ids: list[int], path: str = VOCABULARY) -> str:
    """The text of a list of ids. Bytes are joined before they are read as UTF-8, so a character split over several
    tokens comes back whole; a list cut inside a character gives U+FFFD for the broken rest. Unknown ids raise."""
    table = _token_bytes(path)
    return b"".join(table[i] for i in ids).decode("utf-8", errors="replace")


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[list[str]]:
    texts = batch.column(column)
    for at in range(0, len(texts), SLICE):
        yield [t or "" for t in texts.slice(at, SLICE).to_pylist()]


def encode(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every row, without special tokens; null and empty texts both give an empty list.

    One row comes out for each row in, repeated keys included; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for batch in batches:
            done = 0
            for part in _slices(batch, 1):
                ids = pa.array([e.ids for e in tok.encode_batch_fast(part, add_special_tokens=False)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), ids], [key, "ids"])
                done += len(part)

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, keys: list[str], text: str, path: str = VOCABULARY) -> DataFrame:
    """(keys..., n_tokens bigint) of every row; null and empty texts have 0 tokens. Ids never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for batch in batches:
            n = [len(e.ids) for part in _slices(batch, len(keys)) for e in tok.encode_batch_fast(part, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*keys, "n_tokens"])

    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*(F.col(k) for k in keys), F.col(text).alias("__text")).mapInArrow(run, f"{head}, n_tokens bigint")


def token_spans(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, token_no, token_id, begin_pos, end_pos) of every token; positions are code points of the text.

    Tokens that hold parts of one character all carry that character's span. Null and empty texts give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for batch in batches:
            done = 0
            for part in _slices(batch, 1):
                rows, no, ids, begin, end = [], [], [], [], []
                for i, e in enumerate(tok.encode_batch(part, add_special_tokens=False)):
                    rows += [done + i] * len(e.ids)
                    no += range(len(e.ids))
                    ids += e.ids
                    begin += [a for a, _ in e.offsets]
                    end += [b for _, b in e.offsets]
                done += len(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), pa.array(ids, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], [key, "token_no", "token_id", "begin_pos", "end_pos"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, token_no int, token_id int, begin_pos bigint, end_pos bigint")


def decode(df: DataFrame, key: str, ids: str, path: str = VOCABULARY) -> DataFrame:
    """(key, text) from lists of ids; a null list gives null, an empty one an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_one(x, path) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(ids).alias("__ids")).mapInArrow(run, f"`{key}` {kind}, text string")
