"""Replaying a query log through one least-recently-used cache, in batch and as a stream.

What the cache holds at any place of the log are the ``capacity`` keys that came last before it. So parts of the log can be
replayed side by side: each task is first told the keys that came last in the parts before its own.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import query_key
from lodestone.session import cut


class LRUCache:
    """At most ``capacity`` entries; a hit makes an entry the newest, the oldest one gives way."""

    def __init__(self, capacity: int) -> None:
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.capacity, self.entries = capacity, OrderedDict()

    def get(self, key):
        if key not in self.entries:
            return None
        self.entries.move_to_end(key)
        return self.entries[key]

    def put(self, key, value) -> None:
        self.entries[key] = value
        self.entries.move_to_end(key)
        if len(self.entries) > self.capacity:
            self.entries.popitem(last=False)


def replay(log: DataFrame, order: str, query: str = "query", capacity: int = 1000) -> DataFrame:
    """(order, key, cached): for every row of the log whether its cleaned query is in the cache when it comes.

    Null queries have an empty key. ``order`` should be total; rows of equal order come in the order of their keys. The log
    is range-partitioned by its order; of every part only the ``capacity`` keys that came last travel, and one task joins
    them along the parts, holding ``capacity`` keys. Exact: the same as one cache that sees all rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = log.schema[order].dataType.simpleString()
    key = F.coalesce(query_key(F.col(query)), F.lit(""))
    rows = log.select(F.col(order).alias("__order"), key.alias("key"))
    rows = cut(rows.repartitionByRange("__order", "key").sortWithinPartitions("__order", "key").withColumn("part", F.spark_partition_id()).withColumn("no", F.monotonically_increasing_id()))

    def last_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part = LRUCache(capacity), None
        for b in batches:
            for p, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = p
                cache.put(k, True)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([list(cache.entries)], pa.list_(pa.string()))], ["part", "keys"])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = LRUCache(capacity)
        for b in batches:
            for p, keys in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = len(cache.entries)
                yield pa.RecordBatch.from_arrays([pa.array([p] * n, pa.int32()), pa.array(list(cache.entries), pa.string()), pa.array(range(n), pa.int64())], ["part", "key", "no"])
                for k in keys:
                    cache.put(k, True)

    tails = rows.select("part", "key").mapInArrow(last_keys, "part int, keys array<string>")
    # one row of at most ``capacity`` keys for each part of the log
    states = tails.coalesce(1).sortWithinPartitions("part").mapInArrow(along, "part int, key string, no bigint")
    told = states.select("part", F.lit(0).alias("turn"), "no", "key", F.lit(None).cast(kind).alias("__order"))
    both = told.unionByName(rows.select("part", F.lit(1).alias("turn"), "no", "key", "__order")).repartition("part").sortWithinPartitions("part", "turn", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, at = LRUCache(capacity), None
        for b in batches:
            turn = b.column(1).to_pylist()
            cached = []
            for p, t, k in zip(b.column(0).to_pylist(), turn, b.column(3).to_pylist()):
                if p != at:
                    cache, at = LRUCache(capacity), p
                cached.append(cache.get(k) is not None)
                cache.put(k, True)
            out = pa.RecordBatch.from_arrays([b.column(4), b.column(3), pa.array(cached, pa.bool_())], [order, "key", "cached"])
            yield out.filter(pa.array([t == 1 for t in turn], pa.bool_()))

    return both.mapInArrow(run, f"`{order}` {kind}, key string, cached boolean")


def replay_stream(log: DataFrame, query: str = "query", capacity: int = 1000, shards: int = 1) -> DataFrame:
    """(key, cached) of a streaming log: the state is the keys from the oldest to the newest.

    With one shard (the default) it is one cache that sees the rows of each micro-batch in their order. More shards, by the
    hash of the key, are answered side by side, each with its part of ``capacity``, which must be at least ``shards``: then the
    cache is no longer one, and its hits may differ."""
    if capacity < shards:
        raise ValueError("a shard needs room for one entry")
    each = capacity // shards
    rows = log.select(F.coalesce(query_key(F.col(query)), F.lit("")).alias("key")).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))

    def run(_: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        cache = LRUCache(each)
        for k in state.get[0] if state.exists else []:
            cache.put(k, True)
        for pdf in frames:
            cached = []
            for k in pdf["key"]:
                cached.append(cache.get(k) is not None)
                cache.put(k, True)
            yield pd.DataFrame({"key": pdf["key"], "cached": cached})
        state.update((list(cache.entries),))

    return rows.groupBy("shard").applyInPandasWithState(run, "key string, cached boolean", "keys array<string>", "append", "NoTimeout")
