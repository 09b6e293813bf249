"""Joins and rankings whose keys may be hot.

A key counts as hot when it holds more than ``1 / HOT_KEYS`` of the rows, so at most ``HOT_KEYS`` keys can be hot,
whatever the data: that bound is what allows their list to be collected and broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut

#: At most this many keys can be hot.
HOT_KEYS = 1024
#: Groups below this many rows are never treated as hot.
HOT_FLOOR = 20_000


def hot_keys(df: DataFrame, keys: list[str]) -> list[tuple]:
    """(key values..., rows) of the keys with more than 1/HOT_KEYS of all rows and more than HOT_FLOOR rows.

    The result has at most HOT_KEYS rows. Null keys are never returned. An empty table gives an empty list.
    """
    counts = df.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    big = counts.where(F.col("__rows") > HOT_FLOOR)
    total = big.agg(F.sum("__rows")).first()[0]
    if not total:
        return []
    # a floor alone is no bound; the share of all rows is
    share = df.count() / HOT_KEYS
    return [tuple(r) for r in big.where(F.col("__rows") > share).collect()]


def hot_of_counts(counts: DataFrame, key: str, rows: str) -> list:
    """The keys of a table of counts (each key once) with more than 1/HOT_KEYS of all rows and more than HOT_FLOOR rows: as
    ``hot_keys``, where the counts are there anyway. At most HOT_KEYS values."""
    total = counts.agg(F.sum(rows)).first()[0] or 0
    if total <= HOT_FLOOR:
        return []
    big = counts.where(F.col(key).isNotNull() & (F.col(rows) > max(HOT_FLOOR, total / HOT_KEYS)))
    return [r[0] for r in big.select(key).collect()]


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """Equi-join of a large ``left`` with ``right`` on one key that may be hot in ``left``.

    ``right`` holds each key once. Rows of ``left`` with a hot key meet a broadcast of the at most HOT_KEYS matching
    rows of ``right``; all other rows take an ordinary shuffled join. Rows with a null key match nothing
    (``how`` is inner or left). ``hot`` gives the hot keys, at most HOT_KEYS, where they are known (an empty list: none);
    else ``left`` is counted.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    if hot is None:
        hot = [k for k, _ in hot_keys(left, [key])]
    if len(hot) > HOT_KEYS:
        raise ValueError("too many hot keys")
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    cold_left = left.where(~is_hot | F.col(key).isNull()) if how == "left" else left.where(~is_hot)
    cold = cold_left.join(right.where(~is_hot), key, how)
    warm = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return cold.unionByName(warm)


def rank_in_groups(df: DataFrame, group: str, order: list, out: str = "rank") -> DataFrame:
    """Number the rows of every group by ``order`` from 1 without bringing a group into one task.

    Rows are range-partitioned by (group, order), numbered inside each partition, and shifted by the number of the
    group's rows in earlier partitions: only (partition, group) counts are shuffled. ``order`` must be total for a
    repeatable result. Null groups form one group. An empty table gives an empty table.
    """
    spread = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    numbered = cut(spread.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.expr("__at >> 33")))
    # one row for each partition and group that meet: a group spans many partitions only if it has many rows
    starts = numbered.groupBy("__part", group).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    starts = starts.select(F.col("__part").alias("__p"), F.col(group).alias("__g"), "__first", "__before")
    joined = numbered.join(starts, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")))
    return joined.withColumn(out, F.expr("__at - __first + __before + 1")).drop("__at", "__part", "__p", "__g", "__first", "__before")
