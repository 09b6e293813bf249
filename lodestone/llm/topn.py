"""Top N items within every group, by simultaneous per-group bisection.

The order is score descending, then item ascending. A row's code has 128 bits: the order-preserving 64 of its score, then
its identifier. For every group an interval of codes that holds the cut-off is kept; in each round all groups are refined
at once by counting rows above the midpoints that divide the interval, until the rows above the cut-off number exactly N.
Several midpoints are counted in one pass: 2^b - 1 midpoints do the work of b halvings, with 4 to 8 bits in the first pass
and 8 in later ones, so that no scores, however spread, need more than 17 passes; intervals shrink to the codes that are
there, so few are needed.

No group is ever brought into one task: rows stay spread by (group, salt), hot groups over many salts, and only
(group, sub-interval) counts travel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.skew import HOT_FLOOR, HOT_KEYS
from lodestone.session import cut, ensure_shared_dir, shuffle_partitions

#: Bits of the code that one pass settles at most.
MAX_BITS = 8
MAX_LONG = 2**63 - 1


def _salted(rows: DataFrame, group: list[str]) -> tuple[DataFrame, list[tuple]]:
    """Rows with ``__salt``, 0 except in hot groups; the hot groups with their number of salts (at most HOT_KEYS)."""
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT_FLOOR)
    counts = cut(counts)
    total = rows.count() if not counts.isEmpty() else 0
    share = max(HOT_FLOOR, total / HOT_KEYS)
    hot = [(*r[:-1], int(r[-1] // share) + 1) for r in counts.where(F.col("__n") > share).collect()]
    if not hot:
        return rows.withColumn("__salt", F.lit(0)), []
    hot_df = F.broadcast(rows.sparkSession.createDataFrame(hot, _hot_schema(rows, group)))
    rows = rows.join(hot_df, group, "left")
    return rows.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64("__item"), F.col("__salts")), F.lit(0)).cast("int")).drop("__salts"), hot


def _hot_schema(rows: DataFrame, group: list[str]) -> str:
    return ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in group) + ", __salts int"


def _to_salts(state: DataFrame, group: list[str], hot: list[tuple]) -> DataFrame:
    """Repeat the state of a hot group for each of its salts."""
    if not hot:
        return state.withColumn("__salt", F.lit(0))
    hot_df = F.broadcast(state.sparkSession.createDataFrame(hot, _hot_schema(state, group)))
    state = state.join(hot_df, group, "left")
    return state.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))).drop("__salts")


def order_code(score: F.Column) -> F.Column:
    """The bits of a double as a bigint in the same order: the IEEE code of the absolute value, negative for a negative
    score. Exact: powers of two and quotients by them are. 0.0 and -0.0 are both 0."""
    size = F.abs(score)
    power = lambda e: F.pow(F.lit(2.0), e)
    # the logarithm may be off by one next to a power of two
    e = F.floor(F.log2(size)).cast("int")
    e = F.when(size < power(e), e - 1).when(size >= power(F.least(e + 1, F.lit(1023))), F.when(e < 1023, e + 1).otherwise(e)).otherwise(e)
    mantissa = (size / power(e) - 1) * F.lit(2.0**52)
    code = (
        F.when(size == float("inf"), F.lit(2047 << 52))
        .when(size < F.lit(2.0**-1022), (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint"))
        .otherwise((e + 1023).cast("bigint") * F.lit(1 << 52) + mantissa.cast("bigint"))
    )
    return F.when(score < 0, -code).otherwise(code)


def _shifted(code: str, lo: str, hi: str) -> F.Column:
    """Which of the 2^__bits parts of the interval [lo, hi] of codes a code lies in: the leading bits in which lo and hi
    differ. Integers only, so nothing can overflow or divide by zero."""
    flip = F.lit(-(2**63))  # makes the order of signed numbers that of their bits
    width = F.length(F.bin(F.expr(f"{lo} ^ {hi}")))
    shift = F.greatest(width - F.col("__bits"), F.lit(0))
    # Spark's shift functions take the distance of each row
    moved = F.call_function("shiftrightunsigned", F.col(code).bitwiseXOR(flip), shift)
    return moved.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("__bits")) - 1)


def _piece() -> F.Column:
    """Number of the part of a row, the best one being 0."""
    last = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("__bits")) - 1
    by_score = last - _shifted("__code", "__lo", "__hi")
    return F.when(F.col("__lo") < F.col("__hi"), by_score).otherwise(_shifted("__item", "__ilo", "__ihi")).cast("int")


def _first_bits(count: str, need: str) -> F.Column:
    """Bits of the first pass: parts about twice the rows over the rows wanted, between 16 and 2^MAX_BITS."""
    return F.least(F.lit(MAX_BITS), F.greatest(F.lit(4), F.ceil(F.log2(2.0 * F.col(count) / F.col(need))))).cast("int")


def top_n_per_group(
    df: DataFrame, group: list[str], item: str, score: str, n: int = 10, quota: DataFrame | None = None
) -> DataFrame:
    """The ``n`` rows of every group with the highest score, ties to the smaller item: columns group..., item, score.

    ``item`` is a bigint, ``score`` a number. Rows with a null group value, null item, or a null or NaN score do not
    count; an item counts once per group, with its highest score. Groups with fewer than ``n`` items give them all; an
    empty table gives an empty table; other columns of ``df`` are left out, whatever their names. ``quota`` (group...,
    n bigint) gives each group its own number instead; groups without a quota, or with one below 1, give nothing.
    """
    if n < 1:
        raise ValueError("n must be positive")
    spark = df.sparkSession
    ensure_shared_dir(spark)
    names = [f"__g{i}" for i in range(len(group))]
    rows = df.select(*(F.col(g).alias(k) for g, k in zip(group, names)), F.col(item).cast("bigint").alias("__item"), (F.col(score).cast("double") + F.lit(0.0)).alias("__score"))
    rows = rows.where(" and ".join(f"{k} is not null" for k in [*names, "__item", "__score"]) + " and not isnan(__score)")
    rows, hot = _salted(rows, names)
    parts = shuffle_partitions(spark)
    keys = [*names, "__salt"]
    base = rows.repartition(parts, *keys).groupBy(*keys, "__item").agg(F.max("__score").alias("__score"))
    base = base.withColumn("__code", order_code(F.col("__score"))).persist()

    state = base.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"), F.min("__code").alias("__lo"), F.max("__code").alias("__hi"), F.min("__item").alias("__ilo"), F.max("__item").alias("__ihi"))
    if quota is None:
        state = state.withColumn("__need", F.lit(n).cast("bigint"))
    else:
        want = quota.select(*(F.col(g).alias(k) for g, k in zip(group, names)), F.col("n").cast("bigint").alias("__need")).where("__need >= 1")
        state = state.join(want, names)
    state = cut(state.withColumn("__bits", _first_bits("__n", "__need")))

    # a group is settled when its whole interval is wanted: the cut-off is then the interval's lower end
    settled = [state.where("__n <= __need")]
    open_groups = state.where("__n > __need")
    live = base.select(*keys, "__item", "__code")
    held = None
    while not open_groups.isEmpty():
        within = live.join(_to_salts(open_groups, names, hot).hint("shuffle_hash"), keys)
        within = within.where("__code >= __lo and __code <= __hi and (__lo < __hi or (__item >= __ilo and __item <= __ihi))")
        kept = within.select(*keys, "__item", "__code").persist()
        counted = within.withColumn("__piece", _piece()).groupBy(*names, "__need", "__piece").agg(F.count(F.lit(1)).alias("__n"), F.min("__code").alias("__lo"), F.max("__code").alias("__hi"), F.min("__item").alias("__ilo"), F.max("__item").alias("__ihi"))
        # at most 2^MAX_BITS rows of a group meet here
        upto = F.sum("__n").over(Window.partitionBy(*names).orderBy("__piece").rowsBetween(Window.unboundedPreceding, 0))
        cross = counted.withColumn("__upto", upto).where("__upto >= __need and __upto - __n < __need")
        cross = cross.withColumn("__need", F.expr("__need - (__upto - __n)")).withColumn("__bits", F.lit(MAX_BITS))
        state = cut(cross.select(*state.columns))
        if held is not None:
            held.unpersist()
        live = held = kept
        settled.append(state.where("__n <= __need"))
        open_groups = state.where("__n > __need")
    if held is not None:
        held.unpersist()

    ends = settled[0]
    for s in settled[1:]:
        ends = ends.unionByName(s)
    # an interval of one score ends at its last item, one of several takes its lowest score whole
    ends = ends.select(*names, F.col("__lo").alias("__cs"), F.when(F.col("__lo") < F.col("__hi"), F.lit(MAX_LONG)).otherwise(F.col("__ihi")).alias("__ci"))
    out = base.join(_to_salts(ends, names, hot).hint("shuffle_hash"), keys)
    out = out.where("__code > __cs or (__code = __cs and __item <= __ci)")
    # the result is small beside the rows: written once, it lets go of them
    out = cut(out.select(*(F.col(k).alias(g) for g, k in zip(group, names)), F.col("__item").alias(item), F.col("__score").alias(score)))
    base.unpersist()
    return out
