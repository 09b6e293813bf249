"""One ranking from several differently scaled scores, by closeness to an ideal point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.skew import hot_of_counts, join_hot, rank_in_groups
from lodestone.session import cut

#: Quantiles beyond which scores are drawn in.
WINSOR = (0.05, 0.95)
#: Candidates of each group, the best by closeness, that are first compared with all of their group.
FIRST = 8
#: Candidates that are compared in one task.
CHUNK = 512


def _clean(df: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    known = lambda s: F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double") + F.lit(0.0))
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull())
    return rows.groupBy(group, item).agg(*(F.max(known(s)).alias(s) for s in scores))


def ideal_point_ranking(df: DataFrame, group: str, item: str, scores: list[str], weights: list[float] | None = None) -> DataFrame:
    """(group, item, scores..., closeness, rank) of every candidate.

    Scores are winsorised at the 5 % and 95 % quantiles of their group, divided by the group's vector norm and weighted
    (equally by default); the quantiles are exact, values of the group itself at the ranks ceil(p n) of a distributed sort;
    closeness is d- / (d+ + d-), of the distances to the best and the worst point, rounded to nine decimals; the order is closeness descending, then item ascending. A null or NaN score counts as the group's
    worst; a score that is missing or equal in a whole group has no say; all candidates being equal have closeness 0.
    Rows with a null group or item do not count; a candidate that comes repeatedly has its highest scores. All
    statistics are partial aggregates and hot groups are joined by broadcast and ranked over many tasks.
    """
    weights = weights or [1 / len(scores)] * len(scores)
    if len(weights) != len(scores) or min(weights) < 0:
        raise ValueError("one weight of 0 or more for each score")
    rows = cut(_clean(df, group, item, scores))
    hot = hot_of_counts(rows.groupBy(group).agg(F.count(F.lit(1)).alias("__rows")), group, "__rows")
    held = join_hot(rows, _quantiles(rows, group, scores), group, "left", hot)
    for i, s in enumerate(scores):
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        held = held.withColumn(f"__w{i}", F.coalesce(F.least(F.greatest(F.col(s), lo), hi), lo))
    held = held.drop(*(f"__{e}{i}" for i in range(len(scores)) for e in ("lo", "hi")))
    ends = held.groupBy(group).agg(*(x for i in range(len(scores)) for x in (F.max(f"__w{i}").alias(f"__hi{i}"), F.min(f"__w{i}").alias(f"__lo{i}"), F.sqrt(F.sum(F.col(f"__w{i}") * F.col(f"__w{i}"))).alias(f"__norm{i}"))))
    held = join_hot(held, ends, group, hot=hot)

    def distance(to: str) -> Column:
        parts = [F.coalesce(F.lit(w) * (F.col(f"__w{i}") - F.col(f"__{to}{i}")) / F.when(F.col(f"__norm{i}") > 0, F.col(f"__norm{i}")), F.lit(0.0)) for i, w in enumerate(weights)]
        total = parts[0] * parts[0]
        for p in parts[1:]:
            total = total + p * p
        return F.sqrt(total)

    held = held.withColumn("__near", distance("lo")).withColumn("__far", distance("hi"))
    closeness = F.coalesce(F.col("__near") / F.when(F.col("__near") + F.col("__far") > 0, F.col("__near") + F.col("__far")), F.lit(0.0))
    out = held.select(group, item, *scores, F.round(closeness, 9).alias("closeness"))
    return rank_in_groups(out, group, [F.desc("closeness"), F.asc(item)])


def _quantiles(rows: DataFrame, group: str, scores: list[str]) -> DataFrame:
    """(group, __lo0, __hi0, ...): the WINSOR quantiles of every score, over its values that are there."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(s).alias("v")) for i, s in enumerate(scores)))).alias("x")
    # group and score in one key, so that one sort serves all scores
    long = rows.select(F.col(group).alias("g"), each).where("x.v is not null").select(F.struct("g", "x.i").alias("k"), "x.v")
    ranked = rank_in_groups(long, "k", [F.asc("v")])
    sizes = ranked.groupBy("k").agg(F.max("rank").alias("n"))
    ends = [F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)) for p in WINSOR]
    # two rows for each group and score meet the ranked ones
    wanted = sizes.select("k", F.explode(F.array(*(F.struct(F.lit(j).alias("j"), e.cast("bigint").alias("rank")) for j, e in enumerate(ends)))).alias("w")).select("k", "w.j", "w.rank")
    found = wanted.join(ranked, ["k", "rank"])
    cells = [F.max(F.when((F.col("k.i") == i) & (F.col("j") == j), F.col("v"))).alias(f"__{e}{i}") for i in range(len(scores)) for j, e in enumerate(("lo", "hi"))]
    return found.groupBy(F.col("k.g").alias(group)).agg(*cells)


def _wins(a: str, b: str, scores: list[str]) -> str:
    """SQL: in how many scores a is higher than b; a missing score is higher than nothing and lower than any number."""
    return " + ".join(f"int({a}.`{s}` is not null and ({b}.`{s}` is null or {a}.`{s}` > {b}.`{s}`))" for s in scores)


def majority_winner(ranking: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """(group, item) of the candidate that is higher than each other one of its group in more than half of the scores.

    The ranking proposes: its FIRST best of every group are compared with all candidates of the group, and where one of
    them holds it is the winner, for there is one at most. Groups where none holds meet their candidates in the order of
    the ranking, in chunks of CHUNK neighbours: each chunk keeps the one that was last to win, which a winner always is,
    and the chunks' candidates meet in the next pass; the one left is compared with all of its group. A group may have no
    winner; a lone candidate wins.
    """
    rows = cut(ranking.select(group, item, *scores, F.col("rank").cast("bigint").alias("__pos")))
    best = rows.where(F.col("__pos") <= FIRST).groupBy(group).agg(F.collect_list(F.struct("__pos", item, *scores)).alias("__best"))
    proposed = cut(_holding(rows, best, group, item, scores))
    rest = rows.join(proposed.select(F.col(group).alias("__won")), F.col(group) == F.col("__won"), "left_anti").where(F.col(group).isNotNull())
    last = _eliminated(rest, group, item, scores)
    return proposed.unionByName(_holding(rest, last, group, item, scores))


def _holding(rows: DataFrame, best: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """Of the proposed candidates (``best``: group, __best array of structs, at most FIRST), those that all of their group
    bear out: (group, item). Compared in the tasks; one bit of each proposal travels."""
    need = len(scores) // 2 + 1
    met = join_hot(rows.withColumn("__x", F.struct(item, *scores)), best, group)
    lost = F.expr(f"transform(__best, b -> int(not (b.`{item}` = __x.`{item}` or {_wins('b', '__x', scores)} >= {need})))")
    # a proposal is out where any candidate bears against it: the bits are or-ed
    bits = F.aggregate(F.transform(lost, lambda x, i: F.call_function("shiftleft", x, i)), F.lit(0), lambda a, x: a.bitwiseOR(x))
    out = met.select(group, bits.alias("__lost")).groupBy(group).agg(F.bit_or("__lost").alias("__lost"))
    kept = best.join(out, group).select(group, "__lost", F.posexplode("__best").alias("__i", "__b"))
    return kept.where("(shiftright(__lost, __i) & 1) = 0").select(group, F.col("__b")[item].alias(item))


def _eliminated(rows: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """(group, __best): the one candidate of every group, if any, that elimination in the order of __pos leaves."""
    need = len(scores) // 2 + 1
    pack = F.struct("__pos", item, *scores)
    left, most = rows, rows.agg(F.max("__pos")).first()[0] or 0
    kind = "struct<__pos:bigint," + f"`{item}`:{rows.schema[item].dataType.simpleString()}," + ",".join(f"`{s}`:double" for s in scores) + ">"
    while True:
        chunks = left.groupBy(group, F.floor((F.col("__pos") - 1) / CHUNK).alias("__chunk")).agg(F.array_sort(F.collect_list(pack)).alias("__all"))
        fold = f"aggregate(__all, cast(null as {kind}), (a, x) -> case when a is null or {_wins('x', 'a', scores)} >= {need} then x when {_wins('a', 'x', scores)} >= {need} then a else null end)"
        left = chunks.withColumn("__w", F.expr(fold)).where("__w is not null").select(group, "__w.*", (F.col("__chunk") + 1).alias("__no"))
        left = left.withColumn("__pos", F.col("__no")).drop("__no")
        if most <= CHUNK:
            return left.select(group, F.array(F.struct("__pos", item, *scores)).alias("__best"))
        most = -(-most // CHUNK)
