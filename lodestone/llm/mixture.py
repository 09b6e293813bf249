"""Mixing sources to target weights by exact budget fitting over document lengths."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.tokenizer import VOCABULARY, token_counts
from lodestone.llm.topn import top_n_per_group
from lodestone.session import cut

#: Tokens that the dynamic programme fills at least; the rest of a budget is taken in proportion over all lengths.
GAP = 1 << 16
#: So many of the longest documents find room in the programme at once; it is as wide as they are.
ROOM = 4
#: Where the sum is missed, the programme is widened by 4 again and again while it has no more tokens than this (5 bytes
#: each): beyond, the nearest sum below is taken.
WIDEST = 1 << 26


def source_name(source: F.Column) -> F.Column:
    """Spellings of one source made equal: trimmed, lower case, hyphens and blanks as underscores. Null stays null."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[-\s]+", "_")


def share_budgets(total: int, targets: list[tuple[str, float, int]], have: dict[str, int]) -> dict[str, int]:
    """Tokens for each source: its share of ``total``, at most what it has times its cap; what small sources cannot give
    goes to the others in proportion to their shares, until nothing is left or all are exhausted."""
    most = {s: have.get(s, 0) * r for s, _, r in targets}
    budgets = {s: 0 for s, _, _ in targets}
    open_ = {s: share for s, share, _ in targets if most[s] > 0 and share > 0}
    rest = total
    while open_:
        weight = sum(open_.values())
        full = {s for s, share in open_.items() if most[s] <= rest * share / weight}
        if not full:
            for s, share in open_.items():
                budgets[s] = int(rest * share / weight)
            break
        for s in full:
            budgets[s] = most[s]
            rest -= most[s]
            del open_[s]
    return budgets


def reachable_total(targets: list[tuple[str, float, int]], have: dict[str, int], reach: float = 0.9) -> int:
    """The largest total at which sources with ``reach`` of all weight can give their whole share of it; where they
    cannot at any total, the most that the best stocked sources can give theirs of."""
    most = sorted(((have.get(s, 0) * r / share, share) for s, share, r in targets if share > 0 and have.get(s, 0)), reverse=True)
    weight, goal, total = 0.0, reach * sum(share for _, share, _ in targets), 0.0
    for total, share in most:
        weight += share
        if weight >= goal - 1e-9:
            break
    return int(total)


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, gap: int = GAP, seed: int = 0) -> np.ndarray:
    """How many documents of each length to take so that their tokens reach ``budget`` or the nearest sum below.

    The bulk is taken in equal proportion from all lengths, long ones first, so that the proportion of the others makes up
    for how these fell; fractions of a document are rounded by ``seed``. The last ``gap`` tokens, or as many as ROOM of the
    longest documents have, are filled exactly by a bounded-knapsack programme over the remaining documents in seeded order
    (each length's stock split into powers of two). Where these cannot make up the sum, the programme takes a wider part of
    the budget, up to WIDEST tokens or the whole. All counts are divided by the lengths' greatest common divisor.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    unit = int(np.gcd.reduce(lengths[counts > 0]))
    lengths, budget, total = lengths // unit, budget // unit, total // unit
    gap = max(gap // unit, ROOM * int(lengths[counts > 0].max()), 1)
    while True:
        take = _fit(lengths, counts, budget, gap, np.random.default_rng(seed))
        if gap >= budget or 4 * gap > WIDEST or int((take * lengths).sum()) == budget:
            return take
        gap *= 4


def _fit(lengths: np.ndarray, counts: np.ndarray, budget: int, gap: int, rng: np.random.Generator) -> np.ndarray:
    take, left, total = np.zeros_like(counts), budget, int((lengths * counts).sum())
    for part in (lengths > gap // 8, lengths <= gap // 8):
        have = int((lengths * counts)[part].sum())
        # what the parts not yet taken from hold: their proportion is one
        bulk = max(0, left - gap // 2)
        _rounded(lengths, counts, np.flatnonzero(part), bulk, total, take, rng)
        left = budget - int((take * lengths).sum())
        total -= have
    spare = rng.permutation(np.repeat(np.arange(len(counts)), np.minimum(counts - take, 1 + max(left, 0) // np.maximum(1, lengths)))) if left > gap or left < 0 else []
    for i in spare:
        if left <= gap:
            break
        if lengths[i] <= left - gap // 2 and take[i] < counts[i]:
            take[i] += 1
            left -= int(lengths[i])
    for i in rng.permutation(np.repeat(np.arange(len(counts)), take)) if left < 0 else []:
        if left >= 0:
            break
        take[i] -= 1
        left += int(lengths[i])
    fitted = _filled(lengths, counts, take, left, gap, rng)
    if budget <= gap and int((fitted * lengths).sum()) < budget:  # the programme can hold the whole of it
        return _filled(lengths, counts, np.zeros_like(counts), budget, gap, rng)
    return fitted


def _rounded(lengths: np.ndarray, counts: np.ndarray, where: np.ndarray, bulk: int, total: int, take: np.ndarray, rng: np.random.Generator) -> None:
    """Sets ``take`` at ``where`` to counts * bulk / total, rounded so that each expects its exact proportion: fractions
    are carried along the lengths, sorted but shuffled in runs of 16, so that the sum of tokens strays little."""
    where = where[np.argsort(-lengths[where], kind="stable")]
    order = [i for at in range(0, len(where), 16) for i in rng.permutation(where[at : at + 16]).tolist()]
    # integers of any size: budgets may exceed 2^53
    carry = int(rng.integers(0, 1 << 62)) * total >> 62
    for i in order:
        take[i], rest = divmod(int(counts[i]) * min(bulk, total), max(1, total))
        carry += rest
        if carry >= total:
            carry -= total
            take[i] += take[i] < counts[i]


def _filled(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, left: int, gap: int, rng: np.random.Generator) -> np.ndarray:
    take = take.copy()
    cap = max(0, min(left, max(gap, 1)))
    first = np.full(cap + 1, -1, np.int32)
    reach = np.zeros(cap + 1, bool)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for i in rng.permutation(len(lengths)):
        stock, size = int(min(counts[i] - take[i], cap // max(1, lengths[i]))), 1
        while stock > 0 and not reach[cap]:
            n = min(size, stock)
            step = n * int(lengths[i])
            if step <= cap:
                fresh = np.flatnonzero(reach[: cap + 1 - step] & ~reach[step:]) + step
                first[fresh] = len(items)
                reach[fresh] = True
                items.append((int(i), n))
            stock -= n
            size *= 2
        if reach[cap]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at > 0:
        i, n = items[first[at]]
        take[i] += n
        at -= n * int(lengths[i])
    return take


def mix_sources(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, reach: float = 0.9, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mix (source, doc_id, n_tokens, uses) and the report (one row for each source of ``targets``).

    ``docs`` has doc_id (unique), text and source, ``targets`` has source, target_share and max_repeats. Sizes are tokens
    of the public tokenizer; ``total_tokens`` is by default the largest total at which sources with ``reach`` of the weight
    reach their share: a larger mix would be further from the targets, a smaller one would waste documents. A source
    whose documents, each used ``max_repeats`` times, fall short of its share gives all it can, and the others fill the
    total in proportion to their shares. Every document is used k or k + 1 times, k being equal within a source; which
    ones are used once more is decided by seeded budget fitting on exact lengths and then by a seeded hash. Documents with a null
    id, null or unknown source, or without tokens have no place in the mix; sources without documents are reported with
    share 0. Of repeated target rows of one source the one with the largest share holds. ``targets`` is a configuration
    table: it is read on the driver, and more than 10,000 sources raise an error.
    """
    spark = docs.sparkSession
    wanted = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("s"), F.col("max_repeats").cast("int").alias("r")).where("source is not null and s is not null and r >= 1")
    goal = [tuple(x) for x in wanted.groupBy("source").agg(F.max(F.struct("s", "r")).alias("x")).select("source", "x.s", "x.r").orderBy("source").limit(10_001).collect()]
    if len(goal) > 10_000:
        raise ValueError("more than 10,000 sources")
    goal_df = spark.createDataFrame(goal, "source string, target_share double, max_repeats int")
    sized = docs.select("doc_id", source_name(F.col("source")).alias("source"), "text").where("doc_id is not null and source is not null and text is not null")
    sized = token_counts(sized.join(F.broadcast(goal_df.select("source")), "source").select("doc_id", "source", "text"), ["doc_id", "source"], "text", path)
    sized = cut(sized.where("n_tokens > 0"))

    lengths = sized.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("docs"))
    have = {s: int(t) for s, t in lengths.groupBy("source").agg(F.sum(F.expr("docs * n_tokens"))).collect()}
    total = reachable_total(goal, have, reach) if total_tokens is None else int(total_tokens)
    budgets = share_budgets(total, goal, have)
    plan = []
    for s, share, repeats in goal:
        k = min(repeats, budgets[s] // have[s]) if have.get(s) else 0
        plan.append((s, share, repeats, budgets[s], k, budgets[s] - k * have.get(s, 0) if k < repeats else 0))
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, target_share double, max_repeats int, budget bigint, full_uses int, rest bigint"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens")
        n = fit_budget(pdf["n_tokens"].to_numpy(), pdf["docs"].to_numpy(), int(pdf["rest"].iloc[0]), seed=zlib.crc32(f"{seed} {pdf['source'].iloc[0]}".encode()))
        return pd.DataFrame({"source": pdf["source"], "n_tokens": pdf["n_tokens"], "n": n})

    # a group is a histogram: one row for each distinct length of a source, however many documents there are
    quota = cut(lengths.join(plan_df, "source").groupBy("source").applyInPandas(fit, "source string, n_tokens bigint, n bigint").where("n > 0"))
    drawn = sized.withColumn("__luck", F.xxhash64(F.lit(seed), "doc_id").cast("double"))
    chosen = top_n_per_group(drawn, ["source", "n_tokens"], "doc_id", "__luck", quota=quota).select("doc_id", F.lit(1).alias("__once"))
    uses = sized.join(plan_df, "source").join(chosen, "doc_id", "left").withColumn("uses", F.col("full_uses") + F.coalesce("__once", F.lit(0)))
    mix = cut(uses.where("uses > 0").select("source", "doc_id", "n_tokens", "uses"))

    got = mix.groupBy("source").agg(F.count(F.lit(1)).alias("used_documents"), F.sum(F.expr("n_tokens * uses")).alias("mix_tokens"), F.max("uses").alias("most_uses"))
    there = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"))
    report = plan_df.join(there, "source", "left").join(got, "source", "left").fillna(0, ["documents", "tokens", "used_documents", "mix_tokens", "most_uses"])
    whole = F.sum("mix_tokens").over(Window.partitionBy())  # as many rows as there are sources
    report = report.select("source", "target_share", "max_repeats", "documents", "tokens", "budget", "used_documents", "most_uses", "mix_tokens", F.coalesce(F.round(F.col("mix_tokens") / F.when(whole > 0, whole), 6), F.lit(0.0)).alias("actual_share"))
    return mix, report
