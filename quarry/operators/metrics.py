"""Metrics of recorded outcomes: retrieval, decisions, groups, pairs, mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval(ranks: DataFrame, rank: str = "rank") -> DataFrame:
    """One row of recall at 1, 5 and 10, MRR at 10 and nDCG at 10 over the 1-based rank of each query's one right answer; null is not found."""
    near = F.col(rank) <= 10
    recall = [F.avg(F.coalesce(F.col(rank) <= k, F.lit(False)).cast("double")).alias(f"recall_{k}") for k in (1, 5, 10)]
    gain = lambda x: F.avg(F.when(near, x).otherwise(0.0))
    return ranks.agg(F.count("*").alias("n"), *recall, gain(1 / F.col(rank)).alias("mrr"), gain(1 / F.log2(F.col(rank) + 1)).alias("ndcg"))


def _harmonic(m: Column) -> Column:
    """The sum of 1/k for k up to m, to about 10 digits, less Euler's constant."""
    far = m + 20.0
    tail = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0.0), lambda s, k: s + 1 / (m + k))
    return F.log(far) + 1 / (2 * far) - 1 / (12 * far * far) + 1 / (120 * F.pow(far, F.lit(4))) - tail


def decisions(cases: DataFrame, by: str, bins: int = 15) -> DataFrame:
    """Accuracy, calibration error, signed gap and area under the risk-coverage curve for each value of `by` and, with it null, for all.

    cases has confidence (0 to 1) and correct (boolean). Bins are half open, (lo, hi], the first closed. Cases of equal
    confidence have no order, so their errors count as spread evenly among them; that needs the counts of distinct confidences alone.
    """
    counted = cases.groupBy(by, "confidence").agg(F.count("*").alias("n"), F.count_if("correct").alias("right"))
    points = counted.groupingSets([[F.col(by), F.col("confidence")], [F.col("confidence")]], F.col(by), F.col("confidence")).agg(
        F.sum("n").alias("n"), F.sum("right").alias("right"), F.grouping(by).alias("whole")
    )
    before = Window.partitionBy("whole", by).orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, -1)
    seen, failed = (F.coalesce(F.sum(x).over(before), F.lit(0)) for x in (F.col("n"), F.col("n") - F.col("right")))
    points = points.withColumns({"seen": seen, "failed": failed})
    wrong = F.col("n") - F.col("right")
    risk = wrong + (F.col("failed") - wrong / F.col("n") * F.col("seen")) * (_harmonic(F.col("seen") + F.col("n")) - _harmonic(F.col("seen")))
    bin_ix = F.greatest(F.ceil(F.col("confidence") * bins), F.lit(1))
    sure = F.col("n") * F.col("confidence")
    points = points.select("whole", by, bin_ix.alias("bin"), "n", "right", sure.alias("sure"), risk.alias("risk"))
    binned = points.groupBy("whole", by, "bin").agg(*[F.sum(c).alias(c) for c in ("n", "right", "sure", "risk")])
    total = F.sum("n")
    return binned.groupBy("whole", by).agg(
        total.alias("cases"),
        (F.sum("right") / total).alias("accuracy"),
        (F.sum(F.abs(F.col("sure") - F.col("right"))) / total).alias("ece"),
        ((F.sum("sure") - F.sum("right")) / total).alias("signed_gap"),
        (F.sum("risk") / total).alias("aurc"),
    ).drop("whole")


def advantages(rewards: DataFrame, group: str, reward: str, eps: float = 1e-4) -> DataFrame:
    """(reward - mean) / (sample deviation + eps) within each group; groups of one row or of equal rewards give none.

    Groups are aggregated before the join, so a large one is never gathered.
    """
    own = rewards.groupBy(group).agg(F.avg(reward).alias("_mean"), F.stddev_samp(reward).alias("_sd"), F.min(reward).alias("_lo"), F.max(reward).alias("_hi"))
    joined = rewards.join(own.where("_lo < _hi"), group)
    return joined.withColumn("advantage", (F.col(reward) - F.col("_mean")) / (F.col("_sd") + eps)).drop("_mean", "_sd", "_lo", "_hi")


def paired(runs: DataFrame, left: str, right: str) -> DataFrame:
    """Of (variant, seed, value): mean difference left - right over common seeds, its sample deviation, paired t, and how many are positive."""
    sides = [runs.where(F.col("variant") == v).select("seed", F.col("value").alias(n)) for v, n in ((left, "a"), (right, "b"))]
    d = sides[0].join(sides[1], "seed").select((F.col("a") - F.col("b")).alias("d"))
    t = F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*")))
    return d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), t.alias("t"), F.count_if(F.col("d") > 0).alias("positive"))


def bits_per_byte(rows: DataFrame, nats: str = "nats", text: str = "text") -> DataFrame:
    """All nats in bits, to all bytes of the texts."""
    return rows.agg((F.sum(nats) / F.log(F.lit(2.0)) / F.sum(F.octet_length(text))).alias("bits_per_byte"))


def flops_penalty(terms: DataFrame, rows: int) -> DataFrame:
    """Sum over terms of the squared mean weight, of sparse vectors as (id, term, weight)."""
    return terms.groupBy("term").agg((F.sum("weight") / rows).alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("penalty"))


def quotas(weights: DataFrame, name: str, weight: str, block: int = 10_000) -> DataFrame:
    """(name, quota): the largest-remainder share of each name in a block; ties go to the first name, and a name without any is an error. One row for each name, so weights are few."""
    total = F.sum(weight).over(Window.partitionBy())
    raw = weights.select(name, (F.col(weight) / total * block).alias("raw")).select("*", F.floor("raw").alias("q"))
    left = F.lit(block) - F.sum("q").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("raw") - F.col("q"), 9)), name))
    own = raw.select(name, (F.col("q") + F.when(place <= left, 1).otherwise(0)).alias("quota"))
    return own.select(name, F.when(F.col("quota") > 0, F.col("quota")).otherwise(F.raise_error(F.lit("a weight is too small for the block")).cast("long")).alias("quota"))


def choices(options: DataFrame) -> DataFrame:
    """Accuracy of the option with the highest log probability, whole and for each character, of (item, option, logp, chars, gold); ties go to the lowest option."""
    best = [F.max_by("option", F.struct(score, -F.col("option"))).alias(name) for score, name in ((F.col("logp"), "whole"), (F.col("logp") / F.col("chars"), "per_char"))]
    items = options.groupBy("item").agg(*best, F.first("gold", ignorenulls=True).alias("gold"))
    right = [F.avg(F.coalesce(F.col(c) == F.col("gold"), F.lit(False)).cast("double")).alias(c) for c in ("whole", "per_char")]
    return items.agg(F.count("*").alias("n"), *right)


def preferences(pairs: DataFrame) -> DataFrame:
    """Accuracy and margin of (batch, chosen, rejected) log probabilities: means within batches, then over batches."""
    won, margin = (F.col("chosen") > F.col("rejected")).cast("double"), F.col("chosen") - F.col("rejected")
    by = pairs.groupBy("batch").agg(F.avg(won).alias("accuracy"), F.avg(margin).alias("margin"))
    return by.agg(F.avg("accuracy").alias("accuracy"), F.avg("margin").alias("margin"))
