"""Rows for training on conversations: labels, samples, batches, splits, and pairs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import let, stripped
from quarry.operators.tokens import IGNORED, uniform
from quarry.session import ship

#: What stands around a turn: fixed values.
BEGIN, END = "<|im_start|>", "<|im_end|>"


def labelled(messages: Column, encode: Callable[[Column], Column], learn: str = "assistant") -> Column:
    """The tokens of a conversation as an array of (token, label), from its turns (role, content, train).

    A turn is its begin mark, its role and a line end, its content and its end mark; line ends stand between turns. Labels are IGNORED but for
    the content and end mark of turns that are learned, unless their train is false. Each part is encoded by itself; null content is empty.
    """

    def part(text: Column, learned: Column) -> Column:
        return F.transform(encode(text), lambda t: F.struct(t.alias("token"), F.when(learned, t).otherwise(IGNORED).alias("label")))

    def turn(m: Column, i: Column) -> Column:
        own = (m["role"] == learn) & F.coalesce(m["train"], F.lit(True))
        never = F.lit(False)
        between = F.when(i < F.size(messages) - 1, part(F.lit("\n"), never)).otherwise(F.array().cast("array<struct<token:int,label:int>>"))
        return F.concat(part(F.lit(BEGIN), never), part(F.concat(m["role"], F.lit("\n")), never), part(F.coalesce(m["content"], F.lit("")), own), part(F.lit(END), own), between)

    return F.flatten(F.transform(messages, turn))


def samples(rows: DataFrame, most: int, overlong: str = "tail_truncate", pairs: str = "pairs", least: int = 4) -> DataFrame:
    """(…, input_ids, labels): tokens without the last and labels without the first, of rows whose pairs are labelled().

    Rows of fewer than `least` inputs go; longer ones than `most` keep their end, or go if overlong is drop; those without a label go.
    """
    if overlong not in ("tail_truncate", "drop"):
        raise ValueError(f"overlong can't be {overlong}")
    n = F.size(pairs) - 1
    cut = F.greatest(F.lit(0), n - most)
    ids = F.slice(F.transform(pairs, lambda x: x["token"]), cut + 1, n - cut)
    labels = F.slice(F.transform(pairs, lambda x: x["label"]), cut + 2, n - cut)
    kept = rows.where((n >= least) & ((n <= most) | F.lit(overlong == "tail_truncate")))
    return kept.withColumn("input_ids", ids).withColumn("labels", labels).drop(pairs).where(F.exists("labels", lambda x: x != IGNORED))


def mask_statistics(rows: DataFrame) -> DataFrame:
    """One row on samples (labels): how many, tokens, learned ones, their share, and samples whose learned part is under a tenth."""
    learned = F.size(F.filter("labels", lambda x: x != IGNORED))
    own = rows.select(F.size("labels").alias("n"), learned.alias("learned"))
    return own.agg(
        F.count("*").alias("samples"), F.sum("n").alias("tokens"), F.sum("learned").alias("learned"),
        F.round(F.sum("learned") / F.greatest(F.lit(1), F.sum("n")), 6).alias("share"), F.count_if(F.col("learned") * 10 < F.col("n")).alias("sparse"),
    )


def length_grouped(rows: DataFrame, key: str, length: str, group: int, seed: int = 0, buckets: int = 1024) -> DataFrame:
    """rows with place: a seeded order cut into groups, each of them longest first, so that neighbours are alike in length.

    Places before a row are those of the digest's buckets before its own, `buckets` at most, and a running number inside the bucket, so no task
    has all rows. Ties in length keep the seeded order.
    """
    digest = F.md5(F.concat_ws(":", F.lit(f"order {seed}"), F.col(key).cast("string")))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * buckets / (1 << 32)
    own = rows.withColumns({"_digest": digest, "_bucket": F.floor(bucket)})
    totals = own.groupBy("_bucket").agg(F.count("*").alias("n"))
    before = totals.select("_bucket", (F.sum("n").over(Window.orderBy("_bucket")) - F.col("n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", key)) - 1
    numbered = own.withColumn("_inside", inside).join(F.broadcast(before), "_bucket").withColumn("_rank", F.col("_before") + F.col("_inside"))
    numbered = numbered.withColumn("_group", F.floor(F.col("_rank") / group))
    in_group = F.row_number().over(Window.partitionBy("_group").orderBy(F.desc(length), "_rank")) - 1
    return numbered.withColumn("place", (F.col("_group") * group + in_group).cast("long")).drop("_digest", "_bucket", "_before", "_inside", "_rank", "_group")


def budget_batches(rows: DataFrame, length: str, place: str, budget: int, multiple: int = 1, group: int = 2048) -> DataFrame:
    """rows with group and batch: whole rows in the order of place, a batch as wide as its longest row, rounded up, and no more than budget in all.

    Batches begin anew with every `group` places, so that groups are formed apart from each other; the number of a batch counts inside its group.
    A row that does not fit alone is an error.
    """
    ship(rows.sparkSession)
    padded = F.ceil(F.col(length) / multiple).cast("long") * multiple
    checked = F.when(padded > budget, F.raise_error(F.lit("a row is longer than the budget")).cast("long")).otherwise(padded)
    own = rows.withColumn("group", F.floor(F.col(place) / group).cast("long")).withColumn("_width", checked)

    def run(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(place, kind="stable")
        batch, width, count, out = 0, 0, 0, []
        for own_width in held["_width"].tolist():
            wide = max(width, own_width)
            if count and wide * (count + 1) > budget:
                batch, wide, count = batch + 1, own_width, 0
            out.append(batch)
            width, count = wide, count + 1
        return held.assign(batch=pd.Series(out, index=held.index, dtype="int64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", batch long"
    return own.groupBy("group").applyInPandas(run, schema).drop("_width")


def collated(rows: DataFrame, by: tuple[str, ...], multiple: int = 1, pad: int = 0) -> DataFrame:
    """rows (input_ids, labels) filled up to the longest of their batch, rounded up to a multiple: inputs by pad, labels by IGNORED."""
    longest = rows.groupBy(*by).agg((F.ceil(F.max(F.size("input_ids")) / multiple) * multiple).cast("int").alias("width"))
    fill = lambda a, x: F.concat(F.col(a), F.array_repeat(F.lit(x), F.col("width") - F.size(a)))
    return rows.join(longest, list(by)).withColumns({"input_ids": fill("input_ids", pad), "labels": fill("labels", IGNORED)})


def held_out(rows: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """rows with val, true for about this share of the keys: rows of one key, such as the questions of a case, stay together."""
    return rows.withColumn("val", uniform(F.lit(f"split {seed}"), F.coalesce(F.col(key).cast("string"), F.lit(""))) < share)


def tail_split(rows: DataFrame, order: str, share: float, first: bool = False) -> DataFrame:
    """rows with val, true for the last share of them by order, or the first; at least one if there are two. Only the edge is looked for, not a total order."""
    n = rows.count()
    held = 0 if n < 2 else max(1, int(n * share))
    edge = rows.select(order).orderBy(F.col(order) if first else F.desc(order)).limit(held).agg(F.max(order) if first else F.min(order)).first()[0] if held else None
    inside = F.lit(False) if edge is None else (F.col(order) <= F.lit(edge)) if first else (F.col(order) >= F.lit(edge))
    return rows.withColumn("val", inside)


def turn_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, response): each user turn with the assistant turn that follows it."""
    after = Window.partitionBy("conv_id").orderBy("turn")
    own = turns.select("conv_id", "turn", "role", F.col("text").alias("prompt"), F.lead("role").over(after).alias("_next"), F.lead("text").over(after).alias("response"))
    return own.where("role = 'user' and _next = 'assistant'").select("conv_id", "turn", "prompt", "response")


def usable_pairs(pairs: DataFrame, least: int = 10) -> DataFrame:
    """Pairs with a prompt and a response of `least` characters or more, both without white space around them."""
    own = pairs.withColumns({c: stripped(F.coalesce(F.col(c), F.lit(""))) for c in ("prompt", "response")})
    return own.where((F.col("prompt") != "") & (F.length("response") >= least))


def pair_key(prompt: Column, response: Column) -> Column:
    return F.md5(F.lower(F.concat(stripped(prompt), F.lit("|"), stripped(response))).cast("binary"))


def distinct_pairs(pairs: DataFrame, order: list[str]) -> DataFrame:
    """The first pair of each text, without regard to case, and how many there are."""
    first = pairs.select(pair_key(F.col("prompt"), F.col("response")).alias("key"), *order).groupBy("key")
    return first.agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("copies")).select("key", "_first.*", "copies")


def dialogue_key(messages: Column, roles: tuple[str, ...] = ("user", "assistant")) -> Column:
    """A digest of the turns of these roles, without regard to case and white space around them."""
    own = F.filter(messages, lambda m: m["role"].isin(*roles))
    return F.md5(F.array_join(F.transform(own, lambda m: F.lower(stripped(m["content"]))), "|").cast("binary"))


def merged_datasets(datasets: list[DataFrame], key: str, order: str) -> DataFrame:
    """Rows of all datasets with the number of theirs (origin): of one key, the row of the dataset named first, and there the first by order."""
    every = [d.withColumn("origin", F.lit(k)) for k, d in enumerate(datasets)]
    union = every[0]
    for more in every[1:]:
        union = union.unionByName(more)
    rank = F.struct("origin", order)
    best = union.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in union.columns if c != key]), rank).alias("_row"))
    return best.select(key, "_row.*")


def fitting_pairs(pairs: DataFrame, encode: Callable[[Column], Column], most: int, columns: tuple[str, ...] = ("chosen", "rejected")) -> DataFrame:
    """Pairs whose sides each have no more than `most` tokens; null is empty."""
    fits = [F.size(encode(F.coalesce(F.col(c), F.lit("")))) <= most for c in columns]
    return pairs.where(fits[0] & fits[1] if len(fits) == 2 else fits[0])


def winners(tries: DataFrame, record: str, key: str, reward: str, order: str, threshold: float = 1.0, most: int = 2) -> DataFrame:
    """The first `most` different answers of each record whose reward reaches the threshold, in the order they were drawn."""
    good = tries.where(F.col(reward) >= threshold).groupBy(record, key).agg(F.min(order).alias(order))
    return good.withColumn("rank", F.row_number().over(Window.partitionBy(record).orderBy(order))).where(F.col("rank") <= most)


def foreign(rows: DataFrame, batch: str, key: str, group: str) -> DataFrame:
    """(batch, i, j, allowed): for the ordered pairs of different rows of a batch, whether j may count as a wrong answer for i: not if they share a group.

    A batch is of bounded size by definition; null groups are shared with none.
    """
    a, b = (rows.select(F.col(batch).alias("batch"), F.col(key).alias(n), F.col(group).alias(f"_{n}")) for n in "ij")
    met = a.join(b, "batch").where(F.col("i") != F.col("j"))
    return met.select("batch", "i", "j", F.coalesce(F.col("_i") != F.col("_j"), F.lit(True)).alias("allowed"))


def in_batch_accuracy(scores: DataFrame) -> DataFrame:
    """The share of queries whose own answer scores highest in their batch, of (batch, i, j, score, allowed); the own answer has i = j."""
    best = scores.where(F.col("allowed") | (F.col("i") == F.col("j"))).groupBy("batch", "i").agg(F.max_by("j", F.struct("score", -F.col("j"))).alias("found"))
    return best.agg(F.count("*").alias("queries"), F.round(F.avg((F.col("found") == F.col("i")).cast("double")), 6).alias("accuracy"))


def first_difference(a: Column, b: Column) -> Column:
    """Where two texts first differ, from 0; null if they are equal or one is null. Halves are compared and the one that differs is kept, so work is in proportion to the texts."""
    rest = F.lit(2147483647)

    def half(acc: Column, k: Column) -> Column:
        n = F.call_function("shiftleft", F.lit(1), k)
        x, y = (F.left(acc[c], n) for c in "ab")
        on = F.struct((acc["at"] + n).alias("at"), F.substring(acc["a"], n + 1, rest).alias("a"), F.substring(acc["b"], n + 1, rest).alias("b"))
        return F.when(x == y, on).otherwise(F.struct(acc["at"].alias("at"), x.alias("a"), y.alias("b")))

    def found(both: Column) -> Column:
        bits = F.length(F.bin(F.greatest(F.length(both["a"]), F.length(both["b"]))))
        start = F.struct(F.lit(0).alias("at"), both["a"].alias("a"), both["b"].alias("b"))
        return F.when(both["a"] != both["b"], F.aggregate(F.sequence(bits - 1, F.lit(0), F.lit(-1)), start, half, lambda acc: acc["at"]))

    return let(F.struct(a.alias("a"), b.alias("b")), found)
