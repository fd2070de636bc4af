"""Token windows: segments of documents, best-fit packing, a permuted order, mixtures of folders, and windows of token arrays."""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import let
from quarry.session import ship

#: The label of a position that is not learned: a fixed value.
IGNORED = -100


def segments(docs: DataFrame, size: int, tails: str = "keep") -> DataFrame:
    """(…, start, length) of the pieces of documents with n_tokens: size + 1 tokens each, stepping size; pieces of one token are left out.

    tails: keep has all pieces, drop the first only, end one piece that ends with the document.
    """
    n = F.col("n_tokens")
    if tails == "keep":
        count = F.when(n <= size + 1, F.lit(1)).otherwise(F.ceil((n - 1) / size))
        cut = docs.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1))).withColumn("start", F.col("_j") * size).drop("_j")
    elif tails == "drop":
        cut = docs.withColumn("start", F.lit(0).cast("long"))
    elif tails == "end":
        cut = docs.withColumn("start", F.greatest(F.lit(0), n - (size + 1)).cast("long"))
    else:
        raise ValueError(f"tails can't be {tails}")
    return cut.withColumn("length", F.least(F.lit(size + 1), n - F.col("start")).cast("long")).where("length >= 2")


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """The window of each item: longest first, each into the fullest window that has room, the first of equals, else a new one.

    For each amount of room there is a heap of the windows that have just that much; a number whose bit r says whether one has room r
    gives the least room that is enough.
    """
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count, out = 0, 0, [0] * len(lengths)
    for k in np.argsort(-np.asarray(lengths, np.int64), kind="stable").tolist():
        n = lengths[k]
        if n > capacity:
            raise ValueError(f"an item of {n} does not fit a window of {capacity}")
        if enough := rooms >> n:
            room = n + (enough & -enough).bit_length() - 1
            out[k] = heapq.heappop(waiting[room])
            if not waiting[room]:
                rooms ^= 1 << room
        else:
            room, out[k], count = capacity, count, count + 1
        if left := room - n:
            heapq.heappush(waiting[left], out[k])
            rooms |= 1 << left
    return out


def packed(pieces: DataFrame, capacity: int, shard: str = "shard_ix", order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """pieces with window_ix, by best fit within each shard; shards are independent and must be of bounded size."""
    ship(pieces.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order), kind="stable")
        return rows.assign(window_ix=np.array(best_fit(rows["length"].tolist(), capacity), np.int64))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", window_ix long"
    return pieces.groupBy(shard).applyInPandas(run, schema)


def packing_statistics(pieces: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """One row on packed pieces (doc_id, start, length, shard_ix, window_ix) of docs (doc_id, n_tokens): documents and how many are cut, windows, padding, and tokens that no window holds."""
    own = docs.agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.count_if(F.col("n_tokens") > size + 1).alias("cut"))
    windows = pieces.groupBy("shard_ix", "window_ix").agg(F.sum("length").alias("held")).agg(F.count("*").alias("windows"), F.coalesce(F.sum("held"), F.lit(0)).alias("held"))
    away = pieces.agg(F.coalesce(F.sum(F.when(F.col("start") > 0, F.col("length") - 1)), F.lit(0)).alias("away"))
    share = lambda a, b: F.round(a / F.greatest(F.lit(1), b), 6)
    return own.crossJoin(windows).crossJoin(away).select(  # three single rows
        "docs", "windows", share(F.col("cut"), F.col("docs")).alias("cut_share"), share(F.col("windows") * (size + 1) - F.col("held"), F.col("windows") * (size + 1)).alias("padding_share"),
        share(F.col("away"), F.col("tokens")).alias("no_start_share"),
    )


#: Rounds of the permutation, and the most bits of its range, so that products stay in a long.
ROUNDS, WIDEST = 3, 41


def round_keys(key: int) -> list[tuple[int, int]]:
    """For each round an odd factor of 21 bits and an addend of 40, from a digest of the key."""
    digest = hashlib.sha256(f"permutation {key}".encode()).digest()
    cut = [int.from_bytes(digest[10 * r : 10 * r + 10], "big") for r in range(ROUNDS)]
    return [((x >> 40) % (1 << 21) | 1, x % (1 << 40)) for x in cut]


def permuted(i: Column, n: Column | int, key: int, steps: int = 64) -> Column:
    """The place of i in a shuffled range(n), by arithmetic alone: a function of i, n and key, so any part of the pass can be resumed.

    Numbers of as many bits as n - 1 has are multiplied by odd numbers, added to and folded on themselves, each of which can be undone.
    What falls outside the range goes the same way again; as at least half of the numbers are inside, 64 steps leave one in 2^64 to an
    error. Null gives null; an i outside the range is an error.
    """
    n = F.lit(n).cast("long") if isinstance(n, int) else n.cast("long")
    bits = F.when(n <= 2, F.lit(1)).otherwise(F.length(F.bin(n - 1)))
    mask, fold = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1, F.floor((bits + 1) / 2).cast("int")

    def once(x: Column) -> Column:
        for factor, addend in round_keys(key):
            x = let(((x * factor) + F.lit(addend)).bitwiseAND(mask), lambda y: y.bitwiseXOR(F.call_function("shiftright", y, fold)))
        return x

    found = F.aggregate(F.sequence(F.lit(2), F.lit(steps)), once(i.cast("long")), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    wrong = (i < 0) | (i >= n) | (bits > WIDEST)
    return F.when(i.isNull(), F.lit(None).cast("long")).when(wrong, F.raise_error(F.lit("not in the range of the permutation")).cast("long")).otherwise(
        let(found, lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("too few steps of the permutation")).cast("long")))
    )


def permutation(windows: DataFrame, column: str, n: int, key: int) -> DataFrame:
    """windows with position, the place in range(n) of each window in a shuffled pass; a null window has none, one outside range(n) is an error."""
    return windows.withColumn("position", permuted(F.col(column), n, key))


def interleaved(quotas: DataFrame, name: str = "name", quota: str = "quota") -> DataFrame:
    """(position, name, local): the samples of a block, each folder's spread evenly over it; position counts from 0, local within the folder.

    The k-th of q samples stands at (k - 1/2) / q of the block; ties go to the first name. quotas has a row for each folder, so a block is small.
    """
    each = quotas.select(name, quota, F.explode(F.sequence(F.lit(1).cast("long"), F.col(quota).cast("long"))).alias("_k"))
    place = Window.orderBy((F.col("_k") * 2 - 1) / (F.col(quota) * 2), name)
    return each.select((F.row_number().over(place) - 1).cast("long").alias("position"), F.col(name).alias("name"), (F.col("_k") - 1).alias("local"))


def located(samples: DataFrame, block: DataFrame, quotas: DataFrame, bases: DataFrame, size: int, since: int = 0) -> DataFrame:
    """(k, name, sample): the folder of each sample number k and the sample's number inside the folder.

    block is interleaved(), quotas (name, quota), bases (name, base): what each folder had given when these weights began, at sample
    `since`. A k before that is an error.
    """
    r = F.col("k") - since
    early = F.when(r < 0, F.raise_error(F.lit("a sample before these weights began")).cast("long")).otherwise(r)
    cut = samples.select("k", early.alias("_r")).select("k", F.expr(f"_r div {size}").alias("_b"), F.pmod("_r", F.lit(size)).alias("position"))
    known = block.join(quotas.select("name", "quota"), "name").join(bases, "name")
    return cut.join(known, "position").select("k", "name", (F.col("base") + F.col("_b") * F.col("quota") + F.col("local")).cast("long").alias("sample"))


def given(quotas: DataFrame, bases: DataFrame, block: DataFrame, size: int, k: int, since: int = 0) -> DataFrame:
    """(name, base): what each folder has given after k samples, so that new weights go on from there."""
    whole, rest = divmod(k - since, size)
    part = block.where(F.col("position") < rest).groupBy("name").agg(F.count("*").alias("_more"))
    own = quotas.select("name", "quota").join(bases, "name").join(part, "name", "left")
    return own.select("name", (F.col("base") + F.col("quota") * whole + F.coalesce("_more", F.lit(0))).cast("long").alias("base"))


def estimated(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def code_points(text: Column) -> Column:
    """The code points of a text as an array of ints: the plainest token ids, for rows that need no vocabulary."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def windows(shards: DataFrame, size: int, tokens: str = "tokens") -> DataFrame:
    """(…, window_ix, ids): the (n - 1) // size windows of size + 1 tokens, stepping size; the last token of one is the first target of the next."""
    count = F.floor((F.size(tokens) - 1) / size).cast("int")
    cut = shards.where(count > 0).withColumn("window_ix", F.explode(F.sequence(F.lit(0), count - 1)))
    return cut.withColumn("ids", F.slice(tokens, F.col("window_ix") * size + 1, size + 1)).drop(tokens)


def shifted(ids: Column) -> tuple[Column, Column]:
    """Inputs and targets of a window."""
    return F.slice(ids, 1, F.size(ids) - 1), F.slice(ids, 2, F.size(ids) - 1)


def document_numbers(ids: Column, begin: int) -> Column:
    """How many begin marks stand up to each position. Marks split the array, and each run takes its number, so nothing is summed one by one."""
    at = F.filter(F.transform(ids, lambda t, i: F.when(t == begin, i)), lambda i: i.isNotNull())
    edges = lambda a: F.concat(F.array(F.lit(0)), a, F.array(F.size(ids)))
    return let(edges(at), lambda e: F.flatten(F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda k: F.array_repeat(k - 1, F.element_at(e, k + 1) - F.element_at(e, k)))))


def assembled(pieces: DataFrame, size: int, pad: int) -> DataFrame:
    """(shard_ix, window_ix, ids, segment, labels) of packed pieces with their ids: size + 1 tokens, the piece of each, and targets.

    Pieces stand in the order of doc_id and start; padding after them is a piece of its own. A target across the edge of a piece, or in
    the padding, is IGNORED.
    """
    own = F.sort_array(F.collect_list(F.struct("doc_id", "start", "ids")))
    held = pieces.groupBy("shard_ix", "window_ix").agg(own.alias("own"))
    flat = F.flatten(F.transform("own", lambda x: x["ids"]))
    part = F.flatten(F.transform("own", lambda x, k: F.array_repeat(k, F.size(x["ids"]))))
    fill = lambda a, x: F.concat(a, F.array_repeat(x, size + 1 - F.size(a)))
    whole = held.select("shard_ix", "window_ix", fill(flat, F.lit(pad)).alias("ids"), fill(part, F.size("own")).alias("segment"), F.size("own").alias("_n"))
    target = F.transform(
        F.sequence(F.lit(1), F.lit(size)),
        lambda t: F.when((F.element_at("segment", t) == F.element_at("segment", t + 1)) & (F.element_at("segment", t) < F.col("_n")), F.element_at("ids", t + 1)).otherwise(IGNORED),
    )
    return whole.select("shard_ix", "window_ix", "ids", "segment", target.alias("labels"))


def cumulative(shards: DataFrame, count: str, order: str) -> DataFrame:
    """shards with first and last, the half-open range of window numbers each has: few rows, one for each shard."""
    running = F.sum(count).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return shards.withColumn("last", running.cast("long")).withColumn("first", (F.col("last") - F.col(count)).cast("long"))


def placed(samples: DataFrame, ranges: DataFrame, position: str = "position") -> DataFrame:
    """samples with the shard whose range holds their position, and the window inside it.

    An equi-join on cells of the least range, not on the range itself: every range is put into the cells it touches, a sample into its one.
    """
    width = F.greatest(F.floor(F.avg(F.col("last") - F.col("first"))), F.lit(1)).cast("long")
    cell = ranges.agg(F.coalesce(width, F.lit(1)).alias("c")).first()["c"]
    known = ranges.where("first < last").withColumn("_cell", F.explode(F.sequence(F.expr(f"first div {cell}"), F.expr(f"(last - 1) div {cell}"))))
    met = samples.withColumn("_cell", F.expr(f"{position} div {cell}")).join(known, "_cell")
    return met.where((F.col(position) >= F.col("first")) & (F.col(position) < F.col("last"))).withColumn("window_in_shard", F.col(position) - F.col("first")).drop("_cell")


def uniform(*parts: Column) -> Column:
    """A number from 0 to 1, below 1, by the MD5 of the parts: the same wherever and whenever it is asked for."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("double") / float(1 << 48)


def random_windows(samples: DataFrame, shards: DataFrame, size: int, seed: int) -> DataFrame:
    """(k, shard_ix, offset): for each sample a shard by its share of all tokens, and an offset in it, of shards (shard_ix, n_tokens) that are long enough."""
    ranges = cumulative(shards.where(F.col("n_tokens") > size + 1), "n_tokens", "shard_ix")
    total = ranges.agg(F.max("last")).first()[0]
    if total is None:
        raise ValueError("no shard is long enough")
    drawn = samples.withColumn("position", F.floor(uniform(F.lit(f"shard {seed}"), F.col("k")) * total).cast("long"))
    offset = F.floor(uniform(F.lit(f"offset {seed}"), F.col("k")) * (F.col("n_tokens") - size - 1)).cast("long")
    return placed(drawn, ranges).select("k", "shard_ix", offset.alias("offset"))


def split_of(shards: DataFrame, order: str, listed: list[int] | None = None, none: bool = False, share: float = 0.01) -> DataFrame:
    """shards with split: those listed are val; without a list, the last `share` of them, one at least, of more than one; or none is. One row for each shard."""
    if none:
        return shards.withColumn("split", F.lit("train"))
    if listed:
        return shards.withColumn("split", F.when(F.col(order).isin(*listed), "val").otherwise("train"))
    n = F.count("*").over(Window.partitionBy())
    held = F.when(n > 1, F.greatest(F.lit(1), F.bround(n * share).cast("int"))).otherwise(0)
    return shards.withColumn("split", F.when(F.row_number().over(Window.orderBy(F.desc(order))) <= held, "val").otherwise("train"))


def validation_plan(windows: DataFrame, order: str, first: int, world: int, batch: int, folder: str = "folder") -> DataFrame:
    """The first windows of each folder, dealt over ranks by their number and batched there: (folder, …, ix, rank, batch_ix)."""
    numbered = windows.withColumn("ix", F.row_number().over(Window.partitionBy(folder).orderBy(order)) - 1).where(F.col("ix") < first)
    return numbered.withColumn("rank", F.col("ix") % world).withColumn("batch_ix", F.floor(F.floor(F.col("ix") / world) / batch).cast("int"))


def text_slices(text: Column, most: int) -> Column:
    """A text in slices of `most` characters; an empty one has none."""
    return F.transform(F.when(F.length(text) > 0, F.sequence(F.lit(0), F.floor((F.length(text) - 1) / most).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i * most + 1, F.lit(most)))


def shares(files: DataFrame, size: str, budget: int, step: int) -> DataFrame:
    """files with budget: of a total, to each by its size, in whole steps; half steps go up, every file gets one step at least, none more than its size."""
    part = F.col(size) / F.sum(size).over(Window.partitionBy()) * budget
    return files.withColumn("budget", F.least(F.col(size), F.greatest(F.lit(1), F.floor(part / step + 0.5)) * step).cast("long"))


def merge_weights(n: int, method: str = "mean") -> list[float]:
    """Weights of n snapshots, oldest first, whose sum is one: all equal, or falling as a 1 - sqrt cooldown does."""
    if method == "mean":
        return [1 / n] * n
    if method != "1sqrt":
        raise ValueError(f"method can't be {method}")
    edges = [math.sqrt(k / n) for k in range(n + 1)]
    return [b - a for a, b in zip(edges, edges[1:], strict=False)]
