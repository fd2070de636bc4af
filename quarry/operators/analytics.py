"""Figures on corpora, conversations, vocabularies, recorded decisions, programs and runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.text import let
from quarry.session import ship

#: Words by what they tell of a text, words that tell nothing, and marks of legal titles: fixed values.
LEXICONS = {
    "positive": (
        "good great excellent amazing wonderful fantastic love happy joy brilliant perfect best beautiful awesome pleasant kind helpful positive success agree correct "
        "right sure yes absolutely certainly glad thank please appreciate impressive outstanding remarkable"
    ),
    "negative": (
        "bad terrible awful horrible hate sad angry wrong fail failure worst ugly poor negative disagree error mistake problem unfortunately sorry cannot impossible "
        "difficult danger dangerous risk harm concern warning never no not don't shouldn't"
    ),
    "hedging": (
        "maybe perhaps possibly might could seems appears suggest likely unlikely approximately roughly generally sometimes often usually tend somewhat relatively "
        "arguably potentially presumably apparently allegedly"
    ),
    "authority": (
        "must shall always never definitely certainly clearly obviously undoubtedly absolutely exactly precisely fundamental essential critical crucial important "
        "necessary require mandatory imperative vital"
    ),
}
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from as into through during "
    "before after above below between out off over under again further then once here there when where why how all each every both few more most other some such only own "
    "same so than too very just because but and or if while about up down it its this that these those i me my myself we our ours you your he him his she her they them "
    "their what which who whom not no nor don't didn't won't also like get got make know think well one two even new want use way look first come see need back going "
    "much let really said say go time thing things still"
)
LEGAL_MARKS = ("regulation", "regolamento", "directive", "direttiva", "legal")
#: What metadata leave in generated text, and common Italian words: fixed values.
LEAKS = (r"source:\s*\w+", r"wiki_id:\s*\d+", r"timestamp:\s*\d{4}", r"language:\s*\w{2}", r"categories:\s*", r"(?m)^---\s*$")
ITALIAN = ("il", "la", "di", "che", "è", "per", "in", "un", "una", "non", "sono", "del", "dei")
ACCENTED = "àèéìòùÀÈÉÌÒÙ"
EDGES = ".,;:!?\"'«»()[]{}—–-…"


def front_matter(text: Column) -> tuple[Column, Column]:
    """The keys and values of a block between lines of three hyphens that a text begins with, and how many characters it takes; the last of a key counts."""
    whole = F.regexp_extract(text, r"\A---\s*\n(?s:.*?)\n---\s*\n", 0)
    block = F.regexp_extract(text, r"\A---\s*\n((?s:.*?))\n---\s*\n", 1)
    pair = r"(?m)^(\w+)\s*:\s*(.*)$"
    keys, values = (F.transform(F.regexp_extract_all(block, F.lit(pair), F.lit(k)), tx.stripped) for k in (1, 2))
    entries = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = let(entries, lambda e: F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["k"] == x["k"])))
    return F.map_from_entries(last), F.length(whole)


def source_profile(docs: DataFrame, titles: int = 5) -> DataFrame:
    """For each source: documents, characters, those of metadata and of content, estimated tokens, shares of all, and its first titles. docs: doc_id, source, title, chars, metadata."""
    content = F.col("chars") - F.col("metadata")
    sums = docs.groupBy("source").agg(
        F.count("*").alias("docs"), F.sum("chars").alias("chars"), F.sum("metadata").alias("metadata"), F.sum(content).alias("content"), F.sum(F.greatest(F.lit(1), F.floor(content / 4))).cast("long").alias("tokens")
    )
    first = docs.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where(F.col("_r") <= titles)
    named = first.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", F.coalesce("title", F.lit("")).alias("t")))), lambda x: x["t"]).alias("titles"))
    share = lambda c: F.round(F.col(c) / F.greatest(F.sum(c).over(Window.partitionBy()), F.lit(1)) * 100, 4)  # noqa: E731  a row for each source
    return sums.join(named, "source").withColumns({"doc_share": share("docs"), "token_share": share("tokens"), "metadata_share": F.round(F.col("metadata") / F.greatest("chars", F.lit(1)) * 100, 4)})


def imbalance(profile: DataFrame, chat: str = "chat") -> DataFrame:
    """(finding, source, value) of a source_profile(): over 5 % metadata, a chat source under 10 % of tokens, a source over 70 %, legal texts over 15 %."""
    total = profile.agg(F.sum("tokens").alias("t"), F.sum("chars").alias("c"), F.sum("metadata").alias("m"))
    lacks = F.lit(None).cast("string")
    marked = lambda c: F.rlike(F.lower(c), F.lit("|".join(LEGAL_MARKS)))
    by_title = F.size(F.filter("titles", marked)) * F.floor(F.col("tokens") / F.col("docs"))
    legal = profile.agg(F.sum(F.when(marked(F.col("source")), F.col("tokens")).otherwise(0) + by_title).alias("l"))
    each = profile.crossJoin(F.broadcast(total))  # one row
    share = F.col("tokens") / F.greatest(F.col("t"), F.lit(1)) * 100
    found = [
        total.where("m * 100 > 5 * greatest(c, 1)").select(F.lit("metadata").alias("finding"), lacks.alias("source"), (F.col("m") / F.greatest("c", F.lit(1)) * 100).alias("value")),
        each.where((F.col("source") == chat) & (share < 10) & (F.col("t") > 0)).select(F.lit("little_chat").alias("finding"), "source", share.alias("value")),
        each.where(share > 70).select(F.lit("dominant").alias("finding"), "source", share.alias("value")).orderBy(F.desc("value"), "source").limit(1),
        legal.crossJoin(F.broadcast(total)).where("l > t * 0.15").select(F.lit("legal").alias("finding"), lacks.alias("source"), (F.col("l") / F.greatest("t", F.lit(1)) * 100).alias("value")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumn("value", F.round("value", 4))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0))


def lexicon_ratios(turns: DataFrame) -> DataFrame:
    """For each role, the share of its words that each lexicon holds, to four digits."""
    words = turns.select("role", F.explode(_tokens(F.col("text"))).alias("w")).groupBy("role", "w").agg(F.count("*").alias("n"))
    held = [F.bround(F.sum(F.when(F.col("w").isin(*own.split()), F.col("n")).otherwise(0)) / F.sum("n"), 4).alias(f"{name}_ratio") for name, own in LEXICONS.items()]
    return words.groupBy("role").agg(*held)


def hotspots(turns: DataFrame, n: int = 3, k: int = 15) -> DataFrame:
    """The k most frequent runs of n words of all texts that are not of stop words alone; ties go to the first in the alphabet."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS.split()])
    grams = let(_tokens(F.col("text")), lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.slice(w, i, n))).otherwise(F.array().cast("array<array<string>>")))
    counts = turns.select(F.explode(grams).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    return counts.where(F.size(F.array_except("g", stop)) > 0).select(F.array_join("g", " ").alias("gram"), "n").orderBy(F.desc("n"), "gram").limit(k)


def bias_findings(ratios: DataFrame, shares: DataFrame, diversity: DataFrame) -> DataFrame:
    """(finding, role, value) of lexicon_ratios(), shares (role, share) and diversity (role, diversity): skewed feeling, much hedging or authority, one role over 75 %, uneven diversity. A row for each role, so all are few."""
    skew = F.col("positive_ratio") / F.col("negative_ratio")
    both = ratios.where("positive_ratio > 0 and negative_ratio > 0")
    out = both.where(skew > 3).select(F.lit("positive").alias("finding"), "role", skew.alias("value"))
    out = out.unionByName(both.where(skew < 0.5).select(F.lit("negative").alias("finding"), "role", skew.alias("value")))
    for name in ("hedging", "authority"):
        out = out.unionByName(ratios.where(F.col(f"{name}_ratio") > 0.02).select(F.lit(name).alias("finding"), "role", F.col(f"{name}_ratio").alias("value")))
    most = shares.agg(F.count("*").alias("n"), F.max_by("role", "share").alias("role"), F.max("share").alias("value"))
    out = out.unionByName(most.where("n >= 2 and value > 0.75").select(F.lit("dominance").alias("finding"), "role", "value"))
    ends = diversity.agg(F.count("*").alias("n"), F.min_by("role", "diversity").alias("role"), F.min("diversity").alias("lo"), F.max("diversity").alias("hi"))
    out = out.unionByName(ends.where("n >= 2 and hi > 0 and lo / hi < 0.7").select(F.lit("diversity").alias("finding"), "role", (F.col("lo") / F.col("hi")).alias("value")))
    return out.withColumn("value", F.round("value", 6))


def emission_counts(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """How often each token is given out."""
    return docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def tokenizer_quality(docs: DataFrame, vocabulary: int, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """Bytes and characters for each token, and the share of the vocabulary that is used."""
    sums = docs.agg(F.sum(F.octet_length(text)).alias("b"), F.sum(F.length(text)).alias("c"), F.sum(F.size(tokens)).alias("n"))
    used = emission_counts(docs, tokens).agg(F.count("*").alias("used"))
    share = lambda x, y: F.round(x / F.greatest(y, F.lit(1)), 6)
    return sums.crossJoin(used).select(F.col("n").alias("tokens"), share(F.col("b"), F.col("n")).alias("bytes_per_token"), share(F.col("c"), F.col("n")).alias("chars_per_token"), share(F.col("used"), F.lit(vocabulary)).alias("used_share"))  # single rows


def residues(vocabulary: DataFrame, counts: DataFrame, protected: DataFrame, share: float = 0.00005) -> DataFrame:
    """Tokens of the vocabulary (token) whose counts (token, n) are under a share of all, but for protected ones; none if nothing was given out."""
    least = counts.agg(F.sum("n").alias("_all"))
    seen = vocabulary.join(counts, "token", "left").join(protected, "token", "left_anti").crossJoin(F.broadcast(least))  # one row
    return seen.select("token", F.coalesce("n", F.lit(0)).alias("n"), "_all").where(F.col("n") < F.col("_all") * share).drop("_all")


def pruned_merges(merges: DataFrame, gone: DataFrame) -> DataFrame:
    """Merges (rank, left, right) that do not make one of the tokens in gone (token); what they are made of stays in the vocabulary."""
    return merges.withColumn("token", F.concat("left", "right")).join(gone.select("token"), "token", "left_anti").select("rank", "left", "right")


def leaks(text: Column) -> Column:
    """What metadata leave in a text, in the order of the patterns."""
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in LEAKS]))


def italian_marks(text: Column) -> list[Column]:
    """Whether a text has common Italian words, sentence marks, reasonable case and words with content."""
    words, upper = tx.all_words(F.replace(text, F.lit("İ"), F.lit("i"))), tx.all_upper(text)  # its lower case would be two characters
    return [
        let(words, lambda w: F.exists(w, lambda x: F.lower(x).isin(*ITALIAN))).alias("italian_words"),
        F.rlike(text, F.lit("[.!?;:]")).alias("punctuation"),
        let(words, lambda w: ~upper & (F.size(w) > 3)).alias("casing"),
        let(words, lambda w: F.size(F.filter(w, lambda x: F.length(x) > 3)) > F.size(w) * 0.3).alias("content_words"),
    ]


def suspects(docs: DataFrame, dictionary: DataFrame, around: int = 3) -> DataFrame:
    """(doc_id, place, word, context) of words that no dictionary (word, in lower case) holds, with the words around them.

    Names, abbreviations, words of up to four or from thirty letters, and what is not of letters alone, are not looked up.
    """
    words = docs.select("doc_id", tx.words(F.col("text")).alias("_w")).select("doc_id", "_w", F.posexplode("_w").alias("place", "_raw"))
    own = words.withColumn("word", F.btrim("_raw", F.lit(EDGES)))
    asked = own.where(F.rlike("word", F.lit(r"^\p{L}{5,29}$")) & ~F.rlike("word", F.lit(r"^(?:[A-ZÀ-Ú]{2,}|[A-ZÀ-Ú][a-zà-ú]+)$")))
    context = F.array_join(F.slice("_w", F.greatest(F.col("place") - around, F.lit(0)) + 1, F.least(F.col("place"), F.lit(around)) + around + 1), " ")
    cut = asked.select("doc_id", "place", "word", F.lower("word").alias("_key"), context.alias("context"))
    return cut.join(dictionary.select(F.col("word").alias("_key")), "_key", "left_anti").select("doc_id", "place", "word", "context")


def accents(text: Column) -> list[Column]:
    """How often each accented letter stands in a text, combining marks, and double blanks between words, where a letter may be lost."""
    each = [F.regexp_count(text, F.lit(c)).alias(f"n_{ord(c):x}") for c in ACCENTED]
    return [*each, F.regexp_count(text, F.lit(r"\p{M}")).alias("combining"), F.least(F.lit(10), F.regexp_count(text, F.lit(r"(?U)\w{3,}  \w{3,}"))).alias("gaps")]


def ranked_among_all(vectors: DataFrame, queries: DataFrame, most_queries: int = 100_000) -> DataFrame:
    """(query, rank): where the gold vector of each query stands among all vectors by inner product, from 1; ties go to the smaller id.

    vectors (id, x), queries (query, gold, x). Queries are a stated set of at most most_queries, else it is an error; they go to all tasks, and
    each counts the vectors that are better, so no pairs are listed.
    """
    ship(vectors.sparkSession)
    asked = queries.join(vectors.select(F.col("id").alias("gold"), F.col("x").alias("y")), "gold").limit(most_queries + 1).collect()
    if len(asked) > most_queries:
        raise ValueError("too many queries")
    order = sorted(asked, key=lambda r: r.query)
    matrix = np.array([r.x for r in order], np.float64).reshape(len(order), -1)
    own = np.round(np.array([sum(a * b for a, b in zip(r.x, r.y, strict=True)) for r in order], np.float64), 9)
    gold, names = np.array([r.gold for r in order], np.int64), np.array([r.query for r in order], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        better = np.zeros(len(names), np.int64)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            ids = batch.column("id").to_numpy()
            for low in range(0, len(names), 512):
                cut = slice(low, low + 512)
                scores = np.round(matrix[cut] @ x.T, 9)
                better[cut] += ((scores > own[cut, None]) | ((scores == own[cut, None]) & (ids[None, :] < gold[cut, None]))).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(better)], ["query", "better"])

    return vectors.select("id", "x").mapInArrow(run, "query long, better long").groupBy("query").agg((F.sum("better") + 1).alias("rank"))


def rank_metrics(ranks: DataFrame) -> DataFrame:
    """Recall at 1 and 5, and the mean of all reciprocal ranks."""
    return ranks.agg(F.count("*").alias("queries"), *[F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"recall_{k}") for k in (1, 5)], F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"))


def options_ordered(options: DataFrame) -> DataFrame:
    """(case, question, kind, keys) of options (case, question, kind, key, place): whole numbers of a score in their order, false before true of a noul, others as they stand."""
    number = F.rlike("key", F.lit(r"^-*\d+$"))
    each = F.struct("place", "key", number.alias("n"))
    held = options.groupBy("case", "question", "kind").agg(F.sort_array(F.collect_list(each)).alias("o"))
    keys = F.transform("o", lambda x: x["key"])
    by_number = F.transform(F.sort_array(F.transform("o", lambda x, i: F.struct(x["key"].try_cast("int").alias("v"), i.alias("i"), x["key"].alias("key")))), lambda x: x["key"])
    by_false = F.concat(F.filter(keys, lambda k: k == "false"), F.filter(keys, lambda k: k != "false"))
    scored = (F.col("kind") == "score") & F.forall("o", lambda x: x["n"])
    return held.select("case", "question", "kind", F.when(scored, by_number).when(F.col("kind") == "noul", by_false).otherwise(keys).alias("keys"))


def options_shuffled(keys: Column, case: Column, seed: int) -> Column:
    """The keys in an order by the MD5 of seed, case and key, so that where an option stands tells nothing; of equal keys the first stays first."""
    marked = F.transform(keys, lambda k, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), case.cast("string"), k).cast("binary")).alias("h"), i.alias("i"), k.alias("k")))
    return F.transform(F.array_sort(marked), lambda x: x["k"])


def targets(given: Column, keys: Column, label: Column) -> Column:
    """The share of each key: given ones (a map), or all on the label where given is null, divided by their sum; equal shares if that is 0."""
    raw = F.transform(keys, lambda k: F.when(given.isNotNull(), F.coalesce(F.try_element_at(given, k), F.lit(0.0))).otherwise((k == label).cast("double")))
    total = lambda r: F.aggregate(r, F.lit(0.0), lambda a, b: a + b)
    return let(raw, lambda r: F.when(total(r) > 0, F.transform(r, lambda x: x / total(r))).otherwise(F.transform(r, lambda x: F.lit(1.0) / F.size(r))))


def first_best(shares: Column) -> Column:
    """The place of the highest share, from 0; the first of equals."""
    return (F.array_position(shares, F.array_max(shares)) - 1).cast("int")


def confidence(kind: Column, p: Column) -> Column:
    """How sure a decision is, from 0 to 1: of a choice by its best option, of a score by its mean deviation against an even one, of a noul by its distance from a half."""
    n = F.size(p).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    mean = total(F.transform(p, lambda x, i: x * i))
    even = total(F.transform(p, lambda x, i: F.abs(i - (n - 1) / 2))) / n
    spread = let(mean, lambda m: total(F.transform(p, lambda x, i: x * F.abs(i - m))))
    return F.when(kind == "choice", (F.array_max(p) - 1 / n) / (1 - 1 / n)).when(kind == "score", F.greatest(F.lit(0.0), 1 - spread / even)).otherwise(F.abs(2 * F.element_at(p, 2) - 1))


def losses(cases: DataFrame, by: str) -> DataFrame:
    """For each value of by, and with it null for all: mean log loss and Brier score of (p, target), arrays of shares."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    loss = -total(F.zip_with("p", "target", lambda p, t: t * F.log(F.greatest(p, F.lit(1e-12)))))
    brier = total(F.zip_with("p", "target", lambda p, t: (p - t) * (p - t)))
    own = cases.select(by, loss.alias("l"), brier.alias("b"))
    return own.groupingSets([[F.col(by)], []], F.col(by)).agg(F.count("*").alias("cases"), F.round(F.avg("l"), 6).alias("log_loss"), F.round(F.avg("b"), 6).alias("brier"))


def best_temperature(cases: DataFrame, low: float = 0.05, high: float = 20.0, steps: int = 64, rounds: int = 4) -> float:
    """The temperature whose scaled logits have the least mean log loss against target: a grid in equal ratios, then finer ones around its best point.

    cases has logits and target, arrays of one length; their losses at all points of a grid are summed in one pass, and only the sums come back.
    """
    ship(cases.sparkSession)
    for _ in range(rounds):
        grid = np.geomspace(low, high, steps)

        def summed(batches: Iterator[pa.RecordBatch], grid: np.ndarray = grid) -> Iterator[pa.RecordBatch]:
            held = np.zeros(steps)
            for batch in batches:
                sizes = np.diff(batch.column("logits").offsets.to_numpy())
                for size in np.unique(sizes[sizes > 0]).tolist():
                    own = batch.take(pa.array(np.flatnonzero(sizes == size)))
                    logits, target = (own.column(c).flatten().to_numpy().reshape(-1, size) for c in ("logits", "target"))
                    for k, t in enumerate(grid.tolist()):
                        scaled = logits / t
                        top = scaled.max(axis=1, keepdims=True)
                        held[k] += (target * (np.log(np.exp(scaled - top).sum(axis=1, keepdims=True)) + top - scaled)).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(steps)), pa.array(held)], ["i", "x"])

        sums = cases.select("logits", "target").mapInArrow(summed, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("x", "i").first()
        if sums is None or sums.x == 0:
            return 1.0
        low, high = float(grid[max(0, sums.i - 1)]), float(grid[min(steps - 1, sums.i + 1)])
    return float(np.sqrt(low * high))


def pass_rates(outcomes: DataFrame) -> DataFrame:
    """Of outcomes (problem, test, compiled, passed): the share of problems of which a test compiled, and of which all did and passed."""
    own = outcomes.groupBy("problem").agg(F.bool_or("compiled").alias("c"), F.bool_and(F.col("compiled") & F.col("passed")).alias("p"))
    return own.agg(F.count("*").alias("problems"), F.round(F.avg(F.col("c").cast("double")), 6).alias("compiled"), F.round(F.avg(F.col("p").cast("double")), 6).alias("passed"))


def display_number(text: Column) -> Column:
    """A number as a program displays it: p or y before it makes it negative; null if it is none."""
    own = tx.stripped(text)
    signed = F.rlike(own, F.lit("^[py]"))
    value = F.when(signed, F.substring(own, 2, F.length(own))).otherwise(own).try_cast("double")
    return F.when(signed, -value).otherwise(value)


def typed_equal(kind: Column, got: Column, expected: Column, tolerance: float = 1e-3) -> Column:
    """Whether the lines got (an array) are the expected ones (an array of texts) as values of a kind: Bool, Int, Float, String, or a list of one of the last three.

    Floats may differ by the tolerance, in lists item by item; what cannot be read is not equal.
    """
    base = F.regexp_replace(kind, r"^List\[(.*)\]$", "$1")
    many = F.startswith(kind, F.lit("List["))
    lines = F.when(many, F.slice(got, 1, F.greatest(F.size(expected), F.lit(1)))).otherwise(F.slice(got, 1, 1))

    def same(a: Column, b: Column) -> Column:
        x, y = display_number(a), b.try_cast("double")
        near = F.abs(x - y) <= F.greatest(F.lit(tolerance), 1e-9 * F.greatest(F.abs(x), F.abs(y)))
        whole = F.rlike(F.regexp_replace(tx.stripped(a), "^[py]", ""), F.lit(r"^[+-]?\d+$")) & (x == y)
        return F.when(base == "Float", near).when(base == "Int", whole).when(base == "Bool", (tx.stripped(a) == "1") == (b == "true")).otherwise(tx.stripped(a) == b)

    sized = F.size(lines) == F.size(expected)
    return F.coalesce(sized & F.forall(F.zip_with(lines, expected, same), lambda x: F.coalesce(x, F.lit(False))), F.lit(False))


def energy(samples: DataFrame, device: str, at: str, power: str, counter: str) -> DataFrame:
    """(device, seconds, joules, source): the last counter less the first where both are there, else the area under the power between samples."""
    order = Window.partitionBy(device).orderBy("_t")
    rows = samples.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")))
    step = (F.col("_t") - F.lag("_t").over(order)) / 1e6
    area = F.coalesce((F.col(power) + F.lag(power).over(order)) / 2 * step, F.lit(0.0))
    own = rows.withColumn("_area", area).groupBy(device).agg(
        F.min_by(counter, "_t").alias("a"), F.max_by(counter, "_t").alias("b"), F.sum("_area").alias("s"), ((F.max("_t") - F.min("_t")) / 1e6).alias("seconds")
    )
    counted = F.col("a").isNotNull() & F.col("b").isNotNull()
    return own.select(device, F.round("seconds", 6).alias("seconds"), F.round(F.when(counted, F.col("b") - F.col("a")).otherwise(F.col("s")), 6).alias("joules"), F.when(counted, "counter").otherwise("power").alias("source"))


def extension_counts(files: DataFrame, path: str) -> DataFrame:
    """How many files have each extension, in lower case; none counts as empty."""
    own = F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"\.([A-Za-z0-9]+)$", 1))
    return files.select(own.alias("extension")).groupBy("extension").agg(F.count("*").alias("files"))


def ordered_means(rows: DataFrame, by: tuple[str, ...], value: str, order: str) -> DataFrame:
    """(*by, value): the mean of each group, its values added in the order given.

    Sums of doubles depend on the order, and parts of a group that are added apart would decide by chance which of two equal means is greater.
    Rows are sorted within groups, never gathered.
    """
    own = Window.partitionBy(*by).orderBy(order)
    run = rows.select(*by, value, F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("_sum"), F.row_number().over(own).alias("_place"))
    n = F.count(value)
    return run.groupBy(*by).agg(F.when(n > 0, F.max_by("_sum", "_place") / n).alias(value))


def paired_variants(runs: DataFrame) -> DataFrame:
    """(left, right, n, mean, sd, t, positive) for each two variants, the first name left, over the seeds that both have."""
    a, b = (runs.select(F.col("variant").alias(v), "seed", F.col("value").alias(f"_{v}")) for v in ("left", "right"))
    d = a.join(b, "seed").where("left < right").select("left", "right", (F.col("_left") - F.col("_right")).alias("d"))
    t = F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*")))
    rounded = [F.round(x, 6).alias(n) for x, n in ((F.avg("d"), "mean"), (F.stddev_samp("d"), "sd"), (t, "t"))]
    return d.groupBy("left", "right").agg(F.count("*").alias("n"), *rounded, F.count_if(F.col("d") > 0).alias("positive"))


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, ix): values numbered in the order in which they are first met. Places are counted over ranges of the order, not in one task.

    Values are aggregated first; the count of those before a row is that of the buckets of order before its own, 1,024 at most, and a rank inside.
    """
    firsts = rows.groupBy(value).agg(F.min(order).alias("_o"))
    ends = firsts.agg(F.min("_o").alias("lo"), F.max("_o").alias("hi")).first()
    width = max(1, ((ends.hi or 0) - (ends.lo or 0)) // 1024 + 1)
    cut = firsts.withColumn("_b", F.floor((F.col("_o") - F.lit(ends.lo or 0)) / width))
    totals = cut.groupBy("_b").agg(F.count("*").alias("n"))
    before = totals.select("_b", (F.sum("n").over(Window.orderBy("_b")) - F.col("n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_o")) - 1
    return cut.withColumn("_i", inside).join(F.broadcast(before), "_b").select(value, (F.col("_before") + F.col("_i")).alias("ix"))


def drift(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Of elements (name, ix, x) of two models, for each name that both have: how far apart they are, against the length of the base, and their cosine."""
    both = base.select("name", "ix", F.col("x").alias("a")).join(tuned.select("name", "ix", F.col("x").alias("b")), ["name", "ix"])
    sums = both.groupBy("name").agg(F.count("*").alias("n"), F.sum((F.col("a") - F.col("b")) ** 2).alias("d"), F.sum(F.col("a") ** 2).alias("aa"), F.sum(F.col("b") ** 2).alias("bb"), F.sum(F.col("a") * F.col("b")).alias("ab"))
    relative = F.sqrt("d") / F.greatest(F.sqrt("aa"), F.lit(1e-12))
    return sums.select("name", "n", F.round(relative, 6).alias("relative"), F.round(F.col("ab") / F.greatest(F.sqrt("aa") * F.sqrt("bb"), F.lit(1e-12)), 6).alias("cosine"))


def snapshot_window(snapshots: DataFrame, window: int | None = None, last: int | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """snapshots (name, tokens, terminal) in a window, with place from 0, the oldest first: between start and end, then the last `window` tokens, then the last so many.

    A terminal one counts only if nothing newer is there. Snapshots are few.
    """
    every = Window.partitionBy()
    newest = snapshots.withColumn("_m", F.max("tokens").over(every))
    own = newest.where(~F.coalesce("terminal", F.lit(False)) | (F.col("tokens") == F.col("_m"))).drop("_m")
    if start is not None:
        own = own.where(F.col("tokens") >= start)
    if end is not None:
        own = own.where(F.col("tokens") <= end)
    if window is not None:
        own = own.withColumn("_m", F.max("tokens").over(every)).where(F.col("tokens") > F.col("_m") - window).drop("_m")
    if last is not None:
        own = own.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("tokens"), F.desc("name")))).where(F.col("_r") <= last).drop("_r")
    return own.withColumn("place", F.row_number().over(Window.orderBy("tokens", "name")) - 1)


def out_of_order(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Rows whose value does not exceed that of the row before by order: none if values strictly increase."""
    before = F.lag(value).over(Window.orderBy(order))
    return rows.withColumn("before", before).where(F.col("before").isNotNull() & (F.col(value) <= F.col("before")))


def identity(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Whether all sources agree: for each column how many different digests of it there are, null apart."""
    digest = lambda c: F.sha2(F.coalesce(F.col(c).cast("string"), F.lit("\x00")).cast("binary"), 256)
    return rows.agg(*[F.count_distinct(digest(c)).alias(c) for c in columns])


def index_digest(pieces: DataFrame, by: str, columns: tuple[str, ...]) -> DataFrame:
    """(by, rows, digest): a digest of the rows of each shard that does not depend on their order, to tell whether an index fits its data."""
    own = F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in columns]).cast("binary"), 256)
    half = lambda k: F.conv(F.substring(own, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")
    sums = pieces.groupBy(by).agg(F.count("*").alias("rows"), *[F.sum(half(k)).alias(f"_{k}") for k in range(4)])
    return sums.select(by, "rows", F.sha2(F.concat_ws(":", *[F.col(f"_{k}").cast("string") for k in range(4)]).cast("binary"), 256).alias("digest"))


def mix_spec(spec: str) -> list[tuple[str, float]]:
    """The folders and weights of path=weight,… whose weights are positive; one without a weight, or twice the same folder, is an error."""
    out: dict[str, float] = {}
    for item in filter(None, (x.strip() for x in spec.split(","))):
        path, mark, weight = item.rpartition("=")
        if not mark or not path or float(weight) <= 0 or path in out:
            raise ValueError(f"not a folder with a positive weight: {item}")
        out[path] = float(weight)
    return list(out.items())


def carried(old: DataFrame, new: DataFrame, settings: tuple[str, ...]) -> DataFrame:
    """(folder, base) for the folders of new (folder, settings, content): what the folder of old (…, base) had given, if all settings agree; 0 for one whose content is new.

    A folder whose settings differ is an error.
    """
    known = old.select("folder", F.col("content").alias("_c"), F.col("base").alias("_b"), F.struct(*settings).alias("_s"))
    met = new.join(known, "folder", "left")
    wrong = F.col("_s").isNotNull() & ~F.struct(*[F.col(c) for c in settings]).eqNullSafe(F.col("_s"))
    base = F.when(wrong, F.raise_error(F.lit("the settings of a folder have changed")).cast("long")).when(F.col("_c").eqNullSafe(F.col("content")), F.col("_b")).otherwise(0)
    return met.select("folder", base.cast("long").alias("base"))
