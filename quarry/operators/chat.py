"""Conversations: parsing, validity, deduplication, and statistics by role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "tool")


def parsed(text: Column) -> Column:
    """ChatML turns as an array of (role, content): known roles with content only; what follows an end mark is dropped."""
    turns = F.transform(F.split(text, r"<\|im_start\|>"), lambda t: F.trim(F.regexp_replace(F.split(t, r"<\|im_end\|>")[0], r"(?U)^\s+|\s+$", "")))
    cut = F.filter(turns, lambda t: F.contains(t, F.lit("\n")))
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    pairs = F.transform(cut, lambda t: F.struct(F.lower(strip(F.substring_index(t, "\n", 1))).alias("role"), strip(F.regexp_replace(t, r"^[^\n]*\n", "")).alias("content")))
    return F.filter(pairs, lambda p: p["role"].isin(*ROLES) & (p["content"] != ""))


def gathered(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): turns in their order, as an array of (role, content). A conversation is one row's worth by definition."""
    item = F.struct("turn", F.col("role"), F.coalesce("text", F.lit("")).alias("content"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("m")).select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def issues(m: str = "messages") -> Column:
    """Why a conversation is not valid, as an array of codes."""
    roles = F.transform(m, lambda x: x["role"])
    tests = {
        "no_system_start": F.element_at(roles, 1) != "system",
        "no_assistant": ~F.array_contains(roles, "assistant"),
        "no_input": ~F.exists(roles, lambda r: r.isin("user", "tool")),
        "no_assistant_end": F.element_at(roles, -1) != "assistant",
        "empty_message": F.exists(m, lambda x: x["content"] == ""),
    }
    return F.when(F.size(m) == 0, F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])))


def identity(m: str = "messages") -> Column:
    """The first 16 digits of a digest of all turns but the system's, 200 characters of each."""
    own = F.transform(F.filter(m, lambda x: x["role"] != "system"), lambda x: F.concat(x["role"], F.lit(":"), F.substring(x["content"], 1, 200), F.lit("|")))
    return F.substring(F.sha2(F.array_join(own, "").cast("binary"), 256), 1, 16)


def tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def role_words(turns: DataFrame) -> DataFrame:
    """(role, term) of all lower-case words of two letters or more."""
    return turns.select("role", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("term"))


def tfidf(turns: DataFrame, k: int = 20) -> DataFrame:
    """(role, term, score, rank): the k terms that mark a role, each role's texts being one document."""
    counts = role_words(turns).groupBy("role", "term").agg(F.count("*").alias("c"))
    total = counts.groupBy("role").agg(F.sum("c").alias("total"))
    spread = counts.groupBy("term").agg(F.count("*").alias("df"))
    n = counts.select(F.countDistinct("role").alias("n"))
    score = F.round(F.col("c") / F.col("total") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1), 6)
    joined = counts.join(F.broadcast(total), "role").join(spread, "term").join(F.broadcast(n)).withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("score"), "term")).alias("rank")
    return joined.select("role", "term", "score", rank).where(F.col("rank") <= k)
