"""URL filters: host-suffix and path-prefix expressions joined to rules by short digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark, hash or the end, A-Z in lower case; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _digest(rule: Column) -> Column:
    return F.sha2(rule.cast("binary"), 256)


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix_digits: int = 8, most_lengths: int = 10_000) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url; other columns are not looked at).

    rules has host, path and action; it fits its host and all subdomains where the url's path starts with its own. The longest
    rule wins; of equally long ones that with the longer host, then the action that is first in the alphabet. Every distinct host and path is
    expanded into its host suffixes and path prefixes, of the numbers of labels and the lengths that rules have (most_lengths at most
    of either, else an error). Expressions meet the rules on the first digits of a digest, and the full digest confirms. Without a rule, rule is null and
    the verdict the default. A null url, or one without ://, has an empty host and path, which no rule fits. Null rules do not
    count; repeated pages and null page_ids give a row each; an empty table gives no rows.
    """
    named = F.concat("host", "path")
    known = rules.where("host is not null and path is not null and action is not null")
    known = known.groupBy("host", "path").agg(F.min("action").alias("action")).select(named.alias("rule"), F.length("host").alias("host_length"), F.length("path").alias("path_length"), "action")
    known = known.withColumn("digest", _digest(F.concat_ws("\t", "rule", F.col("host_length").cast("string")))).withColumn("short", F.substring("digest", 1, prefix_digits))
    lengths = sorted(r.path_length for r in known.select("path_length").distinct().limit(most_lengths + 1).collect())
    if len(lengths) > most_lengths:
        raise ValueError("too many different lengths of rule paths")
    cut = pages.select(F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not lengths:
        return cut.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels, depths = F.split("host", r"\."), F.size(F.split("host", r"\."))
    counts = sorted(r.n for r in known.select(F.size(F.split(F.expr("substring(rule, 1, host_length)"), r"\.")).alias("n")).distinct().limit(most_lengths + 1).collect())
    if len(counts) > most_lengths:
        raise ValueError("too many different depths of rule hosts")
    deep = F.filter(F.array(*[F.lit(n) for n in counts]), lambda n: n <= depths)
    suffixes = F.transform(deep, lambda n: F.array_join(F.slice(labels, depths - n + 1, n), "."))
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    spread = cut.where("host != ''").select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    spread = spread.select("host", "path", "suffix", F.explode(prefixes).alias("n")).select("host", "path", F.length("suffix").alias("s"), F.concat("suffix", F.expr("substring(path, 1, n)")).alias("e"))
    spread = spread.withColumn("full", _digest(F.concat_ws("\t", "e", F.col("s").cast("string")))).withColumn("short", F.substring("full", 1, prefix_digits))
    met = spread.join(known, "short").where("full = digest")
    rank = F.struct(F.length("rule").alias("a"), F.col("host_length").alias("b"))
    best = written(met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), rank).alias("best")), "rules").withColumn("salt", F.lit(0).cast("long"))
    salt = F.when(F.col("host") == "", F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) + 1).otherwise(0)  # what no rule fits has no need to meet in one task
    joined = cut.withColumn("salt", salt).join(best, ["host", "path", "salt"], "left")
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
