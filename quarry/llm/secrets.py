"""Secret scans: base patterns, and multipart credentials whose parts are linked within a scope. Built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import let
from quarry.llm.scratch import written

#: The base patterns, in the order of their kinds, with the group whose length counts and the least length. As runs of one class
#: have no shorter match that is long enough, access and hex hold their least length in the pattern.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": ("AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": ("(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
}
#: Weak parts, which are only reported beside their complements: 40 characters that may be a secret key, and endpoints. A key may
#: follow anything but a base64 character (plain or of URLs), so also `=`, `:`, quotes and escapes such as %3D; its + and / may be escaped.
WEAK = {
    "key": (r"(?:(?<![A-Za-z0-9+/_-])|(?<=%(?!2[BbFf])[0-9A-Fa-f]{2}))(?:[A-Za-z0-9+/]{40}|(?=[A-Za-z0-9+/]{0,39}%2[BbFf])(?:[A-Za-z0-9+/]|%2[BbFf]){40})(?![A-Za-z0-9+/=_-]|%2[BbFf])", 0, 40),
    "endpoint": (r"(?:https?|s3|ftp|jdbc:[a-z0-9]+)://[A-Za-z0-9._~:/@%-]+|(?<![a-z0-9.-])[a-z0-9.-]+\.amazonaws\.com", 0, 8),
}
KINDS = [*BASE, *WEAK]
_BLOCK = 128


def _spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """The spans of all leftmost non-overlapping matches whose group is long enough, as an array of (s, e) in code points.

    Texts between the matches and the matches themselves alternate, so that their lengths add up to positions. The sums are taken
    within blocks and over blocks, since an array that grows by one item at a time is copied each time.
    """
    regex = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), F.length)
    part = F.transform(F.regexp_extract_all(text, regex, F.lit(group)), F.length) if group else whole
    items = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(whole), F.lit(1))), F.arrays_zip(whole.alias("w"), part.alias("p")), lambda g, m: F.struct(g.alias("g"), m["w"].alias("w"), m["p"].alias("p")))
    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / _BLOCK).cast("int") - 1), lambda b: F.slice(x, b * _BLOCK + 1, _BLOCK))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        s = acc["at"] + m["g"]
        own = F.array(F.struct(s.alias("s"), (s + m["w"]).alias("e")))
        return F.struct((s + m["w"]).alias("at"), F.when(m["p"] >= least, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    sums = lambda x: F.transform(blocks(x), lambda b: F.aggregate(b, start, step))

    def join(acc: Column, b: Column) -> Column:
        moved = F.transform(b["out"], lambda x: F.struct((x["s"] + acc["at"]).alias("s"), (x["e"] + acc["at"]).alias("e")))
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    nested = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<struct<s:bigint,e:bigint>>>").alias("out"))
    found = F.flatten(F.aggregate(let(items, sums), nested, join)["out"])
    return F.when(F.regexp_like(text, regex), found).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))


def _linked(weak: DataFrame, scope: int) -> DataFrame:
    """(row, linked): the weak parts that stand within scope code points of the parts they need: access identifier and key, endpoint beside both.

    Parts are dealt into intervals of scope code points, each key part also into the neighbours, so that parts near each other meet in
    an equi-join on row and interval. What is joined are the first and last part of each kind in an interval, not all its parts.
    """
    both_held = weak.where("size(access) > 0 and size(key) > 0")
    exploded = [both_held.select("row", F.lit(kind).alias("kind"), F.explode(kind).alias("x")) for kind in ("access", *WEAK)]
    parts = reduce(DataFrame.unionByName, exploded).select("row", "kind", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.expr(f"x.s div {scope}").alias("cell"))
    access = parts.where("kind = 'access'").groupBy("row", "cell").agg(F.min("s").alias("least"), F.max("s").alias("most"))

    def near(rows: DataFrame, anchors: DataFrame) -> DataFrame:
        """Rows within scope of an anchor: all anchors of the own cell are, the last of the cell before or the first of the next may be."""
        spread = rows.select("*", F.explode(F.array(*[F.col("cell") + d for d in (-1, 0, 1)])).alias("at"))
        met = spread.join(anchors.withColumnRenamed("cell", "at"), ["row", "at"])
        gap = F.when(F.col("at") < F.col("cell"), F.col("s") - F.col("most")).when(F.col("at") > F.col("cell"), F.col("least") - F.col("s")).otherwise(0)
        return met.where(gap <= scope).select("row", "kind", "s", "e", "cell").distinct()

    keys = near(parts.where("kind = 'key'"), access)
    anchors = keys.groupBy("row", "cell").agg(F.min("s").alias("least"), F.max("s").alias("most"))
    ends = near(parts.where("kind = 'endpoint'"), anchors)
    both = keys.unionByName(ends)
    return both.groupBy("row").agg(F.collect_list(F.struct("s", "kind", "e")).alias("linked"))


def _label(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))


def scanned(docs: DataFrame, scope: int = 400) -> DataFrame:
    """(kept, base, spans) for each row of docs: kept is the row itself as a struct, the others are arrays of (s, k, e): start, place of the kind in KINDS, end.

    Every whole text is scanned (null: empty); positions count code points, ends are exclusive, and arrays are sorted. base has the
    matches of BASE alone; spans also the keys within scope of an access identifier, and the endpoints within scope of such a key.
    Only rows whose text holds the start of an access identifier are written, given a number and joined; all others take one pass.
    Arrays are of one document's matches. Repeated rows, null doc_ids and columns of any name stay as they are, a row each; an empty
    table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    may_link = F.contains(F.col("_text"), F.lit("AKIA"))  # no part counts without an access identifier
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), text.alias("_text"))
    base = F.array_sort(F.concat(*[_label(kind) for kind in BASE]))
    plain = rows.where(~may_link).select("kept", *[_spans(F.col("_text"), *rule).alias(kind) for kind, rule in BASE.items()]).select("kept", base.alias("base"))
    weak = rows.where(may_link).select("kept", *[_spans(F.col("_text"), *rule).alias(kind) for kind, rule in (BASE | WEAK).items()])
    weak = written(weak.withColumn("row", F.monotonically_increasing_id()), "scanned")
    place = lambda kind: sum((F.when(kind == name, F.lit(k)).otherwise(F.lit(0)) for k, name in enumerate(WEAK, len(BASE))), F.lit(0))
    more = F.transform(F.coalesce("linked", F.array().cast("array<struct<s:bigint,kind:string,e:bigint>>")), lambda x: F.struct(x["s"].alias("s"), place(x["kind"]).alias("k"), x["e"].alias("e")))
    joined = weak.join(_linked(weak, scope), "row", "left").select("kept", base.alias("base"), F.array_sort(F.concat(base, more)).alias("spans"))
    return plain.select("kept", "base", F.col("base").alias("spans")).unionByName(joined)


def spans(docs: DataFrame, scope: int = 400, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, base and spans of scanned(); keep must not hold those two names."""
    found = scanned(docs.select(*dict.fromkeys((*keep, "text"))), scope)
    return found.select(*[F.col(f"kept.`{c}`") for c in keep], "base", "spans")


def listed(column: str) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, found: Column, mask: str = "<SECRET>") -> Column:
    """The text with each span, or run of spans that touch or overlap, replaced by the mask; found is sorted."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"), F.lit(-1).cast("long").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int"))
        apart = x["s"] > acc["last"]
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(apart, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"), F.greatest(acc["last"], x["e"]).alias("last"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647)))
    return F.when(F.size(found) > 0, F.aggregate(found, start, step, rest)).otherwise(text)
