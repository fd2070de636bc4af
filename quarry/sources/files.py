"""Files, archives and marked-up texts as rows."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.session import ship

#: Formats by file name extension: fixed values.
FORMATS = {"txt": "txt", "json": "json", "jsonl": "jsonl", "html": "html", "htm": "html", "xml": "xml", "pdf": "pdf"}


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """(path, format, length, content) of all files under root whose extension, in either case, is known. Content is read only if used."""
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = F.try_element_at(known, F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)))
    return files.select("path", found.alias("format"), "length", "content").where("format is not null")


def within_size(files: DataFrame, most: int) -> DataFrame:
    """Drops files of over `most` bytes, of the formats that are parsed whole."""
    return files.where((F.col("length") <= most) | ~F.col("format").isin("json", "html", "xml", "pdf"))


def volume_capped(files: DataFrame, key: str, size: str, cap: int, seed: int = 0, buckets: int = 1024) -> DataFrame:
    """Rows in a seeded order while the total before them is under cap; the last may pass it.

    The order is that of the MD5 of seed and key. Totals before a row are those of the buckets of the digest before its own, of which
    there are `buckets` at most, and a running total inside the bucket; so no task has all rows. Null keys and sizes count as empty and 0.
    """
    from pyspark.sql import Window

    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets
    rows = files.select("*", digest.alias("_digest"), bucket.alias("_bucket"), F.coalesce(F.col(size), F.lit(0)).alias("_size"))
    totals = rows.groupBy("_bucket").agg(F.sum("_size").alias("n"))
    earlier = totals.select("_bucket", (F.sum("n").over(Window.orderBy("_bucket")) - F.col("n")).alias("_before"))
    inside = F.sum("_size").over(Window.partitionBy("_bucket").orderBy("_digest").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    return rows.join(F.broadcast(earlier), "_bucket").withColumn("_inside", inside).where(F.col("_before") + F.col("_inside") < cap).drop("_digest", "_bucket", "_size", "_before", "_inside")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 without NULs; wrong bytes become the replacement character."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\x00", "")


def marked(text: Column) -> Column:
    """The stripped documents of a text between <bos> and <eos>, without empty ones; what stands before the first <bos> is none."""
    cut = F.filter(F.split(text, "<bos>"), lambda _, i: i > 0)
    return F.filter(F.transform(cut, lambda x: tx.stripped(F.substring_index(x, "<eos>", 1))), lambda x: x != "")


def chatml(text: Column) -> Column:
    """The conversations of a ChatML text: pieces that begin at each system marker; one before the first becomes a system turn."""
    pieces = F.filter(F.transform(F.split(text, r"<\|im_start\|>system"), tx.stripped), lambda x: x != "")
    return F.transform(pieces, lambda x: F.concat(F.lit("<|im_start|>system\n"), x))


def listed(lines: DataFrame) -> DataFrame:
    """Stripped lower-case lines of (value) that are not blank and not comments."""
    return lines.select(F.lower(tx.stripped(F.col("value"))).alias("value")).where("value <> '' and value not like '#%'")


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(year, month) from first to last, both given as yyyy-mm."""
    ends = [F.to_date(F.lit(f"{x}-01")) for x in (first, last)]
    day = spark.range(1).select(F.explode(F.sequence(*ends, F.expr("interval 1 month"))).alias("d"))
    return day.select(F.year("d").alias("year"), F.month("d").alias("month"))


def xml_text(content: Column) -> Column:
    """Every stripped text and tail of an XML document, in the order in which elements end, by lines; null for what is not XML."""

    def one(x: bytes | None) -> str | None:
        try:
            ends = [e for _, e in ElementTree.iterparse(io.BytesIO(x or b""), ("end",))]
        except ElementTree.ParseError:
            return None
        return "\n".join(s for e in ends for s in ((e.text or "").strip(), (e.tail or "").strip()) if s) or None

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(content)


def _safe(name: str) -> bool:
    return not name.startswith(("/", "\\")) and ".." not in name.replace("\\", "/").split("/")


def _members(name: str, data: bytes, depth: int) -> Iterator[tuple[str, bytes | None]]:
    """The files in an archive; one that is damaged gives what could be read of it, and its own name without content."""
    try:
        if depth and data[:2] == b"\x1f\x8b":
            yield from _members(name.removesuffix(".gz"), gzip.decompress(data), depth - 1)
        elif depth and data[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for x in z.infolist():
                    if not x.is_dir() and _safe(x.filename):
                        yield from _members(f"{name}/{x.filename}", z.read(x), depth - 1)
        elif depth and data[257:262] == b"ustar":
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for x in t:
                    if x.isfile() and _safe(x.name):
                        yield from _members(f"{name}/{x.name}", t.extractfile(x).read(), depth - 1)
        else:
            yield name, data
    except (OSError, EOFError, zlib.error, zipfile.BadZipFile, tarfile.TarError, RuntimeError, NotImplementedError):
        yield name, None


def members(files: DataFrame, depth: int = 5) -> DataFrame:
    """(path, content) of the files in gzip, zip and tar archives, known by their first bytes and opened to the given depth; others stay as they are.

    Names that lead out of the archive are left out; a damaged archive is a row without content. Null contents are dropped. Nothing is
    written to disk.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for name, data in _members(path, bytes(content), depth):
                    yield pd.DataFrame({"path": [name], "content": [data]})

    return files.select("path", "content").where("content is not null").mapInPandas(run, "path string, content binary")


def lines_read(spark: SparkSession, path: str) -> DataFrame:
    """(value) of the lines of a text that are not blank, as JSON lines have one object each."""
    return spark.read.text(path).where(F.rlike("value", F.lit(r"(?U)\S")))


def cases(spark: SparkSession, path: str, schemas: dict[str, str] | None = None) -> DataFrame:
    """The rows of a Parquet or a JSON-lines file or folder, by its name; columns in schemas hold JSON as text and are read by these."""
    rows = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.json(path)
    for name, schema in (schemas or {}).items():
        if rows.schema[name].dataType.simpleString() == "string":
            rows = rows.withColumn(name, F.from_json(name, schema))
    return rows


def prompt_rows(spark: SparkSession, path: str) -> DataFrame:
    """(prompt, response) of a JSON document: a list of objects, or an object whose values are such lists, one after the other."""
    item = "array<struct<prompt:string,response:string>>"
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    listed_ = F.rlike("v", F.lit(r"^\s*\["))
    rows = F.when(listed_, F.from_json("v", item)).otherwise(F.flatten(F.map_values(F.from_json("v", f"map<string,{item}>"))))
    return whole.select(F.explode(rows).alias("r")).select("r.prompt", "r.response")


def extracted(files: DataFrame, keys: tuple[str, ...] = ("text",)) -> DataFrame:
    """(path, format, text) of files (path, format, content): by format the text of each, in normal form; what has none is left out.

    A file of JSON lines gives a row for each line that is JSON and has texts. PDF needs its pages as rows and is not read here.
    """
    from quarry.operators.cleaning import normalized
    from quarry.sources.extract import html_text, json_text

    ship(files.sparkSession)
    of = lambda kind: files.where(F.col("format") == kind)
    plain = decoded(F.col("content"))
    parts = [
        of("txt").select("path", "format", plain.alias("text")),
        of("json").select("path", "format", json_text(plain, keys).alias("text")),
        of("jsonl").select("path", "format", F.explode(F.split(plain, "\n")).alias("l")).where(F.rlike("l", F.lit(r"(?U)\S"))).select("path", "format", json_text(F.col("l"), keys).alias("text")),
        of("html").select("path", "format", html_text(plain).alias("text")),
        of("xml").select("path", "format", xml_text(F.col("content")).alias("text")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.where("text is not null").withColumn("text", normalized(F.col("text"))).where("text <> ''")


def generated(concepts: DataFrame, templates: list[str], each: int, seed: int) -> DataFrame:
    """(concept, n, text): `each` texts of every concept (concept), from templates with {} chosen by a hash."""
    rows = concepts.select("concept", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("n"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "concept", F.col("n").cast("string"))), 1, 8), 16, 10).cast("long") % len(templates)
    return rows.select("concept", "n", F.replace(F.element_at(F.array(*[F.lit(t) for t in templates]), (pick + 1).cast("int")), F.lit("{}"), F.col("concept")).alias("text"))
