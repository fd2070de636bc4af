"""Notices in old text form and in XML, as fields and documents."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.text import let
from quarry.operators.cleaning import notice_text
from quarry.session import ship

#: What divides notices, begins a field, tells the format and the language of a file, and names that are no notices: fixed values.
SEPARATOR = r"(?m)^\d+\.\d+/\d+\s*$"
FIELD = r"^([A-Z]{2,3}):\s?(.*)$"
ITALIAN_NAMES = (r"(?i)^IT[_-]", r"(?i)[/\\]IT[_-]", r"(?i)^it_.*utf8.*org$", r"(?i)^IT_.*ISO.*ORG$")
SKIPPED_STARTS, SKIPPED_ENDS = (".", "__"), (".xsd", ".dtd", ".pdf", ".jpg", ".png", ".css", ".html")
CHARSETS = ("ISO-8859-1",)


def read_text(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 where they are not; every byte string is Latin-1, so no further charset is ever needed. Line ends become LF."""
    plain = content.cast("string")
    return F.regexp_replace(F.when(F.is_valid_utf8(plain), plain).otherwise(F.decode(content, CHARSETS[0])), r"\r\n?", "\n")


def sniffed(content: Column) -> Column:
    """xml, txt or null by the first 2,048 bytes: marks of XML, a line that divides notices, or a field at the start of a line."""
    head = F.make_valid_utf8(F.substring(content, 1, 2048).cast("string"))
    xml = F.contains(head, F.lit("<?xml")) | F.contains(head, F.lit("<TED_EXPORT"))
    return F.when(xml, "xml").when(F.rlike(head, F.lit(r"(?m)^\d+\.\d+/\d+")) | F.rlike(head, F.lit(r"(?m)^(TI|ND|CY|AU|TX|AB):\s")), "txt")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_italian(path: Column) -> Column:
    """Whether a file is in Italian by its name."""
    return F.rlike(base_name(path), F.lit("|".join(ITALIAN_NAMES)))


def notice_files(files: DataFrame) -> DataFrame:
    """files (path, content) with kind, xml or txt: XML by name, others only with an Italian name and by what they hold; hidden files, pictures, styles and schemas are none."""
    name = F.lower(base_name(F.col("path")))
    skipped = F.lit(False)
    for x in SKIPPED_STARTS:
        skipped |= F.startswith(name, F.lit(x))
    for x in SKIPPED_ENDS:
        skipped |= F.endswith(name, F.lit(x))
    kind = F.when(F.endswith(name, F.lit(".xml")), "xml").when(is_italian(F.col("path")), sniffed(F.col("content")))
    return files.where(~skipped).withColumn("kind", kind).where("kind is not null")


def fields(block: Column) -> Column:
    """The fields of a notice by tag: a field begins with a tag at the start of a line and takes the lines up to the next, stripped. The last of a tag counts."""

    def cut(lines: Column) -> Column:
        at = F.filter(F.transform(lines, lambda x, i: F.when(F.rlike(x, F.lit(FIELD)), i)), lambda i: i.isNotNull())

        def parts(starts: Column) -> Column:
            def one(i: Column, k: Column) -> Column:
                end = F.coalesce(F.try_element_at(starts, k + 2), F.size(lines))
                head = F.element_at(lines, i + 1)
                more = F.transform(F.slice(lines, i + 2, end - i - 1), tx.stripped)
                return F.struct(F.regexp_extract(head, FIELD, 1).alias("key"), F.array_join(F.concat(F.array(F.regexp_extract(head, FIELD, 2)), more), "\n").alias("value"))

            every = F.transform(starts, one)
            return let(every, lambda e: F.map_from_entries(F.filter(e, lambda x, k: ~F.exists(F.slice(e, k + 2, F.size(e)), lambda y: y["key"] == x["key"]))))

        return let(at, parts)

    return let(F.split(block, "\n"), cut)


def legacy_notices(files: DataFrame) -> DataFrame:
    """(doc_id, title, abstract, body, path) of the notices in old files (path, content): what stands before the first dividing line is none, nor is a notice without text."""
    blocks = F.split(read_text(F.col("content")), SEPARATOR)
    cut = files.select("path", F.explode(F.when(F.size(blocks) > 1, F.slice(blocks, 2, F.size(blocks))).otherwise(blocks)).alias("_b"))
    own = cut.where(tx.stripped(F.col("_b")) != "").select("path", fields(F.col("_b")).alias("f")).where(F.size("f") > 0)
    value = lambda tag: F.coalesce(F.try_element_at("f", F.lit(tag)), F.lit(""))
    stem = F.regexp_replace(base_name(F.col("path")), r"(?<=.)\.[^.]*$", "")
    raw = own.select(tx.stripped(F.coalesce(F.try_element_at("f", F.lit("ND")), stem)).alias("doc_id"), value("TI").alias("title"), value("AB").alias("abstract"), value("TX").alias("body"), "path")
    has = F.lit(False)
    for name in ("title", "abstract", "body"):
        has |= notice_text(F.col(name), lambda x: x) != ""
    return raw.where(has).select("doc_id", *[notice_text(F.col(c)).alias(c) for c in ("title", "abstract", "body")], "path")


def _local(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _whole(element: ElementTree.Element | None) -> str:
    """All text of an element, its parts joined by blanks."""
    return "" if element is None else " ".join(x for x in element.itertext())


def _named(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if _local(e.tag) == name]


def _italian(root: ElementTree.Element) -> tuple[str, str, str] | None:
    """Title, abstract and body: of the Italian form, else the translated title, else of all Italian elements with over 15 characters."""
    forms = [f for section in _named(root, "FORM_SECTION")[:1] for f in section if f.get("LG", "").upper() == "IT"]
    if forms:
        title = _whole(next(iter(_named(forms[0], "TITLE")), None))
        body = dict.fromkeys(t for t in (_whole(p).strip() for p in _named(forms[0], "P")) if t)
        found = title, "\n".join(_whole(x) for x in _named(forms[0], "SHORT_DESCR")), "\n".join(body)
        if any(x.strip() for x in found):
            return found
    for section in _named(root, "TRANSLATION_SECTION")[:1]:
        own = [x for x in _named(section, "ML_TI_DOC") if x.get("LG", "").upper() == "IT"]
        title = _whole(next(iter(_named(own[0], "TI_TEXT")), None)) if own else ""
        if title.strip():
            return title, "", ""
    marks = ("{http://www.w3.org/XML/1998/namespace}lang", "languageID", "LG")
    texts = [t for t in (_whole(e).strip() for e in root.iter() if next((e.get(m) for m in marks if e.get(m)), "").upper() in ("IT", "ITA")) if len(t) > 15]
    return (texts[0], "", "\n\n".join(texts[1:])) if texts else None


def xml_notices(files: DataFrame) -> DataFrame:
    """(doc_id, title, abstract, body, path) of XML notices (path, content) with Italian text, whatever their namespace; what is not XML has none."""
    ship(files.sparkSession)

    @F.pandas_udf("doc_id string, title string, abstract string, body string")
    def parsed(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for path, content in zip(paths, contents, strict=True):
            try:
                root = ElementTree.fromstring(bytes(content or b""))
                found = _italian(root)
            except ElementTree.ParseError:
                found = None
            stem = path.rpartition("/")[2].rpartition(".")[0] or path.rpartition("/")[2]
            rows.append((root.get("DOC_ID", stem), *found) if found else (None,) * 4)
        return pd.DataFrame(rows, columns=["doc_id", "title", "abstract", "body"])

    own = files.select("path", parsed("path", "content").alias("n")).where("n.doc_id is not null")
    return own.select("n.doc_id", *[notice_text(F.col(f"n.{c}")).alias(c) for c in ("title", "abstract", "body")], "path").where("title <> '' or abstract <> '' or body <> ''")


def notice_document(title: Column, abstract: Column, body: Column) -> Column:
    """A notice as one text: its parts that are not empty, a blank line between them."""
    return F.array_join(F.filter(F.array(title, abstract, body), lambda x: x != ""), "\n\n")
