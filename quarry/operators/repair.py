"""Repair of extracted texts: page furniture, merged columns, tables, footnotes, legal texts, program sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.text import let
from quarry.operators.cleaning import ZERO_WIDTH, nfkc

#: Patterns of page numbers, leader dots, breaks in words, list marks, and ends of lines that are kept however short: fixed values.
PAGE_NUMBER = r"(?im)^[\s]*(?:(?:pag(?:ina)?\.?\s*)?[0-9]{1,5}|[—\-–]\s*[0-9]{1,5}\s*[—\-–]|[ivxlcdm]+)[\s]*$"
LEADERS = r"(?m)[.\s·]{5,}\s*\d+\s*$"
WORD_BREAK = r"(?U)(\w{2,})-\s*\n\s*(\w{2,})"
LIST_MARK = r"(?m)^[\s]*[•▪▸►◆◇→‣⁃■□●○]\s*"
LINE_FINALS = ".!?:;»”’\""
#: Lines and inline headers of gazettes, markers of legal texts that stand in mid-sentence, and other marks of merged columns: fixed values.
GAZETTE_LINE = r"(?im)^\s*(?:(?:\d{1,2}\.\d{1,2}\.\d{4}\s+)?IT\s+Gazzetta\s+ufficiale|L\s+\d{1,4}/\d{1,4}\s+IT\s+Gazzetta\s+ufficiale|GU\s+L\s+del\s+\d{1,2}\.\d{1,2}\.\d{4}\s+IT).*$"
GAZETTE = (
    r"(?i)(?:L\s+\d{1,4}/\d{1,4}\s+IT\s+Gazzetta\s+ufficiale|GU\s+L\s+del\s+\d{1,2}\.\d{1,2}\.\d{4}\s+IT|"
    r"Gazzetta\s+ufficiale\s+dell[ae]\s+(?:Comunità|Unione)\s+europe[ae]\s+\d{1,2}\s*\.\s*\d{1,2}\s*\.\s*\d{4})"
)
BEFORE_MARKER = r"[a-zà-úA-Z,;:)\d]"
MARKER = (
    r"\s{1,3}(?:(?:Articolo|Article)\s+\d+|DECIDE\s*:|HA\s+ADOTTATO\s+(?:IL|LA)\s+PRESENTE|IL\s+CONSIGLIO\s+DELL|IL\s+PARLAMENTO\s+EUROPEO|"
    r"Fatto\s+a\s+[A-ZÀ-Ú][a-zà-ú]+|Per\s+il\s+Consiglio|Il\s+presidente\s+del\s+Consiglio|vista\s+la\s+proposta\s+della\s+Commissione|"
    r"visto\s+il\s+(?:trattato|parere)|considerando\s+quanto\s+segue|considerando\s+che)"
)
HYPHENED = r"\b([a-zà-ú]{2,10})-\s*([a-zà-ú]{3,})\b"
PREFIXES = (
    "anti", "auto", "bi", "co", "contro", "de", "dis", "ex", "extra", "foto", "geo", "iper", "infra", "inter", "intra", "macro", "mega",
    "meta", "micro", "mini", "multi", "neo", "non", "omni", "para", "pluri", "poli", "post", "pre", "pro", "proto", "pseudo", "quasi",
    "radio", "re", "retro", "ri", "semi", "socio", "sovra", "sub", "super", "sur", "tecno", "tele", "trans", "tri", "ultra", "uni", "vice",
)
COMPOUNDS = ("controcomando", "controllare", "contromisura")
WORD_ENDS = ("zione", "mente", "enza", "anza", "ibile")
BEFORE_CAPITALS = r"[a-zà-ú,.;:)\d]"
CAPITALS = r"\s{1,3}(?:[A-ZÀ-Ú]{4,}\s+){2,}"
CLAUSE = r"\s+(?:(?:Il|La|Le|Lo|I|Gli|Un|Una|Uno)\s+[a-zà-ú])"
FUSED = r"[a-zà-ú];[a-zà-ú]"
JOINED = r".{0,5}[a-zà-ú]-[A-ZÀ-Ú][a-zà-ú]"
#: Signals of merged columns and what each counts: fixed values.
WEIGHTS = {"gazette": 5.0, "marker": 3.0, "hyphen": 3.0, "capitals": 2.0, "jumps": 2.0, "clause": 2.0, "fused": 2.5}
#: Codes of data types and of stocks, field marks, footnotes and lines of codes: fixed values.
DATA_TYPE = r"\b(?:an?\d|n\d|an?\.\.\d+|[0-9]{1,3}[xX])\b"
STOCK = r"\b[A-Z]{2,5}/[\dA-Z]{1,6}[-.]?"
FIELD_MARK = r'^"?[ROCD]"?$'
FOOTNOTE = r"(?im)^\s*\(\s*\d+\s*\)\s+(?=(?:GU\s|Regolamento|Decisione|Direttiva|Cfr|V\.|Ib|Op)\b)"
CODE_LINE = r"(?m)^\s*[A-Z]{2,10}[/\-]\S+\s*$"
#: How legal documents begin: a fixed pattern.
LEGAL_HEADER = (
    r"(?i)^(Ordinanza della Corte|Sentenza della Corte|Conclusioni dell'avvocato generale|Parere del Comitato|Regolamento \(|Direttiva \(|Decisione \(|"
    r"Raccomandazione \(|Comunicazione della Commissione|GU\s+[CL]\s+\d+|Gazzetta ufficiale|nel procedimento\s+C-\d+/\d+|nella causa\s+C-\d+/\d+)"
)


def legacy_normalized(text: Column, least: int = 3) -> Column:
    """A stricter normal form: no page numbers, leaders, breaks in words or short lines, one kind of list mark. Empty for a blank text."""
    out = F.regexp_replace(nfkc(text), ZERO_WIDTH, "")
    out = F.regexp_replace(F.regexp_replace(out, r"\f", "\n"), r"\t{2,}", "\t")
    out = F.regexp_replace(out, r"[\p{C}&&[^\n\t\r]]", "")
    out = F.regexp_replace(F.regexp_replace(out, PAGE_NUMBER, ""), LEADERS, "")
    out = F.regexp_replace(F.regexp_replace(out, WORD_BREAK, "$1$2"), r"\.{4,}", "…")
    out = F.regexp_replace(F.regexp_replace(out, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n")

    def line(own: Column) -> Column:
        bare = tx.stripped(own)
        return F.when(bare == "", "").when((F.length(bare) >= least) | F.instr(F.lit(LINE_FINALS), F.substring(bare, -1, 1)).cast("boolean"), own)

    out = F.array_join(F.filter(F.transform(F.split(out, "\n"), line), lambda x: x.isNotNull()), "\n")
    return tx.stripped(F.regexp_replace(F.regexp_replace(out, LIST_MARK, "- "), r"\n{3,}", "\n\n"))


def without_furniture(pages: DataFrame, doc: str, page: str, text: str, lines: int = 2, share: float = 0.5, longest: int = 200) -> DataFrame:
    """pages without the lines that stand among the first or last `lines` of many pages of their document, digits aside.

    Many is a share of the pages, two at least, of three pages or more. A page offers 2 * lines at most, so a document has a bounded
    number of such lines, which come back to its pages as an array.
    """
    own = pages.select(doc, page, tx.lines_of(F.col(text)).alias("_l"))
    ends = F.array_distinct(F.transform(F.concat(F.slice("_l", 1, lines), F.when(F.size("_l") > lines, F.slice(F.col("_l"), -lines, lines)).otherwise(F.array().cast("array<string>"))), masked))
    count = own.groupBy(doc).agg(F.count("*").alias("_n"))
    held = own.where(F.size("_l") > 0).select(doc, F.explode(ends).alias("_line")).groupBy(doc, "_line").agg(F.count("*").alias("_c"))
    often = held.join(count, doc).where((F.col("_n") >= 3) & (F.col("_c") >= F.greatest(F.lit(2), F.floor(F.col("_n") * share))) & (F.length(tx.stripped(F.col("_line"))) < longest))
    known = often.groupBy(doc).agg(F.collect_list("_line").alias("_gone"))
    keep = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("_gone", masked(tx.stripped(x))))
    return pages.join(known, doc, "left").withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(keep, "\n"))).drop("_gone")


def masked(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)\d+", "#")


def without_gazette_lines(text: Column) -> Column:
    return F.regexp_replace(text, GAZETTE_LINE, "")


def merge_signals(text: Column) -> dict[str, Column]:
    """How often each mark of merged columns is found in a paragraph."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    heads, tails = (F.regexp_extract_all(text, F.lit(HYPHENED), F.lit(k)) for k in (1, 2))
    broken = F.zip_with(heads, tails, lambda a, b: ~a.isin(*PREFIXES) & ~F.concat(a, b).isin(*COMPOUNDS) & ~F.rlike(a, F.lit(f"({'|'.join(WORD_ENDS)})$")))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\((\d+)\)"), F.lit(1)), lambda x: x.cast("double"))
    jumps = let(numbers, lambda n: F.when(F.size(n) >= 3, F.size(F.filter(F.zip_with(F.slice(n, 1, F.size(n) - 1), F.slice(n, 2, F.size(n) - 1), lambda a, b: F.abs(b - a) > 2), lambda x: x))).otherwise(0))
    joined = F.size(F.filter(F.regexp_extract_all(text, F.lit(JOINED), F.lit(0)), lambda x: F.contains(F.substring(x, 1, F.length(x) - 3), F.lit("'"))))
    return {
        "gazette": count(GAZETTE), "marker": count(f"(?<={BEFORE_MARKER}){MARKER}"), "hyphen": F.size(F.filter(broken, lambda x: x)), "capitals": count(f"(?<={BEFORE_CAPITALS}){CAPITALS}"),
        "jumps": jumps, "clause": count(f"(?<=[a-zà-ú]){CLAUSE}"), "fused": count(FUSED) + joined,
    }


def merge_score(text: Column) -> Column:
    """Weighted marks of merged columns for each word of a paragraph."""
    found = merge_signals(text)
    return sum((found[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)) / F.greatest(F.size(tx.words(text)), F.lit(1))


def column_repaired(text: Column, most: float = 0.08, most_bad: float = 0.40, least_words: int = 10) -> Column:
    """The paragraphs that show no merged columns; empty if too many do and fewer than two are left. Short ones are not judged."""
    paragraphs = F.filter(F.transform(F.split(without_gazette_lines(text), r"(?U)\n\s*\n"), tx.stripped), lambda p: p != "")
    rated = F.transform(paragraphs, lambda p: F.struct(p.alias("p"), F.when(F.size(tx.words(p)) >= least_words, merge_score(p)).alias("s")))

    def decided(own: Column) -> Column:
        clean = F.filter(own, lambda x: x["s"].isNull() | (x["s"] <= most))
        judged = F.size(F.filter(own, lambda x: x["s"].isNotNull()))
        bad = F.size(own) - F.size(clean)
        return F.when((judged > 0) & (bad / judged > most_bad) & (F.size(clean) < 2), "").otherwise(F.array_join(F.transform(clean, lambda x: x["p"]), "\n\n"))

    return F.when(tx.stripped(F.coalesce(text, F.lit(""))) == "", "").otherwise(let(rated, decided))


def consecutive_repeats(words: Column) -> Column:
    """How many words equal the one before, without regard to case."""
    lower = lambda w: F.transform(w, F.lower)
    return let(lower(words), lambda w: F.when(F.size(w) < 2, 0).otherwise(F.size(F.filter(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: a == b), lambda x: x))))


def is_garbage(text: Column) -> Column:
    """Whether a page is a table or a form: repeated words, few different ones, codes, or field marks. Under 20 words nothing is said."""

    def judged(w: Column) -> Column:
        n = F.size(w)
        different = F.size(F.array_distinct(F.filter(F.transform(w, lambda x: F.btrim(F.lower(x), F.lit(".,;:()\"'"))), lambda x: F.length(x) > 1)))
        marks = F.size(F.filter(w, lambda x: F.rlike(x, F.lit(FIELD_MARK))))
        codes = (F.regexp_count(text, F.lit(DATA_TYPE)) >= 3) | (F.regexp_count(text, F.lit(STOCK)) >= 5)
        return (n >= 20) & ((consecutive_repeats(w) / n > 0.15) | (different / n < 0.30) | codes | ((marks / n > 0.05) & (n > 30)))

    return let(tx.words(F.coalesce(text, F.lit(""))), judged)


def without_notes(text: Column) -> Column:
    """Footnote numbers before references, and lines that are codes alone, go."""
    return F.regexp_replace(F.regexp_replace(text, FOOTNOTE, ""), CODE_LINE, "")


def legal_text(text: Column) -> Column:
    """Plain spaces, a space where a capital follows a small letter or a letter a digit or the other way round, stripped lines."""
    out = F.regexp_replace(nfkc(text), r"[    ]", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"[​⁠­]", ""), r"\r\n?", "\n")
    out = F.regexp_replace(out, "([a-zàèéìòù])([A-ZÀÈÉÌÒÙ])", "$1 $2")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)(\d)([A-Za-zÀ-ÖØ-öø-ÿ])", "$1 $2"), r"(?U)([A-Za-zÀ-ÖØ-öø-ÿ])(\d)", "$1 $2")
    out = F.array_join(F.transform(F.split(F.regexp_replace(out, r"[ \t\f\x0b]+", " "), "\n"), tx.stripped), "\n")
    return tx.stripped(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def legal_documents(files: DataFrame, key: str, text: str, least: int = 500) -> DataFrame:
    """(key, doc_ix, text) of the documents in large texts: one begins at a line that looks like a header or follows two blank ones.

    Documents of under `least` characters go, but the last. Lines before the first that is not blank belong to the first.
    """
    lines = files.select(key, F.posexplode(F.split(text, r"\r\n?|\n")).alias("_i", "_line"))
    order = Window.partitionBy(key).orderBy("_i")
    full = tx.stripped(F.col("_line")) != ""
    last = F.last(F.when(full, F.col("_i")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = full & last.isNotNull() & (F.rlike(tx.stripped(F.col("_line")), F.lit(LEGAL_HEADER)) | (F.col("_i") - last > 2))
    numbered = lines.withColumn("_b", begins.cast("int")).withColumn("doc_ix", F.sum("_b").over(order))
    held = numbered.groupBy(key, "doc_ix").agg(F.sort_array(F.collect_list(F.struct("_i", "_line"))).alias("_l"))
    joined = held.select(key, "doc_ix", tx.stripped(F.array_join(F.transform("_l", lambda x: x["_line"]), "\n")).alias("text"))
    final = F.max("doc_ix").over(Window.partitionBy(key))
    return joined.withColumn("_last", final).where((F.length("text") >= least) | ((F.col("doc_ix") == F.col("_last")) & (F.col("text") != ""))).drop("_last")


def code_block(text: Column) -> Column:
    """What the first fenced block holds, plain or marked cobol; the text itself if there is none."""
    pattern = F.lit(r"(?is)```(?:cobol)?\s*\n(.*?)```")
    return F.when(F.rlike(text, pattern), F.regexp_extract(text, r"(?is)```(?:cobol)?\s*\n(.*?)```", 1)).otherwise(text)


def sections_ordered(text: Column) -> Column:
    """The lines of a program with its storage, linkage and procedure parts in that order; the procedure's head names the linked items."""

    def marked(line: Column) -> Column:
        bare = F.upper(tx.stripped(line))
        kind = F.when(F.startswith(bare, F.lit("WORKING-STORAGE SECTION.")), 1).when(F.startswith(bare, F.lit("LINKAGE SECTION.")), 2).when(F.startswith(bare, F.lit("PROCEDURE DIVISION")), 3)
        return F.struct(kind.alias("k"), F.when(kind == 3, "       PROCEDURE DIVISION USING LINKED-ITEMS.").otherwise(line).alias("line"))

    def gathered(lines: Column) -> Column:
        at = F.filter(F.transform(lines, lambda x, i: F.when(x["k"].isNotNull(), F.struct(i.alias("i"), x["k"].alias("k")))), lambda x: x.isNotNull())
        starts = F.concat(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("k"))), at)

        def parts(s: Column) -> Column:
            end = lambda j: F.coalesce(F.try_element_at(s, j + 2)["i"], F.size(lines))
            cut = F.transform(s, lambda x, j: F.struct(x["k"].alias("k"), F.slice(lines, x["i"] + 1, end(j) - x["i"]).alias("own")))
            return F.flatten(F.transform(F.array(*[F.lit(k) for k in range(4)]), lambda k: F.flatten(F.transform(F.filter(cut, lambda c: c["k"] == k), lambda c: c["own"]))))

        return let(starts, parts)

    return F.array_join(F.transform(let(F.transform(F.split(text, "\n"), marked), gathered), lambda x: x["line"]), "\n")
