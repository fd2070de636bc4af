"""Normalisers. Unicode forms and compression are not in Spark, so those two steps run in Arrow-batched functions."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as tx

ZERO_WIDTH = r"[​-‏‪-‮⁠-⁤﻿￾­]"


def nfkc(text: Column) -> Column:
    """Unicode NFKC; null stays null. The repair of wrongly decoded text is not part of it."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return form(text)


def normalized(text: Column) -> Column:
    """NFKC, no zero-width or control characters but LF and tab, single spaces within lines, no blanks at line ends, one blank line at most."""
    text = F.regexp_replace(nfkc(text), ZERO_WIDTH, "")
    text = F.regexp_replace(F.regexp_replace(text, r"\r\n?|\f", "\n"), r"[\p{C}&&[^\n\t]]", "")
    text = F.regexp_replace(text, r"(?U)(?<=\S) {2,}", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+(?=\n|$)", ""), r"\n{3,}", "\n\n")
    return tx.stripped(text)


def notice_text(text: Column, form: Callable[[Column], Column] = nfkc) -> Column:
    """Markup as spaces, no control characters, and runs of blanks and of line ends shortened."""
    text = F.regexp_replace(form(F.regexp_replace(text, "<[^>]+>", " ")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return tx.stripped(F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), r"\n{3,}", "\n\n"))


def merged_paragraphs(text: Column) -> Column:
    """Lines of a paragraph joined by single spaces; blank lines stay between paragraphs."""
    blocks = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), lambda p: tx.stripped(F.regexp_replace(p, r"(?U)\s*\n\s*", " "))), lambda p: p != "")
    return F.array_join(blocks, "\n\n")


def compression_ratio(text: Column) -> Column:
    """Size of the zlib-compressed UTF-8 text at level 6 to its own; 0 for an empty text."""

    @F.pandas_udf("double")
    def ratio(s: pd.Series) -> pd.Series:
        return s.map(lambda t: 0.0 if not t else len(zlib.compress(t.encode(), 6)) / len(t.encode()))

    return ratio(text)


def without_corrupted_lines(text: Column, most: float = 0.25) -> Column:
    """Drops lines in which over `most` of the characters but spaces are of the extended Latin blocks, U+0100 to U+02FF."""

    def sound(line: Column) -> Column:
        own = F.length(F.replace(tx.stripped(line), F.lit(" "), F.lit("")))
        return (own == 0) | (F.regexp_count(line, F.lit(r"[Ā-˿]")) <= own * most)

    return F.array_join(F.filter(F.split(text, "\n"), sound), "\n")


def without_law_references(text: Column) -> Column:
    """Removes what introduces a reference to European law, and leaves the rest of its line."""
    return F.regexp_replace(text, r"(?U)ELI:\s*http://data\.europa\.eu/eli/", "")
