"""Text from HTML and JSON, in Arrow-batched functions since both nest to any depth."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements without content of their own, and elements that end a line.
SILENT = ("aside", "footer", "form", "head", "header", "nav", "noscript", "script", "style", "template")
BLOCKS = ("address", "article", "blockquote", "br", "dd", "div", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "li", "main", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul")


class _Main(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent: list[str] = []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in SILENT:
            self.silent.append(tag)
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag) -> None:
        if tag in self.silent:
            while self.silent.pop() != tag:
                pass
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data) -> None:
        if not self.silent:
            self.out.append(data)


def main_text(html: str | None) -> str | None:
    """The lines of a page outside navigation, scripts and the like; repeated lines once. Null stays null."""
    if html is None:
        return None
    parser = _Main()
    parser.feed(html)
    parser.close()
    lines = (" ".join(x.split()) for x in "".join(parser.out).split("\n"))
    return "\n".join(dict.fromkeys(x for x in lines if x))


def html_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(main_text)

    return run(html)


def found(value, keys: frozenset[str]) -> list[str]:
    """Texts under matching keys: a string, or the strings of a list, whose objects are searched; an object under such a key is not entered."""
    if isinstance(value, list):
        return [x for item in value for x in found(item, keys)]
    if not isinstance(value, dict):
        return []
    out: list[str] = []
    for key, own in value.items():
        if key not in keys:
            out += found(own, keys)
        elif isinstance(own, str):
            out += [own.strip()] * bool(own.strip())
        elif isinstance(own, list):
            for item in own:
                out += [item.strip()] if isinstance(item, str) and item.strip() else found(item, keys) if isinstance(item, dict) else []
    return out


def json_text(content: Column, keys: tuple[str, ...] = ("text",)) -> Column:
    """The distinct texts of a JSON document joined by line ends; null for one that is not JSON or holds none."""
    wanted = frozenset(keys)

    def one(text: str | None) -> str | None:
        try:
            return "\n".join(dict.fromkeys(found(json.loads((text or "").replace("\x00", "")), wanted))) or None
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(content)
