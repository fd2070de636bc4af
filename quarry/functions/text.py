"""Column expressions on text that follow Unicode where plain Java patterns would not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

#: Letters whose upper case is longer, or newer than Unicode 15, and stay as they are where a letter becomes one letter; and those that become another.
_STAY = (
    r"\u0149\u019b\u01f0\u0264\u0390\u03b0\u0587\u1c8a\u1e96-\u1e9a\u1f50\u1f52\u1f54\u1f56\u1f88-\u1f8f\u1f98-\u1f9f\u1fa8-\u1faf\u1fb2\u1fb4\u1fb6\u1fb7\u1fbc\u1fc2\u1fc4\u1fc6\u1fc7\u1fcc"
    r"\u1fd2\u1fd3\u1fd6\u1fd7\u1fe2-\u1fe4\u1fe6\u1fe7\u1ff2\u1ff4\u1ff6\u1ff7\u1ffc\ua7cd\ua7db\ufb00-\ufb06\ufb13-\ufb17\x{10d70}-\x{10d85}"
)
_MOVE = "ß" + "".join(map(chr, [*range(0x1F80, 0x1F88), *range(0x1F90, 0x1F98), *range(0x1FA0, 0x1FA8), 0x1FB3, 0x1FC3, 0x1FF3]))
_MOVED = "ẞ" + "".join(chr(ord(c) + (8 if ord(c) < 0x1FB0 else 9)) for c in _MOVE[1:])
#: Capitals newer than Unicode 15.
_NEW = r"\u1c89\ua7cb\ua7cc\ua7da\ua7dc\x{10d50}-\x{10d65}"


def words(text: Column) -> Column:
    """The pieces between runs of white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def all_words(text: Column) -> Column:
    """The pieces between runs of white space, to which x1c to x1f belong as in Python."""
    return F.filter(F.split(text, r"[\x09-\x0d\x1c-\x20\x85\p{Z}]+"), lambda w: w != "")


def simple_upper(text: Column) -> Column:
    """A text in upper case, one letter for each letter, as SQL has it: ß becomes ẞ, and a ligature stays."""
    odd = rf"(?=[ß\u0149-\x{{10ffff}}])[{_STAY}{_MOVE}]"  # the range first: a class of many parts is slow to tell that a letter is not in it
    parts = F.split(text, f"(?={odd})|(?<={odd})")
    mapped = F.transform(parts, lambda p: F.when(F.rlike(p, F.lit(odd)), F.translate(p, _MOVE, _MOVED)).otherwise(F.upper(p)))
    return F.when(F.rlike(text, F.lit(odd)), F.array_join(mapped, "")).otherwise(F.upper(text))


def all_upper(text: Column) -> Column:
    """Whether upper case, one letter for each letter, leaves a text as it is, and lower case does not."""
    low, up = F.regexp_replace(text, rf"(?=[\u0149-\x{{10ffff}}])[{_STAY}]", ""), F.regexp_replace(text, rf"(?=[\u1c89-\x{{10ffff}}])[{_NEW}]", "")
    return (F.upper(low) == low) & (F.lower(up) != up)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Stripped lines that are not blank; all line ends of Unicode count."""
    return F.filter(F.transform(F.split(text, LINE_ENDS), stripped), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    """Stripped blocks between blank lines."""
    return F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), stripped), lambda x: x != "")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def held(text: Column, others: str) -> Column:
    """How many characters stand in a text but for the class others: what is left without runs of those, so no list of matches is made."""
    return F.length(F.regexp_replace(text, f"{others}+", ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: a lambda that refers to an expression from outside would compute it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(items: Column, n: int) -> Column:
    """All n-grams of an array of words; a shorter array has one, of all its words, and an empty one none."""

    def cut(own: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(own) - n + 1, F.lit(1)))
        return F.when(F.size(own) > 0, F.transform(starts, lambda i: F.array_join(F.slice(own, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(items, cut)


def repeated_share(items: Column) -> Column:
    """The share of items that repeat an earlier one; 0 for none."""
    return let(items, lambda x: F.when(F.size(x) > 0, (F.size(x) - F.size(F.array_distinct(x))) / F.size(x)).otherwise(0.0))


def share(items: Column, pattern: str) -> Column:
    """The share of items in which the pattern is found; 0 for none."""
    hits = lambda x: F.size(F.filter(x, lambda y: F.regexp_like(y, F.lit(pattern))))
    return let(items, lambda x: F.when(F.size(x) > 0, hits(x) / F.size(x)).otherwise(0.0))


def lines_of(text: Column) -> Column:
    """Stripped lines that are not blank, where only LF ends a line."""
    return F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != "")
