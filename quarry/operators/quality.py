"""Document filters: quality, spam, repetition and personal data, as column expressions with the first reason that fails."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx

#: Marks of web boilerplate, bullets, ellipses, links and spam.
BOILERPLATE = (
    r"(?i)(?:cookie\s*polic|privacy\s*polic|termini\s*(?:di\s*)?(?:servizio|uso)|accett[ao]\s*(?:i\s*)?cookie|informativa\s*(?:sulla\s*)?privacy|"
    r"iscriviti\s*alla\s*newsletter|tutti\s*i\s*diritti\s*riservati|copyright\s*©|powered\s*by|all\s*rights\s*reserved|clicca\s*(?:qui|per)|"
    r"leggi\s*(?:tutto|di\s*più|anche)|condividi\s*(?:su|questo)|articoli?\s*correlat[io]|lascia\s*un\s*commento|tag(?:s)?:|categori[ae]:|"
    r"©\s*\d{4}|ultimo\s*aggiornamento|segui(?:ci)?\s*su|(?:facebook|twitter|instagram|linkedin|youtube|tiktok))"
)
BULLET = r"^\s*[-*•▪▸►◆◇→‣⁃]"
ELLIPSIS = r"\.{3,}|…"
LINK = r"(?i)https?://\S+"
SPAM = (
    "casino", "slot machine", "scommesse online", "viagra",
    "cialis", "forex trading", "guadagna subito",
    "lavoro da casa facile", "bitcoin gratis", "trading automatico",
    "prestito immediato", "dimagrire velocemente", "offerta esclusiva",
    "clicca qui per vincere", "congratulazioni hai vinto",
    "eredità milionaria", "principe nigeriano",
)
#: Personal data in the order in which they are replaced, by name, pattern and mark.
PERSONAL = (
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}\b", "<EMAIL>"),
    ("phone", r"(?<!\d)(?:\+39[\s\-]?)?(?:3[0-9]{2}[\s\-.]?[0-9]{3}[\s\-.]?[0-9]{4}|0[0-9]{1,3}[\s\-.]?[0-9]{4,8})(?!\d)", "<TELEFONO>"),
    ("tax_code", r"(?i)\b[A-Z]{6}[0-9]{2}[A-EHLMPRST][0-9]{2}[A-Z][0-9]{3}[A-Z]\b", "<CF>"),
    ("vat", r"\b(?:IT)?[0-9]{11}\b", "<PIVA>"),
    ("iban", r"(?i)\bIT\s?[0-9]{2}\s?[A-Z]\s?(?:[0-9]{5}\s?){2}[0-9A-Z]{12}\b", "<IBAN>"),
    ("ip", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "<IP>"),
    ("card", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", "<CC>"),
)


@dataclass(frozen=True)
class Limits:
    """Thresholds of the quality filter."""

    chars: tuple[int, int] = (100, 500_000)
    words: tuple[int, int] = (20, 100_000)
    uppercase: float = 0.40
    special: float = 0.30
    word_length: tuple[float, float] = (2.0, 20.0)
    line_repeats: float = 0.50
    paragraph_repeats: float = 0.30
    boilerplate: float = 0.50
    bullets: float = 0.70
    ellipses: float = 0.30
    links: float = 0.10
    repetition: float = 0.20


def measured(docs: DataFrame) -> DataFrame:
    """docs with one struct of all measures; a null text counts as an empty one."""
    body = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.withColumns({"_text": body, "_words": tx.words(body), "_lines": tx.lines(body), "_paragraphs": tx.paragraphs(body)})
    n, text = F.size("_words"), F.col("_text")
    per_word = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    letters = tx.held(text, r"\P{L}")
    measures = {
        "chars": F.length("_text"),
        "words": n,
        "uppercase": F.when(letters > 0, tx.held(text, r"\P{Lu}") / letters),
        "special": F.when(F.length("_text") > 0, tx.held(text, r"(?U)[\p{L}\p{N}\s]") / F.length("_text")).otherwise(0.0),
        "word_length": per_word(F.length(F.array_join("_words", ""))),
        "line_repeats": tx.repeated_share(F.col("_lines")),
        "paragraph_repeats": F.when(F.size("_paragraphs") >= 2, tx.repeated_share(F.col("_paragraphs"))).otherwise(0.0),
        "boilerplate": F.when(F.regexp_like(text, F.lit(BOILERPLATE)), tx.share(F.col("_lines"), BOILERPLATE)).otherwise(0.0),  # lines are looked at only where the text has any
        "bullets": tx.share(F.col("_lines"), BULLET),
        "ellipses": per_word(tx.count(text, ELLIPSIS)),
        "links": tx.count(text, LINK) / F.greatest(n, F.lit(1)),
    }
    return cut.withColumns({f"_{k}_m": v for k, v in measures.items()}).withColumn("m", F.struct(*[F.col(f"_{k}_m").alias(k) for k in measures])).drop(*[f"_{k}_m" for k in measures], "_text", "_words", "_lines", "_paragraphs")


def quality_reason(m: str = "m", limits: Limits = Limits()) -> Column:  # noqa: B008
    """The first quality check that fails, or null; checks are made in this order, and a ratio must pass its limit to fail."""
    at = lambda name: F.col(f"{m}.{name}")
    checks = [
        ("too_short", at("chars") < limits.chars[0]),
        ("too_long", at("chars") > limits.chars[1]),
        ("few_words", at("words") < limits.words[0]),
        ("many_words", at("words") > limits.words[1]),
        ("uppercase", at("uppercase") > limits.uppercase),
        ("special_chars", at("special") > limits.special),
        ("short_words", at("word_length") < limits.word_length[0]),
        ("long_words", at("word_length") > limits.word_length[1]),
        ("line_dup", at("line_repeats") > limits.line_repeats),
        ("para_dup", at("paragraph_repeats") > limits.paragraph_repeats),
        ("boilerplate", at("boilerplate") > limits.boilerplate),
        ("bullet_heavy", at("bullets") > limits.bullets),
        ("ellipsis", at("ellipses") > limits.ellipses),
    ]
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in checks])


def domains(text: Column) -> Column:
    """The hosts of all links in lower case, without ports."""
    return F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)), lambda u: F.lower(F.split(F.split(u, "/")[2], ":")[0]))


def from_blocked(rows: DataFrame, text: str, blocked: DataFrame) -> DataFrame:
    """rows whose text has a link to a host of blocked (domain): a semi join, so the list may be of any length."""
    own = rows.withColumn("_n", F.monotonically_increasing_id())
    hit = own.select("_n", F.explode(F.array_distinct(domains(F.col(text)))).alias("domain")).join(blocked.select("domain"), "domain", "left_semi").select("_n").distinct()
    return own.join(hit, "_n", "left_semi").drop("_n")


def spam_reason(text: Column, links: Column, blocked: tuple[str, ...] = (), keywords: tuple[str, ...] = SPAM, most: float = 0.10) -> Column:
    """link density, then blocked domains, then keywords in the lower-case text; the first keyword in the alphabet is named."""
    tests = [F.when(links > most, F.lit("url_density"))]
    if blocked:
        tests.append(F.when(F.arrays_overlap(domains(text), F.array(*[F.lit(d) for d in blocked])), F.lit("blacklist_domain")))
    tests += [F.when(F.contains(F.lower(text), F.lit(k)), F.lit(f"spam_keyword:{k}")) for k in sorted(keywords)]
    return F.coalesce(*tests)


def repetition(text: Column, n: int = 10) -> Column:
    """The share of word n-grams, in lower case, that repeat an earlier one; 0 for fewer than n words."""
    return tx.let(tx.words(F.lower(text)), lambda own: F.when(F.size(own) < n, 0.0).otherwise(tx.repeated_share(tx.ngrams(own, n))))


def redacted(text: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Personal data replaced kind by kind, so that an earlier kind may take the digits of a later one."""
    for name, pattern, mark in PERSONAL:
        if kinds is None or name in kinds:
            text = F.regexp_replace(text, pattern, mark)
    return text


def personal_counts(text: Column) -> list[Column]:
    """How often each mark stands in the redacted text beyond those that were there before."""
    after = redacted(text)
    return [(tx.count(after, mark) - tx.count(text, mark)).alias(f"n_{name}") for name, _, mark in PERSONAL]


def verdicts(docs: DataFrame, limits: Limits = Limits(), blocked: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """The chain in its fixed order, repetition, personal data, quality, spam: (doc_id, text, filter, reason, kept) for each row.

    Quality and spam see the text after redaction; text is the redacted text. Null texts count as empty.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    first = docs.select("doc_id", redacted(body).alias("text"), repetition(body).alias("_repetition"))
    m = measured(first)
    found = m.select(
        "doc_id",
        "text",
        F.when(F.col("_repetition") > limits.repetition, F.lit("repetition")).alias("_repeats"),
        quality_reason("m", limits).alias("_quality"),
        spam_reason(F.col("text"), F.col("m.links"), blocked, most=limits.links).alias("_spam"),
    )
    stage = F.when(F.col("_repeats").isNotNull(), "repetition").when(F.col("_quality").isNotNull(), "quality").when(F.col("_spam").isNotNull(), "spam")
    return found.select("doc_id", "text", stage.alias("filter"), F.coalesce("_repeats", "_quality", "_spam").alias("reason"), stage.isNull().alias("kept"))
