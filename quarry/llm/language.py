"""Language identification: the family first, then one-versus-one machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.linear import bounded_sample, grams, sigmoid, slots, support_vectors
from quarry.llm.rows import kept_fields, with_results
from quarry.session import small_batches

#: Families of closely related languages by their codes: fixed values. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
UNDETERMINED = "und"
BITS = 13
SIZES = range(1, 4)
_LETTER = regex.compile(r"\p{L}")


def features(text: str) -> np.ndarray:
    """Square roots of hashed n-gram counts, scaled to length one."""
    counts = np.sqrt(np.bincount(slots(grams(text, SIZES), BITS), minlength=1 << BITS).astype(np.float32))
    return counts / np.linalg.norm(counts)


class Model:
    """Machines one family against the rest, and for each pair of languages of a family."""

    def __init__(self, x: np.ndarray, labels: list[str], families: dict[str, tuple[str, ...]]):
        of = {code: name for name, codes in families.items() for code in codes}
        self.languages = sorted(set(labels))
        groups: dict[str, list[str]] = {}
        for language in self.languages:
            groups.setdefault(of.get(language, language), []).append(language)
        label = np.array(labels)
        self.groups = [groups[name] for name in sorted(groups)]
        machine = lambda rows, positive: support_vectors(x[rows], np.where(np.isin(label[rows], positive), 1.0, -1.0))
        every = np.arange(len(label))
        weights = [machine(every, g) for g in self.groups] if len(self.groups) > 1 else []
        self.pairs = [(g, a, b) for g in self.groups for a, b in combinations(g, 2)]
        weights += [machine(np.flatnonzero(np.isin(label, (a, b))), (a,)) for _, a, b in self.pairs]
        self.weights = np.array(weights, np.float32).reshape(len(weights), -1) if weights else np.zeros((0, x.shape[1] + 1), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score from 0 to 1: the family's part times the mean part against its relatives."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        margins = self.weights[:, :-1] @ features(text) + self.weights[:, -1]
        group, part = self.groups[0], 1.0
        if len(self.groups) > 1:
            parts = sigmoid(4 * margins[: len(self.groups)])
            best = int(parts.argmax())
            group, part = self.groups[best], float(parts[best])
        won = dict.fromkeys(group, 0.0)
        votes = dict.fromkeys(group, 0)
        for (own, a, b), margin in zip(self.pairs, margins[len(self.weights) - len(self.pairs) :].tolist(), strict=True):
            if own is group:
                p = float(sigmoid(np.float64(4 * margin)))
                won[a], won[b] = won[a] + p, won[b] + 1 - p
                votes[a if margin >= 0 else b] += 1
        winner = min(group, key=lambda g: (-votes[g], -won[g], g))
        return winner, part * (won[winner] / (len(group) - 1) if len(group) > 1 else 1.0)


def fit(docs: DataFrame, training: Column, per_language: int = 300, families: dict[str, tuple[str, ...]] | None = None, languages: int = 1000) -> Model:
    """A model from the text and lang of rows where training holds and lang is not null, about per_language distinct texts of each language.

    The sample is chosen by a hash of the text, and equal texts of one language count once, so that no key or group of copies can
    fill it; more than `languages` languages are an error. Only features of the sample, of a fixed size, come to the driver. Without any
    rows the model knows no language and predicts none.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sample = bounded_sample(rows, "lang", F.col("text"), per_language, languages).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                if (t := text.as_py()) and _LETTER.search(t):
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([features(t).astype(np.float16).tobytes()], pa.binary())], ["lang", "x"])

    found = sorted((r.lang, bytes(r.x)) for r in sample.mapInArrow(run, "lang string, x binary").collect())
    x = np.frombuffer(b"".join(b for _, b in found), np.float16).astype(np.float32).reshape(-1, 1 << BITS)
    return Model(x, [lang for lang, _ in found], FAMILIES if families is None else families)


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """(kept, lang_pred, score) for each row of docs: kept is the row itself as a struct; whole texts are read, and nothing but the text counts.

    A text that is null or has no letter gets `und` and the score 0. Repeated rows, null doc_ids and columns of any name stay as
    they are, a row each; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> list[pa.Array]:
        found = [shared.value.predict(t) for t in texts]
        return [pa.array([a for a, _ in found], pa.string()), pa.array([min(1.0, max(0.0, s)) for _, s in found], pa.float64())]

    return with_results(docs, run, "lang_pred string, score double")


def predicted(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, lang_pred and score of judged(); keep must not hold those two names."""
    return kept_fields(judged(docs.select(*dict.fromkeys((*keep, "text"))), model), keep, "lang_pred", "score")
