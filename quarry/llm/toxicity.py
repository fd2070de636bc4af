"""Toxicity: a linear machine on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.linear import bounded_sample, grams, sigmoid, slots
from quarry.llm.rows import kept_fields, with_results
from quarry.llm.scratch import slices
from quarry.session import small_batches

SIZES = range(4, 7)
BITS = 20
_MARK = np.zeros(1 << BITS, bool)


def present(text: str | None) -> np.ndarray:
    """The places of the n-grams that the whole text holds, in ascending order."""
    at = slots(grams(text or "", SIZES), BITS)
    _MARK[at] = True
    found = np.flatnonzero(_MARK)
    _MARK[found] = False
    return found


class Model:
    """The value of each n-gram's presence, which is scaled to vectors of length one, and the weight of each value."""

    def __init__(self, values: np.ndarray, weights: np.ndarray, bias: float, slope: float = 4.0, shift: float = 0.45):
        self.both = (values + 1j * (values * weights)).astype(np.complex64)  # side by side, so that a text reads one table
        self.bias, self.slope, self.shift = bias, slope, shift

    def score(self, text: str | None) -> float:
        own = self.both[present(text)]
        length = float(np.sqrt(own.real @ own.real))
        margin = (float(own.imag.sum(dtype=np.float64)) / length if length else 0.0) + self.bias
        return float(sigmoid(np.float64(self.slope * margin + self.shift)))


def _machine(sets: list[np.ndarray], labels: np.ndarray, values: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a machine with squared hinge loss, by dual coordinate descent on the sparse rows."""
    scaled = []
    for at in sets:
        own = values[at]
        length = float(np.sqrt(own @ own))
        scaled.append((own / length if length else own).astype(np.float32))
    weights, bias, alpha = np.zeros(len(values), np.float32), 0.0, np.zeros(len(sets))
    pick = np.random.default_rng(3)
    for _ in range(epochs):
        moved = 0.0
        for i in pick.permutation(len(sets)).tolist():
            at, own, y = sets[i], scaled[i], labels[i]
            margin = y * (float(weights[at] @ own) + bias)
            step = max(-alpha[i], (1 - margin - alpha[i] * 0.5 / cost) / (float(own @ own) + 1 + 0.5 / cost))
            if abs(step) > 1e-6:
                alpha[i] += step
                weights[at] += np.float32(step * y) * own
                bias += step * y
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, training: Column, per_class: int = 1000, chars_each: int = 2_000_000, smooth: float = 1.0, cost: float = 3.0, epochs: int = 20) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic) of the rows where training holds for labels' doc_id.

    About per_class doc_ids of either label are chosen by a hash, in the order of the hash as long as their texts have no more than
    chars_each characters together (one at least). A doc_id with several labels counts as toxic if one says so, one with several
    texts has the least; null doc_ids and labels do not count. Over the sample, the numbers of documents that hold an n-gram give its
    log-count ratio; an n-gram's value is the ratio times its distance from chance in standard errors, and a text's vector has
    length one. All n-grams have a place, of 2^20. Without rows of both labels the model gives every text the score 0.
    """
    small_batches(docs.sparkSession)
    known = labels.where(training & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("key")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = bounded_sample(known, "toxic", F.col("key"), per_class, classes=2)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("key"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "key").groupBy("key", "toxic").agg(F.min("text").alias("text"))
    sizes: dict[int, int] = {}
    picked = []
    for r in sorted(rows.select("key", "toxic", F.xxhash64("key").alias("h"), F.coalesce(F.length("text"), F.lit(0)).alias("n")).collect(), key=lambda r: (r.h, r.key)):
        if r.toxic not in sizes or sizes[r.toxic] + r.n <= chars_each:
            sizes[r.toxic] = sizes.get(r.toxic, 0) + r.n
            picked.append(r.key)
    if len(sizes) < 2:
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), -50.0)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [present(t).astype("<i4").tobytes() for _, own in slices(batch) for t in own]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(held, pa.binary())], ["toxic", "held"])

    picked_rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in picked], chosen.select("key").schema)), "key").select("toxic", "text")
    found = picked_rows.mapInArrow(marked, "toxic int, held binary").toArrow()
    sets, toxic = [np.frombuffer(x.as_buffer(), "<i4") for x in found.column("held")], found.column("toxic").to_numpy()
    order = sorted(range(len(sets)), key=lambda k: (toxic[k], len(sets[k]), sets[k].tobytes()[:64], zlib.crc32(sets[k])))  # whatever task found them
    sets, toxic = [sets[k] for k in order], toxic[order]
    counts = [np.bincount(np.concatenate([x for x, y in zip(sets, toxic, strict=True) if y == k]), minlength=1 << BITS) + smooth for k in (0, 1)]
    ratio = np.log(counts[1] / ((toxic == 1).sum() + 2 * smooth)) - np.log(counts[0] / ((toxic == 0).sum() + 2 * smooth))
    ratio[(counts[0] == smooth) & (counts[1] == smooth)] = 0  # n-grams that no document of the sample holds
    values = ratio * np.abs(ratio) / np.sqrt(1 / counts[0] + 1 / counts[1])
    return Model(values, *_machine(sets, np.where(toxic > 0, 1.0, -1.0), values, cost, epochs))


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """(kept, score) for each row of docs: kept is the row itself as a struct, score from 0 to 1; whole texts are read, and nothing but the text counts.

    Null and empty texts are scored like texts without any n-gram of the model. Repeated rows, null doc_ids and columns of any
    name stay as they are, a row each; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    score = lambda texts: [pa.array([shared.value.score(t) for t in texts], pa.float64())]
    return with_results(docs, score, "score double")


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep and score of judged(); keep must not hold that name."""
    return kept_fields(judged(docs.select(*dict.fromkeys((*keep, "text"))), model), keep, "score")
