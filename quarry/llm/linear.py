"""Linear classifiers on byte n-grams: bounded samples, exact n-gram codes, and support vector machines in the dual."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every ASCII byte that is no letter becomes a space.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def grams(text: str, sizes: range) -> np.ndarray:
    """Codes of all byte n-grams of the lower-case text between spaces, repeats included; at most 7 bytes, so codes are exact."""
    data = np.frombuffer(b" " + text.lower().encode().translate(_LETTERS) + b" ", np.uint8).astype(np.uint64)
    out, code = [], data
    for n in range(1, sizes.stop):
        if n > 1:
            if len(data) < n:
                break
            code = code[:-1] | data[n - 1 :] << np.uint64(8 * (n - 1))
        if n >= sizes.start:
            out.append(code | np.uint64(n << 56))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def slots(codes: np.ndarray, bits: int) -> np.ndarray:
    """Each code's place in a table of 2^bits."""
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def bounded_sample(rows: DataFrame, label: str, key: Column, per_class: int, classes: int = 1000, seed: int = 11) -> DataFrame:
    """Rows of each label chosen by a hash of their key, so that about per_class of each remain: all, if there are no more.

    Rows of one key go or stay together, so the caller unites those that are equal. More than `classes` labels are an error, so
    that the size is bounded by their product, up to the chance in the hash.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).count().limit(classes + 1).collect()
    if len(counts) > classes:
        raise ValueError(f"more than {classes} labels")
    if not counts:
        return rows.limit(0)
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, per_class / r[1]))])
    return rows.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 31)) < F.element_at(rate, F.col(label)) * float(1 << 31))


def support_vectors(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 60) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss by dual coordinate descent; the last weight is the bias. y is +1 or -1."""
    kernel = (x @ x.T + 1).astype(np.float64)
    diagonal = kernel.diagonal() + 0.5 / cost
    alpha, score = np.zeros(len(y)), np.zeros(len(y))
    order = np.random.default_rng(3)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)).tolist():
            step = max(-alpha[i], (1 - y[i] * score[i] - alpha[i] * 0.5 / cost) / diagonal[i])
            if abs(step) > 1e-6:
                alpha[i] += step
                score += step * y[i] * kernel[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    signed = alpha * y
    return np.append(x.T @ signed.astype(x.dtype), signed.sum()).astype(np.float64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))
