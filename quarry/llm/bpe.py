"""Byte-pair merges on a segment tree over positions, for single long pieces and for many short ones at once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

NONE = np.iinfo(np.int64).max
_AT = 1 << 40  # a tree value is rank * _AT + position, so the least one is the leftmost pair of the lowest rank; ranks are below 2^23


class Merges:
    """Which two adjacent tokens merge, in which order, and into what: looked up for whole arrays by binary search."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        """pairs: (left, right) to (rank, token)."""
        self.pairs = pairs
        left, right = (np.fromiter((p[i] for p in pairs), np.int64, len(pairs)) for i in (0, 1))
        keys = (left << 32) | right
        order = np.argsort(keys)
        self.keys = np.append(keys[order], NONE)
        self.rank = np.append(np.fromiter((x[0] for x in pairs.values()), np.int64, len(pairs))[order], 0)
        self.token = np.append(np.fromiter((x[1] for x in pairs.values()), np.int64, len(pairs))[order], 0)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair its place in the tables, and whether it is there."""
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        return at, self.keys[at] == key


def merge_long(ids: list[int], merges: Merges) -> list[int]:
    """One piece: each merge takes the root of the tree and renews the leaves of the live neighbours in logarithmic time."""
    n = len(ids)
    if n < 2:
        return ids
    pairs, ids = merges.pairs, list(ids)
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        if found := pairs.get((ids[i], ids[i + 1])):
            tree[size + i] = found[0] * _AT + i
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]

    def put(leaf: int, value: int) -> None:
        i = size + leaf
        if tree[i] == value:
            return
        tree[i] = value
        while i > 1:
            i >>= 1
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                return
            tree[i] = least

    def renew(i: int) -> None:
        found = pairs.get((ids[i], ids[after[i]])) if after[i] >= 0 else None
        put(i, found[0] * _AT + i if found else NONE)

    dead = bytearray(n)
    while tree[1] != NONE:
        i = tree[1] % _AT
        j = after[i]
        ids[i] = pairs[ids[i], ids[j]][1]
        dead[j] = 1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        put(j, NONE)
        renew(i)
        if before[i] >= 0:
            renew(before[i])
    return [x for x, gone in zip(ids, dead, strict=True) if not gone]


def _merge_class(ids: np.ndarray, lengths: np.ndarray, merges: Merges) -> np.ndarray:
    """Pieces in the rows of ids (row length a power of two), merged in step; -1 stands where a token was merged away."""
    count, size = ids.shape
    at = np.arange(size)
    tree = np.full((count, 2 * size), NONE)
    after = np.where(at + 1 < lengths[:, None], at + 1, -1)
    before = np.broadcast_to(at - 1, ids.shape).copy()
    if size > 1:
        place, there = merges.find(ids[:, :-1], ids[:, 1:])
        there &= after[:, :-1] >= 0
        tree[:, size : 2 * size - 1][there] = (merges.rank[place] * _AT + at[:-1])[there]
    step = size
    while step > 1:
        tree[:, step // 2 : step] = np.minimum(tree[:, step : 2 * step : 2], tree[:, step + 1 : 2 * step : 2])
        step //= 2
    rows = np.flatnonzero(tree[:, 1] != NONE)

    def put(r: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        i = leaf + size
        tree[r, i] = value
        for _ in range(size.bit_length() - 1):
            i = i >> 1
            tree[r, i] = np.minimum(tree[r, 2 * i], tree[r, 2 * i + 1])

    def renew(r: np.ndarray, i: np.ndarray) -> None:
        j = after[r, i]
        place, there = merges.find(ids[r, i], ids[r, j])
        put(r, i, np.where(there & (j >= 0), merges.rank[place] * _AT + i, NONE))

    while len(rows):
        i = tree[rows, 1] % _AT
        j = after[rows, i]
        place, _ = merges.find(ids[rows, i], ids[rows, j])
        ids[rows, i] = merges.token[place]
        ids[rows, j] = -1
        k = after[rows, j]
        after[rows, i] = k
        linked = k >= 0
        before[rows[linked], k[linked]] = i[linked]
        put(rows, j, np.full(len(rows), NONE))
        renew(rows, i)
        back = before[rows, i]
        linked = back >= 0
        renew(rows[linked], back[linked])
        rows = rows[tree[rows, 1] != NONE]
    return ids


def merge_many(raw: list[bytes], first_ids: np.ndarray, merges: Merges, last_ids: np.ndarray | None = None, dtype: str = "<u4", long: int = 256) -> list[bytes]:
    """The merged tokens of each piece, as the bytes of integers of dtype.

    first_ids has the token of each byte; last_ids, if given, that of a piece's last byte. Pieces are merged together by
    classes of length, those of over `long` bytes one at a time.
    """
    if not raw:
        return []
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    begins = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(raw), np.uint8)
    ids = first_ids[data]
    if last_ids is not None:
        ends = (begins + lengths - 1)[lengths > 0]
        ids[ends] = last_ids[data[ends]]
    out: list = [b""] * len(raw)
    width = np.dtype(dtype).itemsize
    classes = np.where(lengths > long, -1, np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
    for size_log in np.unique(classes).tolist():
        members = np.flatnonzero((classes == size_log) & (lengths > 0))
        if size_log < 0:
            for k in members.tolist():
                out[k] = np.array(merge_long(ids[begins[k] : begins[k] + lengths[k]].tolist(), merges), dtype).tobytes()
            continue
        size = 1 << size_log
        block = max(1, (1 << 18) // size)
        for first in range(0, len(members), block):
            part = members[first : first + block]
            inside = np.arange(size) < lengths[part, None]
            cells = np.full((len(part), size), -1, np.int64)
            cells[inside] = ids[(begins[part, None] + np.arange(size))[inside]]
            merged = _merge_class(cells, lengths[part], merges)
            live = merged >= 0
            flat, ends = merged[live].astype(dtype).tobytes(), (np.cumsum(live.sum(axis=1)) * width).tolist()
            a = 0
            for k, b in zip(part.tolist(), ends, strict=True):
                out[k] = flat[a:b]
                a = b
    return out


class Cache:
    """What chunks of text encode to, kept up to a bounded number of entries; encode_new does those not met yet."""

    def __init__(self, encode_new: Callable[[list[str]], list[bytes]], kept: int = 600_000, kept_chars: int = 64, group: int = 50_000):
        self.table: dict[str, bytes] = {}
        self.encode_new, self.kept, self.kept_chars, self.group = encode_new, kept, kept_chars, group

    def encode(self, cut: list[list[str]]) -> list[bytes]:
        """For each text, given as chunks, the joined encodings; texts go in groups whose own chunks stay close in memory."""
        if len(self.table) > self.kept:
            self.table.clear()
        groups, size = [[]], 0
        for chunks in cut:
            if size > self.group:
                groups.append([])
                size = 0
            groups[-1].append(chunks)
            size += len(chunks)
        own = [set(chain.from_iterable(g)) for g in groups]
        new = list(set().union(*(x.difference(self.table) for x in own)))
        self.table.update(zip(new, self.encode_new(new), strict=True))
        out = []
        for group, distinct in zip(groups, own, strict=True):
            near = dict(zip(distinct, map(self.table.__getitem__, distinct), strict=True)).__getitem__
            out += [b"".join(map(near, chunks)) for chunks in group]
        for chunk in new:
            if len(chunk) > self.kept_chars:
                del self.table[chunk]
        return out
