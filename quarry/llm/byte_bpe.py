"""Byte-level BPE by rank files: encoding on a segment tree, decoding, and the query's digests."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import Cache, Merges, merge_many
from quarry.llm.scratch import slices
from quarry.session import small_batches

#: Chunks that no match of the pattern crosses: text with the one space before it, or white space.
_CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space to Python's str, but not to Unicode; texts that hold these are matched whole.
_ODD = re.compile("[\x1c-\x1f]")
#: White_Space of the Unicode character database: fixed values.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class ByteBpe:
    """A rank file with its pattern; what was encoded before is kept up to a bounded number of entries."""

    def __init__(self, path: str, pattern: str, kept: int = 600_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        own = self.ranks.get
        self.merges = Merges(
            {(own(t[:i]), own(t[i:])): (rank, rank) for t, rank in self.ranks.items() for i in range(1, len(t)) if own(t[:i]) is not None and own(t[i:]) is not None}
        )
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.whole = {t: array("I", [rank]).tobytes() for t, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"(?!\S)", f"(?![^{_SPACE}])").replace(r"\s+", f"[{_SPACE}]+"))
        self.pieces = Cache(self._encode_pieces, kept)
        self.chunks = Cache(lambda new: self.pieces.encode(list(map(self.pattern.findall, new))), kept)

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, as little-endian unsigned 32-bit integers."""
        raw = [p.encode() for p in pieces]
        whole = [self.whole.get(r) for r in raw]
        rest = [k for k, x in enumerate(whole) if x is None]
        for k, x in zip(rest, merge_many([raw[k] for k in rest], self.bytes, self.merges), strict=True):
            whole[k] = x
        return whole

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text, as little-endian unsigned 32-bit integers."""
        return self.chunks.encode([self.pattern.findall(t) if _ODD.search(t) else _CHUNKS.findall(t) for t in texts])

    def decode(self, ids: bytes) -> bytes:
        """The bytes that such ids stand for."""
        read = array("I")
        read.frombytes(ids)
        return b"".join(map(self.tokens.__getitem__, read))


_READY: dict[tuple[str, str], ByteBpe] = {}


def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One tokenizer for each worker process."""
    if (path, pattern) not in _READY:
        _READY[path, pattern] = ByteBpe(path, pattern)
    return _READY[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) for each row of docs (doc_id, text; other columns are not looked at).

    ids are little-endian unsigned 32-bit integers in a binary. Whole texts are encoded. A null text counts as an empty one, which
    has no ids. Repeated rows and null doc_ids give a row each; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            for first, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(own.encode(texts), pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, data) for each row of encoded(): data are the decoded bytes; null ids count as none. An unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            data = [own.decode(x.as_py() or b"") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(data, pa.binary())], ["doc_id", "ids", "data"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, data binary")
