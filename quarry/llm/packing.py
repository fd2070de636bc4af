"""Lexical retrieval packing: windows filled with BM25 neighbours of a seed document, with nothing padded."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import slices, written
from quarry.session import small_batches

_ODD = re.compile("[\x1c-\x1f]")


#: The printable stand-ins of a byte-level vocabulary for bytes, in the order of the bytes: a fixed rule.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_STANDS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: What the vocabulary's own splitter takes for one piece of lower-case text: a fixed pattern.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class _Kept(dict):
    """What chunks of text encode to; when it is full it becomes the older half, from which what is met again moves over."""

    def __init__(self, encode, most: int, chars: int):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.encode, self.most, self.chars = encode, most, chars

    def __missing__(self, chunk: str) -> bytes:
        if (found := self.older.get(chunk)) is None:
            found = self.encode(chunk)
        if len(chunk) <= self.chars:
            self[chunk] = found
        return found

    def turn(self) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()


class WordBpe:
    """A word-end vocabulary of the tokenizers library. It drops white space, so texts are encoded chunk by chunk.

    The library merges each piece once; texts that hold white space which only Python's str knows, and chunks with code points
    that Python's Unicode tables do not print, as unassigned ones, go through the library whole. Entries kept are bounded in number and length.
    """

    def __init__(self, path: str, kept: int = 300_000, kept_chars: int = 32):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.merge = self.library.model.tokenize
        self.vocabulary = _vocabulary(path)
        self.width, self.code = ("<u4", "I") if self.vocabulary > 1 << 16 else ("<u2", "H")
        self.chunks = _Kept(self._chunk, kept, kept_chars)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_STANDS)
        return array(self.code, [t.id for t in self.merge(shown)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Of one piece, the library's merges; of several, what they encode to."""
        if not chunk.isascii() and not chunk.isprintable():
            return self._whole(chunk)
        if chunk.isalpha():
            return self._piece(chunk)
        own = self.chunks.__getitem__
        if chunk[-1] in ".," and chunk[:-1].isalpha():
            return own(chunk[:-1]) + own(chunk[-1]) if len(chunk) > 1 else self._piece(chunk)
        pieces = _PIECES.findall(chunk)
        return b"".join(map(own, pieces)) if len(pieces) > 1 else self._piece(chunk)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text as the bytes of unsigned integers."""
        own, out = self.chunks.__getitem__, []
        for text in texts:
            out.append(self._whole(text) if _ODD.search(text) else b"".join(map(own, self._lower(text).split())))
            self.chunks.turn()
        return out

    @staticmethod
    def _lower(text: str) -> str:
        """NFC, then each character's own lower case: at a word's end too, a capital sigma is an inner one."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


_READY: dict[str, WordBpe] = {}


def _tokenizer(path: str) -> WordBpe:
    if path not in _READY:
        _READY.clear()
        _READY[path] = WordBpe(path)
    return _READY[path]


#: Terms of a document that decide where it goes.
_ROUTES = 3


def _clocks(vocabulary: int, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each route the terms in the order in which exponential clocks go off, faster for later, rarer merges, and each term's rank in it.

    The first of a document's terms is one of them drawn by weight, the same one for like documents.
    """
    times = np.random.default_rng(seed).exponential(size=(_ROUTES, vocabulary)) / np.log2(np.arange(vocabulary) + 2)
    orders = [np.argsort(t) for t in times]
    return [(order, np.argsort(order).astype(np.int32)) for order in orders]


def _terms(docs: list[np.ndarray], vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of each document: (document, term, count), in that order, and where each document's begin."""
    sizes = np.array([len(d) for d in docs], np.int64)
    kind = np.uint32 if len(docs) * vocabulary < 1 << 32 else np.uint64
    keys = np.repeat(np.arange(len(docs), dtype=kind) * kind(vocabulary), sizes)
    keys += np.concatenate(docs).astype(kind) if docs else keys
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(keys)))
    doc, term = np.divmod(keys[first], kind(vocabulary))
    return doc.astype(np.int64), term.astype(np.int64), count, np.searchsorted(doc, np.arange(len(docs) + 1))


#: A row for each document, and at the end of a task one with the document frequencies it has seen, the number of documents and of ids.
_TOKENS = "kind int, doc_id long, ids binary, route long, tie long"


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """_TOKENS. kind 0, for each row of docs: the ids of the whole text (null: empty), then end_id, as a binary of unsigned integers.

    route is made of terms drawn by weight from the document, the same ones for like documents, so that documents which are
    near in its order share terms; tie spreads documents of one route.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(path)
        vocabulary = max(own.vocabulary, end_id + 1)
        clocks = _clocks(vocabulary)
        part, row, total, df = TaskContext.get().partitionId(), 0, 0, np.zeros(vocabulary, np.int64)
        for batch in batches:
            for first, texts in slices(batch):
                found = [x + array(own.code, [end_id]).tobytes() for x in own.encode(texts)]
                ids, n = [np.frombuffer(x, own.width) for x in found], len(texts)
                _, term, _, begins = _terms(ids, vocabulary)
                df += np.bincount(term, minlength=vocabulary)
                total += sum(map(len, ids))
                routes = np.zeros(n, np.int64)
                for order, rank in clocks:
                    routes = routes << 20 | order[np.minimum.reduceat(rank[term], begins[:-1])]
                tie = pa.array([hash((part, row + k)) & 0x7FFFFFFF for k in range(n)], pa.int64())
                row += n
                columns = [pa.array(np.zeros(n, np.int32)), batch.column("doc_id").slice(first, n), pa.array(found, pa.binary()), pa.array(routes), tie]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _TOKENS.split(", ")])
        sums = np.append(df, [row, total]).astype("<i8").tobytes()
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), none, pa.array([sums], pa.binary()), none, none], [c.split()[0] for c in _TOKENS.split(", ")])

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut.mapInArrow(run, _TOKENS)


def _frequencies(tokens: DataFrame, vocabulary: int) -> tuple[np.ndarray, int, float]:
    """Over all documents: how many hold each term, how many there are, and their mean length. What comes to the driver is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(vocabulary + 2, np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                sums += np.frombuffer(x.as_py(), "<i8")
        has = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(sums[has])], ["term", "n"])

    sums = np.zeros(vocabulary + 2, np.int64)
    found = tokens.where("kind = 1").select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sums[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return sums[:-2], int(sums[-2]), sums[-1] / max(sums[-2], 1)


class Index:
    """A BM25 inverted index of one shard, with corpus-wide document frequencies.

    Terms that over an eighth of the shard holds are rows of a matrix, all others lists of postings.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
        doc, term, count, cuts = _terms(docs, len(idf))
        tf, length = count.astype(np.float32), np.array([len(d) for d in docs], np.float32)[doc]
        weight = (idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))).astype(np.float32)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.begins = np.searchsorted(term[order], np.arange(len(idf) + 1))
        common = np.flatnonzero(np.diff(self.begins) > len(docs) / 8)
        self.row = np.full(len(idf), -1)
        self.row[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), len(docs)), np.float32)
        for row, t in enumerate(common.tolist()):
            span = slice(self.begins[t], self.begins[t + 1])
            self.matrix[row, self.doc[span]] = self.weight[span]
        self.own, self.count = [term[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], len(docs)

    def scores(self, k: int) -> np.ndarray:
        """The BM25 score of every document of the shard for all distinct terms of document k."""
        rows = self.row[self.own[k]]
        asked = np.zeros(len(self.matrix), np.float32)
        asked[rows[rows >= 0]] = 1
        score = (asked @ self.matrix).astype(np.float64)
        spans = [slice(self.begins[t], self.begins[t + 1]) for t in self.own[k][rows < 0].tolist()]
        if spans:
            score += np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.count)
        return score

    def neighbours(self, k: int, unused: np.ndarray) -> np.ndarray:
        """The unused documents that share a term with document k, best first; ties in input order."""
        score = self.scores(k)
        found = np.flatnonzero(unused & (score > 0))
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces of a shard.

    The first unused document seeds a window and its unused neighbours fill it, best first; when they are used up, the next unused
    document seeds what is left. A document that does not fit is cut, and its rest seeds the next window. The last window
    is cut into powers of two, which need no padding.
    """
    index = Index(docs, idf, mean)
    unused = np.ones(len(docs), bool)
    sequence, used, lowest, first = 0, 0, 0, 0
    seed: int | None = None
    rest: int | None = None
    near: Iterator[int] | None = None
    window: list[tuple[int, int, int]] = []
    while True:
        if rest is not None:
            k, seed, near = rest, rest, None
        else:
            first, k = 0, None
            if seed is not None:
                near = iter(index.neighbours(seed, unused).tolist()) if near is None else near
                k = next((x for x in near if unused[x]), None)
            if k is None:
                while lowest < len(docs) and not unused[lowest]:
                    lowest += 1
                if lowest == len(docs):
                    break
                k, seed, near = lowest, lowest, None
            unused[k] = False
        length = min(len(docs[k]) - first, capacity - used)
        window.append((k, first, length))
        used, first = used + length, first + length
        rest = k if first < len(docs[k]) else None
        if used == capacity:
            offset = 0
            for doc, start, n in window:
                yield doc, start, n, sequence, offset
                offset += n
            window, used, sequence, seed = [], 0, sequence + 1, None
    room, offset = 0, 0
    for doc, start, n in window:
        while n:
            if not room:
                sequence, room, offset = sequence + bool(offset), 1 << (used.bit_length() - 1), 0
            cut = min(n, room)
            yield doc, start, cut, sequence, offset
            start, n, room, offset, used = start + cut, n - cut, room - cut, offset + cut, used - cut


def _vocabulary(path: str) -> int:
    """How many ids a tokenizers file has; the driver needs no more of it."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    return 1 + max([*held["model"]["vocab"].values(), *(x["id"] for x in held.get("added_tokens", []))])


def packed(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 4096, shard_docs: int = 2048, shard_tokens: int = 4_000_000, most_parts: int = 100_000) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset), a row for each piece of each row of docs (doc_id, text).

    Ids are those of the tokenizers file at path, then end_id; a null text counts as an empty one and has that id alone. Every
    id lies in one piece, and every sequence has a power of two of them, capacity at most, so nothing is padded; ids in the result are
    little-endian unsigned 32-bit integers. Documents are routed to shards by terms drawn from them by weight, not by where they
    lie in the files: they are put in the order of those terms, and each shard_docs documents, or as many as reach shard_tokens, in that order are a
    shard, whose index is asked with all terms of a seed; term statistics cover all documents. What a seed's shard does not hold
    is not its neighbour. Repeated rows are packed each; a null doc_id keeps its pieces; a text of any length is cut over as
    many windows as it needs; an empty table gives no rows. capacity must be a power of two.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    vocabulary = max(_vocabulary(path), end_id + 1)
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    tokens = written(tokenized(docs, path, end_id), "tokens")
    df, count, mean = _frequencies(tokens, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((np.log(1 + (count - df + 0.5) / (df + 0.5))).astype(np.float32))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        names, held, size = [], [], 0
        for batch in batches:
            for name, x in zip(batch.column("doc_id"), batch.column("ids"), strict=True):
                names.append(name.as_py())
                held.append(np.frombuffer(x.as_py(), width))
                size += len(held[-1])
                if len(held) >= shard_docs or size >= shard_tokens:
                    yield names, held
                    names, held, size = [], [], 0
        if held:
            yield names, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        for names, held in shards(batches):
            rows = list(pack_shard(held, shared.value, mean, capacity))
            for at in range(0, len(rows), 4000):
                doc, start, length, own, offset = zip(*rows[at : at + 4000], strict=True)
                ids = [held[k][a : a + n].astype("<u4").tobytes() for k, a, n in zip(doc, start, length, strict=True)]
                long = lambda x: pa.array(x, pa.int64())
                columns = [long([names[k] for k in doc]), long(start), long(length), pa.array(ids, pa.binary()), long([len(held[k]) for k in doc]), long([sequence + s for s in own]), long(offset)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            sequence += rows[-1][3] + 1

    parts = max(1, min(most_parts, max(int(count * mean) // shard_tokens, count // shard_docs)))
    routed = tokens.where("kind = 0").repartitionByRange(parts, "route", "tie").sortWithinPartitions("route", "tie").select("doc_id", "ids")
    return routed.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
