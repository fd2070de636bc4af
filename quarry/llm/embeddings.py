"""Near-duplicate embeddings by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import connected_components
from quarry.llm.scratch import drop, written
from quarry.session import small_batches

_BITS = 62
#: A vector on its way to its place in the order, and a run of vectors of one width that lie together in it.
_ROW = "width long, code long, tie long, node long, copies long, vector binary, past binary"
_RUN = "part long, start long, size long, width long, code long, nodes binary, copies binary, vectors binary, past binary"


def passes_needed(vectors: int, tile_rows: int, threshold: float, recall: float = 0.97) -> int:
    """Passes after which a pair just at the threshold has stood in neighbouring tiles with the probability `recall`, if hyperplanes halve the data.

    That is the least; _Probes measure what the data need. A random hyperplane divides a pair at an angle of t with the probability t/pi; in a pass a pair meets if its
    hashes agree in as many leading bits as tell the tiles apart.
    """
    agree = 1 - math.acos(threshold) / math.pi
    hit = agree ** max(0.0, math.log2(max(vectors, 1) / tile_rows))
    return max(1, math.ceil(math.log(1 - recall) / math.log(max(1 - hit, 1e-9))))


def _units(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of one width as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as a binary."""
    data = np.ascontiguousarray(rows)
    each = data.shape[1] * data.itemsize
    ends = pa.array(np.arange(len(data) + 1, dtype=np.int32) * each).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(data), [None, ends, pa.py_buffer(data.tobytes())])


def _unpacked(column: pa.Array, rows: int, kind: str) -> np.ndarray:
    """The binaries of a column, of one length, as the rows of a matrix."""
    return np.frombuffer(b"".join(x.as_py() for x in column), kind).reshape(rows, -1)


def _means(points: DataFrame) -> dict[int, np.ndarray]:
    """The mean of the unit vectors of each width. A direction that all vectors share tells none of them apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                own = np.flatnonzero(widths == width)
                units = _units(_matrix(batch.column("embedding").take(pa.array(own))))
                held[width] = held.get(width, 0) + np.append(units.sum(axis=0), len(own))
        width = pa.array(np.repeat(np.array(list(held), np.int64), [w + 1 for w in held]))
        place = pa.array(np.concatenate([np.arange(w + 1) for w in held]) if held else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([width, place, pa.array(np.concatenate(list(held.values())) if held else np.empty(0))], ["width", "place", "x"])

    sums: dict[int, dict[int, float]] = {}
    for r in points.mapInArrow(run, "width long, place long, x double").groupBy("width", "place").agg(F.sum("x").alias("x")).collect():
        sums.setdefault(r.width, {})[r.place] = r.x
    return {w: np.array([x[k] for k in range(w)]) / x[w] for w, x in sums.items()}


def _codes(units: np.ndarray, mean: np.ndarray, seed: int) -> np.ndarray:
    """Sign hashes of the vectors less the mean on random hyperplanes, concatenated to one integer, whose order is lexicographic."""
    planes = np.random.default_rng([seed, units.shape[1]]).standard_normal((units.shape[1], _BITS))
    return ((units - mean) @ planes > 0) @ (1 << np.arange(_BITS - 1, -1, -1, dtype=np.int64))


class _Probes:
    """Made pairs just at the threshold, which tell from the tiles of each pass what share of such pairs has met.

    One of each pair is a row of the table, one of 512 by a hash, the other lies in a random direction from it.
    """

    def __init__(self, points: DataFrame, threshold: float, seed: int, count: int = 512):
        pick = np.random.default_rng(seed)
        self.pairs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        rows = points.orderBy(F.xxhash64("node")).limit(count).select("width", "embedding").collect()
        for width in sorted({r.width for r in rows if r.width > 1}):
            units = _units(np.array([r.embedding for r in rows if r.width == width]))
            away = pick.standard_normal(units.shape)
            away -= (away * units).sum(axis=1, keepdims=True) * units
            self.pairs[width] = units, threshold * units + math.sqrt(1 - threshold**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
        self.met = {width: np.zeros(len(a), bool) for width, (a, _) in self.pairs.items()}

    def add(self, runs: DataFrame, bases: dict[int, int], tile_rows: int, means: dict[int, np.ndarray], seed: int) -> None:
        """Where each probe would stand in the order: as many places as the rows of runs with lower codes; only those sums are collected."""
        flat = {w: np.unique(np.concatenate([_codes(x, means[w], seed) for x in pair])) for w, pair in self.pairs.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, start, size, width, code in zip(*[batch.column(c).to_pylist() for c in ("part", "start", "size", "width", "code")], strict=True):
                    if width in flat:
                        at = np.searchsorted(flat[width], code)  # the first probe that stands at or after the run
                        if at < len(flat[width]):
                            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (width, at, bases[part] + start, bases[part] + start + size)], ["width", "at", "first", "last"])

        place: dict[int, np.ndarray] = {w: np.full(len(c), -1, np.int64) for w, c in flat.items()}
        for r in runs.select("part", "start", "size", "width", "code").mapInArrow(run, "width long, at long, first long, last long").groupBy("width", "at").agg(F.max("first").alias("first")).collect():
            place[r.width][r.at] = r.first
        for w, pair in self.pairs.items():
            tile = np.maximum.accumulate(place[w]) // tile_rows
            at = [tile[np.searchsorted(flat[w], _codes(x, means[w], seed))] for x in pair]
            self.met[w] |= np.abs(at[0] - at[1]) <= 1

    def share(self) -> float:
        met = np.concatenate([np.ones(0, bool), *self.met.values()])
        return float(met.mean()) if len(met) else 1.0


class _Tile:
    """Vectors of one width that lie together in a pass: their nodes, copies, vectors as given, and the tiles they lay in before."""

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, vectors: np.ndarray, past: np.ndarray):
        self.nodes, self.copies, self.vectors, self.past = nodes, copies, vectors, past

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int, kind: str) -> _Tile:
        get = lambda c, k: np.frombuffer(batch.column(c)[i].as_py(), k)
        nodes = get("nodes", "<i8")
        return cls(nodes, get("copies", "<i8"), get("vectors", kind).reshape(len(nodes), -1), get("past", "<i8").reshape(len(nodes), -1))

    def cut(self, first: int, last: int) -> _Tile:
        return _Tile(*(x[first:last] for x in (self.nodes, self.copies, self.vectors, self.past)))

    def joined(self, more: _Tile) -> _Tile:
        return _Tile(*(np.concatenate((getattr(self, c), getattr(more, c))) for c in ("nodes", "copies", "vectors", "past")))


def _spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    left, todo, edges = linked.any(axis=1), [], []
    while todo or left.any():
        if not todo:
            todo = [int(left.argmax())]
            left[todo[0]] = False
        at = todo.pop()
        near = np.flatnonzero(linked[at] & left).tolist()
        left[near] = False
        edges += [(at, x) for x in near]
        todo += near
    return edges


def _compared(a: _Tile, b: _Tile | None, threshold: float) -> pa.RecordBatch | None:
    """Links of a tile with itself (b is None) or with the next; those that an earlier pass compared, in one tile or in neighbours, do not count.

    Rows (u, -1, links) have the links of a vector, rows (u, v, 0) connect what is linked.
    """
    units = _units(a.vectors)
    other, c = (units, a) if b is None else (_units(b.vectors), b)
    linked = units @ other.T >= threshold
    if b is None:
        linked = np.triu(linked, 1)
    i, j = np.nonzero(linked)
    again = (np.abs(a.past[i] - c.past[j]) <= 1).any(axis=1)
    linked[i[again], j[again]] = False
    if not linked.any():
        return None
    n, m = linked.shape
    links, nodes = np.concatenate((linked @ c.copies, a.copies @ linked)), np.concatenate((a.nodes, c.nodes))
    full = np.zeros((n, n) if b is None else (n + m, n + m), bool)
    full[:n, -m:] = linked
    edges = np.array(_spanning(full | full.T), np.int64).reshape(-1, 2)
    if b is None:
        links, nodes = links[:n] + links[n:], a.nodes
    has = np.flatnonzero(links)
    u = np.concatenate((nodes[has], nodes[edges[:, 0]]))
    v = np.concatenate((np.full(len(has), -1), nodes[edges[:, 1]]))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.concatenate((links[has], np.zeros(len(edges), np.int64))))], ["u", "v", "links"])


def _ordered(points: DataFrame, seed: int, means: dict[int, np.ndarray], kind: str, bases: dict[int, int] | None, tile_rows: int) -> DataFrame:
    """A row of _ROW for each vector with its code in this pass. points are (node, copies, width, embedding), or the runs of the pass before with its bases."""
    shared = points.sparkSession.sparkContext.broadcast(means)

    def block(t: _Tile) -> pa.RecordBatch:
        width = t.vectors.shape[1]
        code = _codes(_units(t.vectors), shared.value[width], seed)
        columns = [pa.array(x.astype(np.int64)) for x in (np.full(len(t.nodes), width), code, (t.nodes * -7046029254386353131) >> 1, t.nodes, t.copies)]
        return pa.RecordBatch.from_arrays([*columns, _binary(t.vectors.astype(kind)), _binary(t.past)], [c.split()[0] for c in _ROW.split(", ")])

    def from_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, nodes, copies = (batch.column(c).to_numpy() for c in ("width", "node", "copies"))
            for width in np.unique(widths).tolist():
                own = np.flatnonzero(widths == width)
                yield block(_Tile(nodes[own], copies[own], _matrix(batch.column("embedding").take(pa.array(own))), np.empty((len(own), 0), np.int64)))

    def from_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t, first = _Tile.of(batch, i, kind), bases[batch.column("part")[i].as_py()] + batch.column("start")[i].as_py()
                t.past = np.hstack((t.past, ((first + np.arange(len(t.nodes))) // tile_rows)[:, None]))
                yield block(t)

    return points.mapInArrow(from_points if bases is None else from_runs, _ROW)


def _runs(ordered: DataFrame, parts: int, tile_rows: int, kind: str) -> tuple[DataFrame, dict[int, int], int]:
    """The vectors in the order of their codes, as runs of a quarter of a tile at most; the place of the first vector of each part; and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, run_rows = TaskContext.get().partitionId(), 0, max(1, tile_rows // 4)
        for batch in batches:
            widths = batch.column("width").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                for at in range(low, high, run_rows):
                    rows = batch.slice(at, min(run_rows, high - at))
                    head = [pa.array([x], pa.int64()) for x in (part, start, rows.num_rows, rows.column("width")[0].as_py(), rows.column("code")[0].as_py())]
                    ints = [rows.column(c).to_numpy().astype("<i8").tobytes() for c in ("node", "copies")]
                    body = [*ints, *(b"".join(x.as_py() for x in rows.column(c)) for c in ("vector", "past"))]
                    yield pa.RecordBatch.from_arrays([*head, *[pa.array([x], pa.binary()) for x in body]], [c.split()[0] for c in _RUN.split(", ")])
                    start += rows.num_rows

    order = ["width", "code", "tie"]
    runs = written(ordered.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, _RUN), "runs")
    bases, total = {}, 0
    for part, size in sorted(tuple(r) for r in runs.groupBy("part").agg(F.sum("size")).collect()):  # a row for each part
        bases[part] = total
        total += size
    return runs, bases, total


def _links(runs: DataFrame, bases: dict[int, int], total: int, tile_rows: int, threshold: float, kind: str) -> DataFrame:
    """(u, v, links): each tile_rows vectors in the order of runs are a tile, which is compared with itself and the next.

    Tiles go to lanes of some that follow each other, and the first tile of a lane to the lane before as well.
    """
    spark = runs.sparkSession
    tiles = -(-total // tile_rows)
    each = max(1, min(16, tiles // (4 * spark.sparkContext.defaultParallelism)))
    lane_rows = each * tile_rows

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.array([bases[p] for p in batch.column("part").to_pylist()], np.int64) + batch.column("start").to_numpy()
            last = first + batch.column("size").to_numpy() - 1
            low, high = np.maximum(0, first - tile_rows) // lane_rows, last // lane_rows
            for step in range(int((high - low).max(initial=-1)) + 1):  # from the lane whose halo a run may reach to the one it ends in
                keep = np.flatnonzero(low + step <= high)
                rows = batch.take(pa.array(keep))
                columns = [pa.array((low + step)[keep]), pa.array(first[keep]), *[rows.column(c) for c in ("width", "nodes", "copies", "vectors", "past")]]
                yield pa.RecordBatch.from_arrays(columns, ["lane", "first", "width", "nodes", "copies", "vectors", "past"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, tile, now, before = -1, -1, {}, {}  # of the tile that is being filled, and of the one before, the vectors of each width

        def closed() -> Iterator[pa.RecordBatch]:
            if tile // each == lane:
                yield from filter(None, (_compared(t, None, threshold) for t in now.values()))
            yield from filter(None, (_compared(before[w], t, threshold) for w, t in now.items() if w in before))

        for batch in batches:
            for i in range(batch.num_rows):
                own, first, width = (batch.column(c)[i].as_py() for c in ("lane", "first", "width"))
                whole = _Tile.of(batch, i, kind)
                at, end = first, first + len(whole.nodes)
                while at < end:
                    number, stop = at // tile_rows, min(end, (at // tile_rows + 1) * tile_rows)
                    if (own, number) != (lane, tile):
                        yield from closed()
                        now, before = {}, now if own == lane and number == tile + 1 else {}
                        lane, tile = own, number
                    if own * each <= number <= (own + 1) * each:
                        part = whole.cut(at - first, stop - first)
                        now[width] = now[width].joined(part) if width in now else part
                    at = stop
        yield from closed()

    lanes = runs.mapInArrow(dealt, "lane long, first long, width long, nodes binary, copies binary, vectors binary, past binary")
    lanes = lanes.repartition(max(1, min(tiles // each + 1, 1 << 16)), "lane").sortWithinPartitions("lane", "first")
    return written(lanes.mapInArrow(compared, "u long, v long, links long"), "links", rows=0)


def _met(runs: DataFrame, bases: dict[int, int], tile_rows: int, threshold: float, kind: str, means: dict[int, np.ndarray], nodes: DataFrame, count: int = 64) -> float:
    """Of the true links of `count` vectors to others in runs, the share that some pass has compared."""

    def laid(t: _Tile, batch: pa.RecordBatch, i: int) -> np.ndarray:
        first = bases[batch.column("part")[i].as_py()] + batch.column("start")[i].as_py()
        return np.hstack((t.past, ((first + np.arange(len(t.nodes))) // tile_rows)[:, None]))

    chosen = {r.node for r in nodes.orderBy(F.xxhash64("node")).limit(count).collect()}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = _Tile.of(batch, i, kind)
                own = np.flatnonzero(np.isin(t.nodes, list(chosen)))
                if len(own):
                    yield pa.RecordBatch.from_arrays([_binary(_units(t.vectors)[own]), _binary(laid(t, batch, i)[own])], ["unit", "past"])

    found = runs.mapInArrow(pick, "unit binary, past binary").collect()
    samples = [(np.frombuffer(r.unit, "<f8"), np.frombuffer(r.past, "<i8")) for r in found]

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        true = met = 0
        for batch in batches:
            for i in range(batch.num_rows):
                t = _Tile.of(batch, i, kind)
                units, past = _units(t.vectors), laid(t, batch, i)
                for unit, lay in samples:
                    if len(unit) == units.shape[1]:
                        linked = np.flatnonzero(units @ unit >= threshold)
                        true, met = true + len(linked), met + int((np.abs(past[linked] - lay) <= 1).any(axis=1).sum())
        yield pa.RecordBatch.from_arrays([pa.array([true], pa.int64()), pa.array([met], pa.int64())], ["true", "met"])

    r = runs.mapInArrow(share, "true long, met long").agg(F.sum("true"), F.sum("met")).first()
    return (r[1] or 0) / (r[0] or 1) if r[0] else 1.0


def near_duplicates(table: DataFrame, threshold: float = 0.95, tile_rows: int = 1024, seed: int = 7, recall: float = 0.97, least_passes: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of table (vec_id, embedding; other columns are not looked at).

    Rows link if their cosine in double precision is at least threshold. In each pass the vectors are sorted by their
    concatenated random hashes and cut into tiles of tile_rows; every vector is compared with its own tile and the ones beside it.
    Links are counted where they are found, not listed: a pair counts in the first pass that compared it, which both rows know from
    the tiles they lay in. Codes are of the vectors less the corpus mean; cosines are those of the vectors as they are. Passes are as
    many as passes_needed() says, least_passes at least, and go on until the share `recall` of made pairs just at the threshold has met, as vectors that
    share a direction need more; where all vectors are two tiles, one pass compares all. Vectors that have as many links as a tile has rows may lie in a group that no window holds: they
    alone are sorted anew by further planes until that share of the true links of 64 of them has been compared.

    Equal vectors are one point with a count, and are linked without a search. Vectors that are null, empty, zero, or hold a
    null or non-finite component link with nothing, nor do vectors of different lengths. n_links counts the other rows linked
    directly, component_id is the smallest vec_id that links reach, kept says whether that is the row's own. Rows that repeat a
    vec_id each count; a null vec_id keeps its row, is linked by its vector, and is never kept. An empty table gives no rows.
    """
    spark = table.sparkSession
    small_batches(spark, 4096)
    kind = "<f4" if table.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    values = F.col("embedding").cast("array<double>")
    fit = F.coalesce(F.size(values) > 0, F.lit(False)) & F.forall(values, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(values, lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fit, values).alias("embedding"))
    points = rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("point"), F.count("*").alias("copies"))
    points = written(points.withColumn("node", F.monotonically_increasing_id()), "points", table.count())
    current = points.select("node", "copies", F.size("embedding").alias("width"), "embedding")
    count = points.count()
    found: list[DataFrame] = []
    means, probes, turn, bases = _means(current) if count else {}, _Probes(current, threshold, seed, 512 if count > 2 * tile_rows else 0), 0, None

    def one_pass(ordered: DataFrame, many: int) -> tuple[DataFrame, dict[int, int]]:
        runs, own, total = _runs(ordered, max(spark.sparkContext.defaultParallelism, many // (64 * tile_rows)), tile_rows, kind)
        found.append(_links(runs, own, total, tile_rows, threshold, kind))
        return runs, own

    at_once = count <= 2 * tile_rows  # two tiles stand beside each other, so one pass compares all
    while count > 1 and (turn < (1 if at_once else max(least_passes, passes_needed(count, tile_rows, threshold, recall))) or not at_once and probes.share() < recall):
        before = current if turn else None
        current, bases = one_pass(_ordered(current, seed + turn, means, kind, bases, tile_rows), count)
        if not at_once:
            probes.add(current, bases, tile_rows, means, seed + turn)
        turn += 1
        if before is not None:
            drop(before)
    if found:
        linked = reduce(DataFrame.unionByName, found).where("v < 0").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("n"))
        dense = written(linked.where(F.col("n") >= tile_rows).select("node"), "dense", count)
        many = dense.count()
        while many and (turn == 0 or _met(current, bases, tile_rows, threshold, kind, means, dense) < recall):
            ordered = _ordered(current, seed + turn, means, kind, bases, tile_rows).join(dense, "node", "left_semi").select(*[c.split()[0] for c in _ROW.split(", ")])
            current, bases = one_pass(ordered, many)
            turn += 1
    named = points.withColumn("root", F.col("node")).withColumn("links", F.lit(0).cast("long"))
    if found:
        every = reduce(DataFrame.unionByName, found)
        labels = connected_components(every.where("v >= 0").select("u", "v"), count).withColumnRenamed("component", "up")
        links = every.where("v < 0").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("n"))
        named = points.join(links, "node", "left").join(labels, "node", "left").withColumn("root", F.coalesce("up", "node")).withColumn("links", F.coalesce("n", F.lit(0)))
    named = written(named.select("embedding", "point", "root", (F.col("links") + F.col("copies") - 1).alias("links")), "named", count)
    least = named.groupBy("root").agg(F.min("point").alias("component"))
    named = named.join(least, "root").select("embedding", "links", "component")
    met = rows.where("embedding is not null").join(named, "embedding").select(
        "vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept")
    )
    alone = rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return met.unionByName(alone)
