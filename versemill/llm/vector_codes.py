"""Compression of vectors to codebook indexes, with norm-of-sum bounds before exact distances.

Vectors become whole numbers and are cut into equal parts; each part position has a
codebook that is fitted by rounds of nearest assignment and floored means. With every
row travel, per part and group of entries, a lower bound of the distance to the group's
entries (without the assigned one) and the round that bound was measured in. All
codebooks so far are kept, so a later round lowers a bound by how far an entry has really
moved since that round, one norm of a sum, instead of the sum of its moves' norms. Only
groups whose bound does not exceed the exact distance to the assigned entry are measured
again. Assignments are exact: distances are whole numbers, and bounds are rounded down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versemill.llm.common import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
# Groups of consecutive entries that share a bound: three bytes a group and part of every row.
GROUPS = 4
# Bounds give way by this much, far more than the rounding of their square roots.
SLACK = 1e-9

STATE = (
    T.StructType()
    .add("x", T.ArrayType(T.IntegerType()))
    .add("code", T.BinaryType())
    .add("low", T.BinaryType())
    .add("stamp", T.BinaryType())
    .add("error", T.LongType())
    .add("measured", T.LongType())
)


@dataclass(frozen=True)
class Shape:
    parts: int
    entries: int
    width: int
    groups: int

    def edges(self) -> np.ndarray:
        """Where each group's entries begin and end."""
        return np.linspace(0, self.entries, self.groups + 1).astype(int)


def _half_down(values: np.ndarray) -> np.ndarray:
    """Half-precision numbers not above the given ones."""
    near = np.minimum(values, 60_000).astype(np.float16)
    return np.where(near.astype(np.float64) > values, np.nextafter(near, np.float16(-np.inf)), near).astype(np.float16)


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, exact for both whole and (below 2**53) real numbers."""
    if x.dtype.kind == "f":
        return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None, :]
    return ((x[:, None, :] - entries[None, :, :]) ** 2).sum(2)


def _exact_type(x: np.ndarray, books: np.ndarray) -> type:
    """Real numbers where all distances stay below 2**53, whole ones below 2**62, an error beyond."""
    reach = 2 * int(max(np.abs(x).max(initial=0), np.abs(books).max(initial=0)))
    bound = reach * reach * x.shape[-1] * x.shape[-2]
    if bound >= 1 << 62:
        raise ValueError("components are too large for whole squared distances")
    return np.float64 if bound < 1 << 52 else np.int64


class _Assigner:
    """Assigns rows to the last of several codebooks, using bounds measured against any of them."""

    def __init__(self, history: np.ndarray, shape: Shape) -> None:
        self.history, self.shape = history, shape
        self.now = len(history) - 1
        moved = np.sqrt(((history - history[-1]) ** 2).sum(-1).astype(float)) * (1 + SLACK)  # round, part, entry
        edges = shape.edges()
        self.group_of = np.repeat(np.arange(shape.groups), np.diff(edges))
        # Largest net move in a group since a round: of all entries, and of all but one.
        self.moved = np.stack([moved[:, :, a:b].max(-1, initial=0) for a, b in zip(edges, edges[1:])], -1)
        self.others = np.zeros_like(moved)
        for j in range(shape.entries):
            a, b = edges[self.group_of[j]], edges[self.group_of[j] + 1]
            rest = [k for k in range(a, b) if k != j]
            self.others[:, :, j] = moved[:, :, rest].max(-1, initial=0)

    def first(self, x: np.ndarray, p: int) -> tuple[np.ndarray, ...]:
        rows = np.arange(len(x))
        d = _distances(x, self.history[-1, p].astype(x.dtype))
        best = d.argmin(1)
        least = d[rows, best]
        rest = d.astype(float)
        rest[rows, best] = np.inf
        edges = self.shape.edges()
        low = np.stack([np.sqrt(rest[:, a:b].min(1, initial=np.inf)) for a, b in zip(edges, edges[1:])], 1)
        return best, least, low * (1 - SLACK), np.full(low.shape, self.now, np.uint8), np.full(len(x), self.shape.entries)

    def again(self, x: np.ndarray, p: int, code: np.ndarray, low: np.ndarray, stamp: np.ndarray) -> tuple[np.ndarray, ...]:
        rows = np.arange(len(x))
        book = self.history[-1, p].astype(x.dtype)
        edges = self.shape.edges()
        here = ((x - book[code]) ** 2).sum(1)
        move = self.moved[stamp, p, np.arange(self.shape.groups)[None, :]]
        own = self.group_of[code]
        move[rows, own] = self.others[stamp[rows, own], p, code]
        bound = low - move
        need = ~((bound > 0) & (bound * bound > here[:, None] * (1 + SLACK)))
        best, least = code.copy(), here.copy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for g, (a, b) in enumerate(zip(edges, edges[1:])):
            which = np.flatnonzero(need[:, g])
            d = _distances(x[which], book[a:b])
            found.append((which, d))
            if b == a or not len(which):
                continue
            at = d.argmin(1)
            value, entry = d[np.arange(len(which)), at], at + a
            better = (value < least[which]) | ((value == least[which]) & (entry < best[which]))
            best[which[better]], least[which[better]] = entry[better], value[better]
        low, stamp = low.copy(), stamp.copy()
        # The entry that was left is one of its group's others now; its distance is known.
        left = np.flatnonzero(best != code)
        g = own[left]
        low[left, g] = np.minimum(bound[left, g], np.sqrt(here[left].astype(float)) * (1 - SLACK))
        stamp[left, g] = self.now
        for g, (which, d) in enumerate(found):
            a, b = edges[g], edges[g + 1]
            rest = d.astype(float)
            inside = np.flatnonzero((best[which] >= a) & (best[which] < b))
            rest[inside, best[which[inside]] - a] = np.inf
            low[which, g] = np.sqrt(rest.min(1, initial=np.inf)) * (1 - SLACK)
            stamp[which, g] = self.now
        return best, least, low, stamp, 1 + (need * np.diff(edges)).sum(1)


def _bytes_matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype=kind).reshape(len(column), width)


def _whole(batch: pa.RecordBatch, shape: Shape) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, shape.parts, shape.width)


def _assign(history: np.ndarray, shape: Shape):
    """Rows with their codes, bounds, stamps and errors by the last codebook; rows without a code are new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = _Assigner(history, shape)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _whole(batch, shape)
            x = x.astype(_exact_type(x, history))
            fresh = "code" not in batch.schema.names
            n, cells = batch.num_rows, shape.parts * shape.groups
            code = np.zeros((n, shape.parts), np.uint8)
            low = np.zeros((n, shape.parts, shape.groups), np.float16)
            stamp = np.zeros(low.shape, np.uint8)
            error, measured = np.zeros(n, np.int64), np.zeros(n, np.int64)
            if not fresh:
                code[:] = _bytes_matrix(batch.column("code"), np.uint8, shape.parts)
                low[:] = _bytes_matrix(batch.column("low"), np.float16, cells).reshape(low.shape)
                stamp[:] = _bytes_matrix(batch.column("stamp"), np.uint8, cells).reshape(low.shape)
            for p in range(shape.parts):
                if fresh:
                    done = assigner.first(x[:, p], p)
                else:
                    done = assigner.again(x[:, p], p, code[:, p].astype(int), low[:, p].astype(float), stamp[:, p])
                code[:, p], low[:, p], stamp[:, p] = done[0], _half_down(done[2]), done[3]
                error += done[1].astype(np.int64)
                measured += done[4]
            blobs = [pa.array([row.tobytes() for row in a], pa.binary()) for a in (code, low, stamp)]
            kept = [batch.column("carry"), batch.column("x"), *blobs, pa.array(error), pa.array(measured)]
            yield pa.RecordBatch.from_arrays(kept, ["carry", *STATE.names])

    return run


def _sums(shape: Shape):
    """Per task and entry: the sums and the number of the parts assigned to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((shape.parts, shape.entries, shape.width + 1), np.int64)
        for batch in batches:
            x = _whole(batch, shape).astype(np.int64)
            code = _bytes_matrix(batch.column("code"), np.uint8, shape.parts)
            for p in range(shape.parts):
                np.add.at(total[p, :, :-1], code[:, p], x[:, p])
                total[p, :, -1] += np.bincount(code[:, p], minlength=shape.entries)
        part, entry = np.nonzero(total[:, :, -1])
        for k in range(shape.width + 1):
            cells = [pa.array(part), pa.array(entry), pa.array(np.full(len(part), k)), pa.array(total[part, entry, k])]
            yield pa.RecordBatch.from_arrays(cells, ["part", "entry", "place", "total"])

    return run


def whole_vectors(
    vectors: DataFrame, vector_col: str = "embedding", parts: int = PARTS, scale: int = SCALE
) -> tuple[DataFrame, int]:
    """(carry, x) of the usable rows and their length: ``carry`` holds the other columns, ``x`` floor(scale * component).

    Null vectors and vectors with a null or non-finite component are left out, and so are
    those of another length than most usable ones have (of ties the longer).
    """
    vector = F.col(vector_col).cast("array<double>")
    fine = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    usable = vectors.where(vector.isNotNull() & fine)
    lengths = usable.groupBy(F.size(vector_col).alias("length")).agg(F.count("*").alias("n")).where(f"length > 0 and length % {parts} = 0")
    most = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    length = most["length"] if most else -1
    carry = F.struct(*(F.col(f"`{c}`") for c in vectors.columns if c != vector_col))
    whole = F.transform(vector, lambda v: F.floor(v * scale).cast("int"))
    return usable.where(F.size(vector_col) == length).select(carry.alias("carry"), whole.alias("x")), length


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    groups: int = GROUPS,
) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): carry (the other columns), x, code (a byte a part), error and measured; part by entry by place.

    The codebooks start as the parts of the smallest ids, ascending, null ids last and
    equal ids by vector; with fewer rows than entries there are as many entries as rows.
    Ties go to the lower index; entries without parts stay. Equal vectors get equal codes.
    No rows give no rows and empty codebooks. ``measured`` counts the exact distances of
    the last round. Sums are gathered per entry in each task; parts * entries * width of
    them reach the driver. Each round's rows are written to the shared folder.
    """
    if not 1 <= entries <= 256 or rounds > 255:
        raise ValueError("codes and stamps are single bytes")
    rows, length = whole_vectors(vectors, vector_col, parts, scale)
    start = [r.x for r in rows.orderBy(F.col(f"carry.`{id_col}`").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    schema = T.StructType([rows.schema["carry"], *STATE.fields])
    if not start:
        return vectors.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    shape = Shape(parts, len(start), length // parts, min(groups, len(start)))
    book = np.array(start, np.int64).reshape(len(start), parts, shape.width).transpose(1, 0, 2)
    history = [book]
    for _ in range(rounds):
        rows = stored(rows.mapInArrow(_assign(np.stack(history), shape), schema), "codes")
        counted = rows.select("x", "code").mapInArrow(_sums(shape), "part long, entry long, place long, total long")
        sums = np.zeros((parts, shape.entries, shape.width + 1), np.int64)
        for r in counted.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect():
            sums[r.part, r.entry, r.place] = r.total
        number = sums[:, :, -1:]
        history.append(np.where(number > 0, sums[:, :, :-1] // np.maximum(number, 1), history[-1]))
    return rows.mapInArrow(_assign(np.stack(history), shape), schema), history[-1]


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decode(code: Column, books: np.ndarray, scale: int = SCALE) -> Column:
    """The vectors that codes stand for: the middles of their entries' cells."""
    parts, entries, _ = books.shape
    table = F.lit([[(int(v) + 0.5) / scale for v in entry] for part in books for entry in part])
    digits = F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)),
        lambda p: p * entries + F.conv(F.hex(F.substring(code, p + 1, F.lit(1))), 16, 10).cast("int"),
    )
    return F.flatten(F.transform(digits, lambda k: F.get(table, k)))
