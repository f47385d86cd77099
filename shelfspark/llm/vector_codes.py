"""Product codes of vectors: integer components, one codebook for each part, nearest entries by kd-trees.

A component x becomes the integer floor(scale * x). Vectors are cut into equal
parts; each part position has a codebook, which starts as that part of the
vectors of the least ids. A round broadcasts one kd-tree for each codebook;
tasks find every part's nearest entry by branch and bound and add up integers,
Spark sums them, and each entry becomes the floor of its mean. Nodes whose
bound equals the best distance are visited too, so of equally near entries the
one of the lowest index wins. All arithmetic is on integers, so results do not
depend on how rows are dealt out; components too large for 64-bit arithmetic
are handled as Python's.

The model (parts x entries x positions integers) has a fixed size; only it and
its sums pass the driver.

Defined results: rows whose vector is null, empty, of a length that the parts
do not divide, or has a null or non-finite component are dropped; so are rows
whose vector has another length than that of the least id kept. Null ids come
last, repeated ids in the order of their vectors; repeated rows count each. Of
fewer vectors than entries, each is an entry. Null labels are one group.
Errors beyond a long are its greatest value. An empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Rows that are searched together.
ROWS = 1 << 13
LEAF = 8
#: Sums of up to so many label groups are broadcast.
BROADCAST_LABELS = 100_000
LIMB = 32
_LONG = (1 << 63) - 1


class Node:
    """A box of entries; ``entries`` only at leaves, in the order of their indices."""

    __slots__ = ("entries", "high", "left", "low", "right")

    def __init__(self, points: np.ndarray, entries: np.ndarray):
        own = points[entries]
        self.low, self.high = own.min(axis=0), own.max(axis=0)
        self.left = self.right = self.entries = None
        if len(entries) > LEAF:
            axis = int(np.argmax(self.high - self.low))
            cut = np.sort(own[:, axis])[(len(entries) - 1) // 2]
            below = own[:, axis] <= cut
            if below.all():  # many equal entries at the upper end
                below = own[:, axis] < cut
            if below.any():
                self.left, self.right = Node(points, entries[below]), Node(points, entries[~below])
        if self.left is None:
            self.entries = np.sort(entries)

    def bound(self, x: np.ndarray) -> np.ndarray:
        """The least squared distance that a point of the box can have from each row of ``x``."""
        away = np.maximum(np.maximum(self.low - x, x - self.high), 0)
        return (away * away).sum(axis=1)


class Tree:
    """A kd-tree over the entries of one codebook."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.root = Node(points, np.arange(len(points)))
        self.reach = max(abs(int(points.min())), abs(int(points.max())))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of, and squared distance to, the nearest entry of each row of ``x``."""
        reach = max(self.reach, abs(int(x.min())), abs(int(x.max()))) if len(x) else 0
        exact = np.int64 if x.shape[1] * (2 * reach + 1) ** 2 < _LONG else object
        x = x.astype(exact)
        index, best = np.full(len(x), -1, dtype=np.int64), np.zeros(len(x), dtype=exact)
        self._visit(self.root, np.arange(len(x)), x, index, best)
        return index, best

    def _visit(self, node: Node, rows: np.ndarray, x: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        if not len(rows):
            return
        if node.entries is not None:
            away = x[rows, None, :] - self.points[node.entries][None, :, :]
            d = (away * away).sum(axis=2)
            at = d.argmin(axis=1)
            d, found = d[np.arange(len(rows)), at], node.entries[at]
            better = (index[rows] < 0) | (d < best[rows]) | ((d == best[rows]) & (found < index[rows]))
            index[rows[better]], best[rows[better]] = found[better], d[better]
            return
        left, right = node.left.bound(x[rows]), node.right.bound(x[rows])
        nearer = left <= right
        for side, first, other, bound in ((nearer, node.left, node.right, right), (~nearer, node.right, node.left, left)):
            mine = rows[side]
            self._visit(first, mine, x, index, best)
            self._visit(other, mine[bound[side] <= best[mine]], x, index, best)


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit integers, or Python's if some are too large."""
    with np.errstate(over="ignore"):
        out = np.floor(values.astype(np.float64) * scale)
    if not out.size or np.abs(out).max() < 1 << 52:
        return out.astype(np.int64)
    whole = [math.floor(v * scale) if abs(v) < 1e18 else int(v) * scale for v in values.astype(np.float64).ravel().tolist()]
    return np.array(whole, dtype=object).reshape(values.shape)


def _matrix(column: pa.Array, scale: int) -> np.ndarray:
    """The integer components of a column of whole vectors of one length."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return integers(values, scale).reshape(len(column), -1)


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _limbs(value: int) -> list[int]:
    """``value`` by digits of ``LIMB`` bits, least first; the last one has the sign."""
    out = []
    while not -(1 << LIMB) < value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


class VectorCodes:
    """Codebooks that are fitted to a table and encode it."""

    def __init__(self, vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"):
        if entries > 256:
            raise ValueError("codes have two hexadecimal digits a part")
        self.spark, self.parts, self.scale = vectors.sparkSession, parts, scale
        self.label_type = vectors.schema[label].dataType
        rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).alias("label"))
        finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        whole = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0) & finite)
        self.first = self._least(whole, entries)
        self.length = len(self.first[0]) if self.first else 0
        if any(len(v) != self.length for v in self.first):
            self.first = self._least(whole.where(F.size("v") == self.length), entries)
        self.rows = whole.where(F.size("v") == self.length)
        start = integers(np.array(self.first, dtype=np.float64).reshape(len(self.first), parts, -1) if self.first else np.zeros((0, parts, 1)), scale)
        self.codebooks = [start[:, p, :] for p in range(parts)]
        for _ in range(rounds if self.first else 0):
            self._round()

    @staticmethod
    def _least(rows: DataFrame, n: int) -> list[list[float]]:
        """Vectors of the ``n`` least ids: at most ``n`` rows, which Spark keeps the top of in each partition."""
        return [r.v for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(n).select("v").collect()]

    def _trees(self):
        return self.spark.sparkContext.broadcast([Tree(c) for c in self.codebooks])

    def _round(self) -> None:
        """Assign every part and move each entry to the floor of its parts' mean."""
        trees, parts, scale = self._trees(), self.parts, self.scale
        k, d = self.codebooks[0].shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, sums = np.zeros((parts, k), dtype=np.int64), np.zeros((parts, k, d), dtype=object)
            for held in _larger(batches):
                x = _matrix(held.column("v").combine_chunks(), scale)
                for p in range(parts):
                    own = x[:, p * d : (p + 1) * d]
                    index, _ = trees.value[p].nearest(own)
                    counts[p] += np.bincount(index, minlength=k)
                    order = np.argsort(index, kind="stable")
                    # 2 ** 11 rows at a time: of components below 2 ** 52 they add up in 64 bits
                    for lo in range(0, len(order), 1 << 11):
                        piece = order[lo : lo + (1 << 11)]
                        used, first = np.unique(index[piece], return_index=True)
                        sums[p, used] += np.add.reduceat(own[piece], first, axis=0)
            out = []
            for p, e in np.argwhere(counts > 0).tolist():
                out.append((p, e, -1, 0, int(counts[p, e])))
                out += [(p, e, i, j, digit) for i in range(d) for j, digit in enumerate(_limbs(int(sums[p, e, i])))]
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.int32()] * 4, pa.int64()], strict=True)], names=["part", "entry", "position", "limb", "value"])

        found = self.rows.select("v").mapInArrow(run, "part int, entry int, position int, limb int, value long")
        total: dict[tuple[int, int, int], int] = {}
        for r in found.groupBy("part", "entry", "position", "limb").agg(F.sum("value").alias("value")).collect():  # as many rows as the model has integers
            at = (r.part, r.entry, r.position)
            total[at] = total.get(at, 0) + (r.value << (LIMB * r.limb))
        trees.unpersist()
        for p, book in enumerate(self.codebooks):
            moved = [[total[p, e, i] // total[p, e, -1] for i in range(d)] if (p, e, -1) in total else book[e].tolist() for e in range(k)]
            small = all(abs(x) < 1 << 52 for row in moved for x in row)
            self.codebooks[p] = np.array(moved, dtype=np.int64 if small else object)

    def fingerprint(self) -> str:
        """SHA-256 of all integers by part, entry and position."""
        return hashlib.sha256(",".join(str(int(x)) for c in self.codebooks for x in c.ravel()).encode()).hexdigest()

    def encode(self) -> DataFrame:
        """(vec_id, label, code, error) of every kept row."""
        schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", self.label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
        if not self.first:
            return self.spark.createDataFrame([], schema)
        trees, parts, scale, d = self._trees(), self.parts, self.scale, self.codebooks[0].shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            digits = np.array([f"{i:02x}".encode() for i in range(256)])
            for held in _larger(batches):
                x = _matrix(held.column("v").combine_chunks(), scale)
                code, error = np.zeros((len(x), parts), dtype=np.int64), np.zeros(len(x), dtype=object)
                for p in range(parts):
                    code[:, p], away = trees.value[p].nearest(x[:, p * d : (p + 1) * d])
                    error += away
                text = np.ascontiguousarray(digits[code]).view(f"S{2 * parts}").ravel()
                yield from pa.Table.from_arrays([held.column("vec_id"), held.column("label"), pa.array(text, pa.binary()).cast(pa.string()), pa.array(np.minimum(error, _LONG).astype(np.int64))], names=schema.names).to_batches()

        return self.rows.select("vec_id", "label", "v").mapInArrow(run, schema)

    def report(self) -> DataFrame:
        """(vec_id, code, error, label_error, codebooks_sha256, label) of every kept row."""
        rows = stored(self.encode(), "codes")
        total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
        sums = stored(rows.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "label-errors")
        few = sums.count() <= BROADCAST_LABELS
        joined = rows.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of")))
        return joined.select("vec_id", "code", "error", "label_error", F.lit(self.fingerprint()).alias("codebooks_sha256"), "label")


def vector_codes(vectors: DataFrame, **settings) -> DataFrame:
    return VectorCodes(vectors, **settings).report()
