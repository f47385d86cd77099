"""What each of several filters removes, in every order they can be applied, by a packed bitmap index.

Each partition packs its rows into NumPy bitsets: one for each filter that a
row fails, one for each label, one for each part. AND-NOT and popcount give,
for each set of filters applied before and each filter applied next, what that
filter removes, finds removed already and leaves; the counts of partitions are
summed, and every order of the filters reads its steps from these sums. Orders
are never applied to rows.

Defined results: a null text is empty and has no words; a null part is the
empty string; a row fails ``E`` if a smaller id has its text, so null ids never
fail it and never make others fail; an id with several rows of labels has a
label if one of them has it, an id without labels and a null id have none;
repeated rows count each; an empty table gives no rows; extra columns are
ignored. Texts are compared by SHA-256, words of one text by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, small_batches, stored
from .textscan import SPACED, Words, per_doc, slices

#: The failure conditions of the query, by the bit each has in ``fails``.
NAMES = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 200, 50, 3, b"#$%&*|"
#: Texts with more copies than a thousandth of all rows are at most a thousand.
HOT_SHARE, HOT_LEAST, SALTS = 1000, 10_000, 1024
#: Rows whose bitsets are counted together, and parts a task holds counts for.
ROWS, HELD_PARTS = 1 << 16, 1 << 12
MEASURES = ("removed", "redundant", "kept", "good_lost", "toxic_lost")
_CAPITAL, _SYMBOL, _STARTS = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool), np.ones(256, dtype=bool)
_CAPITAL[0x41:0x5B] = True
_SYMBOL[list(SYMBOLS)] = True
_STARTS[0x80:0xC0] = False


def text_fails(column: pa.Array) -> np.ndarray:
    """Bits A to D of each text."""
    out = []
    for s in slices(column):
        words = Words(s, SPACED, fold=False)
        n = np.diff(words.first)
        order = np.lexsort((words.hash, words.doc))
        h, d = words.hash[order], words.doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        distinct = np.bincount(d[new], minlength=s.n)
        capitals, chars, symbols = (per_doc(c[s.buf], s.offs) for c in (_CAPITAL, _STARTS, _SYMBOL))
        out.append((n < MIN_WORDS) | (100 * distinct < MIN_DISTINCT * n) << 1 | (100 * capitals > MAX_CAPITALS * chars) << 2 | (symbols > 0) << 3)
    return np.concatenate(out).astype(np.int32) if out else np.zeros(0, dtype=np.int32)


def document_fails(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, fails) of ``docs(doc_id, text, lang)``, written down: ``fails`` has the bits A to E."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(text_fails(b.column(3)))], names=["doc_id", "part", "digest", "fails"])

    seen = stored(small_batches(rows).mapInArrow(run, "doc_id long, part string, digest binary, fails int"), "fails")
    copies = stored(seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null"), "copies")
    most = max(HOT_LEAST, seen.count() // HOT_SHARE)
    # texts of very many copies go to all tasks, few as they are; their rows are then dealt out by their ids
    hot = copies.where(F.col("n") > most).select("digest", F.col("first").alias("hot"))
    cold = copies.where(F.col("n") <= most).select("digest", "first", F.lit(0).alias("salt"))
    rows = seen.join(F.broadcast(hot), "digest", "left")
    rows = rows.withColumn("salt", F.when(F.col("hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("doc_id", "fails"), F.lit(SALTS))).cast("int"))
    rows = rows.join(cold, ["digest", "salt"], "left")
    repeated = F.coalesce(F.col("doc_id") > F.coalesce("hot", "first"), F.lit(False))
    return rows.select("doc_id", "part", "digest", (F.col("fails") + 16 * repeated.cast("int")).alias("fails"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``; rows without an id are dealt out and meet no label."""
    of = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = of.agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    marks = marks.where("good or toxic").withColumn("salt", F.lit(0))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(0).cast("int")
    joined = rows.withColumn("salt", salt).join(marks, ["doc_id", "salt"], "left")
    return joined.select("part", "fails", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def _bits(mask: np.ndarray) -> np.ndarray:
    """``mask`` packed into 64-bit words."""
    out = np.zeros(-(-len(mask) // 64) * 8, dtype=np.uint8)
    packed = np.packbits(mask, bitorder="little")
    out[: len(packed)] = packed
    return out.view(np.uint64)


def steps(n_filters: int) -> list[tuple[int, int]]:
    """(set of filters applied before, filter applied next)."""
    return [(s, f) for s in range(1 << n_filters) for f in range(n_filters) if not s >> f & 1]


class Bitmaps:
    """Counts of one task, by part: for each step removed, redundant, kept, good lost, toxic lost."""

    def __init__(self, n_filters: int):
        self.n, self.steps, self.counts = n_filters, steps(n_filters), {}

    def add(self, table: pa.Table) -> None:
        parts = table.column("part").combine_chunks().dictionary_encode()
        code = parts.indices.to_numpy()
        order = np.argsort(code, kind="stable")  # each part's rows lie together, so its bitset covers few words
        code, fails = code[order], table.column("fails").to_numpy()[order]
        good, toxic = (_bits(table.column(c).combine_chunks().to_numpy(zero_copy_only=False)[order]) for c in ("good", "toxic"))
        failed = [_bits(fails >> f & 1 == 1) for f in range(self.n)]
        union = [np.zeros_like(good)]
        for s in range(1, 1 << self.n):
            low = (s & -s).bit_length() - 1
            union.append(union[s & (s - 1)] | failed[low])
        removed = np.stack([failed[f] & ~union[s] for s, f in self.steps])
        redundant = np.stack([failed[f] & union[s] for s, f in self.steps])
        kept = np.stack([~union[s | 1 << f] for s, f in self.steps])
        names = parts.dictionary.to_pylist()
        bounds = np.searchsorted(code, np.arange(len(names) + 1))
        for i, name in enumerate(names):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            words = slice(lo // 64, -(-hi // 64))
            mask = np.zeros((words.stop - words.start) * 64, dtype=bool)
            mask[lo - words.start * 64 : hi - words.start * 64] = True
            part = _bits(mask)
            took = removed[:, words] & part
            got = (took, redundant[:, words] & part, kept[:, words] & part, took & good[words], took & toxic[words])
            counts = np.stack([np.bitwise_count(g).sum(axis=1, dtype=np.int64) for g in got])
            self.counts[name] = self.counts[name] + counts if name in self.counts else counts

    def rows(self) -> pa.RecordBatch:
        names, n = list(self.counts), len(self.steps)
        counts = np.concatenate([self.counts[p] for p in names], axis=1) if names else np.zeros((5, 0), dtype=np.int64)
        before, filters = (np.tile(np.array(c, dtype=np.int32), len(names)) for c in zip(*self.steps, strict=True))
        self.counts = {}
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, dtype=object), n), pa.string()), pa.array(before), pa.array(filters), *map(pa.array, counts)], names=["part", "before", "filter", *MEASURES])


def step_counts(rows: DataFrame, n_filters: int) -> DataFrame:
    """Counts by (part, before, filter) of ``rows(part, fails, good, toxic)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held, n = Bitmaps(n_filters), [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= ROWS:
                index.add(pa.Table.from_batches(held))
                held, n = [], 0
                if len(index.counts) > HELD_PARTS:
                    yield index.rows()
        if n:
            index.add(pa.Table.from_batches(held))
        yield index.rows()

    schema = "part string, before int, filter int, " + ", ".join(f"{m} long" for m in MEASURES)
    return rows.mapInArrow(run, schema).groupBy("part", "before", "filter").agg(*[F.sum(m).alias(m) for m in MEASURES])


def audit_filters(rows: DataFrame, names: str = NAMES) -> DataFrame:
    """One row for each part, order of ``names`` and step, of ``rows(part, fails, good, toxic)``; ``fails`` has a bit for each name.

    The counts are 2 ** n * n / 2 rows a part and the orders n! * n, so this is for a handful of filters.
    """
    n, spark = len(names), rows.sparkSession
    weights = [(s, f, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()), s == (1 << n) - 1 - (1 << f)) for s, f in steps(n)]
    weights = spark.createDataFrame(weights, "before int, filter int, orders long, rest boolean")
    made = [("".join(names[i] for i in order), k + 1, sum(1 << f for f in order[:k]), order[k]) for order in permutations(range(n)) for k in range(n)]
    orders = spark.createDataFrame(made, "filter_order string, step int, before int, filter int")
    counts = durable(step_counts(rows, n))
    by_filter = counts.join(F.broadcast(weights), ["before", "filter"]).groupBy("part", "filter").agg(
        F.sum(F.when(F.col("rest"), F.col("removed")).otherwise(0)).alias("unique_fails"), F.sum(F.col("removed") * F.col("orders")).alias("shapley")
    )
    out = counts.join(F.broadcast(orders), ["before", "filter"]).join(by_filter, ["part", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five conditions A to E on ``docs``, by language."""
    return audit_filters(with_labels(document_fails(docs), labels))
