"""Toxicity: a logistic classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of the text's bytes, A-Z folded and everything but
letters, digits and bytes from 0x80 made a blank, as present or absent in a
document and hashed to ``BUCKETS``. Document frequencies in toxic and other
training documents are counted on the executors; the ``TOP`` n-grams whose
frequencies differ most significantly keep their log-count ratio as scale, and
a logistic regression on the scaled features is fitted on the driver. The fit
sees about ``MAX_ROWS`` labelled documents at most, whatever the input's size;
every document is scored over its whole text.

Defined results: null and empty texts get the score of a document without
features; with labels of one class only (or none) every score is the smoothed
base rate; equal rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, small_batches
from .linear import fold_of, labelled_sample, lbfgs, logistic_loss, sigmoid
from .textscan import ALNUM, LOWER, Slice, slices

BITS = 20
BUCKETS = 1 << BITS
SIZES = (4, 5, 6)
TOP, MAX_ROWS, L2, FOLDS, HELD = 4096, 20_000, 1.0, 4, 2
FOLD_BYTE = np.where(ALNUM, LOWER, 0x20).astype(np.uint8)


def buckets(s: Slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of every n-gram of a slice, one pair of arrays for each size."""
    code = FOLD_BYTE[s.buf].astype(np.uint32) + np.uint32(1)
    doc = np.repeat(np.arange(s.n, dtype=np.int32), np.diff(s.offs))
    g = code
    for n in range(2, max(SIZES) + 1):
        if len(g) < 2:
            return
        g = g[:-1] * np.uint32(0x01000193) + code[n - 1 :]
        if n in SIZES:
            m = len(g)
            inside = doc[:m] == doc[n - 1 : n - 1 + m]
            h = g ^ (g >> np.uint32(15)) ^ np.uint32((n * 0x9E3779B1) & 0xFFFFFFFF)
            h = h * np.uint32(0x85EBCA6B)
            yield doc[:m][inside], (h >> np.uint32(32 - BITS)).astype(np.int32)[inside]


@dataclass
class Model:
    feature: np.ndarray  # bucket -> feature, or -1
    weight: np.ndarray
    bias: float

    def score(self, s: Slice) -> np.ndarray:
        doc, feat = present(s, self.feature, len(self.weight))
        return sigmoid(np.bincount(doc, self.weight[feat], minlength=s.n) + self.bias)


def present(s: Slice, feature: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs of a slice."""
    keys = [np.zeros(0, dtype=np.int64)]
    for doc, bucket in buckets(s):
        f = feature[bucket]
        hit = np.flatnonzero(f >= 0)
        keys.append(np.unique(doc[hit].astype(np.int64) * k + f[hit]))
    key = np.unique(np.concatenate(keys))
    return key // max(k, 1), key % max(k, 1)


def document_frequencies(sample: DataFrame) -> DataFrame:
    """(bucket, toxic, other): in how many documents of each class an n-gram occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            y = np.asarray(batch.column("y").to_numpy(zero_copy_only=False) > 0, dtype=np.int64)
            for s in slices(batch.column("text")):
                keys = np.unique(np.concatenate([d.astype(np.int64) * BUCKETS + b for d, b in buckets(s)] or [np.zeros(0, np.int64)]))
                cls = y[s.first + keys // BUCKETS]
                counts += np.bincount(cls * BUCKETS + keys % BUCKETS, minlength=2 * BUCKETS).reshape(2, BUCKETS)
        at = np.flatnonzero(counts.sum(axis=0))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[1][at]), pa.array(counts[0][at])], names=["bucket", "toxic", "other"])

    # a task sends a table of buckets back, so tasks follow the sample's bytes, not its partitions
    size = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part = sample.coalesce(max(8, size >> 23)).mapInArrow(run, "bucket long, toxic long, other long")
    return part.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, top: int = TOP, l2: float = L2) -> Model:
    sample = durable(labelled_sample(docs, labels, "toxic", FOLDS, HELD, max_rows))
    n = {r.y: r.n for r in sample.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        rate = (n1 + 1) / (n1 + n0 + 2)
        return Model(np.full(BUCKETS, -1, dtype=np.int32), np.zeros(1), float(np.log(rate / (1 - rate))))
    p1, p0 = F.col("toxic") / n1, F.col("other") / n0
    p = (F.col("toxic") + F.col("other") + 1) / (n1 + n0 + 2)
    z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    best = document_frequencies(sample).select("bucket", "toxic", "other", F.abs(z).alias("z")).orderBy(F.desc("z"), "bucket").limit(top).collect()
    feature = np.full(BUCKETS, -1, dtype=np.int32)
    feature[[r.bucket for r in best]] = np.arange(len(best))
    ratio = np.array([np.log((r.toxic + 1) / (n1 + 2)) - np.log((r.other + 1) / (n0 + 2)) for r in best])
    k = len(best)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = (batch.column("y").to_numpy(zero_copy_only=False) > 0).astype(np.int8)
            for s in slices(batch.column("text")):
                doc, feat = present(s, feature, k)
                cut = np.searchsorted(doc, np.arange(s.n + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(y[s.first : s.first + s.n]), pa.array([feat[a:b].astype("<i2").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                    names=["y", "features"],
                )

    got = sample.mapInArrow(rows, "y byte, features binary").toArrow()
    y = got.column("y").to_numpy().astype(np.float64) * 2 - 1
    sets = [np.frombuffer(b.as_py(), dtype="<i2") for b in got.column("features")]
    row, col = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets).astype(np.int64)

    def loss_grad(w: np.ndarray) -> tuple[float, np.ndarray]:
        scaled = ratio * w[:-1]
        loss, d = logistic_loss(y * (np.bincount(row, scaled[col], minlength=len(y)) + w[-1]))
        d *= y
        grad = np.append(ratio * np.bincount(col, d[row], minlength=k), d.sum())
        grad[:-1] += l2 * w[:-1]
        return float(loss.sum() + 0.5 * l2 * (w[:-1] ** 2).sum()), grad

    w = lbfgs(loss_grad, np.zeros(k + 1))
    return Model(feature, ratio * w[:-1], float(w[-1]))


def score_toxicity(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(s) for s in slices(batch.column("text"))]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(parts))], names=["doc_id", "score"])

    scored = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold_of("doc_id", FOLDS) == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
