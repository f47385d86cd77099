"""Document quality by Bradley-Terry pairwise ranking.

Weights minimise the logistic loss on differences of features of preference
pairs (a good document before a poor one). Every labelled document draws
partners of the other class, one at least and more while there are fewer than
``MAX_PAIRS`` pairs, so the pairs grow with the labels. Features of the
documents are made once, in a pass over the texts; moments, each Newton step's
gradient and curvature, and the cut are sums over executors, of which the
driver sees a row for each task. The learned score orders documents; the cut
between labels is the score quantile at the share of poor documents among all
labelled ones, and scores are shifted so that this quantile becomes ``CUT``.

Every document is scored over its whole text. Defined results: null and
empty texts are scored by their (all zero) counts; with labels of one class
only every score is the smoothed base rate; equal rows get equal scores; extra
columns are ignored. Null ids and labels are left out; of several labels for
an id the largest counts; of several documents with an id each is used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored
from .linear import fold_of, logistic_loss, sigmoid
from .quality_rules import measure
from .textscan import SPACED, Slice, Words, mix, per_doc, slices

MAX_PAIRS, L2, FOLDS, HELD, CUT = 200_000, 1.0, 5, 0, 0.3
#: Documents of a class that stand together for a partner to be drawn; rows and bins of a search for a quantile.
GROUP, FEW, BINS = 50, 10_000, 4096


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


UPPER, DIGIT, BANG, PIPE, STOP = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("0123456789"), _mask("!?"), _mask("|"), _mask(".,;:")


def features(s: Slice) -> np.ndarray:
    """A row of bounded statistics for each document."""
    m = {k: v.astype(np.float64) for k, v in measure(s).items()}
    buf = s.buf
    n_bytes = np.maximum(np.diff(s.offs), 1).astype(np.float64)
    words = Words(s, SPACED, fold=True)
    n = np.maximum(m["n_words"], 1)
    length = words.end - words.start
    _, kept = np.unique(mix(words.hash + mix(words.doc.astype(np.uint64))), return_index=True)
    distinct = np.bincount(words.doc[kept], minlength=s.n) / n
    lines = per_doc(buf == 10, s.offs) + 1.0
    rate = lambda mask: np.log1p(100 * per_doc(mask[buf], s.offs) / n_bytes)
    return np.stack([
        np.log1p(m["n_words"]), np.log1p(m["word_chars"] / n), np.log1p(100 * m["n_symbols"] / n), np.log1p(100 * m["n_dup_lines"] / lines),
        m["n_repeat_words"] / n, m["covered_words"] / n, np.log1p(m["longest_repeat"]), distinct, distinct * np.log1p(m["n_words"]),
        rate(UPPER), rate(DIGIT), rate(BANG), rate(PIPE), rate(STOP), rate(buf_high), np.log1p(n / lines),
        per_doc(length <= 3, words.first) / n, per_doc(length >= 12, words.first) / n, (m["n_words"] < 10).astype(np.float64),
    ], axis=1)


buf_high = np.arange(256) >= 0x80


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    gain: float
    constant: float | None = None

    def rank(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight

    def score(self, s: Slice) -> np.ndarray:
        if self.constant is not None:
            return np.full(s.n, self.constant)
        return sigmoid(self.gain * (self.rank(features(s)) - self.cut) + np.log(CUT / (1 - CUT)))


def _matrix(column: pa.Array, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(b"".join(b.as_py() for b in column), dtype=kind).reshape(len(column), -1)


def _sums(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], kind: str = "<f8") -> list[np.ndarray]:
    """``of`` a task's vectors, added over its batches: a row for each task with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column("x"), kind))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["v"])

    return [np.frombuffer(r.v, dtype="<f8") for r in rows.select("x").mapInArrow(run, "v binary").collect()]


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, y, x) of every labelled document outside the held-out fold; features, not texts, are sent to the labels."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                x = features(s).astype("<f8")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.first, s.n), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).alias("y"))
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.coalesce(fold_of("doc_id", FOLDS) != HELD, F.lit(False)))
    return stored(texts.mapInArrow(rows, "doc_id long, x binary").join(known, "doc_id").select("doc_id", "y", "x"), "quality-features")


def _drawn(rows: DataFrame, partners: DataFrame, n_partners: int, each: int) -> DataFrame:
    """(x, other): each of ``rows`` with ``each`` of ``partners``, which wait in groups of about ``GROUP``."""
    n = max(1, n_partners // GROUP)
    at = lambda seed, *more: F.xxhash64("doc_id", "x", *more, F.lit(seed))
    groups = partners.groupBy(F.pmod(at(31), F.lit(n)).alias("group")).agg(F.sort_array(F.collect_list("x")).alias("others"))
    asks = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(each)))).select("x", F.pmod(at(37, "k"), F.lit(n)).alias("group"), at(41, "k").alias("pick"))
    return asks.join(groups, "group").select("x", F.expr("element_at(others, cast(pmod(pick, size(others)) + 1 as int))").alias("other"))


def _nth(scores: DataFrame, rank: int) -> float:
    """The value ``s`` at ``rank`` (from 0) in order, by counts in bins that close in on it."""
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    while low < high:
        inside = scores.where((F.col("s") >= low) & (F.col("s") <= high))
        width = (high - low) / BINS
        bins = sorted(inside.groupBy(F.least(F.floor((F.col("s") - low) / width), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect())
        for b in bins:
            if rank < b.n:
                break
            rank -= b.n
        low, high = b.low, b.high
        if b.n <= FEW:
            return sorted(r.s for r in scores.where((F.col("s") >= low) & (F.col("s") <= high)).collect())[rank]
    return low


def _cut(scores: DataFrame, n: int, poor: int) -> float:
    """The quantile at the share of poor documents; it is a step between scores, so the cut lies in the gap below the first kept score."""
    rank, rest = divmod((n - 1) * poor, n)
    v = _nth(scores, rank)
    s = F.col("s")
    r = scores.agg(F.max(F.when(s < v, s)).alias("below"), F.min(F.when(s > v, s)).alias("above"), F.count_if(s <= v).alias("upto")).first()
    if rest and r.upto == rank + 1:
        return (v + r.above) / 2
    return v if r.below is None else (r.below + v) / 2


def fit(docs: DataFrame, labels: DataFrame, max_pairs: int = MAX_PAIRS, l2: float = L2) -> Model:
    rows = labelled_features(docs, labels)
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = counts.get(True, 0), counts.get(False, 0)
    n = n1 + n0
    if not n1 or not n0:
        return Model(np.zeros(1), np.ones(1), np.zeros(1), 0.0, 1.0, constant=(n1 + 1) / (n + 2))
    mean = sum(_sums(rows, lambda x: x.sum(axis=0))) / n
    scale = np.maximum(np.sqrt(sum(_sums(rows, lambda x: ((x - mean) ** 2).sum(axis=0))) / n), 1e-6)
    good, poor = rows.where("y"), rows.where("not y")
    each = lambda m: max(1, max_pairs // (2 * m))
    pairs = _drawn(good, poor, n0, each(n1)).unionByName(_drawn(poor, good, n1, each(n0)).select(F.col("other").alias("x"), F.col("x").alias("other")))

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = lambda c: np.clip((_matrix(c) - mean) / scale, -8, 8)
        for batch in batches:
            if batch.num_rows:
                d = (z(batch.column("x")) - z(batch.column("other"))).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in d], pa.binary())], names=["x"])

    d = stored(pairs.mapInArrow(differences, "x binary"), "quality-pairs")
    k = len(mean)

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(x: np.ndarray) -> np.ndarray:
            x = x.astype(np.float64)
            loss, g = logistic_loss(x @ w)
            return np.concatenate([[loss.sum()], g @ x, ((-g * (1 + g))[:, None] * x).T.dot(x).ravel()])

        total = sum(_sums(d, part, "<f4"))
        return float(total[0] + 0.5 * l2 * w @ w), total[1 : k + 1] + l2 * w, total[k + 1 :].reshape(k, k) + l2 * np.eye(k)

    w = np.zeros(k)
    loss, g, h = at(w)
    for _ in range(30):
        step, t = np.linalg.solve(h, g), 1.0
        new = at(w - step)
        while new[0] > loss - 1e-4 * t * (g @ step) and t > 1e-6:
            t /= 2
            new = at(w - t * step)
        if new[0] > loss:
            break
        done = loss - new[0] <= 1e-9 * max(1.0, abs(loss))
        w, (loss, g, h) = w - t * step, new
        if done:
            break
    model = Model(mean, scale, w, 0.0, 1.0)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.rank(_matrix(batch.column("x"))))], names=["s"])

    model.cut = _cut(stored(rows.select("x").mapInArrow(scored, "s double"), "quality-scores"), n, n0)
    return model


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(s) for s in slices(batch.column("text"))]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(parts))], names=["doc_id", "score"])

    scored = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold_of("doc_id", FOLDS) == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
