"""Small numpy solver for L2-regularised logistic losses, and bounded labelled samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches


def lbfgs(loss_grad: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, rounds: int = 100, memory: int = 8) -> np.ndarray:
    """Minimise a smooth convex function by L-BFGS with backtracking."""
    f, g = loss_grad(w)
    ss: list[np.ndarray] = []
    ys: list[np.ndarray] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y in zip(reversed(ss), reversed(ys), strict=True):
            a = s @ q / (s @ y)
            alphas.append(a)
            q -= a * y
        if ss:
            q *= ss[-1] @ ys[-1] / (ys[-1] @ ys[-1])
        for s, y, a in zip(ss, ys, reversed(alphas), strict=True):
            q += s * (a - y @ q / (s @ y))
        t, slope = 1.0, g @ q
        if slope <= 1e-12:
            break
        while t > 1e-8:
            new = w - t * q
            f2, g2 = loss_grad(new)
            if f2 <= f - 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = new - w, g2 - g
        if s @ y > 1e-12:
            ss, ys = [*ss, s][-memory:], [*ys, y][-memory:]
        done = abs(f - f2) <= 1e-9 * max(1.0, abs(f))
        w, f, g = new, f2, g2
        if done:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, dtype=np.float64)))


def logistic_loss(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log(1 + exp(-margin)) and its derivative."""
    return np.logaddexp(0.0, -margin), -sigmoid(-margin)


def fold_of(doc_id: str, n: int):
    return F.crc32(F.col(doc_id).cast("string")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of about ``max_rows`` labelled documents outside the held-out fold, chosen by a hash of the id.

    Null ids and labels are left out; of several labels for an id the largest
    counts; of several documents with an id each is used.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.where(fold_of("doc_id", folds) != held)
    n = known.count()
    share = min(1.0, max_rows / n) if n else 1.0
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 20)) < int(share * (1 << 20)))
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
