"""Stupid-backoff language-model scores, computed as a join of n-gram counts with documents' n-grams.

Counts come from all of ``corpus``. n-grams are 64-bit hashes of their words.
Documents are dealt to parts of about ``PART_BYTES`` of text; a part explodes
its n-grams and sends each distinct one once, with how often the part has it,
to the bucket of its hash. A bucket holds the count table of its n-grams and
joins it to every part that asked. n-grams travel packed, a row for each part
and bucket, and only totals travel back, in the order of the part's sorted
hashes; the part then sums its documents' scores. A frequent n-gram is at most
one entry a part, so there are no hot keys.

A word's score is count(n-gram) / count(context) at the longest order, up to
``order``, that was seen, times ``alpha`` for each step of backing off, and
count(word) / corpus size at order 1; the document's score is the sum of their
logarithms. With ``leave_out`` a document is scored under a model of all other
rows: its own counts are taken from the totals, so an n-gram that only it has
is unseen.

Words are [^\\x20\\x09-\\x0D]+. Defined results: a null or blank text has 0
words and score 0; a word the corpus never had counts as if seen half a time;
equal rows get equal scores, and with ``leave_out`` each counts for the others;
an empty corpus has size 1; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches
from .textscan import SPACED, Slice, Words, mix, slices

ALPHA = 0.4
#: Text that a part holds, about; a longer document is most of its part.
PART_BYTES = 8 << 20
#: Buckets of hashes for each part, so that tasks are even.
BUCKETS_A_PART = 4
#: The key under which the number of all words is counted.
SIZE = 0
_U = np.uint64
BLOCK = "part long, bucket long, grams binary, counts binary"


def _keys(s: Slice, order: int) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """(words, for each order the key of the n-gram that ends at each word and whether the document has so many words before)."""
    words = Words(s, SPACED, fold=False)
    place = np.arange(len(words.hash)) - words.first[words.doc]
    key, out = words.hash, [(words.hash, np.ones(len(words.hash), dtype=bool))]
    for n in range(2, order + 1):
        before = np.concatenate([[_U(0)], key[:-1]]) if len(key) else key
        key = mix(before * _U(0xD6E8FEB86659FD93) + words.hash + _U(n))
        out.append((key, place >= n - 1))
    return words, out


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)


def _distinct(texts: pa.ChunkedArray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of a part with their numbers, and the number of its words."""
    keys, counts, held = [np.array([SIZE], dtype=np.uint64)], [np.zeros(1, dtype=np.int64)], 0
    for s in slices(texts):
        words, grams = _keys(s, order)
        for every, there in grams:
            key, n = np.unique(every[there], return_counts=True)
            keys.append(key)
            counts.append(n)
            held += len(key)
        keys.append(np.array([SIZE], dtype=np.uint64))
        counts.append(np.array([len(words.hash)]))
        if held > 1 << 21:  # few slices at a time
            key, n = _summed(keys, counts)
            keys, counts, held = [key], [n], 0
    return _summed(keys, counts)


def _cuts(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the sorted ``key`` that are not empty, bounds of each)."""
    bucket = (((key >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return bucket[start], np.append(start, len(key))


def _packed(n: np.ndarray) -> bytes:
    """Integers by byte planes: the high ones are zeros, which shuffles compress away."""
    return np.ascontiguousarray(n.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _asker(order: int, buckets: int, counted: bool, wanted: bool) -> Callable[[pa.Table], pa.Table]:
    """Blocks of a part: its n-grams, counted if it is of the corpus; part is -1 if no totals are wanted."""

    def run(group: pa.Table) -> pa.Table:
        key, n = _distinct(group.column("text"), order)
        bucket, cut = _cuts(key, buckets)
        part = group.column("part")[0].as_py() if wanted else -1
        pieces = [slice(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        n = n if counted else np.zeros_like(n)
        return pa.table({
            "part": pa.array([part] * len(bucket), pa.int64()), "bucket": pa.array(bucket),
            "grams": pa.array([key[p].tobytes() for p in pieces], pa.binary()), "counts": pa.array([_packed(n[p]) for p in pieces], pa.binary()),
        })

    return run


def _answer(group: pa.Table) -> pa.Table:
    """Totals of one bucket's n-grams for every part that asked."""
    grams = [np.frombuffer(b, dtype=np.uint64) for b in group.column("grams").to_pylist()]
    counts = [_unpacked(b) for b in group.column("counts").to_pylist()]
    _, at = np.unique(np.concatenate(grams), return_inverse=True)
    # integers, as totals of a large corpus are beyond what a float holds exactly
    total = np.zeros(at.max() + 1, dtype=np.int64)
    np.add.at(total, at, np.concatenate(counts))
    ends = np.cumsum([len(g) for g in grams])
    part = group.column("part").to_numpy()
    keep = np.flatnonzero(part >= 0)
    totals = [_packed(total[at[ends[i] - len(grams[i]) : ends[i]]]) for i in keep]
    return pa.table({"part": pa.array(part[keep]), "bucket": group.column("bucket").take(pa.array(keep)), "totals": pa.array(totals, pa.binary())})


def _own(key: np.ndarray, there: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each entry's key occurs in its document."""
    _, at, n = np.unique(mix(key + mix(doc.astype(np.uint64) + _U(1))), return_inverse=True, return_counts=True)
    if there.all():
        return n[at].astype(np.float64)
    return np.bincount(at, weights=there)[at]


def _scorer(order: int, alpha: float, buckets: int, leave_out: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        key, n = _distinct(docs.column("text"), order)
        bucket, cut = _cuts(key, buckets)
        for b, data in zip(answers.column("bucket").to_pylist(), answers.column("totals").to_pylist(), strict=True):
            i = np.searchsorted(bucket, b)
            n[cut[i] : cut[i + 1]] = _unpacked(data)

        def count(x: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(key, x), len(key) - 1)
            return np.where(key[at] == x, n[at], 0).astype(np.float64)

        every = count(np.array([SIZE], dtype=np.uint64))[0]
        n_words, score = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        for s in slices(docs.column("text")):
            words, grams = _keys(s, order)
            mine = np.diff(words.first)
            size = np.maximum(every - (mine[words.doc] if leave_out else 0), 1.0)
            logs, context = np.zeros(len(words.hash)), None
            for at, (gram, there) in enumerate(grams):
                seen = np.where(there, count(gram) - (_own(gram, there, words.doc) if leave_out else 0.0), 0.0)
                if at:
                    before = np.concatenate([[1.0], context[:-1]]) if len(context) else context
                    longer = np.log(np.where(seen > 0, seen, 1.0) / np.where(seen > 0, before, 1.0))
                    logs = np.where(seen > 0, longer, logs + np.where(there, math.log(alpha), 0.0))
                else:
                    logs = np.log(np.where(seen > 0, seen, 0.5) / size)
                context = seen
            n_words.append(mine)
            score.append(_doc_sums(logs, words.first))
        return pa.table({"doc_id": docs.column("did"), "n_words": pa.array(np.concatenate(n_words).astype(np.int64)), "log_score": pa.array(np.concatenate(score))})

    return run


def _doc_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` for each document, each summed by itself."""
    out = np.zeros(len(first) - 1)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[full])
    return out


def _parts(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows(did, text)`` dealt to parts by a hash, and how many parts."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = math.ceil((total + 1) / PART_BYTES)
    part = F.pmod(F.xxhash64("did", "text"), F.lit(parts).cast("long"))
    return rows.select(part.alias("part"), "did", "text").repartition(max(partitions(rows.sparkSession), parts), "part"), parts


def stupid_backoff(docs: DataFrame, corpus: DataFrame | None = None, alpha: float = ALPHA, order: int = 2) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of ``docs(doc_id, text)`` under an ``order``-gram model.

    The model is that of ``corpus(text)``, or, without one, of all other rows
    of ``docs`` (``leave_out``).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows, parts = _parts(small_batches(docs).select(F.col("doc_id").cast("long").alias("did"), text))
    if corpus is None:
        buckets = BUCKETS_A_PART * parts
        blocks = rows.groupBy("part").applyInArrow(_asker(order, buckets, counted=True, wanted=True), BLOCK)
    else:
        known, more = _parts(small_batches(corpus).select(F.monotonically_increasing_id().alias("did"), text))
        buckets = BUCKETS_A_PART * (parts + more)
        blocks = rows.groupBy("part").applyInArrow(_asker(order, buckets, counted=False, wanted=True), BLOCK)
        blocks = blocks.unionByName(known.groupBy("part").applyInArrow(_asker(order, buckets, counted=True, wanted=False), BLOCK))
    answers = blocks.groupBy("bucket").applyInArrow(_answer, "part long, bucket long, totals binary")
    scored = rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_scorer(order, alpha, buckets, corpus is None), "doc_id long, n_words long, log_score double")
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0))
