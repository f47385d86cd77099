"""Quality rules with a suffix array of repeated passages.

Base counts (words, symbols, repeated lines, words in repeated 5-word windows)
come with a verdict from a word-level suffix array of each document: adjacent
suffixes' longest common prefixes give the maximal repeated passages; the
union of their spans and the longest of them are limited. The array is built
only over suffixes whose first ``min_repeat`` words occur twice, by prefix
doubling of ranks; other suffixes can't begin a repeated passage.

Defined results: a null or blank text has no words and fails the base rule; a
text of one huge word is one word; equal rows each get their row; an empty
table gives an empty table. Only ``doc_id`` and ``text`` are read; other
columns, whatever their names, are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textscan import BYTE, SPACED, Slice, Words, grams, mix, per_doc, repeated, rolling, slices, span_hash

MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 10, 0.15, 100
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, base_failed boolean, kept boolean"
_U = np.uint64


def _salt(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(keys + mix(doc.astype(np.uint64) + _U(1)))


def longest_prefixes(words: Words, k: int) -> np.ndarray:
    """For each word, the length in words of the longest passage from it that occurs again in its document; 0 if below k."""
    n = len(words.hash)
    out = np.zeros(n, dtype=np.int64)
    at, key = grams(words, k)
    key = _salt(key, words.doc[at])
    twice = repeated(key)
    cand, key = at[twice], key[twice]
    if not len(cand):
        return out
    # ranks of prefixes of k, 2k, 4k ... words; a suffix that isn't a candidate has a rank of its own
    alone = np.arange(1, n + 1, dtype=np.int64) << 1
    _, first = np.unique(key, return_inverse=True)
    rank = np.concatenate([alone, [0]])
    rank[cand] = (first.astype(np.int64) << 1) | 1
    levels, width = [rank], k
    live = cand
    while len(live):
        nxt = levels[-1].copy()
        pair = mix(levels[-1][live].astype(np.uint64)) + mix(levels[-1][np.minimum(live + width, n)].astype(np.uint64) + _U(7))
        pair = mix(pair)
        keep = repeated(pair)
        nxt[live[~keep]] = alone[live[~keep]]
        live = live[keep]
        if not len(live):
            break
        _, inv = np.unique(pair[keep], return_inverse=True)
        nxt[live] = (inv.astype(np.int64) << 1) | 1
        levels.append(nxt)
        width *= 2
    # suffix array of the candidates: ranks of the longest prefix that is still shared, refined by what follows
    order = _suffix_order(levels, cand, k, n)
    sa = cand[order]
    common = _common(levels, words, sa[:-1], sa[1:], k, n)
    best = np.zeros(len(sa), dtype=np.int64)
    best[1:] = common
    best[:-1] = np.maximum(best[:-1], common)
    out[sa] = np.where(best >= k, best, 0)
    return out


def _suffix_order(levels: list[np.ndarray], cand: np.ndarray, k: int, n: int) -> np.ndarray:
    """Order of the candidates in which those that share the longest prefixes are neighbours."""
    keys, at = [], cand.copy()
    for lv in range(len(levels) - 1, -1, -1):
        keys.append(levels[lv][np.minimum(at, n)])
    return np.lexsort(keys)


def _common(levels: list[np.ndarray], words: Words, a: np.ndarray, b: np.ndarray, k: int, n: int) -> np.ndarray:
    """Longest common prefixes, in words, of pairs of suffixes."""
    a, b = a.copy(), b.copy()
    total = np.zeros(len(a), dtype=np.int64)
    for lv in range(len(levels) - 1, -1, -1):
        rank, width = levels[lv], k << lv
        same = (rank[np.minimum(a, n)] == rank[np.minimum(b, n)]) & (rank[np.minimum(a, n)] & 1 == 1)
        step = np.where(same, width, 0)
        a, b, total = a + step, b + step, total + step
    hashes = np.concatenate([words.hash, [_U(0)]])
    docs = np.concatenate([words.doc, [-1]])
    open_ = np.ones(len(a), dtype=bool)
    for _ in range(k - 1):
        x, y = np.minimum(a, n), np.minimum(b, n)
        open_ &= (hashes[x] == hashes[y]) & (docs[x] == docs[y]) & (docs[x] >= 0)
        if not open_.any():
            break
        a, b, total = a + open_, b + open_, total + open_
    return total


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Mask of the positions in the union of [start, start + length)."""
    d = np.zeros(n + 1, dtype=np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + lengths, -1)
    return np.cumsum(d[:-1]) > 0


def measure(s: Slice) -> dict[str, np.ndarray]:
    buf = s.buf
    H = rolling(BYTE[buf])
    words = Words(s, SPACED, fold=False, H=H)
    n = len(words.hash)
    n_words = np.diff(words.first)
    chars = per_doc(SPACED[buf] & ((buf & 0xC0) != 0x80), s.offs)
    symbols = per_doc(SYMBOL[buf], s.offs)
    # lines: between newlines and document bounds; only those with a word count
    cuts = np.unique(np.concatenate([s.offs, np.flatnonzero(buf == 10), np.flatnonzero(buf == 10) + 1]))
    a, b = cuts[:-1], cuts[1:]
    has_word = np.searchsorted(words.start, b) > np.searchsorted(words.start, a)
    a, b = a[has_word], b[has_word]
    doc = np.searchsorted(s.offs, a, side="right") - 1
    key = _salt(span_hash(H, a, b), doc)
    _, kept = np.unique(key, return_index=True)
    dup_lines = np.bincount(doc, minlength=s.n) - np.bincount(doc[kept], minlength=s.n)
    at, key = grams(words, 5)
    at = at[repeated(_salt(key, words.doc[at]))]
    repeat = per_doc(covered(at, np.full(len(at), 5), n), words.first)
    longest = longest_prefixes(words, MIN_REPEAT)
    from_ = np.flatnonzero(longest)
    cover = per_doc(covered(from_, longest[from_], n), words.first)
    top = np.zeros(s.n, dtype=np.int64)
    np.maximum.at(top, words.doc[from_], longest[from_])
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat, "covered_words": cover, "longest_repeat": top}


def quality_rules(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: the counts, ``base_failed`` and ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(s) for s in slices(batch.column("text"))]
            if not parts:
                continue
            cols = {k: np.concatenate([p[k] for p in parts]).astype(np.int64) for k in parts[0]}
            words, rep = cols["n_words"], cols["n_repeat_words"]
            failed = (words < 10) | (100 * rep > 20 * words)
            good = (cols["covered_words"] <= max_covered * words) & (cols["longest_repeat"] <= max_longest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *map(pa.array, cols.values()), pa.array(failed), pa.array(~failed & good)],
                names=["doc_id", *cols, "base_failed", "kept"],
            )

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the rules keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                m = measure(s)
                words, rep = m["n_words"], m["n_repeat_words"]
                good = (words >= 10) & (100 * rep <= 20 * words) & (m["covered_words"] <= max_covered * words) & (m["longest_repeat"] <= max_longest)
                yield batch.slice(s.first, s.n).filter(pa.array(good))

    return small_batches(docs).mapInArrow(run, docs.schema)
