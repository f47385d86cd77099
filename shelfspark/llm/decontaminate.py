"""Benchmark decontamination with an FM-index of each training shard.

A shard is what one Arrow batch of documents leaves of its text after words
that can't lie in a match are cut away: only runs of words whose neighbours
form pairs that occur in some test window are kept, which loses no match. The
shard's FM-index is the Burrows-Wheeler transform of these runs (one symbol a
word, 0 between runs) in a wavelet tree. All test windows are searched backward
together, occurrences are located by walking to sampled suffix positions, and
the spans of words they cover are merged.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z is folded, compared by
64-bit hash. A window is ``width`` consecutive words of an item; an item of
fewer words, but not none, is one window. Defined results: a null or empty
text has no words and no hits; items without words or without an id are left
out; items with equal ids are one; equal rows get equal results; extra columns
are ignored. Test windows go to every executor in blocks of at most
``BLOCK_WORDS`` words (or one item), one search for each block; after
``PASS_BLOCKS`` blocks the texts and what was found are written down, so
neither the driver nor a task ever holds more blocks than that.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, unused
from .textscan import ALNUM, Words, slices

WIDTH, BLOCK_WORDS, PASS_BLOCKS, SAMPLE = 10, 2_000_000, 4, 8
_U = np.uint64


class Wavelet:
    """Wavelet tree (level-wise) with rank and access over small integers."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before position i."""
        lo = np.zeros_like(i)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones, one = self.ones[k], (symbol >> level) & 1 == 1
            lo = np.where(one, self.zeros[k] + ones[lo], lo - ones[lo])
            i = np.where(one, self.zeros[k] + ones[i], i - ones[i])
        return i - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for k in range(self.bits):
            ones = self.ones[k]
            one = ones[i + 1] - ones[i] == 1
            out = (out << 1) | one
            i = np.where(one, self.zeros[k] + ones[i], i - ones[i])
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of integers by prefix doubling; shorter is less."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank, width = rank.astype(np.int64) + 1, 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: max(n - width, 0)] = rank[width:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[1], (np.diff(key[order]) != 0).astype(np.int64)])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n:
            return order
        width *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int):
        """``text`` of symbols 1 .. sigma - 1, and 0 between runs and at the end."""
        sa = suffix_array(text)
        self.n = len(text)
        bwt = text[sa - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.tree = Wavelet(bwt, sigma)
        self.sampled = sa % SAMPLE == 0
        self.at = np.cumsum(self.sampled) - 1
        self.values = sa[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of the rows of ``patterns``."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero(lo < hi)
            c = patterns[live, j]
            lo[live] = self.less[c] + self.tree.rank(c, lo[live])
            hi[live] = self.less[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        steps, rows = np.zeros(len(rows), dtype=np.int64), rows.copy()
        while True:
            live = np.flatnonzero(~self.sampled[rows])
            if not len(live):
                return self.values[self.at[rows]] + steps
            c = self.tree.access(rows[live])
            rows[live] = self.less[c] + self.tree.rank(c, rows[live])
            steps[live] += 1


class Windows:
    """Distinct windows of a block of items, by length, and the items they belong to."""

    def __init__(self, names: list[str], hashes: list[np.ndarray], width: int):
        size = np.array([len(h) for h in hashes], dtype=np.int64)
        self.vocab, sym = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_inverse=True)
        self.probe = np.zeros(1 << 16, dtype=bool)
        self.probe[(self.vocab >> _U(48)).astype(np.int64)] = True
        sym, first = sym.astype(np.int32) + 1, np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        self.names = np.array(names, dtype=object)
        #: length: (windows, bounds of each one's items in the third, positions in ``names``)
        self.groups: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        pairs = [np.zeros(0, np.int64)]
        of = np.minimum(size, width)
        for k in np.unique(of).tolist():
            on = np.flatnonzero(of == k)
            count = size[on] - k + 1
            item = np.repeat(on, count)
            at = np.repeat(first[on] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            patterns, which = np.unique(sym[at[:, None] + np.arange(k)], axis=0, return_inverse=True)
            owners = np.unique(np.stack([which.ravel(), item]), axis=1)
            self.groups[k] = (patterns, np.searchsorted(owners[0], np.arange(len(patterns) + 1)), owners[1])
            pairs.append(np.unique(patterns[:, :-1].astype(np.int64) * (len(self.vocab) + 1) + patterns[:, 1:]))
        self.pairs = np.unique(np.concatenate(pairs))
        self.shortest = min(self.groups, default=1)

    def items(self, group: int, pattern: int) -> list[str]:
        _, bounds, owners = self.groups[group]
        return self.names[owners[bounds[pattern] : bounds[pattern + 1]]].tolist()

    def symbols(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), dtype=np.int64)
        maybe = np.flatnonzero(self.probe[(h >> _U(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocab, h[maybe]), max(len(self.vocab) - 1, 0))
        if len(self.vocab):
            out[maybe] = np.where(self.vocab[at] == h[maybe], at + 1, 0)
        return out

    def runs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, word indices) of the runs that may hold a window; runs are parted by symbol 0 at index -1."""
        sym = self.symbols(words.hash)
        inside = sym > 0
        key = sym[:-1] * (len(self.vocab) + 1) + sym[1:]
        link = inside[:-1] & inside[1:] & (words.doc[:-1] == words.doc[1:])
        on = np.flatnonzero(link)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, key[on]), len(self.pairs) - 1)
            link[on] = self.pairs[at] == key[on]
        else:
            link[on] = False
        here = np.flatnonzero(inside)
        if not len(here):
            return here, here
        starts = here[(here == 0) | ~np.concatenate([[False], link])[here]]
        ends = here[~np.concatenate([link, [False]])[here]] + 1
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return starts, starts
        size = ends - starts + 1
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        index = np.repeat(starts - first, size) + np.arange(size.sum())
        last = np.cumsum(size) - 1
        out = np.append(sym, 0)[index]
        out[last], index[last] = 0, -1
        return out, index


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1]


def _blocks(benchmark: DataFrame, width: int, block_words: int) -> Iterator[Windows]:
    """Windows of the benchmark in blocks of bounded size, made one after the other from a stream of items; one without windows for none."""
    names, hashes, n = [], [], 0
    for row in benchmark.where("item_id is not null").select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        words = [Words(s, ALNUM, fold=True).hash for s in slices(pa.array([row[1]], pa.string()))][0]
        if len(words):
            if names and n + len(words) > block_words:
                yield Windows(names, hashes, width)
                names, hashes, n = [], [], 0
            names.append(row[0])
            hashes.append(words)
            n += len(words)
    yield Windows(names, hashes, width)


def occurrences(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS, carry: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """``docs(doc_id, text)``, and the columns to ``carry``, with n_words, ``hits`` (merged runs of words as (first, last + 1) and bytes) and the items found."""
    runs = "array<struct<w0:int,w1:int,b0:int,b1:int>>"
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    schema = f"doc_id long, text string, n_words long, hits {runs}, items array<string>{more}"

    def search(block: Windows):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text, index, owner, n_words, bounds, base = [np.zeros(1, np.int64)], [np.full(1, -1)], [np.full(1, -1)], [], [], 0
                for s in slices(batch.column("text")):
                    words = Words(s, ALNUM, fold=True)
                    sym, at = block.runs(words)
                    text.append(sym)
                    index.append(np.where(at >= 0, at + base, -1))
                    owner.append(s.first + np.append(words.doc, 0)[at])
                    n_words.append(np.diff(words.first))
                    bounds.append((words.start - s.offs[words.doc], words.end - s.offs[words.doc]))
                    base += len(words.hash)
                if not n_words:
                    continue
                text, index, owner = np.concatenate(text), np.concatenate(index), np.concatenate(owner)
                counts = np.concatenate(n_words)
                first = np.concatenate([[0], np.cumsum(counts)])
                b0, b1 = (np.concatenate([b[k] for b in bounds]) for k in (0, 1))
                found: dict[int, tuple[list, set]] = defaultdict(lambda: ([], set()))
                if len(text) > 1:
                    fm = FMIndex(text, len(block.vocab) + 1)
                    for n, (patterns, _, _) in block.groups.items():
                        lo, hi = fm.search(patterns)
                        got = np.repeat(np.arange(len(lo)), hi - lo)
                        if not len(got):
                            continue
                        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(len(got))
                        at = fm.locate(rows)
                        doc, word = owner[at], index[at]
                        pair = np.unique(np.stack([doc, got]), axis=1)
                        for d, p in pair.T.tolist():
                            found[d][1].update(block.items(n, p))
                        order = np.argsort(doc, kind="stable")
                        cuts = np.flatnonzero(np.diff(doc[order])) + 1
                        for part in np.split(order, cuts):
                            found[int(doc[part[0]])][0].append(np.stack([word[part], word[part] + n]))
                hits, items = [], []
                old_hits, old_items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
                for d in range(batch.num_rows):
                    runs_, names_ = found.get(d, ([], set()))
                    if not runs_:
                        hits.append(old_hits[d])
                        items.append(old_items[d])
                        continue
                    old = np.array([[h["w0"], h["w1"]] for h in old_hits[d]], dtype=np.int64).reshape(-1, 2).T + first[d]
                    a, b = _merge(*np.concatenate([*runs_, old], axis=1))
                    hits.append([{"w0": int(x - first[d]), "w1": int(y - first[d]), "b0": int(b0[x]), "b1": int(b1[y - 1])} for x, y in zip(a, b, strict=True)])
                    items.append(sorted({*old_items[d], *names_}))
                kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("w0", "w1", "b0", "b1")]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(counts), pa.array(hits, kind), pa.array(items, pa.list_(pa.string())), *map(batch.column, carry)], names=["doc_id", "text", "n_words", "hits", "items", *carry])

        return run

    out = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(runs).alias("hits"), F.array().cast("array<string>").alias("items"), *carry)
    for n, block in enumerate(_blocks(benchmark, width, block_words)):
        if n and n % PASS_BLOCKS == 0:
            out = stored(out, "searched")
        out = out.mapInArrow(search(block), schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``."""
    found = occurrences(docs, benchmark, width, block_words)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["w1"] - h["w0"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def remove_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with the bytes from the first to the last word of each merged run of hits taken out of ``text``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, hits in zip(batch.column("text"), batch.column("hits").to_pylist(), strict=True):
                if not hits:
                    out.append(text.as_py())
                    continue
                raw, keep, at = text.as_py().encode(), [], 0
                for h in hits:
                    keep.append(raw[at : h["b0"]])
                    at = h["b1"]
                out.append(b"".join([*keep, raw[at:]]).decode())
            names = [c for c in batch.schema.names if c not in ("text", "hits")]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(out, pa.string())], names=[*names, "text"])

    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = unused(docs, *[f"kept{i}" for i in range(len(rest))])  # names that meet none of our own
    named = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in zip(rest, carried, strict=True)])
    found = occurrences(named, benchmark, width, block_words, carry=carried)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.select("doc_id", *carried).schema) + ", text string"
    out = found.select("doc_id", *carried, "text", "hits").mapInArrow(cut, schema)
    back = dict(zip(rest, carried, strict=True))
    return out.select(*[F.col(back.get(c, c)).alias(c) for c in docs.columns])
