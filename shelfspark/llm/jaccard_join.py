"""Near-duplicate join by Jaccard similarity of word shingles, with the chosen-path method.

Documents with the same words are one *content* from the start. A content's
set of five-word shingles is embedded as ``SIGNATURE`` min-hashes, so that a
sampled coordinate is a sampled shared token. Each run starts at a root that
holds every content; a node splits its contents on the values of one or two
coordinates chosen by the node's path (1 / similarity of them on average),
again and again, until a bucket is small. Small buckets are compared by brute
force; runs repeat until a pair at the threshold is found with the target
recall at the greatest depth that the corpus made necessary. Runs come in
batches, each with min-hashes of its own. A large bucket that keeps most of its parent is one of near copies (its
contents agree on token after token): it is not split on, but becomes a
candidate as a whole; so does what is still large at the greatest depth.

Candidates only say which contents belong together. Of a large connected
component only contents that share one of their rarest shingles, as all linked
ones do, stay together; each component is then compared in full with exact
sets, in blocks of bounded size, and links are counted inside the blocks, so
no pair is emitted as a row.

Steps are removed as soon as nothing reads them, and what they shuffle once
they are written.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z is folded; a text of
fewer than five words, but not none, is one shingle. Defined results: null,
empty and wordless texts have no shingles, no links and a class of their own;
equal rows link to each other; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, partitions, scratch, small_batches, stored, whole_groups
from .textscan import ALNUM, BASE, Slice, Words, mix, rolling, slices, span_hash

WIDTH, SIMILARITY, RECALL = 5, 0.8, 0.999
SIGNATURE, BUCKET, DEPTH, DENSE, SLACK, BLOCK = 64, 64, 12, 0.6, 0.2, 1000
#: Runs that share their min-hashes, at most.
BATCH = 6
#: Up to so many wanted contents are sent to every executor (24 bytes each); more are joined by a shuffle.
BROADCAST_CONTENTS = 600_000
NO_ID = -(1 << 63)
_U = np.uint64


def _coefficients(batch: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of a batch's min-hashes."""
    at = np.arange(1, SIGNATURE + 1, dtype=np.uint64) + _U(2000 * batch)
    return mix(at) | _U(1), mix(at + _U(1000))


def shingles(s: Slice, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content key of each document or 0, first shingle of each document, distinct sorted shingle hashes)."""
    words = Words(s, ALNUM, fold=True)
    n = np.diff(words.first)
    H = rolling(words.hash)
    key = np.where(n > 0, span_hash(H, words.first[:-1], words.first[1:]), _U(0))
    size = np.where(n >= width, width, n)
    count = np.where(n > 0, n - size + 1, 0)
    doc = np.repeat(np.arange(s.n), count)
    at = np.repeat(words.first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    g = np.zeros(len(at), dtype=np.uint64)
    for j in range(width):
        inside = j < size[doc]
        g = np.where(inside, g * _U(BASE) + words.hash[np.minimum(at + j, max(len(words.hash) - 1, 0))] if len(at) else g, g)
    g = mix(g)
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    doc, g = doc[new], g[new]
    return key, np.searchsorted(doc, np.arange(s.n + 1)), g


def signatures(first: np.ndarray, g: np.ndarray, batch: int = 0) -> np.ndarray:
    """32 bits of min-hashes (documents x SIGNATURE) of the sets in ``g``; rows without shingles are zero.

    With fewer, contents that share nothing meet in buckets by chance: with 16
    bits, 46 of 3,000,000 in each.
    """
    out = np.zeros((len(first) - 1, SIGNATURE), dtype=np.uint32)
    full, (a, b) = np.flatnonzero(np.diff(first)), _coefficients(batch)
    if len(full):
        for i in range(SIGNATURE):
            out[full, i] = np.minimum.reduceat((g * a[i] + b[i]) >> _U(16), first[full]).astype(np.uint32)
    return out


def _ids(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.col("text").cast("string").alias("text"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th"))


def _contents(docs: DataFrame, width: int, number: int = 0) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                key, first, g = shingles(s, width)
                sig = signatures(first, g, number)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(s.first, s.n) for c in ("did", "th")), pa.array(key.view(np.int64)), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (sig, sig.astype(np.uint8)))], names=["did", "th", "k", "sig", "low"])

    return _ids(docs).mapInArrow(run, "did long, th long, k long, sig binary, low binary")


def _sketches(contents: DataFrame) -> DataFrame:
    """(k, sig, low) of each content with words."""
    return stored(contents.where("k <> 0").groupBy("k").agg(F.first("sig").alias("sig"), F.first("low").alias("low")), "sketches")


def _sig(column: pa.ChunkedArray | pa.Array, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _split(rows: DataFrame, similarity: float) -> DataFrame:
    """Children (k, node, pn) of rows (k, node, sig, pn); pn is the size of the parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, k = _sig(batch.column("sig")), batch.column("k").to_numpy()
            node = batch.column("node").to_numpy().view(np.uint64)
            whole, part = divmod(1 / similarity, 1)
            draw = (mix(node + _U(3)) >> _U(11)).astype(np.float64) / (1 << 53)
            n = int(whole) + (draw < part)
            for j in range(int(whole) + 1):
                on = np.flatnonzero(n > j)
                at = ((mix(node[on]) >> _U(8)) + _U(j) * (_U(1) + (mix(node[on] + _U(5)) >> _U(9)) % _U(SIGNATURE - 1))) % _U(SIGNATURE)
                value = sig[on, at.astype(np.int64)].astype(np.uint64)
                child = mix(mix(node[on] + at) + value)
                yield pa.RecordBatch.from_arrays([pa.array(k[on]), pa.array(child.view(np.int64)), batch.column("pn").take(pa.array(on))], names=["k", "node", "pn"])

    return rows.select("k", "node", "sig", "pn").mapInArrow(run, "k long, node long, pn long")


def _bucket_edges(rows: DataFrame, similarity: float) -> DataFrame:
    """Brute force in small buckets of rows (node, k, low): (a, b) joins each content to the least one it is connected to.

    ``low`` has a byte of each min-hash: bytes agree by chance once in 256, far
    less than the slack that candidates have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "node"):
            node, k, sig = t.column("node").to_numpy(), t.column("k").to_numpy(), _sig(t.column("low"), np.uint8)
            starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            sizes = np.diff(np.append(starts, len(node)))
            for m in np.unique(sizes[sizes > 1]):
                every = starts[sizes == m]
                step = max(1, (1 << 22) // (m * m * SIGNATURE))
                for c in range(0, len(every), step):
                    idx = every[c : c + step, None] + np.arange(m)
                    x, ids = sig[idx], k[idx]
                    near = (x[:, :, None, :] == x[:, None, :, :]).mean(axis=3) >= similarity - SLACK
                    label = ids.copy()
                    while True:
                        best = np.where(near, label[:, None, :], np.iinfo(np.int64).max).min(axis=2)
                        if (best == label).all():
                            break
                        label = best
                    on = label != ids
                    if on.any():
                        yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(label[on])], names=["a", "b"])

    n = partitions(rows.sparkSession)
    return rows.repartition(n, "node").sortWithinPartitions("node").select("node", "k", "low").mapInArrow(run, "a long, b long")


def survival(agree: float, similarity: float, depth: int) -> float:
    """Probability that contents which agree on so much of their min-hashes share a bucket after ``depth`` splits of a run."""
    whole, part = divmod(1 / similarity, 1)
    q = 1.0
    for _ in range(depth):
        miss = 1 - agree * q
        q = 1 - (1 - part) * miss**whole - part * miss ** (whole + 1)
    return q


def missed(similarity: float, depth: int, runs: int) -> float:
    """Probability that a batch of ``runs`` misses a pair at the threshold, over what its min-hashes may say of the pair."""
    total = 0.0
    for m in range(SIGNATURE + 1):
        q = survival(m / SIGNATURE, similarity, depth) if m / SIGNATURE >= similarity - SLACK else 0.0
        total += math.comb(SIGNATURE, m) * similarity**m * (1 - similarity) ** (SIGNATURE - m) * (1 - q) ** runs
    return total


def next_runs(done: list[int], recall: float, similarity: float, depth: int) -> int:
    """Runs of the batch that follows batches of ``done`` runs, 0 if those reach ``recall`` at ``depth``."""
    left = math.prod(missed(similarity, depth, n) for n in done)
    if left <= 1 - recall:
        return 0
    return next((n for n in range(1, BATCH) if left * missed(similarity, depth, n) <= 1 - recall), BATCH)


def candidate_components(reps: DataFrame, similarity: float, recall: float, fresh: Callable[[int], DataFrame], bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """(node, root) of the contents ``reps(k, sig, low)`` that have a candidate.

    Batches of runs follow, on ``fresh(number)``, the contents with new
    min-hashes, until they are enough for the deepest level any run came to.
    """
    edges, done, deepest = None, [], 2
    while n := next_runs(done, recall, similarity, deepest):
        first = sum(done) + 1
        found, reached = _batch(fresh(len(done)) if done else reps, first, first + n - 1, similarity, bucket, depth)
        edges = found if edges is None else edges.unionByName(found)
        done, deepest = [*done, n], max(deepest, reached)
    return components(edges)


def _batch(reps: DataFrame, first: int, last: int, similarity: float, bucket: int, depth: int) -> tuple[DataFrame, int]:
    """(edges (a, b) that the runs ``first`` to ``last`` find, the deepest level they came to).

    Each level's edges are written before the next is split, so that only one
    level's rows lie on disk at a time. ``reps`` is a stored step; it is removed.
    """
    runs = F.explode(F.sequence(F.lit(first), F.lit(last)))
    level = reps.select("k", "sig", runs.alias("run")).select("k", F.xxhash64("run", F.lit(41)).alias("node"), "sig", F.lit(1 << 62).alias("pn"))
    edges, above = None, []
    for at in range(1, depth + 1):
        split = stored(_split(level, similarity), "split")
        dropped(*above)
        n = split.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = stored(split.join(n, "node"), "nodes")
        dropped(split)
        found = _bucket_edges(rows.where(F.col("n") <= bucket).join(reps.select("k", "low"), "k").select("node", "k", "low"), similarity)
        settled = (F.col("n") >= DENSE * F.col("pn")) | F.lit(at == depth)
        dense = rows.where((F.col("n") > bucket) & settled)
        least = dense.groupBy("node").agg(F.min("k").alias("b"))
        found = found.unionByName(dense.join(least, "node").select(F.col("k").alias("a"), "b").where("a <> b"))
        found = stored(found.distinct(), "found")
        edges, above = found if edges is None else edges.unionByName(found), [rows]
        large = rows.where((F.col("n") > bucket) & ~settled)
        if not large.limit(1).count():
            break
        level = large.join(reps.select("k", "sig"), "k").select("k", "node", "sig", F.col("n").alias("pn"))
    dropped(reps, rows)
    return edges, at


def _links(x: np.ndarray, y: np.ndarray | None, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Linked pairs among the sets ``x`` (or between ``x`` and ``y``), as a boolean matrix; exact."""
    rows = np.concatenate([x, y]) if y is not None else x
    size = np.array([len(sets[r]) for r in rows])
    flat = np.concatenate([sets[r] for r in rows])
    owner = np.repeat(np.arange(len(rows)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1
    owner, col = owner[shared], col[shared]
    if len(col):
        _, col = np.unique(col, return_inverse=True)
    na = len(x)
    nb = len(rows) - na if y is not None else na
    inter = np.zeros((na, nb), dtype=np.float32)
    width = 2048
    cuts = np.searchsorted(col, np.arange(0, (col[-1] if len(col) else -1) + 1 + width, width))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        m = np.zeros((len(rows), width), dtype=np.float32)
        m[owner[a:b], col[a:b] % width] = 1
        inter += m[:na] @ (m[na:] if y is not None else m).T
    sa, sb = size[:na, None].astype(np.float64), (size[na:] if y is not None else size)[None, :].astype(np.float64)
    linked = inter >= similarity * (sa + sb - inter) - 1e-6
    if y is None:
        np.fill_diagonal(linked, False)
    return linked


def _verify(rows: DataFrame, similarity: float) -> DataFrame:
    """(k, n_links, label) from rows (unit, side, k, copies, set); a unit is a block of a component or a pair of blocks."""

    def unit(side: np.ndarray, k: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], cross: bool) -> pa.RecordBatch | None:
        _, one = np.unique(k, return_index=True)
        if cross:
            x, y = one[side[one] == 0], one[side[one] == 1]
            if not len(x) or not len(y):
                return None
            m = _links(x, y, sets, similarity)
            near = np.zeros((len(x) + len(y),) * 2, dtype=bool)
            near[: len(x), len(x) :], near[len(x) :, : len(x)] = m, m.T
            one = np.concatenate([x, y])
        else:
            near = _links(one, None, sets, similarity)
        on = near.any(axis=1)
        if not on.any():
            return None
        near, one = near[on][:, on], one[on]
        n, label = near @ copies[one], k[one].copy()
        while True:
            best = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (best == label).all():
                break
            label = best
        return pa.RecordBatch.from_arrays([pa.array(k[one]), pa.array(n.astype(np.int64)), pa.array(label)], names=["k", "n_links", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "unit"):
            names = np.asarray(t.column("unit").to_pylist())
            starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            side, k, copies = (t.column(c).to_numpy() for c in ("side", "k", "copies"))
            sets = [np.frombuffer(b, dtype=np.uint64) for b in t.column("set").to_pylist()]
            for a, b in zip(starts, np.append(starts[1:], len(names)), strict=True):
                if b - a > 1 and (out := unit(side[a:b], k[a:b], copies[a:b], sets[a:b], names[a].endswith("x"))) is not None:
                    yield out

    n = partitions(rows.sparkSession)
    return rows.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(run, "k long, n_links long, label long")


def _tokens(sets: DataFrame) -> DataFrame:
    """(k, size, token) of each shingle of ``sets(k, set)``; size is the set's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column("set").to_pylist()
            size = np.array([len(x) // 8 for x in sets], dtype=np.int64)
            cols = [np.repeat(batch.column("k").to_numpy(), size), np.repeat(size, size), np.frombuffer(b"".join(sets), dtype=np.int64)]
            for a in range(0, len(cols[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)]) for c in cols], names=["k", "size", "token"])

    return sets.select("k", "set").mapInArrow(run, "k long, size long, token long")


def _parted(sets: DataFrame, similarity: float) -> DataFrame:
    """(k, root, size) of contents ``sets(k, set)`` that may have a link, in smaller components; exact.

    A candidate component grows with the corpus where many contents share a
    passage. Two sets at the threshold share one of the rarest
    ``n - ceil(similarity * n) + 1`` shingles of each (n: the size of the set),
    so only contents that meet in these stay together.
    """
    tokens = _tokens(sets)
    seen = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1")
    shared = tokens.join(seen, "token").groupBy("k", "size").agg(F.sort_array(F.collect_list(F.struct("seen", "token"))).alias("by"))
    # shingles of one content only are the rarest, and lead nowhere
    left = F.col("size") - F.ceil(similarity * F.col("size") - 1e-6) + 1 - (F.col("size") - F.size("by"))
    rare = stored(shared.where(left > 0).select("k", F.explode(F.slice("by.token", F.lit(1), left.cast("int"))).alias("token")), "rare")
    first = rare.groupBy("token").agg(F.min("k").alias("b"))
    roots = components(stored(rare.join(first, "token").select(F.col("k").alias("a"), "b").where("a <> b").distinct(), "met")).select(F.col("node").alias("k"), "root")
    dropped(rare)
    return roots.join(roots.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Shingle sets of the wanted contents (did, k, root, size, copies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                key, first, g = shingles(s, width)
                part = batch.slice(s.first, s.n)
                keep = np.flatnonzero(key.view(np.int64) == part.column("k").to_numpy())
                rows = [part.column(c).take(pa.array(keep)) for c in ("k", "root", "size", "copies")]
                yield pa.RecordBatch.from_arrays([*rows, pa.array([g[first[i] : first[i + 1]].tobytes() for i in keep], pa.binary())], names=["k", "root", "size", "copies", "set"])

    small = wanted.count() <= BROADCAST_CONTENTS
    joined = _ids(docs).join(F.broadcast(wanted) if small else wanted, "did").select("text", "k", "root", "size", "copies")
    return joined.mapInArrow(run, "k long, root long, size long, copies long, set binary")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, recall: float = RECALL, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links, class_key, text_hash) for every row of ``docs(doc_id, text)``.

    ``class_id`` is the least id among the documents connected by links,
    ``copy_of`` the least id of the same words, ``n_links`` the number of
    documents whose similarity is at least ``similarity``. Where ids are null
    or repeat, ``class_key`` (null for a text without words) tells classes
    apart and ``text_hash``, of the text with null as empty, the rows.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(stored(_near_duplicates(docs, similarity, width, recall, bucket, block), "duplicates"))


def _near_duplicates(docs: DataFrame, similarity: float, width: int, recall: float, bucket: int, block: int) -> DataFrame:
    contents = stored(_contents(docs, width), "contents")
    base = stored(contents.select("did", "th", "k"), "rows")
    reps = stored(base.where("k <> 0").groupBy("k").agg(F.count(F.lit(1)).alias("copies"), F.min("did").alias("did")), "reps")
    sketches = _sketches(contents)
    dropped(contents)
    comps = candidate_components(sketches, similarity, recall, lambda number: _sketches(_contents(docs, width, number)), bucket).select(F.col("node").alias("k"), "root")
    size = comps.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    wanted = stored(comps.join(size, "root").join(reps.select("k", "did", "copies"), "k"), "wanted")
    sets = stored(_sets(docs, wanted, width), "sets")
    # a component larger than a block is parted where it can be, and what is left dealt as all pairs of its blocks
    if sets.where(F.col("size") > block).limit(1).count():
        large = sets.where(F.col("size") > block)
        parted = large.drop("root", "size").join(_parted(large, similarity), "k")
        sets = sets.where(F.col("size") <= block).unionByName(parted)
    blocks = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("k", F.lit(5)), blocks).cast("int")
    dealt = sets.select("*", mine.alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j")).select(
        F.concat_ws(":", "root", F.least("i", "j"), F.greatest("i", "j"), F.when(F.col("i") == F.col("j"), F.lit("o")).otherwise(F.lit("x"))).alias("unit"),
        (F.col("i") > F.col("j")).cast("int").alias("side"), "k", "copies", "set",
    )
    found = stored(_verify(dealt, similarity), "links")
    links = found.groupBy("k").agg(F.sum("n_links").alias("others"))
    classes = components(found.select(F.col("k").alias("a"), F.col("label").alias("b")))
    least = classes.join(reps.select(F.col("k").alias("node"), "did"), "node").groupBy("root").agg(F.min("did").alias("class"))
    by_content = (
        reps.select("k", "copies", F.col("did").alias("copy"))
        .join(links, "k", "left").join(classes.join(least, "root").select(F.col("node").alias("k"), "root", "class"), "k", "left")
    )
    out = base.select("did", "th", F.when(F.col("k") != 0, F.col("k")).alias("k")).join(by_content, "k", "left")
    named = lambda c: F.nullif(c, F.lit(NO_ID))
    return out.select(
        named(F.col("did")).alias("doc_id"), named(F.coalesce("class", "copy", "did")).alias("class_id"), named(F.coalesce("copy", "did")).alias("copy_of"),
        (F.coalesce("others", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
        F.coalesce("root", "k").alias("class_key"), F.col("th").alias("text_hash"),
    )
