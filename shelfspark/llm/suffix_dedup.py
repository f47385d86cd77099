"""Exact removal of long repeated passages by distributed prefix doubling on sampled suffixes.

A byte is removed if some string of ``threshold`` bytes that covers it also
starts anywhere else in the corpus. A suffix array of every byte would be
many times the input, so only *anchors* are sorted: each window of
``threshold`` bytes is owned by the place of the least hash among its first
``width`` positions. Equal windows have their anchors at equal offsets, so
repeats can only begin at windows whose anchors agree on the
``threshold - width + 1`` bytes that all windows of an anchor share.

1. Anchors are ranked by the first half of those bytes; the pair (rank, next
   bytes) at the doubled offset is sorted and ranked again, which is past the
   common bytes; anchors whose rank is unique leave after each round. Equal
   pairs are counted before they are shuffled.
2. Past the common bytes, anchors with the same whole neighbourhood (a
   *variant*) are counted; all windows of a variant that occurs twice repeat.
3. The windows of the other anchors, together with one of each repeated
   variant they compete with, are compared one by one by hash.

Spans are merged for each document. A second, longer threshold is judged only
on the runs that the shorter one found, since each of its strings lies inside
one. *Passages* are runs of the shorter threshold with at least ``min_words``
whole words. Matches never cross documents. Hashes have 64 bits. Defined
results: null is an empty text and keeps nothing; texts shorter than
``threshold`` keep everything; two equal rows repeat each other; rows that
share an id are told apart by a hash of their text; an empty table gives an
empty table; other columns are dropped (``dedup_text`` keeps those of the
input, whatever their names).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, unused
from .textscan import BASE_INV, BYTE, Slice, mix, powers, rolling, slices, span_hash

THRESHOLD = 400
#: A passage: so many bytes that occur again, and so many whole words in the run they make.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 50
#: Up to so many bytes of ranges go to every executor (8 for a range, 48 for a document that has any); more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
NO_ID = -(1 << 63)
_U = np.uint64
ANCHORS = "did long, th long, s int, e int, a1 long, a2 long, v long"
RANGES = "did long, th long, ranges array<struct<s:int,e:int>>"


def shape(threshold: int) -> tuple[int, int]:
    """(width of the sampling window, bytes of the hashes it compares)."""
    width = max(1, min(128, threshold // 2))
    return width, max(1, min(8, threshold - width))


def anchors(s: Slice, threshold: int) -> tuple[np.ndarray, ...]:
    """(doc, first start, last start, hash of the first half, hash of the second half, variant) of every anchor."""
    width, k = shape(threshold)
    n = len(s.buf)
    if n < threshold:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3
    H = rolling(BYTE[s.buf])
    g = mix((H[k:] - H[:-k]) * powers(n + 1, BASE_INV)[: n + 1 - k])
    low = _U(0xFFFFFFFF)
    key = (g & ~low) | (low - np.arange(len(g), dtype=np.uint64))  # of equal hashes the last is least
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: -(width - span)], key[width - span :])
    at = (low - (key & low)).astype(np.int64)
    usable = np.maximum(np.diff(s.offs) - threshold + 1, 0)  # starts of each document
    start = np.repeat(s.offs[:-1] - np.concatenate([[0], np.cumsum(usable)[:-1]]), usable) + np.arange(usable.sum())
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3
    doc = np.repeat(np.arange(s.n), usable)
    at = at[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    p, a, b = at[first], start[first], start[last]
    common = threshold - width + 1
    half = (common + 1) // 2
    v = span_hash(H, a, b + threshold) + mix(((p - a) * threshold + (b - a)).astype(np.uint64))
    return doc[first], a, b, span_hash(H, p, p + half), span_hash(H, p + half, p + common), mix(v)


def _ids_repeat(docs: DataFrame) -> bool:
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"))
    return ids.groupBy("did").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0


def _keyed(docs: DataFrame, hashed: bool | None = None) -> DataFrame:
    """(did, th, text): a null id is NO_ID; ``th`` is a hash of the text if ids repeat (``hashed``), else 0, which costs a shuffle nothing."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    th = F.xxhash64(text) if (_ids_repeat(docs) if hashed is None else hashed) else F.lit(0).cast("long")
    return small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), th.alias("th"), text.alias("text"))


def _anchor_rows(keyed: DataFrame, threshold: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "th"))
            for s in slices(batch.column("text")):
                doc, a, b, h1, h2, v = anchors(s, threshold)
                if len(doc):
                    base, row = s.offs[doc], s.first + doc
                    cols = [did[row], th[row], (a - base).astype(np.int32), (b - base).astype(np.int32), h1.view(np.int64), h2.view(np.int64), v.view(np.int64)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["did", "th", "s", "e", "a1", "a2", "v"])

    return keyed.mapInArrow(run, ANCHORS)


def _rerank(pos: DataFrame, *pair: str, count: Column | None = None) -> DataFrame:
    """Replace ``pair`` by its rank in the sorted order of the pairs that occur at least twice; other positions leave."""
    twice = pos.groupBy(*pair).agg((F.count(F.lit(1)) if count is None else count).alias("n")).where("n > 1").drop("n")
    ranks = stored(twice.repartitionByRange(*pair).sortWithinPartitions(*pair).withColumn("next", F.monotonically_increasing_id()), "ranks")
    return pos.join(ranks, list(pair)).drop(*pair).withColumnRenamed("next", "rank")


def _sized(per_doc: DataFrame) -> DataFrame:
    """Mark per-document ranges for a broadcast if their checked size is small."""
    total = per_doc.agg(F.sum(F.size("ranges") * 8 + 48)).first()[0] or 0
    return F.broadcast(per_doc) if total <= BROADCAST_BYTES else per_doc


def _windows(keyed: DataFrame, wanted: DataFrame, threshold: int) -> DataFrame:
    """(did, th, i, x): the hash of every wanted window; ``wanted`` has ranges of starts by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "th"))
            ranges = batch.column("ranges")
            for s in slices(batch.column("text")):
                H = rolling(BYTE[s.buf])
                for r in range(s.n):
                    got = ranges[s.first + r].values
                    a, b = got.field("s").to_numpy().astype(np.int64), got.field("e").to_numpy().astype(np.int64)
                    i = np.unique(np.repeat(a - np.concatenate([[0], np.cumsum(b - a + 1)[:-1]]), b - a + 1) + np.arange((b - a + 1).sum()))
                    x = span_hash(H, s.offs[r] + i, s.offs[r] + i + threshold)
                    n = len(i)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, did[s.first + r])), pa.array(np.full(n, th[s.first + r])), pa.array(i.astype(np.int32)), pa.array(x.view(np.int64))], names=["did", "th", "i", "x"])

    by_doc = stored(wanted.groupBy("did", "th").agg(F.collect_list(F.struct("s", "e")).alias("ranges")), "wanted")
    texts = keyed.join(_sized(by_doc), ["did", "th"]).select("did", "th", "text", "ranges")
    return texts.mapInArrow(run, "did long, th long, i int, x long")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = [_merged(r) for r in batch.column("ranges")]
        sizes = np.cumsum([0, *(len(a) for a, _ in runs)], dtype=np.int32)
        flat = [np.concatenate([x[k] for x in runs]).astype(np.int32) for k in (0, 1)] if runs else [np.zeros(0, np.int32)] * 2
        lists = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays(list(map(pa.array, flat)), names=["s", "e"]))
        yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("th"), lists], names=["did", "th", "ranges"])


def _spans(keyed: DataFrame, threshold: int) -> DataFrame:
    """(did, th, ranges) of the keyed texts (strings or bytes) that have a repeated string of ``threshold`` bytes."""
    pos = stored(_rerank(_anchor_rows(keyed, threshold), "a1"), "anchors")
    # the next round ranks variants with their counts, so equal neighbourhoods are one row each
    place = F.struct("did", "th", "s", "e")
    variants = pos.groupBy("rank", "a2", "v").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"))
    variants = stored(_rerank(stored(variants, "variants"), "rank", "a2", count=F.sum("n")), "variants")
    whole = pos.join(variants.where("n > 1").select("v"), "v").select("did", "th", "s", (F.col("e") + threshold).alias("e"))
    contested = variants.where("n = 1").select("rank").distinct()
    wanted = variants.join(contested, "rank").select("at.*")
    # two equal rows ask for the same windows twice; these belong to repeated variants anyway
    windows = _windows(keyed, wanted, threshold)
    twice = windows.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x")
    single = windows.join(twice, "x").select("did", "th", F.col("i").alias("s"), (F.col("i") + threshold).alias("e"))
    lists = whole.unionByName(single).groupBy("did", "th").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    return stored(lists.mapInArrow(_merge, RANGES), "spans")


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(did, th, ranges): the maximal runs of bytes to remove, of each document that has any."""
    return _spans(_keyed(docs), threshold)


def _longer(keyed: DataFrame, spans: DataFrame, threshold: int) -> DataFrame:
    """The spans of a longer ``threshold``, judged on the runs of ``spans`` that can hold one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = (batch.column(c).to_pylist() for c in ("did", "th"))
            rows = []
            for s in slices(batch.column("text")):
                for r in range(s.n):
                    a, b = _merged(batch.column("ranges")[s.first + r])
                    raw = s.buf[s.offs[r] : s.offs[r + 1]]
                    rows += [(did[s.first + r], th[s.first + r], x, raw[x:y].tobytes()) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["did", "th", "at", "text"])

    long = spans.select("did", "th", F.filter("ranges", lambda r: r["e"] - r["s"] >= threshold).alias("ranges")).where(F.size("ranges") > 0)
    texts = keyed.join(_sized(long), ["did", "th"]).select("did", "th", "text", "ranges")
    pieces = stored(texts.mapInArrow(cut, "did long, th long, at int, text binary"), "pieces")
    # a piece is known by its document and place
    found = _spans(pieces.select("did", F.xxhash64("th", "at").alias("th"), "text"), threshold).withColumnRenamed("th", "piece")
    places = pieces.select("did", "th", "at", F.xxhash64("th", "at").alias("piece")).distinct()
    moved = found.join(places, ["did", "piece"]).select("did", "th", F.explode(F.transform("ranges", lambda r: F.struct((r["s"] + F.col("at")).alias("s"), (r["e"] + F.col("at")).alias("e")))).alias("r"))
    return stored(moved.groupBy("did", "th").agg(F.collect_list("r").alias("ranges")), "spans")


def _merged(spans: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a list of (s, e)."""
    if not spans.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s, e = spans.values.field("s").to_numpy().astype(np.int64), spans.values.field("e").to_numpy().astype(np.int64)
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:], len(s)) - 1]


def _kept(raw: memoryview, s: np.ndarray, e: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in zip(s.tolist(), e.tolist(), strict=True):
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out)


def _words(raw: bytes, a: int, b: int) -> int:
    """Whole words ([^\\x20\\x09-\\x0D]+) of ``raw`` inside [a, b)."""
    words = raw[a:b].split()
    inside = lambda at: 0 < at < len(raw) and not raw[at - 1 : at].isspace() and not raw[at : at + 1].isspace()
    return max(len(words) - inside(a) - inside(b), 0)


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, passage: int = PASSAGE_BYTES, min_words: int = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_bytes) for every row of ``docs(doc_id, text)``.

    The first five are those of the repeated strings of ``threshold`` bytes.
    The last two count the passages: runs of repeated strings of ``passage``
    bytes (at most ``threshold``) with at least ``min_words`` whole words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s in slices(batch.column("text")):
                for r in range(s.n):
                    a, b = _merged(batch.column("spans")[s.first + r])
                    raw = s.buf[s.offs[r] : s.offs[r + 1]].tobytes()
                    found = [(x, y) for x, y in zip(*(v.tolist() for v in _merged(batch.column("shorter")[s.first + r])), strict=True) if _words(raw, x, y) >= min_words]
                    rows.append((len(raw), int((b - a).sum()), len(a), hashlib.sha256(_kept(memoryview(raw), a, b)).hexdigest(), len(found), sum(y - x for x, y in found)))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(cols)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes"])

    keyed = _keyed(docs.select("doc_id", "text"))
    shorter = _spans(keyed, min(passage, threshold))
    longer = _longer(keyed, shorter, threshold).withColumnRenamed("ranges", "spans")
    both = stored(shorter.join(longer, ["did", "th"], "left"), "spans")
    size = both.agg(F.sum((F.size("ranges") + F.coalesce(F.size("spans"), F.lit(0))) * 8 + 48)).first()[0] or 0
    joined = keyed.join(F.broadcast(both) if size <= BROADCAST_BYTES else both, ["did", "th"], "left")
    rows = joined.select(F.nullif("did", F.lit(NO_ID)).alias("doc_id"), "text", "spans", F.col("ranges").alias("shorter"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_bytes long")


def dedup_text(docs: DataFrame, threshold: int = THRESHOLD, min_words: int = 0) -> DataFrame:
    """``docs`` without the repeated bytes of ``text``; characters that a cut would divide go as a whole. A null text becomes empty.

    Runs with fewer than ``min_words`` whole words stay.
    """
    did, th, text, spans = unused(docs, "did", "th", "body", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in slices(batch.column(text)):
                for r in range(s.n):
                    a, b = _merged(batch.column(spans)[s.first + r])
                    raw = s.buf[s.offs[r] : s.offs[r + 1]].tobytes()
                    if min_words and len(a):
                        on = np.array([_words(raw, x, y) >= min_words for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                        a, b = a[on], b[on]
                    for at in range(len(a)):
                        while a[at] > 0 and raw[a[at]] & 0xC0 == 0x80:
                            a[at] -= 1
                        while b[at] < len(raw) and raw[b[at]] & 0xC0 == 0x80:
                            b[at] += 1
                    out.append(_kept(memoryview(raw), a, b).decode())
            if out:
                keep = [c for c in batch.schema.names if c not in (spans, text)]
                yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(out, pa.string())], names=[*keep, text])

    hashed = _ids_repeat(docs)
    found = _sized(_spans(_keyed(docs.select("doc_id", "text"), hashed), threshold)).select(F.col("did").alias(did), F.col("th").alias(th), F.col("ranges").alias(spans))
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = [c for c in docs.columns if c != "text"]
    named = docs.withColumns({text: body, did: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), th: F.xxhash64(body) if hashed else F.lit(0).cast("long")})
    joined = named.join(found, [did, th], "left").select(*[F.col(f"`{c}`") for c in rest], text, spans)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.drop(text, spans).schema) + f", `{text}` string"
    return joined.mapInArrow(run, schema).select(*[F.col(f"`{text}`").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
