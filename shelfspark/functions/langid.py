"""Language of a text by byte n-grams, with a margin that says whether to rely on it.

The model is naive Bayes over hashed n-grams of one to four bytes of lower
cased letters: one table of languages x ``BUCKETS`` log probabilities, of
fixed size whatever was counted. Counting is additive: each partition adds up
one such table, Spark sums them. A guess is reliable if the text has enough
n-grams and the best language is ahead of the second by enough for each of
them; what is short, mixed or in no known language is not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, SIZES = 1 << 14, (1, 2, 3, 4)
#: Bytes of text that are scored at once; longer texts are added up in pieces.
PIECE = 1 << 16
#: n-grams that a reliable guess needs, and nats for each that it must be ahead.
LEAST, AHEAD = 60, 0.5
_CLEAN = r"[^\p{L}]+"


def _letters(c: Column) -> Column:
    """Lower-case words with single blanks around them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), _CLEAN, " ")), F.lit(" "))


def _buckets(data: bytes) -> Iterator[np.ndarray]:
    """Hashed n-grams of each piece of ``data``; a piece begins with the last bytes of the one before, counted once."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    for at in range(0, len(b), PIECE):
        lo, hi = at, min(at + PIECE, len(b))
        for n in SIZES:
            end = min(hi + n - 1, len(b))
            part = b[lo:end]
            if len(part) < n:
                continue
            h = np.full(len(part) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = (h * np.uint64(0x100000001B3)) ^ part[k : len(part) - n + 1 + k]
            h ^= h >> np.uint64(29)
            yield ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)).astype(np.int64)


@dataclass(frozen=True)
class Languages:
    """Names of the languages and log probabilities (languages x BUCKETS)."""

    names: tuple[str, ...]
    weights: np.ndarray

    def guess(self, data: bytes) -> tuple[str | None, float, bool]:
        """(language, nats ahead for each n-gram, reliable)."""
        total, n = np.zeros(len(self.names)), 0
        for h in _buckets(data):
            total += self.weights[:, h].sum(axis=1, dtype=np.float64)
            n += len(h)
        if not n or not len(self.names) or not data.strip():
            return None, 0.0, False
        order = np.argsort(-total, kind="stable")
        ahead = float(total[order[0]] - total[order[1]]) / n if len(order) > 1 else 0.0
        return self.names[order[0]], ahead, n >= LEAST and ahead >= AHEAD


def fit_languages(texts: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
    """A model of all rows with a language; what it collects are languages x BUCKETS counts at most.

    Rows without a language or text are left out; no rows give a model that
    guesses nothing.
    """
    rows = texts.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), _letters(F.col(text)).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                have = held.setdefault(name, np.zeros(BUCKETS, dtype=np.int64))
                for h in _buckets(t):
                    have += np.bincount(h, minlength=BUCKETS)
        for name, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])

    found = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = tuple(sorted(set(found["lang"])))
    counts = np.zeros((len(names), BUCKETS))
    counts[[names.index(x) for x in found["lang"]], found["bucket"]] = found["n"]
    # half a count for what was not seen, so that no n-gram decides alone
    smooth = counts + 0.5
    return Languages(names, np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32))


def detected(df: DataFrame, text: str, model: Languages) -> DataFrame:
    """``df`` with ``detected`` (null if there is nothing to go by), ``ahead`` and ``reliable``."""
    from pyspark.sql import types as T

    sent = df.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([*df.schema.fields, T.StructField("detected", T.StringType()), T.StructField("ahead", T.DoubleType()), T.StructField("reliable", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, ahead, sure = zip(*[sent.value.guess(t) for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()], strict=True) if b.num_rows else ((), (), ())
            made = [pa.array(names, pa.string()), pa.array(ahead, pa.float64()), pa.array(sure, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=out.names)

    return df.withColumn("letters_", _letters(F.col(text))).mapInArrow(run, out)


def language_mismatch(language: Column, found: Column, reliable: Column) -> Column:
    """Whether a description is reliably in another language than the one named; doubt is no mismatch."""
    return F.coalesce(reliable & language.isNotNull() & (found != language), F.lit(False))
