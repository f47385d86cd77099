"""Byte-level BPE: texts to token ids with offsets, and ids back to bytes.

A rank file becomes a model of the ``tokenizers`` library: each byte is
written as one printable character, a token as the string of its bytes'
characters, and each token's merge is what all merges before it leave of the
token. Texts are cut by the pattern; every match ("piece") is encoded by
itself, each distinct piece once while it is remembered. Work is done over
Arrow batches, in groups of about ``GROUP`` characters, and longer texts in
parts cut before white space that follows other characters, where every
pattern of this kind ends a piece: the memory of a worker depends neither on
the size of a batch nor on that of a text.

Decoding reverses the byte table. Characters split between tokens come back
whole when all their tokens are there; the offsets of each of these tokens
cover the whole character.

Defined results: null and empty texts have no tokens and decode to no bytes;
strings of special tokens are ordinary text; bytes that are not UTF-8 count as
U+FFFD; null ids and ids outside the vocabulary decode to U+FFFD; a null list
of ids decodes to no bytes; equal rows give equal results; an empty table
gives none; other columns are kept, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .common import small_batches, unused

GROUP = 1 << 20
#: What remembered pieces may take, in about bytes.
MEMORY = 96 << 20
#: Characters of whose classes all Unicode versions of the two pattern engines agree; a text with others is split by the library itself.
UNSETTLED = r"[^\x00-ԯ‐-‧‰-⁞぀-ゖァ-ヺ一-龥가-힣]"
_models: dict = {}


def byte_characters() -> list[str]:
    """The character of each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        out.setdefault(b, chr(0x100 + len(out) - len(own)))
    return [out[b] for b in range(256)]


def merged_before(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts of ``token`` after all merges of lower rank."""
    cap, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], cap))
        if ranks.get(parts[at] + parts[at + 1], cap) >= cap:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Vocabulary:
    """A rank file and the pattern that splits text; its bytes travel with the tasks, so executors need no file."""

    def __init__(self, path: str, pattern: str):
        self.data, self.pattern = Path(path).read_bytes(), pattern
        self.version = hashlib.sha256(self.data + pattern.encode()).hexdigest()

    def model(self, offsets: bool = False) -> Model:
        key = self.version, offsets
        if key not in _models:
            _models[key] = Model(self, offsets)
        return _models[key]


class Model:
    """What a worker keeps of a vocabulary, and the tokens of pieces it has met."""

    def __init__(self, vocabulary: Vocabulary, offsets: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import regex
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, vocabulary.data.splitlines())}
        chars = byte_characters()
        written = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = []
        for t in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__):
            parts = merged_before(t, ranks)
            if len(parts) != 2:
                raise ValueError(f"token {ranks[t]} is not one merge of earlier tokens")
            merges.append((written[parts[0]], written[parts[1]]))
        self.library = Tokenizer(models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split_exactly = pre_tokenizers.Split(Regex(vocabulary.pattern), "isolated").pre_tokenize_str
        latin = "".join(map(chr, range(0x100)))
        letters, digits, spaces = ("".join(map(re.escape, regex.findall(c, latin))) for c in (r"\p{L}", r"\p{N}", r"\s"))
        plain = vocabulary.pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{digits}]")
        for written_so, means in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{digits}]"), (r"\S", f"[^{spaces}]"), (r"\s", f"[{spaces}]")):
            plain = plain.replace(written_so, means)
        # on Latin-1 the standard library's engine does the same in less than half the time
        self.plain, self.wide = (None if r"\p" in plain else re.compile(plain).findall), re.compile(r"[^\x00-\xff]").search
        self.split, self.unsettled, self.cut = regex.compile(vocabulary.pattern).findall, regex.compile(UNSETTLED).search, regex.compile(r"(?<=\S)\s").search
        # the byte table reversed: each id's bytes, one after another; the last entry is what is not in the vocabulary
        byte_of = {c: b for b, c in enumerate(chars)}
        size = max(ranks.values(), default=-1) + 1
        tokens = ["�".encode()] * (size + 1)
        for t, r in ranks.items():
            tokens[r] = bytes(byte_of[c] for c in written[t])
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.token_at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.offsets = offsets
        self.forget()

    def forget(self) -> None:
        """No pieces are known. ``place`` numbers them; ``first`` says where each one's tokens begin in ``values`` (ids, and starts and ends of offsets)."""
        self.place: dict[str, int] = {}
        self.first, self.chars, self.held = array("q", [0]), array("q"), 0
        self.values = [array("i") for _ in range(3 if self.offsets else 1)]

    def pieces(self, text: str) -> list[str]:
        if self.plain and not self.wide(text):
            return self.plain(text)
        return [p for p, _ in self.split_exactly(text)] if self.unsettled(text) else self.split(text)

    def parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > GROUP:
            cut = self.cut(text, at + GROUP)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def learn(self, pieces: list[str]) -> None:
        """Encode the pieces not remembered."""
        if self.held > MEMORY:
            self.forget()
        new = list(set(pieces).difference(self.place))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        run = self.library.encode_batch if self.offsets else self.library.encode_batch_fast
        ids = self.values[0]
        for e in run(new, add_special_tokens=False):
            ids.extend(e.ids)
            self.first.append(len(ids))
            if self.offsets:
                starts, ends = zip(*e.offsets, strict=True)
                self.values[1].extend(starts)
                self.values[2].extend(ends)
        self.chars.extend(map(len, new))
        self.held = 200 * len(self.place) + 2 * sum(self.chars) + 12 * len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Tokens of each text, and ids (with offsets also starts and ends, in characters) of all, one after another."""
        split = [self.pieces(t) for t in texts]
        flat, n_pieces = list(chain.from_iterable(split)), list(map(len, split))
        self.learn(flat)
        at = np.fromiter(map(self.place.__getitem__, flat), dtype=np.int64, count=len(flat))
        first = np.frombuffer(self.first, dtype=np.int64)
        begin, n = first[at], first[at + 1] - first[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        token = np.repeat(begin - ends[:-1], n) + np.arange(ends[-1])
        out = [np.frombuffer(v, dtype=np.int32)[token] if len(token) else np.zeros(0, dtype=np.int32) for v in self.values]
        bounds = np.concatenate([[0], np.cumsum(n_pieces)]).astype(np.int64)
        if self.offsets:
            chars = np.frombuffer(self.chars, dtype=np.int64)[at] if len(at) else np.zeros(0, dtype=np.int64)
            text_start = np.repeat(np.cumsum([0, *map(len, texts)])[:-1], n_pieces)
            shift = np.repeat(np.cumsum(chars) - chars - text_start, n)
            out[1:] = [v + shift for v in out[1:]]
        return np.diff(ends[bounds]), out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ``ids``, and how many each has."""
        unknown = len(self.token_at) - 2
        ids = np.where((ids >= 0) & (ids < unknown), ids, unknown)
        n = self.token_at[ids + 1] - self.token_at[ids]
        return self.token_bytes[np.repeat(self.token_at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def _texts(column: pa.Array) -> list[str]:
    try:
        out = column.to_pylist()
    except UnicodeDecodeError:
        out = [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]
    return [t or "" for t in out]


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts, about ``GROUP`` characters each."""
    first = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > GROUP:
            yield first, i
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)


def _lists(n: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values, kind))


def _mapped(df: DataFrame, rest: list[T.StructField], last: Column, run: Callable, made: list[T.StructField]) -> DataFrame:
    """``run`` over the columns ``rest`` and ``last``, which ``made`` replace. Columns travel by number, as names may hold anything."""
    columns = [df[f"`{f.name.replace('`', '``')}`"] for f in rest]
    inner = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate([*rest, *made])])
    rows = small_batches(df).select(*[c.alias(f"c{i}") for i, c in enumerate([*columns, last])])
    return rows.mapInArrow(lambda batches: run(batches, inner.names), inner).toDF(*[f.name for f in [*rest, *made]])


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", offsets: bool = True) -> DataFrame:
    """``df`` with ``ids`` in place of the column ``text``; ``starts`` and ``ends`` are the characters each token touches."""
    names = unused(df.drop(text), "ids", "starts", "ends")[: 3 if offsets else 1]
    rest = [f for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
        model = vocabulary.model(offsets)
        for batch in batches:
            texts = _texts(batch.column(len(rest)))
            for lo, hi in _groups(texts):
                if hi - lo == 1 and len(texts[lo]) > GROUP:
                    n, found, shift = 0, [], 0
                    for part in model.parts(texts[lo]):
                        k, got = model.encode([part])
                        found.append([got[0], *(x + shift for x in got[1:])])
                        n, shift = n + k, shift + len(part)
                    values = [np.concatenate(v) for v in zip(*found, strict=True)]
                else:
                    n, values = model.encode(texts[lo:hi])
                held = batch.slice(lo, hi - lo).columns[: len(rest)]
                yield pa.RecordBatch.from_arrays([*held, *(_lists(n, v, pa.int32()) for v in values)], names=columns)

    return _mapped(df, rest, df[f"`{text}`"].cast("string"), run, [T.StructField(n, T.ArrayType(T.IntegerType(), False), False) for n in names])


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", as_text: bool = False) -> DataFrame:
    """``df`` with ``decoded``, the bytes of ``ids``, in their place; ``as_text`` adds ``decoded_text``, where a character of which tokens are missing is U+FFFD."""
    names = unused(df.drop(ids), "decoded", "decoded_text")[: 2 if as_text else 1]
    rest = [f for f in df.schema.fields if f.name != ids]

    def run(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
        model = vocabulary.model()
        for batch in batches:
            column = batch.column(len(rest))
            for at in range(0, len(column), 200):
                held = column.slice(at, 200)
                n = held.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                data, size = model.decode(held.flatten().fill_null(-1).to_numpy().astype(np.int64))
                ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
                out = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                made = [out, pa.array([b.decode("utf-8", "replace") for b in out.to_pylist()], pa.string())] if as_text else [out]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, 200).columns[: len(rest)], *made], names=columns)

    kinds = (T.BinaryType(), T.StringType())
    return _mapped(df, rest, df[f"`{ids}`"].cast("array<int>"), run, [T.StructField(n, k, False) for n, k in zip(names, kinds, strict=False)])
