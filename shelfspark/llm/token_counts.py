"""Delta-maintained token counts by source, language and tokenizer version.

A batch of changes (insert, delete, revise) becomes signed ledger rows, each
document's token count with a plus or a minus; sums of a batch's rows are its
delta, and totals are the sums of all committed deltas. A batch is written
under its own id first and counts only once its commit marker exists, so a
job that dies can be run again and a committed batch is never applied twice.

``insert`` adds a row's count, ``delete`` takes back all that is counted for
its doc_id, ``revise`` does both. Defined results: null and empty texts have 0
tokens but count as documents; a null doc_id can be inserted but not deleted;
null sources and languages are groups of their own; several inserts of an id
add up; of several revisions of an id in one batch the one of the greatest
(text, source, lang) counts, nulls being least; an id that is inserted and
deleted in one batch loses what was counted before it; deleting an unknown id
changes nothing; an empty batch commits an empty delta; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

# Fixed value: the pre-tokenizer of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEDGER = "doc_id long, source string, lang string, docs long, tokens long"
_encoders: dict = {}


class Tokenizer:
    """A byte-level BPE vocabulary of token ranks; its bytes travel with the tasks, so executors need no file."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.data, self.pattern = Path(path).read_bytes(), pattern
        digest = hashlib.sha256(self.data + pattern.encode()).hexdigest()[:12]
        self.version = f"{Path(path).name}@{digest}"

    def encoder(self):
        if self.version not in _encoders:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.data.splitlines())}
            _encoders[self.version] = tiktoken.Encoding(self.version, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return _encoders[self.version]


def count_tokens(rows: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``rows(doc_id, source, lang, text)`` as ledger rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer.encoder().encode_ordinary
        for batch in batches:
            n = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "source", "lang")], pa.array([1] * len(n), pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "docs", "tokens"])

    return small_batches(rows).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, LEDGER)


def _once(changes: DataFrame) -> DataFrame:
    """Inserts, and one revision of each id; only ids with several revisions are shuffled with their texts."""
    several = changes.where("change = 'revise' and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if not several.limit(1).count():
        return changes
    row = ["text", "source", "lang"]
    twice = (F.col("change") == "revise") & F.col("n").isNotNull()
    marked = changes.select("doc_id", "change", *row).join(several.withColumn("n", F.lit(2)), "doc_id", "left")
    last = marked.where(twice).groupBy("doc_id").agg(F.max(F.struct(*row)).alias("r")).select("doc_id", F.lit("revise").alias("change"), "r.*")
    return marked.where(~twice).drop("n").unionByName(last)


class TokenRollup:
    """Totals kept in the folder ``root``, for one tokenizer version."""

    def __init__(self, spark: SparkSession, root: str, tokenizer: Tokenizer):
        self.spark, self.tokenizer = spark, tokenizer
        self.root = f"{root.rstrip('/')}/{re.sub('[^A-Za-z0-9._@-]', '_', tokenizer.version)}"

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        path, fs = self._path("commits")
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def ledger(self) -> DataFrame | None:
        done = [f"{self.root}/ledger/{b}" for b in self.batches()]
        return self.spark.read.schema(LEDGER).parquet(*done) if done else None

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes(doc_id, change, source, lang, text)`` once; False if ``batch`` was already committed."""
        if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        if batch in self.batches():
            return False
        added = count_tokens(_once(changes.where("change in ('insert', 'revise')")), self.tokenizer)
        before = self.ledger()
        if before is not None:
            gone = changes.where("change in ('delete', 'revise')").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
            held = before.join(gone, "doc_id").groupBy("doc_id", "source", "lang").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            added = added.unionByName(held.where("docs <> 0 or tokens <> 0").withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")}))
        added.write.mode("overwrite").parquet(f"{self.root}/ledger/{batch}")
        rows = self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger/{batch}")
        delta = rows.groupBy("source", "lang").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        delta.write.mode("overwrite").parquet(f"{self.root}/delta/{batch}")
        path, fs = self._path(f"commits/{batch}")
        fs.create(path, False).close()
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches; groups that sum to nothing are left out."""
        schema = "source string, lang string, docs long, tokens long"
        done = [f"{self.root}/delta/{b}" for b in self.batches()]
        rows = self.spark.read.schema(schema).parquet(*done) if done else self.spark.createDataFrame([], schema)
        sums = rows.groupBy("source", "lang").agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0").select("source", "lang", F.lit(self.tokenizer.version).alias("tokenizer"), "n_docs", "n_tokens")
