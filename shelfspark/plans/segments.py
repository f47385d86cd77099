"""A full-text index in generations: a refresh writes the changed documents only, reading merges, compaction folds.

Each generation is a segment: postings sorted by term in files of bounded
size, lengths, the ids it replaces or removes, and a dictionary of the first
and last term of every file. A query looks its words and prefixes up in the
dictionaries and opens no other file; rows of documents that a later
generation replaced are dropped by a join on the ids of that generation. One
marker a generation (``TableSet``) makes it visible whole, once.

Defined results: a refresh of an id that has been made before changes
nothing; ids without a document are removed; ids unknown so far are added; an
empty refresh leaves only its marker; an index without generations finds
nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import TableSet
from ..sources.work import spread, stored
from . import fulltext
from .fulltext import WEIGHTS, Index, Term

POSTINGS, LENGTHS, DEAD, FILES = "id long, col string, place int, term string", "id long, dl int", "id long, generation int", "file string, first string, last string, rows long"
#: Postings in a file.
FILE_ROWS = 2_000_000
_LAST = "\U0010ffff"


class SegmentIndex:
    """The index below ``root``, a folder that the whole cluster reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root.rstrip("/"), TableSet(spark, root, {})

    def segments(self) -> list[dict]:
        """Live segments: folder and generation."""
        return self.log.marker(self.log.version())["live"].get("segments", [])

    def _write(self, generation: int, built: Index, dead: DataFrame) -> dict:
        folder = f"{self.root}/segments/{generation:06d}-{uuid.uuid4().hex}"
        rows = built.postings.select("id", "col", F.col("place").cast("int").alias("place"), "term")
        n = rows.count()
        rows.repartitionByRange(max(1, -(-n // FILE_ROWS)), "term", "id").sortWithinPartitions("term", "id").write.parquet(f"{folder}/postings")
        built.lengths.select("id", F.col("dl").cast("int").alias("dl")).write.parquet(f"{folder}/lengths")
        dead.select("id", F.lit(generation).alias("generation")).distinct().write.parquet(f"{folder}/dead")
        named = self.spark.read.schema(POSTINGS).parquet(f"{folder}/postings").select("term", F.col("_metadata.file_path").alias("file"))
        named.groupBy("file").agg(F.min("term").alias("first"), F.max("term").alias("last"), F.count(F.lit(1)).alias("rows")).coalesce(1).write.parquet(f"{folder}/files")
        return {"folder": folder, "generation": generation}

    def refresh(self, commit: str, docs: DataFrame, changed: DataFrame | None = None) -> bool:
        """The documents ``changed(id)`` (by default those of ``docs``) are from now on those of ``docs``; False if ``commit`` was made before."""
        if self.log.known(commit):
            return False
        version, live = self.log.version(), self.segments()
        with spread(docs):
            ids = None if changed is None else stored(changed.select("id").distinct(), "changed")
            new = docs if changed is None else docs.join(ids, "id", "left_semi")
            rows = stored(fulltext.words(fulltext.long_form(new)), "words")  # tokens are made once, then counted and sorted
            segment = self._write(version + 1, fulltext.of_words(rows), rows if changed is None else ids)
        self.log.publish(version + 1, {"id": commit, "live": {"segments": [*live, segment]}})
        return True

    def compact(self) -> None:
        """All segments as one, without what was replaced."""
        version, whole = self.log.version(), self.index()
        with spread(whole.postings):
            whole = Index(stored(whole.postings, "postings"), stored(whole.lengths, "lengths"))
            segment = self._write(version + 1, whole, whole.lengths.limit(0))
        self.log.publish(version + 1, {"id": f"compact-{version + 1}", "live": {"segments": [segment]}})

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows (with ``generation``) of documents that no later generation replaced."""
        live = self.segments()
        dead = reduce(DataFrame.union, [self.spark.read.schema(DEAD).parquet(f"{s['folder']}/dead") for s in live[1:]]) if len(live) > 1 else None
        if dead is None:
            return rows.drop("generation")
        last = dead.groupBy("id").agg(F.max("generation").alias("since"))
        return rows.join(last, "id", "left").where(F.col("since").isNull() | (F.col("generation") >= F.col("since"))).drop("generation", "since")

    def files(self, terms: list[Term] | None = None) -> list[tuple[str, int]]:
        """(file, generation) of the postings that may hold one of ``terms``."""
        parts = [self.spark.read.schema(FILES).parquet(f"{s['folder']}/files").withColumn("generation", F.lit(s["generation"])) for s in self.segments()]
        if not parts:
            return []
        rows = reduce(DataFrame.union, parts)
        if terms is not None:
            spans = {(w, w + _LAST if t.prefix and k == len(t.words) - 1 else w) for t in terms for k, w in enumerate(t.words)}
            rows = rows.where(reduce(lambda a, b: a | b, [(F.col("first") <= hi) & (F.col("last") >= lo) for lo, hi in sorted(spans)], F.lit(False)))
        return [(r.file, r.generation) for r in rows.select("file", "generation").collect()]

    def index(self, terms: list[Term] | None = None) -> Index:
        """The index of the newest generation, of ``terms`` if given: their files only."""
        of: dict[int, list[str]] = {}
        for file, generation in self.files(terms):
            of.setdefault(generation, []).append(file)
        reads = [self.spark.read.schema(POSTINGS).parquet(*files).withColumn("generation", F.lit(g)) for g, files in sorted(of.items())]
        lengths = [self.spark.read.schema(LENGTHS).parquet(f"{s['folder']}/lengths").withColumn("generation", F.lit(s["generation"])) for s in self.segments()]
        every = lambda parts, schema: self._alive(reduce(DataFrame.union, parts)) if parts else self.spark.createDataFrame([], schema)
        return Index(every(reads, POSTINGS), every(lengths, LENGTHS))

    def search(self, text: str | None, columns: tuple = (), weights: dict[str, float] = WEIGHTS) -> DataFrame:
        """(id, rank) of matching documents, as ``fulltext.search`` finds them in a fresh index."""
        groups, excluded = fulltext.compile_match(text, columns)
        terms = [t for g in groups for t in (*g.wanted, *g.unwanted)] + excluded
        return fulltext.search(self.index(terms), text, columns, weights)
