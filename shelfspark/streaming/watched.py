"""Watched folders: arrivals as a stream or by comparing listings, imports committed once, sources deleted after it.

The stream lists new files and never reads them; their bytes are hashed in
tasks, in blocks. Each micro-batch becomes one commit of files and import
tasks (``sources.commits``), named by the streaming query's own id and the
number of the batch: a batch that is run again after a crash finds its commit
and changes nothing, one that died before its marker has left nothing behind.

Sources are deleted in two commits around the deletion, the intent and the
outcome. What lies between them is done again by the next call, and a removal
event that the deletion causes finds the intent.

Defined results: a file that vanishes before it is hashed is no arrival; a
file whose hash is the one known for its path makes no task; of several rows
of a path the latest counts; a source whose size or time differs from what
was imported stays (outcome ``changed``); one that is missing already counts
as ``deleted``; empty batches only leave their commit.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.commits import Change, Table, TableSet
from ..sources.files import name_glob, visible
from ..sources.work import stored
from .events import relevant, unchanged_dropped

LISTED = "path string, modificationTime timestamp, length long, content binary"
TABLES = {
    "watched_files": Table("path string, length long, modified timestamp, hash string", ("path",)),
    "import_tasks": Table("task_id string, path string, length long, modified timestamp, hash string, status string, result string", ("task_id",)),
    "source_deletions": Table("task_id string, path string, ts timestamp, outcome string", ("task_id",), refers={"task_id": ("import_tasks", "task_id")}),
}
# Results of an import that took nothing over, and words that tell what a watcher's error is.
DUPLICATES = ("skipped_duplicate", "duplicate")
GONE = ("no such file", "not found", "enoent", "does not exist")
DENIED = ("permission denied", "access denied", "eperm", "eacces")


def _located(path: str):
    """File system and its own path of a Hadoop path, which has no escapes."""
    from pyarrow import fs

    scheme = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*(?=:)", path)
    if scheme is None or scheme[0] == "file":
        return fs.LocalFileSystem(), "/" + path[scheme.end() + 1 if scheme else 0 :].lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe="/:@"))


def _sha256(path: str) -> str | None:
    system, name = _located(path)
    digest = hashlib.sha256()
    try:
        with system.open_input_stream(name) as data:
            while block := data.read(1 << 20):
                digest.update(block)
    except FileNotFoundError:
        return None
    return digest.hexdigest()


def hashed(files: DataFrame) -> DataFrame:
    """``files(path, length, modified)`` with the SHA-256 of their bytes; files that are gone are out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(hash=pd.Series([_sha256(p) for p in frame["path"]], index=frame.index, dtype="object"))

    return files.select("path", "length", "modified").mapInPandas(run, "path string, length long, modified timestamp, hash string").where("hash is not null")


def _listed(files: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    rows = visible(files, spark, root).select("path", "length", F.col("modificationTime").alias("modified"), F.lit("changed").alias("kind"))
    return relevant(rows).drop("kind")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified) of all book files below ``root``; no bytes are read."""
    return _listed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name_glob()).load(root), spark, root)


def arrivals(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (path, length, modified): files that appear below ``root``. A file changed in place is seen by ``polled`` only."""
    stream = spark.readStream.format("binaryFile").schema(LISTED).option("recursiveFileLookup", "true").option("pathGlobFilter", name_glob()).option("maxFilesPerTrigger", files_per_batch)
    return _listed(stream.load(root), spark, root)


def polled(now: DataFrame, known: DataFrame) -> DataFrame:
    """Events (path, kind, length, modified) between what is known and a listing: changed in size or time, new, removed."""
    had = known.select("path", F.col("length").alias("had_length"), F.col("modified").alias("had_modified"), F.lit(True).alias("had"))
    both = now.select("path", "length", "modified", F.lit(True).alias("is")).join(had, "path", "full")
    same = F.col("length").eqNullSafe(F.col("had_length")) & F.col("modified").eqNullSafe(F.col("had_modified"))
    kind = F.when(F.col("is").isNull(), "removed").when(F.col("had").isNull() | ~same, "changed")
    return both.select("path", kind.alias("kind"), "length", "modified").where("kind is not null")


def deletable(tasks: DataFrame, deletions: DataFrame) -> DataFrame:
    """Tasks whose source may be deleted: completed, not found to be a duplicate, and without a deletion so far."""
    took = tasks.where("status = 'completed'").where(~F.coalesce(F.col("result").isin(*DUPLICATES), F.lit(False)))
    return took.join(deletions.select("task_id"), "task_id", "left_anti")


def errors(found: DataFrame, directories: DataFrame) -> DataFrame:
    """``found(path, error)`` with ``class`` (gone, denied or other) and the ``directory_id`` whose path begins theirs, the shortest if several do."""
    has = lambda words: F.lower("error").rlike("|".join(words))
    kind = F.when(has(GONE), "gone").when(has(DENIED), "denied").otherwise("other")
    rows = found.withColumn("class", F.when(F.col("path").isNull(), "other").otherwise(kind))
    # beginnings are joined by equality: one row for each length, of distinct paths only
    starts = rows.select("path").where("path is not null").distinct().select("path", F.explode(F.sequence(F.lit(1), F.greatest(F.length("path"), F.lit(1)))).alias("n"))
    starts = starts.select("path", F.expr("substring(path, 1, n)").alias("start"))
    of = starts.join(directories.select(F.col("path").alias("start"), F.col("id").alias("directory_id")), "start")
    of = of.groupBy("path").agg(F.min_by("directory_id", F.struct(F.length("start"), "directory_id")).alias("directory_id"))
    return rows.join(of, "path", "left")


class Inbox:
    """Files, import tasks and deletions of watched folders, in tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.tables = spark, TableSet(spark, root, TABLES)

    def take(self, files: DataFrame, commit: str, removed: DataFrame | None = None) -> bool:
        """Commit ``files(path, length, modified)`` with a pending task for each whose bytes are new, and forget the paths of ``removed``."""
        if self.tables.known(commit):
            return False
        last = files.groupBy("path").agg(F.max_by(F.struct("length", "modified"), "modified").alias("f")).select("path", "f.*")
        seen = stored(hashed(last), "inbox")  # each file is read once
        new = unchanged_dropped(seen, self.tables.read("watched_files"))
        tasks = new.select(F.sha2(F.concat_ws("\0", F.lit(commit), "path"), 256).alias("task_id"), "path", "length", "modified", "hash", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("result"))
        gone = removed.select("path") if removed is not None else None
        return self.tables.commit(commit, {"watched_files": Change(seen, gone), "import_tasks": Change(tasks)}).committed

    def poll(self, root: str, commit: str) -> DataFrame:
        """Take what changed below ``root`` since the last time; the events, as they were found."""
        below = self.tables.read("watched_files").where(F.col("path").startswith(_qualified(self.spark, root) + "/"))
        found = stored(polled(listing(self.spark, root), below), "polled")
        self.take(found.where("kind = 'changed'"), commit, found.where("kind = 'removed'"))
        return found

    def watch(self, root: str, checkpoint: str, files_per_batch: int = 1000, **trigger) -> StreamingQuery:
        """Start the stream that takes each batch of arrivals once; ``trigger`` as ``DataStreamWriter.trigger`` has it."""

        def sink(batch: DataFrame, number: int) -> None:
            # the id lies in the checkpoint: a new checkpoint is a new query, whose batches count from 0 again
            query = json.loads("".join(r.value for r in batch.sparkSession.read.text(f"{checkpoint}/metadata").collect()))["id"]
            self.take(batch, f"{query}-{number}")

        return arrivals(self.spark, root, files_per_batch).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def finish(self, results: DataFrame, commit: str) -> bool:
        """Write ``results(task_id, status, result)`` of imports to their tasks; unknown tasks are left out."""
        tasks = self.tables.read("import_tasks").drop("status", "result").join(results.select("task_id", "status", "result"), "task_id")
        return self.tables.commit(commit, {"import_tasks": Change(tasks)}).committed

    def delete_sources(self) -> DataFrame:
        """Delete the sources of finished imports; (task_id, path, ts, outcome) of those that this call settled."""
        due = deletable(self.tables.read("import_tasks"), self.tables.read("source_deletions"))
        intent = due.select("task_id", "path", F.current_timestamp().alias("ts"), F.lit(None).cast("string").alias("outcome"))
        self.tables.commit(f"intent-{uuid.uuid4().hex}", {"source_deletions": Change(intent)})
        # also those that an earlier call only meant to delete
        open_ = self.tables.read("source_deletions").where("outcome is null").join(self.tables.read("import_tasks").select("task_id", "length", "modified"), "task_id")
        settled = stored(_deleted(open_), "deleted")
        self.tables.commit(f"outcome-{uuid.uuid4().hex}", {"source_deletions": Change(settled)})
        return settled

    def own_deletions(self) -> DataFrame:
        """Deletions meant or done, as events for ``gate.gated``."""
        return self.tables.read("source_deletions").select("path", F.lit("own").alias("kind"), "ts")


def _qualified(spark: SparkSession, root: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def _deleted(rows: DataFrame) -> DataFrame:
    """Delete each path that still has its length and time; done again, it finds the file missing."""

    def outcome(path: str, length: int, millis: int) -> str | None:
        from pyarrow import fs

        system, name = _located(path)
        info = system.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            return "deleted"
        if info.size != length or abs(info.mtime_ns // 1_000_000 - millis) > 1:
            return "changed"
        try:
            system.delete_file(name)
        except FileNotFoundError:
            pass
        except OSError:
            return None  # tried again by the next call
        return "deleted"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [outcome(p, n, m) for p, n, m in zip(frame["path"], frame["length"], frame["millis"], strict=True)]
            yield frame[["task_id", "path", "ts"]].assign(outcome=pd.Series(got, index=frame.index, dtype="object"))

    said = "task_id string, path string, ts timestamp, outcome string"
    return rows.select("task_id", "path", "ts", "length", F.unix_millis("modified").alias("millis")).mapInPandas(run, said).where("outcome is not null")
