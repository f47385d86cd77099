"""Tables that change together: staged files, one marker for a commit, keys checked before it.

A commit first writes the rows that change in each table as new Parquet
folders, which nothing reads. Then one marker file appears under the number
that follows the last one; it names the live folders of every table. Readers
follow the newest marker only, so a job that dies before the marker changes
no table, and one that dies after it has changed all of them. Two writers
that start from the same commit want the same number: the second one gets
``Conflict`` and starts again from what it then reads.

A row replaces the row of its key, a key among the deleted takes it away;
readers keep the newest row of each key, and ``compact`` writes that state
down. Written is in proportion to what changes.

Before the marker, all rows are held against the rules: keys that are null or
repeated within a commit, unique columns taken by another key, and references
to rows that aren't there come back as rows, and nothing is committed.

Defined results: a commit of an id that was committed before changes nothing;
deleting an unknown key changes nothing; a key both written and deleted in
one commit is written; an empty commit only leaves its id; nulls in unique
columns or references are held against nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another commit took the number."""


@dataclass(frozen=True)
class Table:
    """Schema (DDL), key columns, sets of unique columns, and references: column -> (table, column)."""

    schema: str
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    refers: dict[str, tuple[str, str]] = field(default_factory=dict)


@dataclass
class Change:
    """Rows that are written, and keys of rows that are deleted."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None


@dataclass
class Outcome:
    """``committed`` is false for a repeated id (without violations) and for rows that break a rule."""

    committed: bool
    violations: DataFrame | None = None


VIOLATION = "table string, rule string, key string"


class TableSet:
    """The tables below ``root``, a folder that the whole cluster reads."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    # --- markers

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the newest commit; 0 before the first."""
        path, fs = self._path("commits")
        return max((int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()), default=0) if fs.exists(path) else 0

    def marker(self, version: int) -> dict:
        """What a commit says: its id, and the live folders."""
        if not version:
            return {"live": {}}
        path, fs = self._path(f"commits/{version:012d}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def known(self, commit: str) -> bool:
        """Whether a commit of this id was made."""
        if not self.version():
            return False
        return bool(self.spark.read.schema("id string").json(f"{self.root}/commits/[0-9]*").where(F.col("id") == commit).limit(1).count())

    def publish(self, version: int, marker: dict) -> None:
        """Let the marker appear whole, or not at all if the number is taken."""
        staged, fs = self._path(f"commits/_{uuid.uuid4().hex}")
        target, _ = self._path(f"commits/{version:012d}")
        out = fs.create(staged, True)
        out.write(json.dumps(marker).encode())
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(staged, target, options)
        except Py4JJavaError as taken:
            fs.delete(staged, False)
            if "FileAlreadyExists" in str(taken.java_exception.getClass()):
                raise Conflict(f"commit {version} was made by another writer") from None
            raise

    # --- reading

    def _history(self, name: str, paths: list[str]) -> DataFrame:
        schema = f"{self.tables[name].schema}, _gone boolean, _version long"
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """Rows of the table as of a commit, the newest one by default."""
        at = self.version() if version is None else version
        return self._latest(name, self._history(name, self.marker(at)["live"].get(name, [])))

    def _latest(self, name: str, rows: DataFrame) -> DataFrame:
        table = self.tables[name]
        columns = [c for c in rows.columns if c not in ("_gone", "_version")]
        last = rows.groupBy(*table.key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in table.key]), F.struct("_version", (~F.col("_gone")).alias("written"))).alias("r"))
        return last.where("not r._gone").select(*[F.col(c) if c in table.key else F.col(f"r.{c}").alias(c) for c in columns])

    # --- writing

    def _stage(self, name: str, change: Change, version: int) -> str:
        table, path = self.tables[name], f"data/{name}/{version:012d}-{uuid.uuid4().hex}"
        want = self.spark.createDataFrame([], table.schema).schema
        parts = []
        if change.rows is not None:
            parts.append(change.rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want], F.lit(False).alias("_gone")))
        if change.gone is not None:
            parts.append(change.gone.select(*[(F.col(f.name) if f.name in table.key else F.lit(None)).cast(f.dataType).alias(f.name) for f in want], F.lit(True).alias("_gone")).distinct())
        reduce(DataFrame.unionByName, parts).withColumn("_version", F.lit(version).cast("long")).write.parquet(f"{self.root}/{path}")
        return path

    def _broken(self, live: dict[str, list[str]], staged: dict[str, str]) -> DataFrame:
        """Violations (table, rule, key) that the staged rows would bring."""
        new = {n: self._history(n, [p]).where("not _gone") for n, p in staged.items()}
        after = {n: self._latest(n, self._history(n, [*live.get(n, []), *([staged[n]] if n in staged else [])])) for n in self.tables}
        said = lambda d, name, rule, key: d.select(F.lit(name).alias("table"), F.lit(rule).alias("rule"), F.to_json(F.struct(*key)).alias("key"))
        found = []
        for name, table in self.tables.items():
            key = list(table.key)
            if name in new:
                null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
                found.append(said(new[name].where(null), name, "null key", key))
                found.append(said(new[name].where(~null).groupBy(*key).count().where("count > 1"), name, "repeated key", key))
                for columns in table.unique:
                    # only groups that this commit touches are looked at
                    touched = new[name].select(*columns).dropna().distinct()
                    groups = after[name].join(touched, list(columns), "left_semi").groupBy(*columns).count().where("count > 1").select(*columns)
                    found.append(said(new[name].join(groups, list(columns), "left_semi"), name, f"unique {', '.join(columns)}", key))
            for column, (other, target) in table.refers.items():
                there = after[other].select(F.col(target).alias(column)).where(F.col(column).isNotNull()).distinct()
                if name in new:
                    found.append(said(new[name].where(F.col(column).isNotNull()).join(there, column, "left_anti"), name, f"{column} refers to {other}", key))
                if other in staged:  # rows that lose what they refer to
                    lost = self._history(other, [staged[other]]).where("_gone").select(F.col(target).alias(column)).join(there, column, "left_anti")
                    found.append(said(after[name].join(lost, column, "left_semi"), name, f"{column} refers to {other}", key))
        return reduce(DataFrame.unionByName, found).distinct() if found else self.spark.createDataFrame([], VIOLATION)

    def commit(self, commit: str, changes: dict[str, Change]) -> Outcome:
        """Change all tables of ``changes`` at once, once for each id."""
        if self.known(commit):
            return Outcome(False)
        version = self.version()
        live = self.marker(version)["live"]
        staged = {n: self._stage(n, c, version + 1) for n, c in changes.items() if c.rows is not None or c.gone is not None}
        broken = self._broken(live, staged)
        if broken.limit(1).count():
            return Outcome(False, broken)
        self.publish(version + 1, {"id": commit, "live": {**live, **{n: [*live.get(n, []), p] for n, p in staged.items()}}})
        return Outcome(True)

    def compact(self, name: str) -> None:
        """Write the state of a table down as one folder; what readers see stays the same."""
        version = self.version()
        live = self.marker(version)["live"]
        path = f"data/{name}/{version + 1:012d}-{uuid.uuid4().hex}"
        rows = self._latest(name, self._history(name, live.get(name, [])))
        rows.withColumns({"_gone": F.lit(False), "_version": F.lit(version + 1).cast("long")}).write.parquet(f"{self.root}/{path}")
        self.publish(version + 1, {"id": f"compact-{version + 1}-{name}", "live": {**live, name: [path]}})
