"""Shared helpers: table access, shared-folder checkpoints, row grouping, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares. Only a local master may go without: it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shelfspark-"))
    return str(jsc.getCheckpointDir().get())


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with files that every executor can read again."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path for ``name`` below the shared folder; all paths of an application lie in one folder, to be removed with it."""
    return f"{shared_dir(spark)}/shelfspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Steps that were stored within ``scratch``.
_steps: ContextVar[list[DataFrame] | None] = ContextVar("steps", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: columnar, compressed, and columns can be pruned."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if (steps := _steps.get()) is not None:
        steps.append(out)
    return out


def dropped(*steps: DataFrame) -> None:
    """Remove the files of ``stored`` steps, which nothing may read any more."""
    for df in steps:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if f"/shelfspark/{spark.sparkContext.applicationId}/" not in folder:
                raise ValueError(f"{folder} holds no step of this application")
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Of the steps stored within only those remain that were given to the function this yields; what a step has shuffled goes as soon as it is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    conf, steps, kept = spark.conf, [], set()
    was, outer = conf.get(name, "false"), _steps.set(steps)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(id(df))
        return df

    conf.set(name, "true")
    try:
        yield keep
    finally:
        conf.set(name, was)
        _steps.reset(outer)
        dropped(*(df for df in steps if id(df) not in kept))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until none is a column of ``df`` (upper and lower case are one)."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def small_batches(df: DataFrame) -> DataFrame:
    """Have Spark hand rows to Python in batches of bounded size, so that neither side holds many long texts at once."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Re-cut a stream sorted by ``key`` so that no group is divided between two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[-1]
        lo, hi = 0, batch.num_rows - 1
        while lo < hi:  # first row of the last group
            mid = (lo + hi) // 2
            if keys[mid] == last:
                hi = mid
            else:
                lo = mid + 1
        if lo == 0 and held and held[-1].column(key)[-1] == last:
            held.append(batch)
            continue
        if lo:
            yield pa.Table.from_batches([*held, batch.slice(0, lo)])
        elif held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(lo)]
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, max_rounds: int = 60, hub: int = 256) -> DataFrame:
    """Connected components of ``edges(a, b)`` as (node, root); root is the least node.

    Min-label hooking with pointer jumping: each round is two joins and one
    partially aggregated ``min``. The edges of a node with more than ``hub``
    of them are dealt to several salts, and its label to each of these, so no
    task meets all of them. Edges with a null end are ignored; no edges give
    an empty table.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    both = stored(e.select(ends).select("e.*").distinct(), "edges")
    hubs = stored(both.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / hub).cast("int").alias("parts")).where("parts > 1"), "hubs")
    salt = F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")
    e = stored(both.join(hubs, "b", "left").select("a", "b", salt.alias("salt")), "edges")
    dropped(both)
    labels = e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    labels = stored(labels, "labels")
    for _ in range(max_rounds):
        sent = labels.select(F.col("node").alias("b"), F.col("root").alias("r")).join(hubs, "b", "left")
        sent = sent.select("b", "r", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
        seen = e.join(sent, ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("r").alias("best"))
        # a root hooks to the least label any of its members sees
        hooked = (
            labels.join(seen, "node").groupBy("root").agg(F.min("best").alias("to"))
            .select("root", F.least("root", "to").alias("to"))
        )
        jump = hooked.select(F.col("root").alias("to"), F.col("to").alias("to2"))
        step = hooked.join(jump, "to", "left").select("root", F.coalesce("to2", "to").alias("to"))
        new = stored(
            labels.join(step, "root", "left")
            .select("node", F.coalesce("to", "root").alias("root"), (F.coalesce("to", "root") != F.col("root")).alias("moved")),
            "labels",
        )
        dropped(labels)
        changed = new.where("moved").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            dropped(e, hubs)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
