"""The folder a cluster shares for steps that are written once and read again."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local master may go without and gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shelfspark-"))
    return str(context.getCheckpointDir().get())


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path for ``name`` below the application's folder."""
    return f"{shared_dir(spark)}/shelfspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    """Tasks to deal small tables to whose rows cost much each."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the application's folder and read back."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of input files for each partition of a shuffle of large tables.
PART_BYTES = 16 << 20


def dealt(tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Tables dealt by their key to a partition for each ``PART_BYTES`` of their files, as they are if the session deals to as many."""
    parts = -(-sum(input_bytes(df) for df, _ in tables.values()) // PART_BYTES) if tables else 0
    few = any(parts <= partitions(df.sparkSession) for df, _ in tables.values())
    return {name: df if few else df.repartition(parts, key) for name, (df, key) in tables.items()}


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, listed without reading any."""
    spark, total = df.sparkSession, 0
    for file in set(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
        total += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


@contextmanager
def spread(df: DataFrame):
    """Steps written within are shuffled to as many partitions as the files that ``df`` reads ask for, never to fewer than the session does, so that tasks stay small however large the tables are."""
    conf, name = df.sparkSession.conf, "spark.sql.shuffle.partitions"
    was = conf.get(name)
    conf.set(name, str(max(int(was), -(-input_bytes(df) // PART_BYTES))))
    try:
        yield
    finally:
        conf.set(name, was)


def files_version(spark: SparkSession, folder: str) -> str:
    """A fingerprint of names, sizes and times of the files in a folder and in its folders, listed without reading any."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    digest, found = hashlib.sha256(), fs.listFiles(top, True)
    rows = []
    while found.hasNext():
        f = found.next()
        rows.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    for row in sorted(rows):
        digest.update(row.encode())
    return digest.hexdigest()
