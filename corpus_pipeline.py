"""The corpus pipeline: quality rules, near copies, repeated passages, benchmark passages, mixing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all rows its
predecessor kept; ``run`` writes each stage's result as Parquet to the folder
the cluster shares and reads it again as the next one's input.

Defined results: null and empty texts have no words, so the quality rules drop
them; an empty table stays empty through all stages, an empty benchmark removes
nothing; of near copies the row of the least (doc_id, hash of its text) stays,
with null ids first; columns beyond those of documents are dropped by each
stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import table, work_dir
from shelfspark.llm.decontaminate import remove_contamination
from shelfspark.llm.jaccard_join import near_duplicates
from shelfspark.llm.mixing import mix_sources
from shelfspark.llm.quality_rules import keep_good
from shelfspark.llm.suffix_dedup import PASSAGE_BYTES, PASSAGE_WORDS, dedup_text

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs.select(*COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least id; rows that are equal in id and text become one."""
    rows = near_duplicates(docs)
    row = F.struct("doc_id", "text_hash")
    first = rows.where("class_key is not null").groupBy("class_key").agg(F.min(row).alias("row")).select("row.*")
    first = first.unionByName(rows.where("class_key is null").select("doc_id", "text_hash"))
    first = first.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    same = lambda text_hash: F.col("doc_id").eqNullSafe(F.col("kept_id")) & (text_hash == F.col("kept_hash"))
    again = rows.join(first, same(F.col("text_hash")), "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    kept = docs.select(*COLUMNS).join(first, same(F.xxhash64(F.coalesce("text", F.lit("")))), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]) if again else kept


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages (200 bytes and 50 words or more) that occur again."""
    return _counted(dedup_text(docs.select(*COLUMNS), PASSAGE_BYTES, PASSAGE_WORDS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark."""
    return _counted(remove_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document in the mix: doc_id, source, size, source_size, target, copies, taken."""
    return mix_sources(docs)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_copies),
    ("suffix_dedup", passages),
    ("decontaminate", benchmark),
    ("mix_sources", mixing),
]

#: Connected components and pivotal rounding have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = table(spark, sf_dir, "documents"), work_dir(spark, "pipeline")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{name}")
    return docs
