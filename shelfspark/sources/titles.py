"""Books with their normalised title kept, in tables bucketed by its beginning, so that title blocks meet without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_title


def title_block(norm: Column) -> Column:
    """The first three characters of a normalised title of at least three bytes, else null."""
    return F.when(F.octet_length(norm) >= 3, F.substring(norm, 1, 3))


def with_norm_title(books: DataFrame) -> DataFrame:
    """``books`` with ``norm_title``: kept where it is there, made from the title where it is missing or empty; null titles have none."""
    made = normalize_title(F.col("title"))
    if "norm_title" not in books.columns:
        return books.withColumn("norm_title", made)
    return books.withColumn("norm_title", F.when(F.coalesce("norm_title", F.lit("")) == "", made).otherwise(F.col("norm_title")))


def save_by_block(books: DataFrame, name: str, buckets: int, path: str | None = None) -> DataFrame:
    """Save ``books`` with norm_title and block as the table ``name``, bucketed by block; books without a block are kept, in the bucket of null.

    Two tables with the same number of buckets join on ``block``, and rank
    within it, without an exchange. ``buckets`` should make files of some
    hundred MB; a beginning that very many books share makes one of them large.
    Files go to the warehouse, or to ``path``.
    """
    rows = with_norm_title(books).withColumn("block", title_block(F.col("norm_title")))
    # one file a bucket: without this every task writes a file of each bucket
    rows = rows.repartition(buckets, "block")
    writer = rows.write.bucketBy(buckets, "block").sortBy("block").mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return books.sparkSession.table(name)
