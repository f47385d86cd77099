"""Entity lists, statistics, duplicates, retention and device sync as set-based transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from .library import latest


def with_counts(entities: DataFrame, links: DataFrame, key: str) -> DataFrame:
    n = links.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("book_count"))
    return entities.join(n, "id", "left").withColumn("book_count", F.coalesce("book_count", F.lit(0).cast("long")))


def overview(cat) -> DataFrame:
    b = cat.books.agg(F.count(F.lit(1)).alias("books"))
    f = cat.book_files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))
    return b.crossJoin(f).withColumn("files_per_book", F.when(F.col("books") > 0, F.col("files") / F.col("books")).otherwise(0.0))


def by_format(cat) -> DataFrame:
    return cat.book_files.groupBy(F.lower("format").alias("format")).agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"))


def counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def child_summary(tasks: DataFrame) -> DataFrame:
    states = ("pending", "running", "completed", "failed", "cancelled")
    return tasks.where("parent_task_id is not null").groupBy("parent_task_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in states])


def find_or_create(existing: DataFrame, names: DataFrame) -> DataFrame:
    """Names (A-Z folded) that ``existing(name)`` lacks, each once."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    new = names.select("name", fold(F.col("name")).alias("k")).groupBy("k").agg(F.min("name").alias("name"))
    return new.join(existing.select(fold(F.col("name")).alias("k")), "k", "left_anti").select("name")


def hash_duplicates(files: DataFrame) -> DataFrame:
    """Files whose content is already held by an earlier file (lowest id stays)."""
    first = files.groupBy("hash").agg(F.min("id").alias("first_id"))
    return files.join(first, "hash").where("id <> first_id").select("id", "hash", "first_id")


def top_candidates(candidates: DataFrame, n: int = 5) -> DataFrame:
    return latest(candidates, "run_id", F.col("score").desc(), F.col("created_at"), F.col("id"), n=n)


SOURCE_TRUST = ("user", "embedded", "content_scan", "provider")


def best_isbn(identifiers: DataFrame) -> DataFrame:
    trust = F.coalesce(F.array_position(F.array(*map(F.lit, SOURCE_TRUST)), F.col("source_type")), F.lit(99))
    order = [trust, F.when(F.col("identifier_type") == "isbn13", 0).otherwise(1), F.col("confidence").desc(), F.col("value")]
    return latest(identifiers.where(F.col("identifier_type").isin("isbn13", "isbn10")), "book_id", *order).drop("rn")


def live_quality(books: DataFrame, identifiers: DataFrame, authors: DataFrame, series: DataFrame) -> DataFrame:
    """``books`` with ``score`` and ``status`` of what they now hold.

    A strong identifier is an ISBN with its checksum, no placeholder, or any
    other kind; titles and author names that stand for nothing do not count.
    Richness has seven parts: description (not empty), language, publisher,
    year, pages, a series, a cover. ``authors`` has book_id and name.
    """
    held = lambda rows, flag: rows.select(F.col("book_id").alias("id")).distinct().withColumn(flag, F.lit(True))
    flags = {
        "strong_": identifiers.where(W.is_valid_identifier(F.col("identifier_type"), F.col("value"))),
        "author_": authors.where(F.col("name").isNotNull() & ~W.is_garbage_author(F.col("name"))), "series_": series,
    }
    rows = books
    for flag, links in flags.items():
        rows = rows.join(held(links, flag), "id", "left")
    there = [F.length("description") > 0, *[F.col(f).isNotNull() for f in ("language", "publisher_id", "publication_year", "page_count", "cover_path", "series_")]]
    filled = sum((F.coalesce(t, F.lit(False)).cast("int") for t in there), F.lit(0))
    title = F.col("title").isNotNull() & ~F.coalesce(W.is_garbage_title(F.col("title")), F.lit(True))
    score = T.quality_score(F.col("strong_").isNotNull(), title, F.col("author_").isNotNull(), F.lit(0.0), filled, 7, 0.3)
    return rows.withColumn("score", score).withColumn("status", T.status_of(F.col("score"))).drop(*flags)


def expired_tasks(tasks: DataFrame, now: Column, days: int = 30) -> DataFrame:
    done = F.col("status").isin("completed", "failed", "cancelled")
    return tasks.where(done & (F.col("created_at") < now - F.expr(f"interval {days} days")))


def sync_diff(selections: DataFrame, ledger: DataFrame) -> DataFrame:
    """new, changed, skip or removed for each (device, book)."""
    s = selections.select(F.col("user_id").alias("device_id"), "book_id", F.col("file_id").alias("want"))
    have = ledger.select("device_id", "book_id", F.col("file_id").alias("have"), "removed_synced_at")
    j = s.join(have, ["device_id", "book_id"], "full")
    kind = (
        F.when(F.col("want").isNull(), F.when(F.col("removed_synced_at").isNull(), "removed").otherwise("gone"))
        .when(F.col("have").isNull() | F.col("removed_synced_at").isNotNull(), "new").when(F.col("want") != F.col("have"), "changed").otherwise("skip")
    )
    return j.select("device_id", "book_id", kind.alias("change")).where("change <> 'gone'")
