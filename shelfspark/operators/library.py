"""Library queries: a ``BookFilter`` as one plan, sort orders, pages and relation bundles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_title
from ..plans import fulltext
from ..plans.search import BookFilter, identifier_types


def filtered(cat, f: BookFilter) -> DataFrame:
    """Books that meet every condition; memberships are semi or anti joins, so no row multiplies."""
    b = cat.books
    if f.matches_nothing:
        return b.where(F.lit(False))
    for column, value in (("metadata_status", f.status), ("publisher_id", f.publisher), ("metadata_user_trusted", f.trusted), ("metadata_locked", f.locked), ("resolution_state", f.state), ("resolution_outcome", f.outcome), ("language", f.language)):
        if value is not None:
            b = b.where(F.col(column) == F.lit(value))
    if f.year_min is not None:
        b = b.where(F.col("publication_year") >= f.year_min)
    if f.year_max is not None:
        b = b.where(F.col("publication_year") <= f.year_max)
    for column, want in (("cover_path", f.has_cover), ("description", f.has_description)):
        if want is not None:
            there = F.col(column).isNotNull() & (F.col(column) != "")
            b = b.where(there if want else ~there)
    for p in f.not_publisher:
        b = b.where(F.col("publisher_id").isNull() | (F.col("publisher_id") != p))

    def member(rows: DataFrame, how: str = "left_semi") -> DataFrame:
        return b.join(rows.select(F.col("book_id").alias("id")), "id", how)

    if f.format is not None:
        b = member(cat.book_files.where(F.col("format") == f.format))
    if f.author is not None:
        b = member(cat.book_authors.where(F.col("author_id") == f.author))
    if f.series is not None:
        b = member(cat.book_series.where(F.col("series_id") == f.series))
    if f.tags:
        links = cat.book_tags.where(F.col("tag_id").isin(*f.tags))
        b = member(links.groupBy("book_id").agg(F.countDistinct("tag_id").alias("n")).where(F.col("n") == len(set(f.tags))) if f.tags_all else links)
    for table, key, ids in (("book_tags", "tag_id", f.not_tags), ("book_authors", "author_id", f.not_author), ("book_series", "series_id", f.not_series)):
        if ids:
            b = member(getattr(cat, table).where(F.col(key).isin(*ids)), "left_anti")
    if f.has_identifiers is not None:
        b = member(cat.identifiers, "left_semi" if f.has_identifiers else "left_anti")
    if f.identifier is not None:
        kind, value = f.identifier
        b = member(cat.identifiers.where(F.col("identifier_type").isin(*identifier_types(kind)) & (F.col("value") == value))) if identifier_types(kind) else b.where(F.lit(False))
    if f.text or f.columns:
        b = b.join(fulltext.search(fulltext.index_of(cat), f.text, f.columns), "id")
    return b


def ordered(cat, b: DataFrame, by: str = "added_at", descending: bool = True, text: str | None = None) -> DataFrame:
    """Rows with their sort key last to first; ``id`` breaks ties."""
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    if by == "relevance" and "rank" in b.columns:
        norm = normalize_title(F.col("title"))
        want = normalize_title(F.lit(text or ""))
        hit = b.join(cat.identifiers.where(F.col("value") == F.lit(re.sub(r"[\s-]", "", text or "").upper())).select(F.col("book_id").alias("id")).distinct().withColumn("has_id", F.lit(1)), "id", "left")
        boost = F.when((want != "") & (norm == want), 20.0).otherwise(0.0) + F.when((want != "") & norm.startswith(want), 5.0).otherwise(0.0) + F.when(F.col("has_id") == 1, 15.0).otherwise(0.0)
        return hit.withColumn("rank", F.col("rank") - boost).drop("has_id").orderBy("rank", "id")
    if by == "relevance":  # without a text: by title, whatever the direction
        return b.orderBy("sort_title", "id")
    if by == "author":
        keys = cat.book_authors.join(cat.authors.select(F.col("id").alias("author_id"), "sort_name"), "author_id").groupBy(F.col("book_id").alias("id")).agg(F.min("sort_name").alias("sort_author"))
        return b.join(keys, "id", "left").orderBy(way("sort_author"), "id")
    if by == "series":
        keys = cat.book_series.groupBy(F.col("book_id").alias("id")).agg(F.min("series_id").alias("sort_series"), F.min("position").alias("sort_position"))
        return b.join(keys, "id", "left").orderBy(way("sort_series"), way("sort_position"), "id")
    column = {"title": "sort_title", "sort_title": "sort_title", "updated_at": "updated_at", "rating": "rating", "metadata_status": "metadata_status"}.get(by, "added_at")
    return b.orderBy(way(column), "id")


def default_sort(by: str | None, text: str | None) -> str:
    """The sort of a request that may name none: relevance for a text, else the newest."""
    return by or ("relevance" if text else "added_at")


def searched(cat, text: str, by: str | None = None, descending: bool = True) -> DataFrame:
    """Books of a full-text query in the order asked for, by relevance unless another is."""
    return ordered(cat, filtered(cat, BookFilter(text=text)), default_sort(by, text), descending, text)


def total_pages(total: int, size: int) -> int:
    return -(-total // size) if size else 0


def page(rows: DataFrame, number: int = 1, size: int = 25) -> DataFrame:
    size = min(max(size, 1), 100)
    return rows.offset((max(number, 1) - 1) * size).limit(size)


def relations(cat, b: DataFrame) -> DataFrame:
    """Each book's authors, series, tags and formats as ``|``-joined names ('' if none)."""
    def names(link: DataFrame, dim: DataFrame | None, key: str, order: str, out: str) -> DataFrame:
        j = link.join(dim.select(F.col("id").alias(key), F.col("name").alias("n")), key) if dim is not None else link.withColumn("n", F.col(key))
        j = j.withColumn("o", F.col(order) if order in j.columns else F.lit(0))
        return j.groupBy(F.col("book_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "n"))), lambda x: x["n"]), "|").alias(out))

    out = b.select("id")
    for link, dim, key, order, name in ((cat.book_authors, cat.authors, "author_id", "position", "authors"), (cat.book_series, cat.series, "series_id", "position", "series"), (cat.book_tags, cat.tags, "tag_id", "none", "tags"), (cat.book_files.select("book_id", "format").distinct(), None, "format", "none", "formats")):
        out = out.join(names(link, dim, key, order, name), "id", "left")
    return out.fillna("", ["authors", "series", "tags", "formats"])


def latest(rows: DataFrame, key: str | list[str], *order, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order``."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
