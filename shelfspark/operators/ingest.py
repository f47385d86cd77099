"""Import of a file's metadata: scores, provenance, the query sent to providers, and what differs from a proposal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from .entities import SOURCE_TRUST, best_isbn
from .library import latest

# What richness may add by profile, and what a title that agrees with the file name adds.
PROFILES = {"strict": 0.0, "balanced": 0.3, "permissive": 0.5}
AGREEMENT = 0.2


def ingest_score(profile: str) -> Column:
    """Score of rows (title, author, valid_id, file_title, description, language, publisher, has_subjects, publication_year)."""
    title = F.coalesce(~W.is_garbage_title(F.col("title")), F.lit(False))
    author = F.coalesce(~W.is_garbage_author(F.col("author")), F.lit(False))
    agrees = title & F.coalesce(W.ingest_titles_match(F.col("title"), F.col("file_title")), F.lit(False))
    some = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("description", "language", "publisher")] + [F.coalesce("has_subjects", F.lit(False)), F.col("publication_year").isNotNull()]
    return T.quality_score(F.coalesce("valid_id", F.lit(False)), title, author, F.when(agrees, AGREEMENT).otherwise(0.0), sum((c.cast("int") for c in some), F.lit(0)), len(some), PROFILES[profile])


def backfilled(rows: DataFrame, live: DataFrame) -> DataFrame:
    """``rows(id, score)`` with null scores from ``live(id, live)``."""
    return rows.join(live, "id", "left").withColumn("score", F.coalesce("score", "live")).drop("live")


def best_of_type(identifiers: DataFrame, kind: str) -> DataFrame:
    """Each book's most trusted identifier of a type: source, confidence, value."""
    trust = F.coalesce(F.array_position(F.array(*map(F.lit, SOURCE_TRUST)), F.col("source_type")), F.lit(99))
    return latest(identifiers.where(F.col("identifier_type") == kind), "book_id", trust, F.col("confidence").desc(), "value").drop("rn")


def metadata_queries(books: DataFrame, identifiers: DataFrame, authors: DataFrame) -> DataFrame:
    """(id, title, author, isbn, asin): what providers are asked about each book; the author is the first by name of ``authors(book_id, name)``."""
    named = lambda d, v, out: d.select(F.col("book_id").alias("id"), F.col(v).alias(out))
    first = authors.groupBy("book_id").agg(F.min("name").alias("name"))
    out = books.join(named(first, "name", "author"), "id", "left").join(named(best_isbn(identifiers), "value", "isbn"), "id", "left")
    return out.join(named(best_of_type(identifiers, "asin"), "value", "asin"), "id", "left").select("id", "title", "author", "isbn", "asin")


def names_differ(mine: Column, theirs: Column) -> Column:
    """Whether two lists of authors (or series) are not the same set after normalising."""
    norm = lambda a: F.array_distinct(F.transform(a, T.normalize_author))
    a, b = norm(mine), norm(theirs)
    return (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)


def provenance(fields: dict[str, Column], origin: str, protected: bool = False) -> Column:
    """A struct that says where each field that has a value came from."""
    entry = F.struct(F.lit(origin).alias("origin"), F.lit(protected).alias("protected"))
    return F.struct(*[F.when(v.isNotNull(), entry).alias(k) for k, v in fields.items()])
