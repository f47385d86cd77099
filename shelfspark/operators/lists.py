"""Lists of entities as a caller pages through them, and lookups by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .entities import with_counts
from .library import page, relations

#: For each list, the keys it may be sorted by with their ties; the first is the default.
SORTS = {
    "authors": {"sort_name": (), "name": (), "book_count": ("sort_name",)}, "series": {"name": (), "book_count": ("name",)},
    "tags": {"name": (), "category": ("name",), "book_count": ("name",)}, "publishers": {"name": ()},
}
_LINKS = {"authors": ("book_authors", "author_id"), "series": ("book_series", "series_id"), "tags": ("book_tags", "tag_id")}


def by_key(rows: DataFrame, **keys) -> DataFrame:
    """Rows whose columns equal the given values: point lookups by id, hash, path or (type, value)."""
    for column, value in keys.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows


def _holds(c: str, part: str) -> Column:
    """``LIKE`` with A-Z folded; the text's own wildcards are live."""
    fold = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return fold(F.col(c)).like("%" + part.translate({k: k + 32 for k in range(65, 91)}).replace("\\", "\\\\") + "%")


def listed(cat, kind: str, by: str | None = None, descending: bool = False, search: str | None = None, category: str | None = None, number: int = 1, size: int = 25) -> DataFrame:
    """A page of authors, series, tags (perhaps of a category) or publishers, with book counts where the list has them."""
    rows = getattr(cat, kind)
    if search:
        rows = rows.where(_holds("name", search) | _holds("sort_name", search) if "sort_name" in rows.columns else _holds("name", search))
    if category is not None:
        rows = rows.where(F.lower("category") == category.lower())
    if kind in _LINKS:
        table, key = _LINKS[kind]
        rows = with_counts(rows, getattr(cat, table), key)
    sorts = SORTS[kind]
    by = by if by in sorts else next(iter(sorts))
    first = F.col(by).desc() if descending else F.col(by).asc()
    return page(rows.orderBy(first, *sorts[by], "id"), number, size)


def book(cat, book_id) -> DataFrame:
    """One book with its relations."""
    return by_key(cat.books, id=book_id).join(relations(cat, by_key(cat.books, id=book_id)), "id")


def pending_links(links: DataFrame, number: int = 1, size: int = 25) -> DataFrame:
    """Pending duplicate links, the newest first."""
    return page(links.where("status = 'pending'").orderBy(F.col("created_at").desc(), "book_id_a", "book_id_b"), number, size)


def table_sizes(cat, names: tuple[str, ...]) -> DataFrame:
    """(name, rows) of catalog tables, in one union."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [getattr(cat, n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n in names])


def stored_sizes(spark, paths: dict[str, str]) -> DataFrame:
    """(name, rows, bytes) of Parquet tables by their folders, the largest first; a folder that is not there has neither and comes last.

    Bytes are those of the listing, rows are counted from the files' footers.
    """
    from functools import reduce

    def one(name: str, path: str) -> DataFrame:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        there = fs.exists(at)
        n = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")) if there else spark.range(1).select(F.lit(None).cast("long").alias("rows"))
        return n.select(F.lit(name).alias("name"), "rows", F.lit(fs.getContentSummary(at).getLength() if there else None).cast("long").alias("bytes"))

    return reduce(DataFrame.unionByName, [one(n, p) for n, p in paths.items()]).orderBy(F.col("bytes").desc_nulls_last(), "name")
