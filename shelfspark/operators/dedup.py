"""Duplicates among incoming and known books: by identifier and format, by fuzzy title and author."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_author, normalize_title, trigram_similarity, trigrams
from ..sources.titles import title_block, with_norm_title
from ..sources.work import stored
from .library import latest
from .similarity import similar_strings

# Likeness that matches, that links by itself, and that is enough for a title without an author.
TITLE_MATCH, AUTHOR_MATCH, TITLE_LINK, AUTHOR_LINK, TITLE_ONLY = 0.7, 0.6, 0.85, 0.8, 0.9
BLOCK_ROWS = 20
#: Likeness that names are first looked for at, before all at ``AUTHOR_MATCH`` are.
NEAR_NAMES = 0.79


def isbn_decision(incoming: DataFrame, identifiers: DataFrame, files: DataFrame) -> DataFrame:
    """(id, decision, existing_id) of ``incoming(id, identifier_type, value, format)``.

    ``skip``: a book with the identifier has the format already; ``link``: one
    has the identifier in other formats only; ``new``: none has it. The lowest
    id of the better kind is named.
    """
    known = identifiers.select("identifier_type", "value", "book_id").distinct()
    has = files.select("book_id", "format").distinct().withColumn("has", F.lit(True))
    met = incoming.join(known, ["identifier_type", "value"]).join(has, ["book_id", "format"], "left")
    by = met.groupBy("id").agg(F.min(F.when(F.col("has"), F.col("book_id"))).alias("same"), F.min(F.when(F.col("has").isNull(), F.col("book_id"))).alias("other"))
    out = incoming.select("id").distinct().join(by, "id", "left")
    return out.select("id", F.when(F.col("same").isNotNull(), "skip").when(F.col("other").isNotNull(), "link").otherwise("new").alias("decision"), F.coalesce("same", "other").alias("existing_id"))


def _scored(pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``pairs`` with the trigram likeness of columns ``a`` and ``b``, each distinct pair compared once."""
    seen = pairs.select(a, b).distinct().withColumn(out, trigram_similarity(F.col(a), F.col(b)))
    return pairs.join(seen, [a, b])


def _in_blocks(incoming: DataFrame, existing: DataFrame, links: DataFrame, block_rows: int) -> DataFrame:
    """The best duplicate among the ``block_rows`` lowest ids of those whose titles begin alike; tables of ``titles.save_by_block`` meet without a shuffle."""
    blocked = lambda books: books if "block" in books.columns else with_norm_title(books).withColumn("block", title_block(F.col("norm_title")))
    known = blocked(existing).select(F.col("id").alias("existing_id"), F.col("norm_title").alias("t"), "block").where("block is not null")
    known = latest(known, "block", "existing_id", n=block_rows).drop("rn")
    new = blocked(incoming).select("id", F.col("norm_title").alias("x"), F.coalesce(normalize_author(F.col("author")), F.lit("")).alias("p"), "block")
    near = _scored(new.join(known, "block").where(F.col("id") != F.col("existing_id")), "x", "t", "title_similarity").where(F.col("title_similarity") >= TITLE_MATCH)
    names = links.join(known.select(F.col("existing_id").alias("book_id")), "book_id", "left_semi").select(F.col("book_id").alias("existing_id"), normalize_author(F.col("name")).alias("q")).distinct()
    liked = _scored(near.select("id", "p", "existing_id").join(names, "existing_id"), "p", "q", "like").groupBy("id", "existing_id").agg(F.max("like").alias("best"))
    both = near.join(liked, ["id", "existing_id"], "left")
    author = F.when((F.col("p") == "") & F.col("best").isNull(), 1.0).when((F.col("p") == "") | F.col("best").isNull(), 0.0).otherwise(F.col("best"))
    both = both.withColumn("author_similarity", author)
    full = F.col("author_similarity") >= AUTHOR_MATCH
    both = both.where(full | (F.col("title_similarity") >= TITLE_ONLY))
    order = [full.desc(), F.when(full, F.col("title_similarity") + F.col("author_similarity")).otherwise(F.col("title_similarity")).desc(), F.col("existing_id")]
    return latest(both, "id", *order).select("id", "existing_id", "title_similarity", "author_similarity")


def fuzzy_duplicates(incoming: DataFrame, existing: DataFrame, links: DataFrame, block_rows: int | None = None) -> DataFrame:
    """(id, existing_id, title_similarity, author_similarity) of the best duplicate of ``incoming(id, title, author)``.

    ``existing(id, title)`` and its authors ``links(book_id, name)``. Titles of
    less than three bytes, normalised, meet nothing. The best match by title
    and author wins, else the best by title alone; ties go to the lowest id.

    All known books are compared, by joins on distinct titles and names only:
    what grows with the books of one title are their distinct authors, of
    which each keeps its two lowest ids. Names that are alike are only looked
    for where no book of the most alike title has the very name, and those less
    alike than ``NEAR_NAMES`` only where no closer one settles it. With ``block_rows`` only so many of
    the lowest ids are compared whose titles begin with the same three
    characters. Repeated incoming rows of an id are one if equal.
    """
    if block_rows is not None:
        return _in_blocks(incoming, existing, links, block_rows)
    new = incoming.select("id", normalize_title(F.col("title")).alias("x"), F.coalesce(normalize_author(F.col("author")), F.lit("")).alias("p")).where(F.octet_length("x") >= 3).distinct()
    known = existing.select(F.col("id").alias("existing_id"), normalize_title(F.col("title")).alias("t")).where("t is not null and t <> ''")
    names = links.select(F.col("book_id").alias("existing_id"), normalize_author(F.col("name")).alias("q")).where("q is not null").distinct()
    new, written = stored(new, "incoming"), stored(known.join(names, "existing_id", "left"), "known")
    titles = stored(similar_strings(new.select("x"), written.select("t"), TITLE_MATCH).select(F.col("a").alias("x"), F.col("b").alias("t"), F.col("likeness").alias("title_similarity")), "titles")
    settled = stored(_by_equal_names(new, titles, written), "settled")
    left = new.where("p <> ''").join(settled.select("id", "x", "p"), ["id", "x", "p"], "left_anti")
    left = stored(left.join(titles.select("x").distinct(), "x", "left_semi").select(*new.columns), "unsettled")
    sure = settled
    for likeness in (NEAR_NAMES, AUTHOR_MATCH):
        if not left.limit(1).count():
            break
        near = stored(_by_alike_names(left, titles, written, likeness), "near")
        sure = sure.unionByName(near)
        left = stored(left.join(near.select("id", "x", "p"), ["id", "x", "p"], "left_anti"), "unsettled")
    sure = stored(sure, "sure")
    alone = titles.where(F.col("title_similarity") >= TITLE_ONLY).join(_two_lowest(written, "t"), "t")
    rest = _best(new.join(sure.select("id"), "id", "left_anti"), alone.select("x", "existing_id", "title_similarity", F.lit(0.0).alias("author_similarity"), F.col("title_similarity").alias("score")), "x")
    # a name that is alike enough would have been found above, so these likenesses are below AUTHOR_MATCH
    named = rest.select("id", "p", "existing_id", "title_similarity").join(written.select("existing_id", "q"), "existing_id")
    like = F.max(F.when((F.col("p") == "") | F.col("q").isNull(), 0.0).otherwise(trigram_similarity(F.col("p"), F.col("q"))))
    rest = named.groupBy("id", "existing_id", "title_similarity").agg(like.alias("author_similarity"))
    return sure.select(*_FOUND).unionByName(rest.select(*_FOUND))


def _by_alike_names(left: DataFrame, titles: DataFrame, written: DataFrame, likeness: float) -> DataFrame:
    """The best duplicates of those of ``left`` that no name of less likeness can surpass; above ``AUTHOR_MATCH`` the rest is left for a lower one."""
    names = written.where("q is not null")
    authors = stored(similar_strings(left.select("p"), names.select("q"), likeness).select(F.col("a").alias("p"), F.col("b").alias("q"), F.col("likeness").alias("author_similarity")), "authors")
    pairs = left.select("x", "p").distinct().join(titles, "x")
    full = pairs.join(authors, "p").join(_two_lowest(names, "t", "q"), ["t", "q"]).select("x", "p", "existing_id", "title_similarity", "author_similarity")
    best = _best(left, full.withColumn("score", F.col("title_similarity") + F.col("author_similarity")), "x", "p")
    if likeness <= AUTHOR_MATCH:
        return best
    most = titles.groupBy("x").agg(F.max("title_similarity").alias("most"))
    return best.join(most, "x").where(F.col("title_similarity") + F.col("author_similarity") > F.col("most") + likeness).select(*best.columns)


def _by_equal_names(new: DataFrame, titles: DataFrame, written: DataFrame) -> DataFrame:
    """The best duplicates of those of ``new`` that nothing can surpass: the most alike title by an author of the same name; and all of those without an author, whose names are like none."""
    same = lambda name: F.array_sort(trigrams(F.col(name)))  # noqa: E731 - likeness 1: equal sets of trigrams
    named = _two_lowest(written.where("q is not null").withColumn("same", same("q")), "t", "same")
    pairs = new.select("x", "p").distinct().join(titles, "x")
    equal = pairs.where("p <> ''").withColumn("same", same("p")).join(named, ["t", "same"])
    none = pairs.where("p = ''").join(_two_lowest(written.where("q is null"), "t"), "t")
    found = equal.select("x", "p", "existing_id", "title_similarity").unionByName(none.select("x", "p", "existing_id", "title_similarity"))
    best = _best(new, found.withColumn("author_similarity", F.lit(1.0)).withColumn("score", F.col("title_similarity") + F.col("author_similarity")), "x", "p")
    most = titles.groupBy("x").agg(F.max("title_similarity").alias("most"))
    return best.join(most, "x").where((F.col("p") == "") | (F.col("title_similarity") >= F.col("most"))).select(*best.columns)


_FOUND = ("id", "existing_id", "title_similarity", "author_similarity")


def _two_lowest(rows: DataFrame, *key: str) -> DataFrame:
    """(key, existing_id): of each key the two lowest ids, since one may be the incoming book itself. Aggregates only, however many books share a title."""
    first = rows.groupBy(*key).agg(F.min("existing_id").alias("lowest"))
    second = rows.join(first, list(key)).where(F.col("existing_id") > F.col("lowest")).groupBy(*key).agg(F.min("existing_id").alias("existing_id"))
    return first.withColumnRenamed("lowest", "existing_id").unionByName(second)


def _best(new: DataFrame, found: DataFrame, *key: str) -> DataFrame:
    """``new`` with the best other book of its key: the greatest score, then the lowest id."""
    once = found.groupBy(*key, "existing_id").agg(F.max("score").alias("score"), F.max_by(F.struct("title_similarity", "author_similarity"), "score").alias("by"))
    two = latest(once, list(key), F.col("score").desc(), "existing_id", n=2).drop("rn")
    met = new.join(two, list(key)).where(F.col("id") != F.col("existing_id"))
    return met.groupBy(*new.columns).agg(F.min(F.struct((-F.col("score")).alias("score"), "existing_id", "by")).alias("m")).select(*new.columns, "m.existing_id", "m.by.*")


def auto_links(found: DataFrame, formats: DataFrame, files: DataFrame) -> DataFrame:
    """Fuzzy matches alike enough to become one more format of the known book, which lacks the format in ``formats(id, format)``."""
    sure = found.where((F.col("title_similarity") >= TITLE_LINK) & (F.col("author_similarity") >= AUTHOR_LINK)).join(formats, "id")
    return sure.join(files.select(F.col("book_id").alias("existing_id"), "format").distinct(), ["existing_id", "format"], "left_anti").select("id", "existing_id", "format")


def link_rows(found: DataFrame, links: DataFrame) -> DataFrame:
    """New duplicate links (book_id_a, book_id_b, confidence): pairs that exist in neither direction, the mean likeness as confidence."""
    key = lambda a, b: [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]
    new = found.where("id <> existing_id").select("existing_id", "id", ((F.col("title_similarity") + F.col("author_similarity")) / 2).alias("confidence"), *key("id", "existing_id"))
    new = latest(new, ["lo", "hi"], "existing_id")
    return new.join(links.select(*key("book_id_a", "book_id_b")).distinct(), ["lo", "hi"], "left_anti").select(F.col("existing_id").alias("book_id_a"), F.col("id").alias("book_id_b"), "confidence")


def boosted_status(status: Column, score: Column, trusted: Column, floor: float = 0.8) -> tuple[Column, Column]:
    """(status, score) at import: a trusted publisher makes a book identified with ``floor`` at least."""
    on = F.coalesce(trusted, F.lit(False))
    return F.when(on, "identified").otherwise(status), F.when(on, F.greatest(score, F.lit(floor))).otherwise(score)
