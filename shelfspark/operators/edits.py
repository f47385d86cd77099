"""Set edits and merges of catalog rows: unions with a target, renames, replacements and bulk updates, each as a rewritten table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import partitions
from .library import latest

MERGED_FIELDS = ("description", "language", "publisher_id", "publication_year", "page_count", "rating")


def moved_links(links: DataFrame, merges: DataFrame, key: str | tuple[str, ...], owner: str = "book_id") -> DataFrame:
    """Links(owner, key, ...) after ``merges(winner, secondary)``: the secondary's move over, what the primary has already wins, ties go to the first secondary."""
    m = merges.select(F.col("winner").alias("to"), F.col("secondary").alias(owner))
    own = links.join(m, owner, "left").withColumn("moved", F.col("to").isNotNull()).withColumn("from_", F.col(owner))
    own = own.withColumn(owner, F.coalesce("to", owner)).drop("to")
    return latest(own, [owner, *([key] if isinstance(key, str) else key)], "moved", "from_").drop("rn", "moved", "from_")


def merged_identifiers(identifiers: DataFrame, merges: DataFrame) -> DataFrame:
    """Identifiers after ``merges(winner, secondary)``: those whose kind and value the primary lacks move to it with their source and confidence."""
    return moved_links(identifiers, merges, ("identifier_type", "value"))


def merged_files(files: DataFrame, merges: DataFrame) -> DataFrame:
    """Files(id, book_id, hash, added_at, ...) after ``merges(winner, secondary)``.

    All go to the primary; of those that are then equal by hash the one added
    first stays (without a time before all, then the lowest id). Books outside
    the merges keep repeated files; files without a hash equal none.
    """
    to = merges.select(F.col("secondary").alias("book_id"), F.col("winner").alias("to_"))
    moved = files.join(to, "book_id", "left").withColumn("book_id", F.coalesce("to_", "book_id")).select(*files.columns)
    ids = merges.select(F.col("winner").alias("book_id")).distinct()
    touched = moved.join(ids, "book_id", "left_semi")
    once = latest(touched.where("hash is not null"), ["book_id", "hash"], "added_at", "id").select(*files.columns)
    return moved.join(ids, "book_id", "left_anti").unionByName(touched.where("hash is null")).unionByName(once)


def appended_authors(links: DataFrame, merges: DataFrame) -> DataFrame:
    """As ``moved_links`` on authors, with new ones placed after the primary's in their old order."""
    m = merges.select(F.col("winner").alias("to"), F.col("secondary").alias("book_id"))
    mine = links.join(m.select("book_id"), "book_id", "left_anti")
    coming = links.join(m, "book_id").select(F.col("to").alias("book_id"), "author_id", "role", "position").join(mine.select("book_id", "author_id", "role"), ["book_id", "author_id", "role"], "left_anti")
    coming = latest(coming, ["book_id", "author_id", "role"], "position").drop("rn")
    last = mine.groupBy("book_id").agg(F.max("position").alias("last"))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("position", "author_id"))
    coming = coming.join(last, "book_id", "left").withColumn("position", (F.coalesce("last", F.lit(0)) + place).cast("int")).drop("last")
    return mine.unionByName(coming.select(*mine.columns))


def merged_books(books: DataFrame, merges: DataFrame, prefer: str = "primary") -> DataFrame:
    """Books after ``merges(winner, secondary)``: fields from the preferred side first ("primary", "secondary" or "higher_quality"), the best ingest score, secondaries gone."""
    second = books.select(F.col("id").alias("secondary"), F.col("title").alias("s_title"), F.col("ingest_quality_score").alias("s_score"), *[F.col(f).alias(f"s_{f}") for f in MERGED_FIELDS])
    pair = merges.join(second, "secondary").withColumnRenamed("winner", "id").drop("secondary")
    b = books.join(merges.select(F.col("secondary").alias("id")), "id", "left_anti").join(pair, "id", "left")
    flip = {"primary": F.lit(False), "secondary": F.lit(True), "higher_quality": F.coalesce(F.col("s_score") > F.col("ingest_quality_score"), F.lit(False))}[prefer]
    new = {f: F.when(flip, F.coalesce(f"s_{f}", f)).otherwise(F.coalesce(f, f"s_{f}")) for f in MERGED_FIELDS}
    new["title"] = F.when(flip & (F.coalesce("s_title", F.lit("")) != ""), F.col("s_title")).otherwise(F.col("title"))
    new["ingest_quality_score"] = F.greatest("ingest_quality_score", "s_score")
    return b.withColumns(new).select(*books.columns)


def settled_links(links: DataFrame, merges: DataFrame) -> DataFrame:
    """Duplicate links after merges: the pair's own is merged, other pending ones of the secondary are dismissed."""
    m = merges.select("winner", F.col("secondary").alias("gone"))
    sides = links.select("book_id_a", "book_id_b", F.explode(F.array("book_id_a", "book_id_b")).alias("gone")).join(m, "gone")
    pair = (F.least("book_id_a", "book_id_b") == F.least("winner", "gone")) & (F.greatest("book_id_a", "book_id_b") == F.greatest("winner", "gone"))
    found = sides.groupBy("book_id_a", "book_id_b").agg(F.bool_or(pair).alias("own"))
    status = F.when(F.col("own"), "merged").when(F.col("own").isNotNull() & (F.col("status") == "pending"), "dismissed").otherwise(F.col("status"))
    return links.join(found, ["book_id_a", "book_id_b"], "left").withColumn("status", status).drop("own")


def linked_members(books: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``books(id, key)`` that share the key with another id, without making a pair; a null shares nothing."""
    many = books.groupBy(*key).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").drop("lo", "hi")
    return books.join(many, key)


def settled_classes(books: DataFrame, key: list[str], wins: Column, status: Column) -> DataFrame:
    """``settled_links`` of all pairs of ``books(id, key)`` that share the key, after every book became part of its class's least one before it that ``wins``.

    ``status`` (of ``book_id_a``, ``book_id_b``) is that of a pair before. What
    a merge says of a pair stands at its two books, so books are joined and
    made pairs last: no pair is sent or sorted, though their number is the
    square of a class.
    """
    first = books.groupBy(*key).agg(F.min(F.when(wins, F.col("id"))).alias("first"))
    known = books.join(first, key).select("id", *key, F.when(F.col("first") < F.col("id"), F.col("first")).alias("into"))
    known = known.repartition(partitions(books.sparkSession), *key)  # few bytes make many pairs
    side = lambda s: known.select(*key, F.col("id").alias(f"book_id_{s}"), F.col("into").alias(f"into_{s}"))
    pairs = side("a").join(side("b"), key).where("book_id_a < book_id_b")
    gone = F.col("into_a").isNotNull() | F.col("into_b").isNotNull()
    now = F.when(F.col("into_b") == F.col("book_id_a"), "merged").when(gone & (F.col("status") == "pending"), "dismissed").otherwise(F.col("status"))
    return pairs.withColumn("status", status).select("book_id_a", "book_id_b", now.alias("status"))


def merged_series(series: DataFrame, links: DataFrame, source, target, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Series and links after ``source`` became part of ``target``, which may get a new name."""
    rows = series.where(F.col("id") != F.lit(source))
    if name is not None:
        rows = rows.withColumn("name", F.when(F.col("id") == F.lit(target), F.lit(name)).otherwise(F.col("name")))
    moved = links.withColumn("moved", F.col("series_id") == F.lit(source)).withColumn("series_id", F.when(F.col("series_id") == F.lit(source), F.lit(target)).otherwise(F.col("series_id")))
    return rows, latest(moved, ["book_id", "series_id"], "moved").drop("rn", "moved")


def edited_tags(links: DataFrame, books: DataFrame, tags: list, replace: bool) -> DataFrame:
    """Tag links with ``tags`` set on ``books(id)``, in place of theirs or beside them."""
    ids = books.select(F.col("id").alias("book_id")).distinct()
    new = ids.select("book_id", F.explode(F.array(*map(F.lit, dict.fromkeys(tags)))).alias("tag_id")) if tags else ids.select("book_id", F.lit(None).cast(dict(links.dtypes)["tag_id"]).alias("tag_id")).where(F.lit(False))
    base = links.join(ids, "book_id", "left_anti") if replace else links
    return base.unionByName(new).distinct()


def first_identifiers(found: DataFrame, cap: int = 5) -> DataFrame:
    """Scanned identifiers(book_id, ordinal, identifier_type, value): each once where first seen, the first ``cap`` of a book."""
    once = latest(found, ["book_id", "identifier_type", "value"], "ordinal").drop("rn")
    return latest(once, "book_id", "ordinal", n=cap).drop("rn")


def bulk_updated(books: DataFrame, ids: DataFrame, **values: Column) -> DataFrame:
    """Books of ``ids`` with new values, trusted by the user in these fields (``user_fields``)."""
    hit = ids.select("id").distinct().withColumn("hit", F.lit(True))
    out = books.join(hit, "id", "left")
    new = {c: F.when(F.col("hit"), v).otherwise(F.col(c)) for c, v in values.items()}
    return out.withColumns({**new, "user_fields": F.when(F.col("hit"), F.lit(",".join(sorted(values))))}).drop("hit")


def flattened_tasks(tasks: DataFrame, middle: str = "scan_isbn") -> DataFrame:
    """Tasks whose parent is of the type ``middle`` and has a parent hang from that one; one level is lifted."""
    up = tasks.where(F.col("task_type") == middle).select(F.col("id").alias("parent_task_id"), F.col("parent_task_id").alias("grand"))
    return tasks.join(up, "parent_task_id", "left").withColumn("parent_task_id", F.coalesce("grand", "parent_task_id")).drop("grand").select(*tasks.columns)


def updated_tasks(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """Tasks with ``changes(id, status, progress, moment)``: a first start and a first end are kept."""
    new = changes.select("id", F.col("status").alias("n_status"), F.col("progress").alias("n_progress"), "moment")
    ends = F.col("n_status").isin("completed", "failed", "cancelled")
    return tasks.join(new, "id", "left").withColumns({
        "started_at": F.coalesce("started_at", F.when(F.col("n_status") == "running", F.col("moment"))), "completed_at": F.coalesce("completed_at", F.when(ends, F.col("moment"))),
        "status": F.coalesce("n_status", "status"), "progress": F.coalesce("n_progress", "progress"),
    }).drop("n_status", "n_progress", "moment")


def trust(books: DataFrame, ids: DataFrame, on: bool) -> DataFrame:
    """User trust switched for ``ids``, but for books being resolved: trust confirms and ends the matter, distrust forgets its outcome and what was pending is done."""
    hit = ids.select("id").distinct().withColumn("hit", F.lit(True))
    b = books.join(hit, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)) & ~F.col("resolution_state").eqNullSafe("running"))
    state = F.lit("done") if on else F.when(F.col("resolution_state") == "pending", "done").otherwise(F.col("resolution_state"))
    new = {"metadata_user_trusted": F.lit(on), "resolution_outcome": F.lit("confirmed" if on else None).cast("string"), "resolution_state": state}
    if on:
        new["metadata_status"] = F.lit("identified")
    return b.withColumns({c: F.when(F.col("hit"), v).otherwise(F.col(c)) for c, v in new.items()}).drop("hit")


def expired_sessions_gone(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") >= now)
