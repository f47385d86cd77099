"""Device sync: what a device should have against its ledger, revision hashes, pages, and the ledger after delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _valid(selections: DataFrame, files: DataFrame) -> DataFrame:
    """Selections whose file is an EPUB of the selected book, with its hash."""
    epub = files.where(F.lower("format") == "epub").select(F.col("id").alias("file_id"), F.col("book_id").alias("file_book"), F.col("hash").alias("file_hash"))
    return selections.join(epub, "file_id").where("file_book = book_id").drop("file_book")


def candidates(selections: DataFrame, files: DataFrame, books: DataFrame, ledger: DataFrame) -> DataFrame:
    """(device_id, book_id) that may need delivery: no ledger row, a removed one, or one that differs in file, hash, selection time or age.

    ``selections(device_id, book_id, file_id, updated_at)``,
    ``ledger(device_id, book_id, l_file_id, l_hash, l_selected, delivered_at, removed_synced_at)``.
    """
    want = _valid(selections, files).join(books.select(F.col("id").alias("book_id"), F.col("updated_at").alias("changed")), "book_id")
    j = want.join(ledger.withColumn("there", F.lit(True)), ["device_id", "book_id"], "left")
    other = lambda a, b: F.col(a).isNull() | (F.col(a) != F.col(b))
    late = F.date_trunc("second", F.col("changed")) > F.date_trunc("second", F.col("delivered_at"))
    need = F.col("there").isNull() | F.col("removed_synced_at").isNotNull() | other("l_file_id", "file_id") | other("l_hash", "file_hash") | other("l_selected", "updated_at") | F.col("delivered_at").isNull() | F.coalesce(late, F.lit(False))
    return j.where(need).select("device_id", "book_id")


def removals(selections: DataFrame, files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows without an acknowledged removal whose book has no valid selection any more."""
    gone = ledger.where("removed_synced_at is null").join(_valid(selections, files).select("device_id", "book_id"), ["device_id", "book_id"], "left_anti")
    return gone.select("device_id", "book_id")


def revision(*parts: Column) -> Column:
    """SHA-256 of the rendered fields, each as its length and text, so that no two lists of fields read alike."""
    text = [F.when(p.isNull(), F.lit("-")).otherwise(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"))) for p in parts]
    return F.sha2(F.concat_ws("|", *text), 256)


def classified(desired: DataFrame, ledger: DataFrame) -> DataFrame:
    """(device_id, book_id, change) of ``desired(device_id, book_id, revision)``: ``new`` unless delivered and not removed before, ``changed`` if the revision differs, else ``skip``."""
    j = desired.join(ledger.select("device_id", "book_id", F.col("revision").alias("had"), "delivered_at", "removed_synced_at", F.lit(True).alias("there")), ["device_id", "book_id"], "left")
    same = F.col("there") & F.col("removed_synced_at").isNull() & F.col("had").eqNullSafe(F.col("revision"))
    return j.select("device_id", "book_id", F.when(F.coalesce(same, F.lit(False)), "skip").when(F.col("delivered_at").isNotNull() & F.col("removed_synced_at").isNull(), "changed").otherwise("new").alias("change"))


def sync_page(changes: DataFrame, gone: DataFrame, size: int) -> DataFrame:
    """(device_id, book_id, change, has_more): the first ``size`` changes of each device by book, removals in what room is left."""
    rows = changes.where("change <> 'skip'").withColumn("turn", F.lit(0)).unionByName(gone.select("device_id", "book_id", F.lit("removed").alias("change"), F.lit(1).alias("turn")))
    w = Window.partitionBy("device_id")
    placed = rows.withColumns({"place": F.row_number().over(w.orderBy("turn", "book_id")), "n": F.count(F.lit(1)).over(w)})
    return placed.where(F.col("place") <= size).select("device_id", "book_id", "change", (F.col("n") > size).alias("has_more"))


def delivered(ledger: DataFrame, page: DataFrame, now: Column) -> DataFrame:
    """The ledger after a page went out: delivered rows lose their tombstone, removed ones keep their first removal time."""
    p = page.select("device_id", "book_id", "change")
    j = ledger.join(p, ["device_id", "book_id"], "full")
    sent, gone = F.col("change").isin("new", "changed"), F.col("change") == "removed"
    return j.withColumns({
        "delivered_at": F.when(sent, now).otherwise(F.col("delivered_at")), "removed_at": F.when(sent, None).when(gone, F.coalesce("removed_at", now)).otherwise(F.col("removed_at")),
        "removed_synced_at": F.when(sent, None).when(gone, now).otherwise(F.col("removed_synced_at")),
    }).drop("change")
