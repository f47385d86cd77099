"""Kept titles in buckets, merges of identifiers and files, live quality, table sizes, indexed subtitles."""

import datetime as dt
from types import SimpleNamespace

import pytest

from shelfspark.operators import edits, lists
from shelfspark.operators.dedup import fuzzy_duplicates
from shelfspark.operators.entities import live_quality
from shelfspark.plans import fulltext
from shelfspark.sources.titles import save_by_block, with_norm_title

BOOKS = "id long, title string, author string"


@pytest.fixture
def no_broadcast(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_bucketed_tables_meet_without_an_exchange(spark, no_broadcast, tmp_path):
    words = ["The Sea", "Sea of Stars", "sea, of stars!", "The Wood", "Woods", "ab", "", None, "Seaside"]
    rows = [(i, words[i % len(words)], "Ann" if i % 2 else None) for i in range(60)]
    new, old = spark.createDataFrame(rows[:30], BOOKS), spark.createDataFrame(rows[30:], BOOKS)
    links = spark.createDataFrame([(i, "Ann") for i in range(30, 60, 3)], "book_id long, name string")
    a, b = save_by_block(new, "t_new", 4, f"{tmp_path}/new"), save_by_block(old, "t_old", 4, f"{tmp_path}/old")
    try:
        assert a.count() == 30 and b.count() == 30
        plain, kept = fuzzy_duplicates(new, old, links, 20), fuzzy_duplicates(a, b, links, 20)
        assert "hashpartitioning(block" in planned(plain) and "hashpartitioning(block" not in planned(kept)
        assert sorted(kept.collect()) == sorted(plain.collect()) and plain.count() > 5
    finally:
        spark.sql("DROP TABLE t_new")
        spark.sql("DROP TABLE t_old")


def test_titles_are_filled_in_where_they_lack(spark):
    rows = [(1, "The Sea!", None), (2, "The Sea!", ""), (3, "The Sea!", "kept"), (4, None, None), (5, "", None)]
    got = {r.id: r.norm_title for r in with_norm_title(spark.createDataFrame(rows, "id long, title string, norm_title string")).collect()}
    assert got == {1: "sea", 2: "sea", 3: "kept", 4: None, 5: ""}
    assert with_norm_title(spark.createDataFrame([(1, "A Wood")], "id long, title string")).first().norm_title == "wood"
    assert with_norm_title(spark.createDataFrame([], "id long, title string")).count() == 0


MERGES = [(1, 2), (1, 3), (9, 8)]


def test_merged_identifiers(spark):
    merges = spark.createDataFrame(MERGES, "winner long, secondary long")
    rows = [(1, "asin", "A", "user"), (2, "asin", "A", "embedded"), (2, "isbn13", "X", "embedded"), (3, "isbn13", "X", "provider"), (3, "asin", "X", "provider"), (7, "asin", "A", "user"), (8, "asin", None, "user")]
    got = edits.merged_identifiers(spark.createDataFrame(rows, "book_id long, identifier_type string, value string, source_type string"), merges)
    assert {tuple(r) for r in got.select("book_id", "identifier_type", "value", "source_type").collect()} == {(1, "asin", "A", "user"), (1, "isbn13", "X", "embedded"), (1, "asin", "X", "provider"), (7, "asin", "A", "user"), (9, "asin", None, "user")}


def test_merged_files(spark):
    day = lambda n: dt.date(2024, 1, n)
    merges = spark.createDataFrame(MERGES, "winner long, secondary long")
    rows = [(10, 1, "h", day(5)), (11, 2, "h", day(2)), (12, 3, "h", day(2)), (13, 2, "g", None), (14, 1, "g", day(1)), (15, 7, "h", day(1)), (16, 7, "h", day(1)), (17, 3, None, day(1)), (18, 1, None, day(1))]
    got = edits.merged_files(spark.createDataFrame(rows, "id long, book_id long, hash string, added_at date"), merges)
    assert {(r.id, r.book_id) for r in got.collect()} == {(11, 1), (13, 1), (15, 7), (16, 7), (17, 1), (18, 1)}
    assert edits.merged_files(got.limit(0), merges).count() == 0


def test_live_quality(spark):
    books = [(1, "Sea", "d", "en", "p", 2000, 10, ""), (2, " UNTITLED ", "", None, None, None, None, None), (3, None, None, None, None, None, None, None), (4, "Sea", None, None, None, None, None, None)]
    b = spark.createDataFrame(books, "id long, title string, description string, language string, publisher_id string, publication_year int, page_count int, cover_path string")
    ids = spark.createDataFrame([(1, "isbn10", "080442957X"), (2, "isbn13", "9780000000000"), (3, "asin", "x"), (4, "isbn13", "9783161484101"), (4, "isbn10", "12345")], "book_id long, identifier_type string, value string")
    who = spark.createDataFrame([(1, "Ann"), (1, "Unknown"), (2, "Bo"), (4, " various "), (4, None)], "book_id long, name string")
    shelf = spark.createDataFrame([(1, 1), (1, 2)], "book_id long, series_id long")
    got = {r.id: (round(r.score, 6), r.status) for r in live_quality(b, ids, who, shelf).collect()}
    assert got == {1: (1.0, "identified"), 2: (0.0, "unidentified"), 3: (0.4, "needs_review"), 4: (0.1, "unidentified")}
    assert live_quality(b.limit(0), ids, who, shelf).count() == 0


def test_sizes_of_stored_tables(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/small")
    spark.range(100000).write.parquet(f"{tmp_path}/large")
    rows = lists.stored_sizes(spark, {"none": f"{tmp_path}/none", "small": f"{tmp_path}/small", "large": f"{tmp_path}/large"}).collect()
    assert [(r.name, r.rows) for r in rows] == [("large", 100000), ("small", 10), ("none", None)]
    assert rows[0].bytes > rows[1].bytes > 0 and rows[2].bytes is None


def test_subtitles_belong_to_the_indexed_title(spark):
    none = spark.createDataFrame([], "book_id long, author_id long, series_id long, tag_id long")
    names = spark.createDataFrame([], "id long, name string")
    books = spark.createDataFrame([(1, "Sea", "a story", None, None), (2, "Sea", None, None, None)], "id long, title string, subtitle string, description string, publisher_id string")
    cat = SimpleNamespace(books=books, book_authors=none, book_series=none, book_tags=none, authors=names, series=names, tags=names)
    assert {r.id: r.title for r in fulltext.documents(cat).collect()} == {1: "Sea a story", 2: "Sea"}
