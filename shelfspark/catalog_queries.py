"""Registered queries over the catalog's domain views, and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import entities as E
from .operators import library as L
from .operators import resolution as R
from .operators import transitions as X
from .plans import fulltext, segments
from .functions import words as W
from .plans.search import BookFilter, lookup_many, resolve
from .registry import ORACLES, QUERIES  # noqa: F401
from .registry import add as _add
from .registry import rounded as _r
from .registry import shared_sql
from .scalar_queries import isbns_sql
from .sources.views import Catalog, oracle
from .sources.work import work_dir
from .streaming import events as S



# --- library filters: ids of the books that meet a filter -------------------------------------------------
_FILTERS: dict[str, tuple[BookFilter, str]] = {
    "lib_status": (BookFilter(status="identified"), "metadata_status = 'identified'"),
    "lib_author": (BookFilter(author=7), "id IN (SELECT book_id FROM book_authors WHERE author_id = 7)"),
    "lib_series": (BookFilter(series="ECONOMY"), "id IN (SELECT book_id FROM book_series WHERE series_id = 'ECONOMY')"),
    "lib_tags_any": (BookFilter(tags=("1-URGENT", "2-HIGH")), "id IN (SELECT book_id FROM book_tags WHERE tag_id IN ('1-URGENT', '2-HIGH'))"),
    "lib_tags_all": (BookFilter(tags=("1-URGENT", "2-HIGH"), tags_all=True), "id IN (SELECT book_id FROM book_tags WHERE tag_id IN ('1-URGENT', '2-HIGH') GROUP BY book_id HAVING count(DISTINCT tag_id) = 2)"),
    "lib_not_tags": (BookFilter(not_tags=("1-URGENT",)), "id NOT IN (SELECT book_id FROM book_tags WHERE tag_id = '1-URGENT')"),
    "lib_not_author": (BookFilter(not_author=(7,)), "id NOT IN (SELECT book_id FROM book_authors WHERE author_id = 7)"),
    "lib_not_series": (BookFilter(not_series=("ECONOMY",)), "id NOT IN (SELECT book_id FROM book_series WHERE series_id = 'ECONOMY')"),
    "lib_not_publisher": (BookFilter(not_publisher=("Brand#1",)), "publisher_id IS NULL OR publisher_id <> 'Brand#1'"),
    "lib_publisher": (BookFilter(publisher="Brand#1"), "publisher_id = 'Brand#1'"),
    "lib_trusted": (BookFilter(trusted=True), "metadata_user_trusted"),
    "lib_locked": (BookFilter(locked=False), "NOT metadata_locked"),
    "lib_state": (BookFilter(state="pending"), "resolution_state = 'pending'"),
    "lib_outcome": (BookFilter(outcome="disputed"), "resolution_outcome = 'disputed'"),
    "lib_language": (BookFilter(language="en"), "language = 'en'"),
    "lib_year": (BookFilter(year_min=1960, year_max=1980), "publication_year BETWEEN 1960 AND 1980"),
    "lib_format": (BookFilter(format="epub"), "id IN (SELECT book_id FROM book_files WHERE format = 'epub')"),
    "lib_has_cover": (BookFilter(has_cover=True), "cover_path IS NOT NULL AND cover_path <> ''"),
    "lib_missing_cover": (BookFilter(has_cover=False), "cover_path IS NULL OR cover_path = ''"),
    "lib_missing_desc": (BookFilter(has_description=False), "description IS NULL OR description = ''"),
    "lib_has_ids": (BookFilter(has_identifiers=True), "id IN (SELECT book_id FROM identifiers)"),
    "lib_missing_ids": (BookFilter(has_identifiers=False), "id NOT IN (SELECT book_id FROM identifiers)"),
    "lib_identifier": (BookFilter(identifier=("isbn", "9780000000019")), "id IN (SELECT book_id FROM identifiers WHERE identifier_type IN ('isbn10', 'isbn13') AND value = '9780000000019')"),
    "lib_combined": (BookFilter(status="needs_review", year_min=1955, has_identifiers=True, not_tags=("5-LOW",)), "metadata_status = 'needs_review' AND publication_year >= 1955 AND id IN (SELECT book_id FROM identifiers) AND id NOT IN (SELECT book_id FROM book_tags WHERE tag_id = '5-LOW')"),
    "lib_nothing": (BookFilter(matches_nothing=True), "1 = 0"),
}
for _name, (_filter, _where) in _FILTERS.items():
    _add(_name, lambda c, f=_filter: L.filtered(c, f).select("id", "title"), f"SELECT id, title FROM books WHERE {_where}")


# --- the search language ------------------------------------------------------------------------------------
def _searched(query: str) -> Callable[[Catalog], DataFrame]:
    return lambda c: L.filtered(c, resolve(query, c)[0]).select("id", "title", "publication_year")


_BOOKS3 = "SELECT id, title, publication_year FROM books WHERE "
_add("library_publisher_year", _searched('publisher:"Brand#1" year:1960..1980'), _BOOKS3 + "publisher_id IS NOT NULL AND publisher_id = 'Brand#1' AND publication_year BETWEEN 1960 AND 1980")
_add("dsl_tags_status", _searched("tag:1-URGENT -tag:2-HIGH status:identified"), _BOOKS3 + "id IN (SELECT book_id FROM book_tags WHERE tag_id = '1-URGENT') AND id NOT IN (SELECT book_id FROM book_tags WHERE tag_id = '2-HIGH') AND metadata_status = 'identified'")
_add("dsl_presence", _searched("-missing:cover has:identifiers year:>1960"), _BOOKS3 + "cover_path IS NOT NULL AND cover_path <> '' AND id IN (SELECT book_id FROM identifiers) AND publication_year >= 1961")
_add("dsl_unknown_is_empty", _searched("author:nobody"), _BOOKS3 + "1 = 0")
_add("dsl_lone_isbn", _searched("978-0000000019"), _BOOKS3 + "id IN (SELECT book_id FROM identifiers WHERE identifier_type IN ('isbn10', 'isbn13') AND value = '9780000000019')")


# --- sorts, pages, scopes, bundles ----------------------------------------------------------------------------
def _top(by: str, descending: bool) -> Callable[[Catalog], DataFrame]:
    return lambda c: L.page(L.ordered(c, c.books, by, descending), 1, 50).select("id", "title")


_AUTHOR = "LEFT JOIN (SELECT ba.book_id, min(a.sort_name) AS k FROM book_authors ba JOIN authors a ON a.id = ba.author_id GROUP BY ba.book_id) s ON s.book_id = b.id"
_SERIES = "LEFT JOIN (SELECT book_id, min(series_id) AS k, min(position) AS p FROM book_series GROUP BY book_id) s ON s.book_id = b.id"
_add("sort_title", _top("title", False), "SELECT id, title FROM books ORDER BY sort_title NULLS FIRST, id LIMIT 50")
_add("sort_rating", _top("rating", True), "SELECT id, title FROM books ORDER BY rating DESC NULLS LAST, id LIMIT 50")
_add("sort_status", _top("metadata_status", False), "SELECT id, title FROM books ORDER BY metadata_status, id LIMIT 50")
_add("sort_added", _top("unknown key", True), "SELECT id, title FROM books ORDER BY added_at DESC NULLS LAST, id LIMIT 50")
_add("sort_updated", _top("updated_at", True), "SELECT id, title FROM books ORDER BY updated_at DESC NULLS LAST, id LIMIT 50")
_add("sort_relevance_no_text", _top("relevance", True), "SELECT id, title FROM books ORDER BY sort_title NULLS FIRST, id LIMIT 50")
_add("sort_author", _top("author", False), f"SELECT b.id, b.title FROM books b {_AUTHOR} ORDER BY k NULLS FIRST, b.id LIMIT 50")
_add("sort_series", _top("series", True), f"SELECT b.id, b.title FROM books b {_SERIES} ORDER BY k DESC NULLS LAST, p DESC NULLS LAST, b.id LIMIT 50")
_add("page_2", lambda c: L.page(L.ordered(c, c.books, "title", False), 2, 25).select("id", "title"), "SELECT id, title FROM books ORDER BY sort_title NULLS FIRST, id LIMIT 25 OFFSET 25")
_add("scope_minus", lambda c: c.books.where("metadata_status = 'identified'").join(c.duplicate_links.select(F.col("book_id_a").alias("id")), "id", "left_anti").select("id"), "SELECT id FROM books WHERE metadata_status = 'identified' AND id NOT IN (SELECT book_id_a FROM duplicate_links)")
_add("count_scope", lambda c: L.filtered(c, BookFilter(language="en", has_cover=True)).agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM books WHERE language = 'en' AND cover_path <> ''")
_add("rel_bundle", lambda c: L.relations(c, c.books), """
    SELECT b.id, coalesce(a.v, '') AS authors, coalesce(s.v, '') AS series, coalesce(t.v, '') AS tags, coalesce(f.v, '') AS formats FROM books b
    LEFT JOIN (SELECT book_id, string_agg(name, '|' ORDER BY position, name) AS v FROM book_authors JOIN authors ON id = author_id GROUP BY book_id) a ON a.book_id = b.id
    LEFT JOIN (SELECT book_id, string_agg(series_id, '|' ORDER BY position, series_id) AS v FROM book_series GROUP BY book_id) s ON s.book_id = b.id
    LEFT JOIN (SELECT book_id, string_agg(tag_id, '|' ORDER BY tag_id) AS v FROM book_tags GROUP BY book_id) t ON t.book_id = b.id
    LEFT JOIN (SELECT book_id, string_agg(format, '|' ORDER BY format) AS v FROM (SELECT DISTINCT book_id, format FROM book_files) x GROUP BY book_id) f ON f.book_id = b.id""")

# --- statistics and entity lists --------------------------------------------------------------------------------
_add("stats_overview", lambda c: E.overview(c).withColumn("files_per_book", _r("files_per_book")), "SELECT books, files, CAST(bytes AS BIGINT) AS bytes, round(CASE WHEN books > 0 THEN files / books ELSE 0.0 END, 6) AS files_per_book FROM (SELECT count(*) AS books FROM books) a, (SELECT count(*) AS files, coalesce(sum(file_size), 0) AS bytes FROM book_files) b")
_add("stats_formats", E.by_format, "SELECT lower(format) AS format, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM book_files GROUP BY lower(format)")
_add("stats_status", lambda c: E.counts(c.books, "metadata_status"), "SELECT metadata_status, count(*) AS n FROM books GROUP BY metadata_status")
_add("stats_task_status", lambda c: E.counts(c.tasks, "status"), "SELECT status, count(*) AS n FROM tasks GROUP BY status")
_add("stats_task_types", lambda c: E.counts(c.tasks, "task_type"), "SELECT task_type, count(*) AS n FROM tasks GROUP BY task_type")
_add("stats_tasks24h", lambda c: c.tasks.crossJoin(c.tasks.agg(F.max("created_at").alias("now"))).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr("created_at >= now - interval 24 hours")).alias("last_24h")), "SELECT count(*) AS total, count(*) FILTER (WHERE created_at >= (SELECT max(created_at) FROM tasks) - INTERVAL 24 HOUR) AS last_24h FROM tasks")
_add("stats_sidebar", lambda c: c.books.agg(*[F.count_if(F.expr(e)).alias(n) for n, e in (("review", "metadata_status = 'needs_review'"), ("unidentified", "metadata_status = 'unidentified'"), ("pending", "resolution_state = 'pending'"), ("locked", "metadata_locked"))]), "SELECT count(*) FILTER (WHERE metadata_status = 'needs_review') AS review, count(*) FILTER (WHERE metadata_status = 'unidentified') AS unidentified, count(*) FILTER (WHERE resolution_state = 'pending') AS pending, count(*) FILTER (WHERE metadata_locked) AS locked FROM books")
_add("stats_pending_duplicates", lambda c: c.duplicate_links.where("status = 'pending'").agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM duplicate_links WHERE status = 'pending'")
_add("child_summary", lambda c: E.child_summary(c.tasks), "SELECT parent_task_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("pending", "running", "completed", "failed", "cancelled")) + " FROM tasks WHERE parent_task_id IS NOT NULL GROUP BY parent_task_id")
for _e, _l, _k in (("authors", "book_authors", "author_id"), ("series", "book_series", "series_id"), ("tags", "book_tags", "tag_id")):
    _add(f"{_e}_counts", lambda c, e=_e, lk=_l, k=_k: E.with_counts(getattr(c, e), getattr(c, lk), k).select("id", "name", "book_count"), f"SELECT e.id, e.name, count(l.book_id) AS book_count FROM {_e} e LEFT JOIN {_l} l ON l.{_k} = e.id GROUP BY e.id, e.name")
_add("publishers_counts", lambda c: E.with_counts(c.publishers, c.books.where("publisher_id is not null"), "publisher_id").select("id", "name", "book_count"), "SELECT e.id, e.name, count(b.id) AS book_count FROM publishers e LEFT JOIN books b ON b.publisher_id = e.id GROUP BY e.id, e.name")
_add("tag_categories", lambda c: c.tags.select("category").distinct(), "SELECT DISTINCT category FROM tags")
_add("find_or_create", lambda c: E.find_or_create(c.publishers, c.publishers.select(F.lower("name").alias("name")).union(c.series.select("name"))), "SELECT DISTINCT name FROM series")
_add("queue_fifo", lambda c: c.books.where("resolution_state = 'pending' and (not metadata_locked or metadata_user_trusted)").orderBy("added_at", "id").limit(100).select("id"), "SELECT id FROM books WHERE resolution_state = 'pending' AND (NOT metadata_locked OR metadata_user_trusted) ORDER BY added_at NULLS FIRST, id LIMIT 100")

# --- scalar functions -------------------------------------------------------------------------------------------
_RAW_TITLE = "CASE id % 3 WHEN 0 THEN concat('The ', title) WHEN 1 THEN concat(title, ', Don''t!') ELSE title END"
_add("norm_title", lambda c: c.books.select("id", T.normalize_title(F.expr(_RAW_TITLE)).alias("v")), f"SELECT id, regexp_replace(trim(regexp_replace(replace(lower({_RAW_TITLE}), '''', ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '^(the|a|an|le|la|les|der|die|das) (.)', '\\2') AS v FROM books")
_add("sort_titles", lambda c: c.books.select("id", T.sort_title(F.col("title")).alias("v")), "SELECT id, regexp_replace(title, '^(the|a|an) ', '', 'i') AS v FROM books")
_add("sort_name", lambda c: c.books.select("id", T.sort_name(F.expr("concat('Ann ', title)")).alias("v")), "SELECT id, regexp_replace(concat('Ann ', title), '^(.*) ([^ ]+)$', '\\2, \\1') AS v FROM books")
_add("norm_author", lambda c: c.authors.select("id", T.normalize_author(F.expr("concat(name, ', Ann')")).alias("v")), "SELECT id, trim(regexp_replace(concat('ann ', lower(name)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS v FROM authors")
_add("split_authors", lambda c: c.authors.select("id", F.array_join(T.split_authors(F.expr("concat(name, '; Ann Lee')")), "|").alias("v")), "SELECT id, concat(name, '|Ann Lee') AS v FROM authors")
_ODD = " + ".join(f"CAST(substring(value, {i}, 1) AS INT) * {1 if i % 2 else 3}" for i in range(1, 14))
_add("isbn_validate", lambda c: c.identifiers.where("identifier_type = 'isbn13'").select("book_id", "value", T.isbn13_ok(F.col("value")).alias("ok")), f"SELECT book_id, value, ({_ODD}) % 10 = 0 AS ok FROM identifiers WHERE identifier_type = 'isbn13'")
_TEN = " + ".join(f"CAST(substring(value, {i + 3}, 1) AS INT) * {11 - i}" for i in range(1, 10))
_add("isbn_convert", lambda c: c.identifiers.where("identifier_type = 'isbn13'").select("book_id", T.isbn13_to_10(F.col("value")).alias("isbn10")), f"SELECT book_id, CASE WHEN ({_ODD}) % 10 = 0 THEN concat(substring(value, 4, 9), CASE (11 - ({_TEN}) % 11) % 11 WHEN 10 THEN 'X' ELSE CAST((11 - ({_TEN}) % 11) % 11 AS VARCHAR) END) END AS isbn10 FROM identifiers WHERE identifier_type = 'isbn13'")
_add("isbn_scan", lambda c: c.documents.join(c.identifiers.where("identifier_type = 'isbn13'").select(F.col("book_id").alias("doc_id"), "value"), "doc_id", "left").select("doc_id", F.array_join(W.scan_isbns(F.concat(F.col("text"), F.coalesce(F.concat(F.lit(" ISBN "), "value", F.lit(".")), F.lit("")))), "|").alias("found")), f"SELECT doc_id, {isbns_sql('t')} AS found FROM (SELECT doc_id, text || coalesce(' ISBN ' || value || '.', '') AS t FROM documents LEFT JOIN (SELECT book_id, value FROM identifiers WHERE identifier_type = 'isbn13') i ON book_id = doc_id) x")
_add("sentences", lambda c: c.documents.select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n")), "SELECT doc_id, CAST(len(list_filter(string_split_regex(regexp_replace(text, '([.?!][\"'')\\]]{0,3})\\s+', '\\1\x01', 'g'), '\x01'), lambda x: x <> '')) AS BIGINT) AS n FROM documents")
_add("year_parse", lambda c: c.books.select("id", T.leading_year(F.expr("concat(cast(publication_year as string), '-05-01')")).alias("year")), "SELECT id, CAST(publication_year AS INT) AS year FROM books")
_add("content_hash", lambda c: c.documents.select("doc_id", F.sha2("text", 256).alias("sha256")), "SELECT doc_id, sha256(text) AS sha256 FROM documents")


# --- full-text search -----------------------------------------------------------------------------------------------
_FTS_DOCS = """docs AS (SELECT b.id, b.title, b.description, b.publisher_id AS publisher, a.v AS authors, s.v AS series, t.v AS tags FROM books b
    LEFT JOIN (SELECT book_id, string_agg(name, ' ' ORDER BY name) AS v FROM (SELECT DISTINCT book_id, name FROM book_authors JOIN authors ON id = author_id) x GROUP BY book_id) a ON a.book_id = b.id
    LEFT JOIN (SELECT book_id, series_id AS v FROM book_series) s ON s.book_id = b.id
    LEFT JOIN (SELECT book_id, string_agg(tag_id, ' ' ORDER BY tag_id) AS v FROM book_tags GROUP BY book_id) t ON t.book_id = b.id)"""
_TOK = "list_filter(string_split_regex(lower(strip_accents(coalesce({0}, ''))), '[^\\p{{L}}\\p{{N}}+#]+'), lambda x: x <> '')"
_COLS = ("title", "description", "authors", "series", "publisher", "tags")
_TOKENS = "tok AS (SELECT id, " + ", ".join(f"{_TOK.format(c)} AS {c}" for c in _COLS) + " FROM docs)"


def _fts(select: str) -> str:
    return oracle(f"SELECT 1 FROM books, book_authors, authors, book_series, book_tags").rsplit(" SELECT 1", 1)[0] + f", {_FTS_DOCS}, {_TOKENS} {select}"


def _any(test: str) -> str:
    return "(" + " OR ".join(f"len(list_filter({c}, lambda x: {test})) > 0" for c in _COLS) + ")"


def _hits(text: str | None, columns: tuple = ()) -> Callable[[Catalog], DataFrame]:
    return lambda c: fulltext.search(fulltext.index_of(c), text, columns).select("id")


_add("fts_docs", fulltext.documents)
ORACLES["fts_docs"] = oracle("SELECT 1 FROM books, book_authors, authors, book_series, book_tags").rsplit(" SELECT 1", 1)[0] + f", {_FTS_DOCS} SELECT * FROM docs"
for _name, _text, _columns, _test in (
    ("fts_term", '"study"', (), _any("x = 'study'")),
    ("fts_prefix", "stu", (), _any("x LIKE 'stu%'")),
    ("fts_and_or", '"the" "study" OR urg', (), f"({_any("x = 'the'")} AND {_any("x = 'study'")}) OR {_any("x LIKE 'urg%'")}"),
    ("fts_not", "stu NOT economy", (), f"{_any("x LIKE 'stu%'")} AND NOT {_any("x = 'economy'")}"),
    ("fts_only_not", "NOT economy", (), f"NOT {_any("x = 'economy'")}"),
    ("fts_column", None, (("title", "stud", False),), "len(list_filter(title, lambda x: x LIKE 'stud%')) > 0"),
    ("fts_phrase", '"a study"', (), "(" + " OR ".join(f"concat(' ', array_to_string({c}, ' '), ' ') LIKE '% a study %'" for c in _COLS) + ")"),
):
    _add(_name, _hits(_text, _columns))
    ORACLES[_name] = _fts(f"SELECT id FROM tok WHERE {_test}")
_W = {"title": 10, "description": 1, "authors": 5, "series": 3, "publisher": 2, "tags": 2}
_add("fts_bm25", lambda c: fulltext.search(fulltext.index_of(c), '"study"').select("id", _r("rank").alias("rank")))
ORACLES["fts_bm25"] = _fts(", ".join([
    "", "f AS (SELECT id, " + " + ".join(f"{w} * len(list_filter({c}, lambda x: x = 'study'))" for c, w in _W.items()) + " AS tf, " + " + ".join(f"len({c})" for c in _COLS) + " AS dl FROM tok)",
    "s AS (SELECT count(*) AS n, avg(dl) AS al, count(*) FILTER (WHERE tf > 0) AS df FROM f)",
]).lstrip() + " SELECT id, round(-(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al)), 6) AS rank FROM f, s WHERE tf > 0")

_LEN = ", ".join(["", "f AS (SELECT id, " + " + ".join(f"{w} * len(list_filter({c}, lambda x: x LIKE 'study%'))" for c, w in _W.items()) + " AS tf, " + " + ".join(f"len({c})" for c in _COLS) + " AS dl FROM tok)", "s AS (SELECT count(*) AS n, avg(dl) AS al, count(*) FILTER (WHERE tf > 0) AS df FROM f)"]).lstrip()
_add("fts_boosted", lambda c: L.page(L.searched(c, "study"), 1, 50).select("id", _r("rank").alias("rank")))
ORACLES["fts_boosted"] = _fts(_LEN + " SELECT f.id, round(-(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al)) - CASE WHEN lower(title) = 'study' THEN 25 WHEN lower(title) LIKE 'study%' THEN 5 ELSE 0 END, 6) AS rank FROM f JOIN books b ON b.id = f.id, s WHERE tf > 0 ORDER BY rank, f.id LIMIT 50")
_add("fts_refresh", lambda c: (lambda i: i.refreshed(c.books.where("id % 5 = 0"), fulltext.documents(c).where("id % 10 <> 0")).lengths.join(i.postings.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left").select("id", "dl"))(fulltext.index_of(c)))
ORACLES["fts_refresh"] = _fts("SELECT id, CAST(" + " + ".join(f"len({c})" for c in _COLS) + " AS INT) AS dl FROM tok WHERE id % 10 <> 0")


def _generations(c: Catalog) -> segments.SegmentIndex:
    """All books without descriptions, then the books that have one, then those without a language taken out."""
    idx, docs = segments.SegmentIndex(c.spark, work_dir(c.spark, "fts")), fulltext.documents(c)
    idx.refresh("load", docs.withColumn("description", F.lit(None).cast("string")))
    idx.refresh("descriptions", docs.where("description is not null"))
    idx.refresh("gone", docs.limit(0), c.books.where("language is null").select("id"))
    return idx


_add("fts_generations", lambda c: (lambda i: i.lengths.join(i.postings.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left").select("id", "dl", F.coalesce("n", F.lit(0)).cast("int").alias("n")))(_generations(c).index()))
ORACLES["fts_generations"] = _fts("SELECT id, CAST(" + " + ".join(f"len({c})" for c in _COLS) + " AS INT) AS dl, CAST(" + " + ".join(f"len({c})" for c in _COLS) + " AS INT) AS n FROM tok WHERE id IN (SELECT id FROM books WHERE language IS NOT NULL)")
_add("fts_generations_search", lambda c: _generations(c).search("study").select("id"))
ORACLES["fts_generations_search"] = _fts("SELECT id FROM tok WHERE id IN (SELECT id FROM books WHERE language IS NOT NULL) AND (" + " OR ".join(f"len(list_filter({c}, lambda x: x LIKE 'study%')) > 0" for c in _COLS) + ")")

_FOR_NAMES = "SELECT name AS query FROM authors UNION ALL SELECT lower(substring(name, 3, 7)) FROM authors UNION ALL SELECT substring(name, 10, 9) FROM authors UNION ALL SELECT concat('%', substring(name, 16, 2)) FROM authors UNION ALL SELECT upper(username) FROM users"
_add("relations_in_bulk", lambda c: lookup_many(c.authors, shared_sql(c, _FOR_NAMES)).select("query", F.array_join("ids", ",").alias("ids"), "exact"))
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["relations_in_bulk"] = oracle(f"""/*cte*/ asked AS (SELECT DISTINCT query FROM ({_FOR_NAMES}) a), same AS (SELECT query, id, name, true AS exact FROM asked JOIN authors ON {_LOW.format('name')} = {_LOW.format('query')}),
    part AS (SELECT query, id, name, false AS exact FROM asked JOIN authors ON {_LOW.format('name')} LIKE concat('%', {_LOW.format('query')}, '%') WHERE query NOT IN (SELECT query FROM same)),
    top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY name, id) AS place FROM (SELECT * FROM same UNION ALL SELECT * FROM part) u)
    SELECT a.query, coalesce(string_agg(CAST(t.id AS VARCHAR), ',' ORDER BY place), '') AS ids, coalesce(bool_or(t.exact), false) AS exact FROM asked a LEFT JOIN top t ON t.query = a.query AND place <= 5 GROUP BY a.query""")

# --- similarity, quality, duplicates ------------------------------------------------------------------------------------
_PAIRS = "SELECT a.id AS a, b.id AS b, lower(a.name) AS x, lower(b.name) AS y FROM publishers a JOIN publishers b ON a.id < b.id"


def _pairs(c: Catalog) -> DataFrame:
    p = c.publishers
    return p.select(F.col("id").alias("a"), F.lower("name").alias("x")).join(p.select(F.col("id").alias("b"), F.lower("name").alias("y")), F.col("a") < F.col("b"))


_GRAMS = "list_distinct(list_transform(range(1, greatest(len({0}) - 1, 1)), lambda i: substring({0}, i, 3)))"
_add("trigram_pairs", lambda c: _pairs(c).select("a", "b", _r(T.trigram_similarity(F.col("x"), F.col("y"))).alias("v")), f"SELECT a, b, round(len(list_intersect({_GRAMS.format('x')}, {_GRAMS.format('y')})) / len(list_distinct(list_concat({_GRAMS.format('x')}, {_GRAMS.format('y')}))), 6) AS v FROM ({_PAIRS}) p")
_PREFIX = "CASE WHEN x[1:4] = y[1:4] THEN 4 WHEN x[1:3] = y[1:3] THEN 3 WHEN x[1:2] = y[1:2] THEN 2 WHEN x[1:1] = y[1:1] THEN 1 ELSE 0 END"
_add("jaro_winkler_pairs", lambda c: _pairs(c).select("a", "b", _r(T.jaro_winkler(F.col("x"), F.col("y"))).alias("v")), f"SELECT a, b, round(jaro_similarity(x, y) + {_PREFIX} * 0.1 * (1 - jaro_similarity(x, y)), 6) AS v FROM ({_PAIRS}) p")


#: Books of which some titles and names stand for nothing, and ISBN-10s of which one in eleven has the right check digit.
_QB = "SELECT id, CASE WHEN id % 19 = 0 THEN ' Unknown ' ELSE title END AS title, CASE WHEN id % 7 = 0 THEN '' ELSE description END AS description, language, publisher_id, publication_year, CASE WHEN id % 4 <> 3 THEN page_count END AS page_count, cover_path FROM books"
_QI = "SELECT book_id, identifier_type, value FROM identifiers UNION ALL SELECT id, 'isbn10', concat(lpad(CAST(id AS VARCHAR(19)), 9, '0'), CASE WHEN id % 11 = 10 THEN 'X' ELSE CAST(id % 11 AS VARCHAR(2)) END) FROM books"
_QA = "SELECT book_id, CASE WHEN author_id % 3 <> 0 THEN 'Various' ELSE name END AS name FROM book_authors JOIN authors ON id = author_id"


def _quality(c: Catalog) -> DataFrame:
    q = E.live_quality(shared_sql(c, _QB), shared_sql(c, _QI), shared_sql(c, _QA), c.book_series)
    return q.select("id", _r("score").alias("score"), "status")


_TEN = " + ".join(f"CASE substring(value, {i}, 1) WHEN 'X' THEN 10 ELSE CAST(substring(value, {i}, 1) AS INT) END * {11 - i}" for i in range(1, 11))
_STRONG = f"CASE identifier_type WHEN 'isbn13' THEN ({_ODD}) % 10 = 0 WHEN 'isbn10' THEN ({_TEN}) % 11 = 0 ELSE true END"
_QUOTED = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_Q = f"""
    SELECT id, least(CASE WHEN id IN (SELECT book_id FROM ({_QI}) i WHERE value NOT IN ({_QUOTED(W.PLACEHOLDER_ISBNS)}) AND {_STRONG}) THEN 0.4 ELSE 0.0 END
      + CASE WHEN lower(trim(title)) IN ({_QUOTED(W.GARBAGE_TITLES)}) THEN 0.0 WHEN id IN (SELECT book_id FROM ({_QA}) a WHERE lower(trim(name)) NOT IN ({_QUOTED(W.GARBAGE_AUTHORS)})) THEN 0.3 ELSE 0.1 END
      + ((coalesce(description, '') <> '')::INT + (language IS NOT NULL)::INT + (publication_year IS NOT NULL)::INT + (publisher_id IS NOT NULL)::INT + (page_count IS NOT NULL)::INT + (cover_path IS NOT NULL)::INT + (id IN (SELECT book_id FROM book_series))::INT) / 7.0 * 0.3, 1.0)::DOUBLE AS q FROM ({_QB}) b"""
_add("quality_live", _quality, f"SELECT id, round(q, 6)::DOUBLE AS score, CASE WHEN q >= 0.6 THEN 'identified' WHEN q >= 0.2 THEN 'needs_review' ELSE 'unidentified' END AS status FROM ({_Q}) x")
_add("dup_hash", lambda c: E.hash_duplicates(c.book_files), "SELECT id, hash, first_id FROM (SELECT id, hash, min(id) OVER (PARTITION BY hash) AS first_id FROM book_files) x WHERE id <> first_id")
_add("dup_isbn", lambda c: c.identifiers.join(c.book_files.select("book_id", "format").distinct(), "book_id").groupBy("value", "format").agg(F.count(F.lit(1)).alias("n"), F.min("book_id").alias("first")), "SELECT value, format, count(*) AS n, min(i.book_id) AS first FROM identifiers i JOIN (SELECT DISTINCT book_id, format FROM book_files) f ON f.book_id = i.book_id GROUP BY value, format")
_NT = "regexp_replace(trim(regexp_replace(replace(lower(title), '''', ''), '[^\\p{L}\\p{N}]+', ' ', 'g')), '^(the|a|an|le|la|les|der|die|das) (.)', '\\2')"
_add("file_dedup", lambda c: L.latest(c.book_files, ["book_id", "hash"], "added_at", "id").select("id", "book_id", "hash"), "SELECT id, book_id, hash FROM (SELECT *, row_number() OVER (PARTITION BY book_id, hash ORDER BY added_at, id) AS rn FROM book_files) x WHERE rn = 1")

# --- latest per key, retention, sync ----------------------------------------------------------------------------------
_add("latest_run", lambda c: L.latest(c.resolution_runs, "book_id", F.col("started_at").desc(), "id").select("book_id", "id", "state"), "SELECT book_id, id, state FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY started_at DESC, id) AS rn FROM resolution_runs) x WHERE rn = 1")
_add("top5_candidates", lambda c: E.top_candidates(c.identification_candidates).select("run_id", "id", _r("score").alias("score")), "SELECT run_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, created_at, id) AS rn FROM identification_candidates) x WHERE rn <= 5")
_add("best_isbn", lambda c: E.best_isbn(c.identifiers).select("book_id", "value"), "SELECT book_id, value FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY CASE source_type WHEN 'user' THEN 1 WHEN 'embedded' THEN 2 WHEN 'content_scan' THEN 3 ELSE 4 END, CASE identifier_type WHEN 'isbn13' THEN 0 ELSE 1 END, confidence DESC, value) AS rn FROM identifiers WHERE identifier_type IN ('isbn10', 'isbn13')) x WHERE rn = 1")
_add("reading_latest", lambda c: L.latest(c.reading_progress, ["user_id", "book_id"], F.col("updated_at").desc(), "id").select("user_id", "book_id", "id", _r("progress").alias("progress")), "SELECT user_id, book_id, id, round(progress, 6) AS progress FROM (SELECT *, row_number() OVER (PARTITION BY user_id, book_id ORDER BY updated_at DESC, id) AS rn FROM reading_progress) x WHERE rn = 1")
_add("continue_reading", lambda c: c.reading_progress.where("progress > 0 and progress < 1").orderBy(F.col("updated_at").desc(), "id").limit(20).select("id", "user_id", "book_id"), "SELECT id, user_id, book_id FROM reading_progress WHERE progress > 0 AND progress < 1 ORDER BY updated_at DESC, id LIMIT 20")
_NOW = "(SELECT max(ts) FROM events)"
_add("retention_tasks", lambda c: E.expired_tasks(c.tasks.crossJoin(c.events.agg(F.max("ts").alias("now"))), F.col("now"), 7).select("id"), f"SELECT id FROM tasks WHERE status IN ('completed', 'failed', 'cancelled') AND created_at < {_NOW} - INTERVAL 7 DAY")
_add("sync_diff", lambda c: E.sync_diff(c.sync_selections, c.sync_items), """
    SELECT * FROM (SELECT coalesce(s.user_id, i.device_id) AS device_id, coalesce(s.book_id, i.book_id) AS book_id,
      CASE WHEN s.file_id IS NULL THEN CASE WHEN i.removed_synced_at IS NULL THEN 'removed' ELSE 'gone' END WHEN i.file_id IS NULL OR i.removed_synced_at IS NOT NULL THEN 'new' WHEN s.file_id <> i.file_id THEN 'changed' ELSE 'skip' END AS change
    FROM sync_selections s FULL JOIN sync_items i ON s.user_id = i.device_id AND s.book_id = i.book_id) x WHERE change <> 'gone'""")
_add("stream_debounce", lambda c: S.debounced(S.relevant(c.file_events)), """
    SELECT path, arg_max(kind, ts) AS kind, max(ts) AS ts, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts, id) AS burst FROM
      (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY path ORDER BY ts, id) + INTERVAL 2 SECOND THEN 0 ELSE 1 END AS new FROM file_events
       WHERE regexp_matches(lower(path), '[.]epub$') AND (kind = 'removed' OR (kind = 'changed' AND NOT contains(path, '/.')))) a) b GROUP BY path, burst""")
_add("stream_relevant", lambda c: S.relevant(c.file_events).select("id", "path", "kind"), "SELECT id, path, kind FROM file_events WHERE regexp_matches(lower(path), '[.]epub$') AND (kind = 'removed' OR (kind = 'changed' AND NOT contains(path, '/.')))")

# --- state transitions ------------------------------------------------------------------------------------------------
_ASKED = "id % 3 = 0"
_add("mark_pending", lambda c: X.mark_pending(c.books, c.books.where(_ASKED)).select("id", "resolution_state"), f"SELECT id, CASE WHEN {_ASKED} AND resolution_state <> 'running' THEN 'pending' ELSE resolution_state END AS resolution_state FROM books")
_add("claim_pending", lambda c: X.move_state(c.books, c.books.where(_ASKED), "pending", "running").select("id", "resolution_state"), f"SELECT id, CASE WHEN {_ASKED} AND resolution_state = 'pending' THEN 'running' ELSE resolution_state END AS resolution_state FROM books")
_add("mark_done", lambda c: X.move_state(c.books, c.books.where(_ASKED), None, "done").select("id", "resolution_state"), f"SELECT id, CASE WHEN {_ASKED} THEN 'done' ELSE resolution_state END AS resolution_state FROM books")
_add("cancel_children", lambda c: X.cancel_children(c.tasks, c.tasks.where("id < 5")).select("id", "status"), "SELECT id, CASE WHEN parent_task_id < 5 AND status = 'pending' THEN 'cancelled' ELSE status END AS status FROM tasks")
_add("recover_tasks", lambda c: X.recover_tasks(c.tasks).select("id", "status"), "SELECT id, CASE status WHEN 'running' THEN 'pending' ELSE status END AS status FROM tasks")
_add("supersede_candidates", lambda c: X.supersede_candidates(c.identification_candidates, c.resolution_runs.groupBy("book_id").agg(F.max("id").alias("run_id"))).select("id", "status"), "SELECT i.id, CASE WHEN i.run_id <> k.r THEN 'superseded' ELSE i.status END AS status FROM identification_candidates i LEFT JOIN (SELECT book_id, max(id) AS r FROM resolution_runs GROUP BY book_id) k ON k.book_id = i.book_id")
_add("repair_runs", lambda c: X.repair_runs(c.resolution_runs, c.resolution_runs.where("id % 2 = 0").select("book_id", F.col("started_at").alias("requested_at"))).select("id", "state", "outcome"), "SELECT r.id, CASE WHEN state = 'running' THEN CASE WHEN a.asked > r.started_at THEN 'superseded' ELSE 'failed' END ELSE state END AS state, CASE WHEN state <> 'running' THEN outcome END AS outcome FROM resolution_runs r LEFT JOIN (SELECT book_id, max(started_at) AS asked FROM resolution_runs WHERE id % 2 = 0 GROUP BY book_id) a ON a.book_id = r.book_id")
_add("upsert_ledger", lambda c: X.upsert(c.sync_items, c.sync_selections.select(F.col("user_id").alias("device_id"), "book_id", "file_id"), ["device_id", "book_id"]).select("device_id", "book_id", "file_id", "delivered_at"), "SELECT coalesce(s.user_id, i.device_id) AS device_id, coalesce(s.book_id, i.book_id) AS book_id, coalesce(s.file_id, i.file_id) AS file_id, i.delivered_at FROM sync_items i FULL JOIN sync_selections s ON s.user_id = i.device_id AND s.book_id = i.book_id")
_add("cascade_delete", lambda c: X.cascade_delete(c.book_files, c.books.where(_ASKED)).select("id", "book_id"), "SELECT id, book_id FROM book_files WHERE book_id % 3 <> 0")
_add("purge_tombstones", lambda c: X.purge_tombstones(c.sync_items.crossJoin(c.sync_items.agg(F.max("delivered_at").alias("now"))), F.col("now")).select("device_id", "book_id"), "SELECT device_id, book_id FROM sync_items WHERE removed_synced_at IS NULL OR removed_synced_at >= (SELECT max(delivered_at) FROM sync_items) - INTERVAL 90 DAY")

# --- tiers and the auto-apply decision ------------------------------------------------------------------------------------
_SIGNALS = {"isbn": "id % 2 = 0", "asin": "id % 17 = 0", "title": "id % 3 <> 0", "author": "id % 4 = 1", "proof": "id % 5 <> 0", "cross_provider": "id % 7 = 0", "contradiction": "id % 11 = 0", "language_mismatch": "id % 13 = 0"}


def _scored(c: Catalog) -> DataFrame:
    return R.tiered(c.identification_candidates.select("id", "run_id", "score", *[F.expr(e).alias(n) for n, e in _SIGNALS.items()]))


_TIERED = f"""t AS (SELECT *, CASE WHEN (isbn OR asin) AND (title OR author) AND proof THEN 'strong' WHEN isbn OR asin OR ((title OR author) AND cross_provider) THEN 'probable' ELSE 'weak' END AS tier
    FROM (SELECT id, run_id, score AS raw, {", ".join(f"{e} AS {n}" for n, e in _SIGNALS.items())} FROM identification_candidates) s),
    v AS (SELECT *, least(greatest(raw * CASE tier WHEN 'strong' THEN 1.0::DOUBLE WHEN 'probable' THEN 0.85::DOUBLE ELSE 0.65::DOUBLE END, 0.0::DOUBLE), 1.0::DOUBLE) AS score FROM t)"""
_CTES = oracle("SELECT 1 FROM identification_candidates, resolution_runs").rsplit(" SELECT 1", 1)[0] + ", " + _TIERED
_add("candidate_tiers", lambda c: _scored(c).select("id", "tier", _r("score").alias("score")))
ORACLES["candidate_tiers"] = _CTES + " SELECT id, tier, round(score, 6) AS score FROM v"
_add("auto_apply", lambda c: R.decide(c.resolution_runs, _scored(c)))
ORACLES["auto_apply"] = _CTES + """, p AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second, count(*) FILTER (WHERE score >= 0.85::DOUBLE) OVER (PARTITION BY run_id) AS above FROM v WINDOW w AS (PARTITION BY run_id ORDER BY score DESC, id))
    SELECT r.id AS run_id, p.id AS best_id, CASE WHEN p.id IS NULL THEN 'no_candidates' WHEN tier <> 'strong' THEN CASE WHEN isbn OR asin THEN 'blocked_no_trusted_id' WHEN contradiction THEN 'blocked_contradiction' ELSE 'blocked_low_tier' END
      WHEN language_mismatch THEN 'blocked_contradiction' WHEN score < 0.85::DOUBLE THEN 'blocked_low_tier' WHEN above > 1 OR score - second < 0.15::DOUBLE THEN 'blocked_ambiguous' ELSE 'auto_apply_allowed' END AS decision
    FROM resolution_runs r LEFT JOIN p ON p.run_id = r.id AND place = 1"""
_PROPOSED = """SELECT id, (id % 9) / CAST(10.0 AS DOUBLE) AS confidence, id % 5 = 0 AS same_isbn, id % 10 = 0 AS same_asin, CASE WHEN id % 8 <> 0 THEN (id % 11) / CAST(10.0 AS DOUBLE) END AS title_sim,
    CASE WHEN id % 3 <> 0 THEN (id % 7) / CAST(6.0 AS DOUBLE) END AS author_sim, rating / CAST(5.0 AS DOUBLE) AS publisher_sim, CAST(id % 11 AS INT) AS filled, id % 13 = 0 AS other_language FROM {0}"""
_add("candidate_score", lambda c: R.scored(c.spark.sql(_PROPOSED.format("{books}"), books=c.books)).select("id", _r("score").alias("score"), "contradiction", "title", "author"), f"""
    SELECT id, round(greatest(least(greatest(confidence + CASE WHEN same_isbn THEN 0.2 ELSE 0 END + CASE WHEN same_asin THEN 0.2 ELSE 0 END + CASE WHEN title_sim < 0.3 THEN -0.15 ELSE coalesce(title_sim * 0.1, 0) END
      + coalesce(author_sim * 0.05, 0) + coalesce(publisher_sim * 0.05, 0) + filled / 10.0::DOUBLE * 0.05, 0), 1) - CASE WHEN other_language THEN 0.15 ELSE 0 END, 0)::DOUBLE, 6) AS score,
      coalesce(title_sim < 0.3, false) AS contradiction, coalesce(title_sim >= 0.3, false) AS title, coalesce(author_sim > 0.5, false) AS author FROM ({_PROPOSED.format("books")}) x""")

# the other modules register their queries when imported
from . import ingest_queries, library_queries, match_queries, plan_queries, review_queries, scalar_queries  # noqa: E402, F401
