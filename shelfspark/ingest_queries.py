"""Queries of markup, ingest scores, requests and file names, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import markup as K
from .operators import ingest as I
from .operators import library as L
from .plans import search as P
from .registry import add, rounded, shared_sql
from .sources.views import Catalog

_GONE = "html"
for _tag in K.DANGEROUS:
    _GONE = f"regexp_replace(regexp_replace({_GONE}, '(?is)<{_tag}.*?</{_tag}>', '', 'g'), '(?is)<{_tag}[^>]*(>|$)', '', 'g')"
_BREAKS = f"regexp_replace(regexp_replace({_GONE}, '(?i)<br\\s*/?>|<hr\\s*/?>|</?li\\b[^>]*>', chr(10), 'g'), '(?i)</?(?:{'|'.join(K.BLOCKS)})\\b[^>]*>', concat(chr(10), chr(10)), 'g')"
_BARE = f"regexp_replace(regexp_replace({_BREAKS}, '(?s)<!--.*?(-->|$)', '', 'g'), '(?s)<[^>]*(>|$)', '', 'g')"
_DECODED = f"replace(replace(replace(replace({_BARE}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_SPACED = f"replace(regexp_replace(regexp_replace(regexp_replace({_DECODED}, '[^\\S\\n]*\\n[^\\S\\n]*(?:\\n[^\\S\\n]*)+', chr(1), 'g'), '[^\\S\\n]*\\n[^\\S\\n]*', chr(10), 'g'), '[^\\S\\n]+', ' ', 'g'), chr(1), concat(chr(10), chr(10)))"
add("strip_html", lambda c: c.pages.select("page_id", K.strip_html(F.col("html")).alias("v")), f"SELECT page_id, nullif(regexp_replace({_SPACED}, '^\\s+|\\s+$', '', 'g'), '') AS v FROM pages")
_RISKY = "concat('<a href=\"javascript:run(', CAST(id AS VARCHAR(9)), ')\" onclick=\"x()\" id=\"i\">', title, '</a><iframe src=\"q\">z</iframe> &#65;&#x42;&amp;lt; &bogus; <img src=\"data:x\" onload=y>')"
add("safe_html", lambda c: shared_sql(c, f"SELECT id, {_RISKY} AS t FROM books").select("id", K.safe_html(F.col("t")).alias("v")), "SELECT id, concat('<a href=\"\" id=\"i\">', title, '</a> AB&lt; &bogus; <img src=\"\">') AS v FROM books")
add("html_text_nodes", lambda c: c.pages.select("page_id", K.text_nodes(F.col("html")).alias("v")), "SELECT page_id, trim(regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS v FROM pages")

_META = "SELECT id, CASE id % 5 WHEN 0 THEN 'Unknown' WHEN 1 THEN NULL ELSE title END AS title, CASE id % 3 WHEN 0 THEN 'calibre' ELSE 'Ann Lee' END AS author, id % 4 = 0 AS valid_id, CASE id % 2 WHEN 0 THEN concat(title, '!') ELSE 'zzz' END AS file_title, description, language, publisher_id AS publisher, publication_year, id % 6 = 0 AS has_subjects FROM books"
_REAL = "title IS NOT NULL AND title <> 'Unknown'"
_RICH = "(CASE WHEN description <> '' THEN 1 ELSE 0 END + CASE WHEN language <> '' THEN 1 ELSE 0 END + CASE WHEN publisher <> '' THEN 1 ELSE 0 END + CASE WHEN has_subjects THEN 1 ELSE 0 END + CASE WHEN publication_year IS NOT NULL THEN 1 ELSE 0 END)"
_CONF = f"least(CASE WHEN valid_id THEN 0.4 ELSE 0 END + CASE WHEN {_REAL} THEN CASE WHEN author = 'Ann Lee' THEN 0.3 ELSE 0.1 END ELSE 0 END + CASE WHEN {_REAL} AND file_title <> 'zzz' THEN 0.2 ELSE 0 END + {_RICH} / 5.0 * {{0}}, 1.0)"


def _ingest(c: Catalog) -> DataFrame:
    rows = shared_sql(c, _META)
    return rows.select("id", *[rounded(I.ingest_score(profile)).alias(profile) for profile in I.PROFILES])


add("ingest_scores", _ingest, f"SELECT id, round({_CONF.format('0.0')}::DOUBLE, 6) AS strict, round({_CONF.format('0.3')}::DOUBLE, 6) AS balanced, round({_CONF.format('0.5')}::DOUBLE, 6) AS permissive FROM ({_META}) x")
_SCORES = "SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE ingest_quality_score END AS score, id % 10 / CAST(10.0 AS DOUBLE) AS live FROM books"
add("score_backfill", lambda c: I.backfilled(shared_sql(c, "SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE ingest_quality_score END AS score FROM books"), shared_sql(c, "SELECT id, id % 10 / CAST(10.0 AS DOUBLE) AS live FROM books")).select("id", rounded("score").alias("score")), f"SELECT id, round(coalesce(score, live), 6) AS score FROM ({_SCORES}) x")
_QUERY = "SELECT id, title FROM books"
add("metadata_query", lambda c: I.metadata_queries(shared_sql(c, _QUERY), c.identifiers, shared_sql(c, "SELECT book_id, name FROM book_authors JOIN authors ON id = author_id WHERE position = 1")), """
    SELECT b.id, b.title, a.name AS author, i.value AS isbn, s.value AS asin FROM books b LEFT JOIN (SELECT book_id, min(name) AS name FROM book_authors JOIN authors ON id = author_id WHERE position = 1 GROUP BY book_id) a ON a.book_id = b.id
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY CASE source_type WHEN 'user' THEN 1 WHEN 'embedded' THEN 2 WHEN 'content_scan' THEN 3 ELSE 4 END, CASE identifier_type WHEN 'isbn13' THEN 0 ELSE 1 END, confidence DESC, value) AS rn FROM identifiers WHERE identifier_type IN ('isbn10', 'isbn13')) i ON i.book_id = b.id AND i.rn = 1
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY CASE source_type WHEN 'user' THEN 1 WHEN 'embedded' THEN 2 WHEN 'content_scan' THEN 3 ELSE 4 END, confidence DESC, value) AS rn FROM identifiers WHERE identifier_type = 'asin') s ON s.book_id = b.id AND s.rn = 1""")
_DIFF = "SELECT b.id, CASE b.id % 3 WHEN 0 THEN 'x' ELSE 'Ann Lee' END AS mine, CASE b.id % 2 WHEN 0 THEN 'LEE, ANN' ELSE 'Bob' END AS theirs FROM books b"
add("authors_differ", lambda c: shared_sql(c, _DIFF).select("id", I.names_differ(F.array("mine"), F.array("theirs")).alias("v")), f"SELECT id, NOT (mine = 'Ann Lee' AND theirs = 'LEE, ANN') AS v FROM ({_DIFF}) x")
add("provenance_start", lambda c: c.books.select("id", F.to_json(I.provenance({"title": F.col("title"), "language": F.col("language")}, "embedded")).alias("v")), "SELECT id, concat('{\"title\":{\"origin\":\"embedded\",\"protected\":false}', CASE WHEN language IS NULL THEN '' ELSE ',\"language\":{\"origin\":\"embedded\",\"protected\":false}' END, '}') AS v FROM books")
_TOK = P.sign(P.BookFilter(language="en", not_tags=("1-URGENT",)), b"k" * 32)
add("signed_scope", lambda c: L.filtered(c, P.verified(_TOK, b"k" * 32)).select("id"), "SELECT id FROM books WHERE language = 'en' AND id NOT IN (SELECT book_id FROM book_tags WHERE tag_id = '1-URGENT')")
add("request_filter", lambda c: L.filtered(c, P.from_request({"language": " en ", "year_min": "1990", "year_max": "1960", "has_cover": "true"})).select("id"), "SELECT id FROM books WHERE language = 'en' AND publication_year BETWEEN 1960 AND 1990 AND cover_path IS NOT NULL AND cover_path <> ''")
