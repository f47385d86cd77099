"""Queries of duplicate detection and candidate merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import dedup as D
from .operators import merging as M
from .registry import add, rounded, shared_sql
from .scalar_queries import _NT, _tri
from .sources.views import Catalog
from .sources.work import dealt

_IN = "SELECT book_id + 1 AS id, identifier_type, value, CASE book_id % 3 WHEN 0 THEN 'epub' WHEN 1 THEN 'pdf' ELSE 'mobi' END AS format FROM identifiers"
add("dup_isbn_decision", lambda c: D.isbn_decision(shared_sql(c, _IN), c.identifiers, c.book_files), f"""
    SELECT id, CASE WHEN same IS NOT NULL THEN 'skip' WHEN other IS NOT NULL THEN 'link' ELSE 'new' END AS decision, coalesce(same, other) AS existing_id FROM (
      SELECT n.id, min(CASE WHEN f.has THEN i.book_id END) AS same, min(CASE WHEN f.has IS NULL THEN i.book_id END) AS other FROM ({_IN}) n LEFT JOIN identifiers i ON i.identifier_type = n.identifier_type AND i.value = n.value
      LEFT JOIN (SELECT DISTINCT book_id, format, true AS has FROM book_files) f ON f.book_id = i.book_id AND f.format = n.format GROUP BY n.id) x""")
#: Incoming books: odd ids, whose titles lose a letter or get a word, and whose author is that of the least place.
_NEW = "SELECT b.id, CASE b.id % 3 WHEN 0 THEN concat(title, 's') WHEN 1 THEN upper(title) ELSE concat(title, ' two') END AS title, a.name AS author FROM books b LEFT JOIN (SELECT book_id, min(name) AS name FROM book_authors JOIN authors ON id = author_id WHERE book_id % 12 <> 3 GROUP BY book_id) a ON a.book_id = b.id WHERE b.id % 2 = 1"
_AUTH = "SELECT book_id, name FROM book_authors JOIN authors ON id = author_id WHERE position <= 2"
_KNOWN = "SELECT id, title FROM books WHERE id % 2 = 0"


def _fuzzy(c: Catalog, block_rows: int | None = D.BLOCK_ROWS) -> DataFrame:
    return D.fuzzy_duplicates(shared_sql(c, _NEW), shared_sql(c, _KNOWN), shared_sql(c, _AUTH), block_rows)


_N1 = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_FUZZY = f"""
    SELECT id, existing_id, ts AS title_similarity, coalesce(asim, 0) AS author_similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN asim >= 0.6 THEN 0 ELSE 1 END, CASE WHEN asim >= 0.6 THEN ts + asim ELSE ts END DESC, existing_id) AS rn FROM (
      SELECT p.id, p.existing_id, p.ts, CASE WHEN author IS NULL AND n.k IS NULL THEN 1.0 WHEN author IS NULL OR n.k IS NULL THEN 0.0 ELSE n.k END AS asim FROM (
        SELECT *, {_tri('x', 't')} AS ts FROM (SELECT id, author, {_NT.format('title')} AS x FROM ({_NEW}) a) n JOIN
          (SELECT * FROM (SELECT existing_id, t, row_number() OVER (PARTITION BY t[1:3] ORDER BY existing_id) AS r FROM (SELECT id AS existing_id, {_NT.format('title')} AS t FROM ({_KNOWN}) k) b WHERE strlen(t) >= 3) d WHERE r <= 20) k ON n.x[1:3] = k.t[1:3]) p
      LEFT JOIN LATERAL (SELECT max({_tri('u', 'v')}) AS k FROM (SELECT {_N1.format('p.author')} AS u, {_N1.format('l.name')} AS v FROM ({_AUTH}) l WHERE l.book_id = p.existing_id) w) n ON true
      WHERE p.ts >= 0.7) q WHERE asim >= 0.6 OR ts >= 0.9) z WHERE rn = 1"""
add("dup_fuzzy", lambda c: _fuzzy(c).withColumns({k: rounded(k) for k in ("title_similarity", "author_similarity")}), f"SELECT id, existing_id, round(title_similarity::DOUBLE, 6) AS title_similarity, round(author_similarity::DOUBLE, 6) AS author_similarity FROM ({_FUZZY}) y")
add("dup_auto_link", lambda c: D.auto_links(_fuzzy(c), c.books.select("id", F.expr("case id % 3 when 1 then 'cbz' else 'epub' end").alias("format")), c.book_files), f"SELECT y.id, y.existing_id, CASE y.id % 3 WHEN 1 THEN 'cbz' ELSE 'epub' END AS format FROM ({_FUZZY}) y WHERE title_similarity >= 0.85 AND author_similarity >= 0.8 AND NOT EXISTS (SELECT 1 FROM book_files f WHERE f.book_id = y.existing_id AND f.format = CASE y.id % 3 WHEN 1 THEN 'cbz' ELSE 'epub' END)")
#: All known books, whatever their titles begin with: titles and names are compared once for each distinct pair, as in plain nested loops.
_EXACT = f"""
    WITH n AS MATERIALIZED (SELECT id, {_NT.format('title')} AS x, coalesce({_N1.format('author')}, '') AS p FROM ({_NEW}) a), k AS MATERIALIZED (SELECT id AS existing_id, {_NT.format('title')} AS t FROM ({_KNOWN}) b),
    l AS MATERIALIZED (SELECT DISTINCT book_id AS existing_id, {_N1.format('name')} AS q FROM ({_AUTH}) c),
    tt AS MATERIALIZED (SELECT x, t, {_tri('x', 't')} AS ts FROM (SELECT DISTINCT x FROM n WHERE strlen(x) >= 3) u, (SELECT DISTINCT t FROM k WHERE t <> '') v WHERE {_tri('x', 't')} >= 0.7),
    aa AS MATERIALIZED (SELECT p, q, {_tri('p', 'q')} AS like_ FROM (SELECT DISTINCT p FROM n) u, (SELECT DISTINCT q FROM l) v),
    c AS (SELECT n.id, k.existing_id, tt.ts, CASE WHEN n.p = '' AND max(l.q) IS NULL THEN 1.0 WHEN n.p = '' OR max(l.q) IS NULL THEN 0.0 ELSE max(aa.like_) END AS asim
      FROM n JOIN tt ON tt.x = n.x JOIN k ON k.t = tt.t AND k.existing_id <> n.id LEFT JOIN l ON l.existing_id = k.existing_id LEFT JOIN aa ON aa.p = n.p AND aa.q = l.q GROUP BY n.id, k.existing_id, tt.ts, n.p)
    SELECT id, existing_id, round(ts::DOUBLE, 6) AS title_similarity, round(asim::DOUBLE, 6) AS author_similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN asim >= 0.6 THEN 0 ELSE 1 END, CASE WHEN asim >= 0.6 THEN ts + asim ELSE ts END DESC, existing_id) AS rn FROM c WHERE asim >= 0.6 OR ts >= 0.9) z WHERE rn = 1"""
add("dup_fuzzy_exact", lambda c: _fuzzy(c, None).withColumns({k: rounded(k) for k in ("title_similarity", "author_similarity")}), f"SELECT * FROM ({_EXACT}) exact")
_OLD = "SELECT id + 1 AS book_id_a, id AS book_id_b FROM books WHERE id % 8 = 0"
add("dup_link_rows", lambda c: D.link_rows(_fuzzy(c), shared_sql(c, _OLD)).withColumn("confidence", rounded("confidence")), f"SELECT existing_id AS book_id_a, id AS book_id_b, round(((title_similarity + author_similarity) / 2)::DOUBLE, 6) AS confidence FROM ({_FUZZY}) y WHERE NOT EXISTS (SELECT 1 FROM ({_OLD}) o WHERE least(o.book_id_a, o.book_id_b) = least(y.id, y.existing_id) AND greatest(o.book_id_a, o.book_id_b) = greatest(y.id, y.existing_id))")


def _trusted(c: Catalog) -> DataFrame:
    status, score = D.boosted_status(F.col("metadata_status"), F.col("ingest_quality_score"), F.col("publisher_id") == "Brand#1")
    return c.books.select("id", status.alias("status"), rounded(score).alias("score"))


add("trusted_import", _trusted, "SELECT id, CASE WHEN publisher_id IS NOT NULL AND publisher_id = 'Brand#1' THEN 'identified' ELSE metadata_status END AS status, round(CASE WHEN publisher_id IS NOT NULL AND publisher_id = 'Brand#1' THEN greatest(ingest_quality_score, 0.8::DOUBLE) ELSE ingest_quality_score END, 6) AS score FROM books")

#: Proposals for books: three providers, every second one with an ISBN, some with a changed title.
_CAND = """SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY id) AS INT) AS ordinal, CASE id % 3 WHEN 0 THEN 'hardcover' WHEN 1 THEN 'open_library' ELSE 'loc' END AS provider, least(score, 1.0) AS score, concat('Book ', CAST(book_id AS VARCHAR(9)), CASE id % 5 WHEN 0 THEN ' again' ELSE '' END) AS title,
    CASE WHEN id % 4 = 0 THEN 'Ann Lee' END AS author, CASE WHEN id % 2 = 0 THEN concat('isbn13:978', lpad(CAST(book_id AS VARCHAR(9)), 9, '0'), '0') ELSE concat('lccn:', CAST(id AS VARCHAR(12))) END AS identifier, CASE WHEN id % 3 = 0 THEN 'text' END AS description, CASE WHEN id % 7 = 0 THEN 'Audio CD' END AS physical_format,
    CASE WHEN id % 6 = 0 THEN concat('http://c/', CAST(id AS VARCHAR(12))) END AS cover_url FROM identification_candidates"""


def candidates(c: Catalog) -> DataFrame:
    none = {n: t for n, t in (f.strip().split(" ") for f in M.CANDIDATE.split(", "))}
    by_book = Catalog(c.spark, c.sf_dir)
    by_book._made["identification_candidates"] = dealt({"found": (c.identification_candidates.select("id", "book_id", "score"), "book_id")})["found"]
    rows = shared_sql(by_book, _CAND).withColumns({"authors": F.filter(F.array("author"), lambda x: x.isNotNull()), "identifiers": F.array("identifier")})
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in none.items()])


add("cand_resolve", lambda c: M.merged_candidates(candidates(c)).select("book_id", "ordinal", "provider", rounded("score").alias("score"), "cross_provider", F.array_join("merged_from", "|").alias("merged_from"), F.array_join("identifiers", "|").alias("identifiers"), "cover_url", "field_count"))
