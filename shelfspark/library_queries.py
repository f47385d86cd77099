"""Queries of lookups, lists, device sync and event streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import library as L
from .operators import lists as N
from .operators import sync as Y
from .operators.edits import linked_members
from .registry import add, shared_sql
from .sources.views import Catalog
from .streaming import events as S
from .streaming import watched as W

# --- lookups and lists -----------------------------------------------------------------------------------------
add("lookup_book", lambda c: N.by_key(c.books, id=42).select("id", "title", "publisher_id"), "SELECT id, title, publisher_id FROM books WHERE id = 42")
add("lookup_hash", lambda c: N.by_key(c.book_files, hash="h10").select("id", "book_id", "format"), "SELECT id, book_id, format FROM book_files WHERE hash = 'h10'")
_PATHS = "SELECT id, concat('/', format, '/', CAST(book_id AS VARCHAR(9))) AS path FROM book_files"
add("lookup_path", lambda c: N.by_key(shared_sql(c, _PATHS), path="/epub/102").select("id"), f"SELECT id FROM ({_PATHS}) x WHERE path = '/epub/102'")
add("lookup_identifier", lambda c: N.by_key(c.identifiers, identifier_type="asin", value="B000000040").select("book_id"), "SELECT book_id FROM identifiers WHERE identifier_type = 'asin' AND value = 'B000000040'")
add("book_detail", lambda c: N.book(c, 40).select("id", "title", "authors", "series", "tags", "formats"), """
    SELECT b.id, b.title, coalesce((SELECT string_agg(name, '|' ORDER BY position, name) FROM book_authors JOIN authors ON id = author_id WHERE book_id = 40), '') AS authors, coalesce((SELECT string_agg(series_id, '|' ORDER BY position, series_id) FROM book_series WHERE book_id = 40), '') AS series,
      coalesce((SELECT string_agg(tag_id, '|' ORDER BY tag_id) FROM book_tags WHERE book_id = 40), '') AS tags, coalesce((SELECT string_agg(DISTINCT format, '|' ORDER BY format) FROM book_files WHERE book_id = 40), '') AS formats FROM books b WHERE b.id = 40""")
_N = "(SELECT count(*) FROM {0} l WHERE l.{1} = e.id)"
for _name, _kind, _by, _desc, _order, _count in (
    ("list_authors", "authors", None, False, "sort_name, id", _N.format("book_authors", "author_id")), ("list_authors_busiest", "authors", "book_count", True, "book_count DESC, sort_name, id", _N.format("book_authors", "author_id")),
    ("list_series", "series", "book_count", False, "book_count, name, id", _N.format("book_series", "series_id")), ("list_tags", "tags", "category", True, "category DESC, name, id", _N.format("book_tags", "tag_id")), ("list_publishers", "publishers", "name", True, "name DESC, id", "0"),
):
    add(_name, lambda c, k=_kind, b=_by, d=_desc: N.listed(c, k, b, d).select("id", "name", *(["book_count"] if k != "publishers" else [])), f"SELECT id, name{'' if _kind == 'publishers' else ', book_count'} FROM (SELECT e.*, {_count} AS book_count FROM {_kind} e) x ORDER BY {_order} LIMIT 25")
add("search_authors", lambda c: N.listed(c, "authors", "name", True, search="R#0000000_").select("id", "name", "book_count"), "SELECT id, name, (SELECT count(*) FROM book_authors l WHERE l.author_id = e.id) AS book_count FROM authors e WHERE lower(name) LIKE '%r#0000000_%' ORDER BY name DESC, id LIMIT 25")
add("search_tags", lambda c: N.listed(c, "tags", "name", search="h", category="PRIORITY").select("id", "book_count"), "SELECT id, (SELECT count(*) FROM book_tags l WHERE l.tag_id = e.id) AS book_count FROM tags e WHERE lower(name) LIKE '%h%' AND lower(category) = 'priority' ORDER BY name, id LIMIT 25")
add("default_sort", lambda c: L.page(L.ordered(c, c.books, L.default_sort(None, None)), 1, 50).select("id"), "SELECT id FROM books ORDER BY added_at DESC NULLS LAST, id LIMIT 50")
_LINKS = "SELECT l.*, b.added_at AS created_at FROM duplicate_links l JOIN books b ON b.id = l.book_id_a"
add("pending_duplicates", lambda c: N.pending_links(shared_sql(c, _LINKS)).select("book_id_a", "book_id_b"), f"SELECT book_id_a, book_id_b FROM ({_LINKS}) x WHERE status = 'pending' ORDER BY created_at DESC NULLS LAST, book_id_a, book_id_b LIMIT 25")
add("bookmark_order", lambda c: c.bookmarks.where("user_id = 7").orderBy("position", "id").limit(20).select("id"), "SELECT id FROM bookmarks WHERE user_id = 7 ORDER BY position NULLS FIRST, id LIMIT 20")
add("task_roots", lambda c: c.tasks.where("parent_task_id is null").orderBy(F.col("created_at").desc(), "id").limit(10).select("id"), "SELECT id FROM tasks WHERE parent_task_id IS NULL ORDER BY created_at DESC NULLS LAST, id LIMIT 10")
add("watched_enabled", lambda c: c.watched_directories.where("enabled").orderBy("path").select("id", "path"), "SELECT id, path FROM watched_directories WHERE enabled")
add("users_active", lambda c: c.users.where("is_active").groupBy("role").agg(F.count(F.lit(1)).alias("n")), "SELECT role, count(*) AS n FROM users WHERE is_active GROUP BY role")
add("table_sizes", lambda c: N.table_sizes(c, ("books", "authors", "book_files", "identifiers", "tasks")), " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in ("books", "authors", "book_files", "identifiers", "tasks")))
_OUT = "SELECT book_id_a AS id FROM duplicate_links UNION ALL SELECT book_id_b FROM duplicate_links UNION ALL SELECT 999999999"
add("scope_count", lambda c: c.books.where("language = 'en'").join(linked_members(c.part.select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type"), ["p_name", "p_brand", "p_type"]).select("id").unionByName(c.part.select((F.max("p_partkey") + 999999999).alias("id"))), "id", "left_anti").agg(F.count(F.lit(1)).alias("n")), f"SELECT count(*) AS n FROM books WHERE language = 'en' AND id NOT IN ({_OUT})")
add("manifest_totals", lambda c: c.book_files.groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes")).withColumn("files", F.sum("n").over(Window.partitionBy())), "SELECT format, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS bytes, (SELECT count(*) FROM book_files) AS files FROM book_files GROUP BY format")

# --- device sync --------------------------------------------------------------------------------------------------
_SEL = "SELECT book_id % 10 AS device_id, book_id, min(id) AS file_id, max(added_at) AS updated_at FROM book_files GROUP BY book_id % 10, book_id"
_LED = "SELECT book_id % 10 AS device_id, book_id, CASE WHEN book_id % 7 = 0 THEN -1 ELSE min(id) END AS l_file_id, CASE WHEN book_id % 5 = 0 THEN NULL ELSE min(hash) END AS l_hash, max(added_at) AS l_selected, CASE WHEN book_id % 11 = 0 THEN NULL ELSE max(added_at) END AS delivered_at, CASE WHEN book_id % 13 = 0 THEN max(added_at) END AS removed_synced_at FROM book_files WHERE book_id % 4 <> 0 GROUP BY book_id % 10, book_id"
_OK = f"SELECT s.*, f.hash FROM ({_SEL}) s JOIN book_files f ON f.id = s.file_id AND f.book_id = s.book_id AND lower(f.format) = 'epub'"
add("sync_candidates", lambda c: Y.candidates(shared_sql(c, _SEL), c.book_files, c.books, shared_sql(c, _LED)), f"""
    SELECT s.device_id, s.book_id FROM ({_OK}) s JOIN books b ON b.id = s.book_id LEFT JOIN ({_LED}) l ON l.device_id = s.device_id AND l.book_id = s.book_id
    WHERE l.device_id IS NULL OR removed_synced_at IS NOT NULL OR l_file_id <> file_id OR l_hash IS NULL OR l_hash <> hash OR l_selected IS NULL OR l_selected <> s.updated_at OR delivered_at IS NULL OR date_trunc('second', b.updated_at) > date_trunc('second', delivered_at)""")
add("sync_removed", lambda c: Y.removals(shared_sql(c, _SEL), c.book_files, shared_sql(c, _LED)), f"SELECT device_id, book_id FROM ({_LED}) l WHERE removed_synced_at IS NULL AND NOT EXISTS (SELECT 1 FROM ({_OK}) s WHERE s.device_id = l.device_id AND s.book_id = l.book_id)")
add("sync_revision", lambda c: c.books.select("id", Y.revision(F.col("id"), F.col("title"), F.col("language"), F.col("publication_year")).alias("revision")), "SELECT id, sha256(array_to_string(list_transform([CAST(id AS VARCHAR), title, language, CAST(publication_year AS VARCHAR)], lambda x: CASE WHEN x IS NULL THEN '-' ELSE concat(CAST(len(x) AS VARCHAR), ':', x) END), '|')) AS revision FROM books")
_DES = "SELECT book_id % 10 AS device_id, book_id, concat('r', CAST(book_id % 3 AS VARCHAR(2))) AS revision FROM book_series"
_HAD = "SELECT book_id % 10 AS device_id, book_id, concat('r', CAST(book_id % 2 AS VARCHAR(2))) AS revision, CASE WHEN book_id % 5 = 0 THEN NULL ELSE 1 END AS delivered_at, CASE WHEN book_id % 7 = 0 THEN 1 END AS removed_at, CASE WHEN book_id % 7 = 0 THEN 1 END AS removed_synced_at FROM (SELECT DISTINCT book_id FROM book_files WHERE book_id % 4 <> 2) f"
_CLS = f"SELECT d.device_id, d.book_id, CASE WHEN h.book_id IS NOT NULL AND removed_synced_at IS NULL AND h.revision = d.revision THEN 'skip' WHEN delivered_at IS NOT NULL AND removed_synced_at IS NULL THEN 'changed' ELSE 'new' END AS change FROM ({_DES}) d LEFT JOIN ({_HAD}) h ON h.device_id = d.device_id AND h.book_id = d.book_id"
_GONE = f"SELECT h.device_id, h.book_id FROM ({_HAD}) h WHERE removed_synced_at IS NULL AND h.book_id NOT IN (SELECT book_id FROM ({_DES}) d)"
add("sync_classified", lambda c: Y.classified(shared_sql(c, _DES), shared_sql(c, _HAD)), _CLS)


def _page(c: Catalog) -> DataFrame:
    gone = shared_sql(c, _HAD).where("removed_synced_at is null").join(shared_sql(c, _DES), ["device_id", "book_id"], "left_anti")
    return Y.sync_page(Y.classified(shared_sql(c, _DES), shared_sql(c, _HAD)), gone.select("device_id", "book_id"), 12)


_PAGE = f"SELECT device_id, book_id, change, n > 12 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY turn, book_id) AS place, count(*) OVER (PARTITION BY device_id) AS n FROM (SELECT device_id, book_id, change, 0 AS turn FROM ({_CLS}) k WHERE change <> 'skip' UNION ALL SELECT device_id, book_id, 'removed', 1 FROM ({_GONE}) g) u) v WHERE place <= 12"
add("sync_page", _page, _PAGE)
add("sync_ledger", lambda c: Y.delivered(shared_sql(c, _HAD), _page(c), F.lit(9)).select("device_id", "book_id", "delivered_at", "removed_at", "removed_synced_at"), f"""
    SELECT coalesce(h.device_id, p.device_id) AS device_id, coalesce(h.book_id, p.book_id) AS book_id, CAST(CASE WHEN change IN ('new', 'changed') THEN 9 ELSE delivered_at END AS INT) AS delivered_at,
      CAST(CASE WHEN change IN ('new', 'changed') THEN NULL WHEN change = 'removed' THEN coalesce(removed_at, 9) ELSE removed_at END AS INT) AS removed_at, CAST(CASE WHEN change IN ('new', 'changed') THEN NULL WHEN change = 'removed' THEN 9 ELSE removed_synced_at END AS INT) AS removed_synced_at
    FROM ({_HAD}) h FULL JOIN ({_PAGE}) p ON p.device_id = h.device_id AND p.book_id = h.book_id""")

# --- event streams, run as batches -----------------------------------------------------------------------------------
add("stream_cooldown", lambda c: S.cooled(c.file_events, 86400.0).select("path", "kind", "ts"))
_HASHED = "SELECT id, path, CASE WHEN id % 3 = 0 THEN 'h1' ELSE 'h2' END AS hash FROM file_events"
_FILES = "SELECT path, CASE WHEN length(path) % 3 = 0 THEN 'h2' WHEN length(path) % 3 = 1 AND id % 50 = 0 THEN 'h2' ELSE 'h1' END AS hash FROM file_events"
add("stream_unchanged", lambda c: S.unchanged_dropped(shared_sql(c, _HASHED), shared_sql(c, _FILES)).select("id", "path", "hash"), f"SELECT id, path, hash FROM ({_HASHED}) e WHERE NOT (EXISTS (SELECT 1 FROM ({_FILES}) f WHERE f.path = e.path) AND NOT EXISTS (SELECT 1 FROM ({_FILES}) f WHERE f.path = e.path AND f.hash <> e.hash))")
add("stream_own_deletes", lambda c: S.foreign_removals(c.file_events.where("kind = 'removed'"), c.file_events.where("kind = 'changed'"), 3600).select("id", "path"), "SELECT id, path FROM file_events e WHERE kind = 'removed' AND NOT EXISTS (SELECT 1 FROM file_events d WHERE d.kind = 'changed' AND d.path = e.path AND e.ts >= d.ts AND e.ts < d.ts + INTERVAL 3600 SECOND)")
#: Purchases end what all other events began.
_IMP = "SELECT user_id AS task_id, concat('/p', CAST(event_id AS VARCHAR(9))) AS path, ts FROM events WHERE event_type <> 'purchase'"
_DONE = "SELECT user_id AS task_id, CASE WHEN value < 20 THEN 'failed' ELSE 'completed' END AS status, ts FROM events WHERE event_type = 'purchase'"
add("stream_finished", lambda c: S.finished_imports(shared_sql(c, _IMP), shared_sql(c, _DONE), "100 days"), f"SELECT i.task_id, i.path, d.ts AS done_at FROM ({_IMP}) i JOIN ({_DONE}) d ON d.task_id = i.task_id AND d.status = 'completed' AND d.ts >= i.ts AND d.ts <= i.ts + INTERVAL 100 DAY")

# --- watched folders: listings, tasks and errors as a folder's tables would hold them ------------------------------------
_NOW_LISTED = "SELECT concat(CASE WHEN id % 6 = 5 THEN '/new/' ELSE '/in/' END, hash, '/', CAST(id AS VARCHAR(19))) AS path, CAST(file_size AS BIGINT) AS length, added_at AS modified FROM book_files"
_WAS_LISTED = "SELECT concat('/in/', hash, '/', CAST(id AS VARCHAR(19))) AS path, CAST(file_size AS BIGINT) + CASE WHEN book_id % 4 = 0 THEN 1 ELSE 0 END AS length, CASE WHEN book_id % 9 <> 0 THEN added_at END AS modified FROM book_files"
add("watch_polled", lambda c: W.polled(shared_sql(c, _NOW_LISTED), shared_sql(c, _WAS_LISTED)).select("path", "kind", "length"), f"""
    SELECT coalesce(n.path, w.path) AS path, CASE WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS kind, n.length FROM ({_NOW_LISTED}) n FULL JOIN ({_WAS_LISTED}) w ON w.path = n.path
    WHERE n.path IS NULL OR w.path IS NULL OR n.length <> w.length OR n.modified IS DISTINCT FROM w.modified""")
_IMPORTS = "SELECT event_id AS task_id, concat('/in/', CAST(user_id AS VARCHAR(19))) AS path, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'completed' END AS status, CASE event_id % 3 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'imported' END AS result FROM events"
_SETTLED = "SELECT event_id AS task_id FROM events WHERE event_type = 'purchase'"
add("watch_deletable", lambda c: W.deletable(shared_sql(c, _IMPORTS), shared_sql(c, _SETTLED)).select("task_id", "path"), f"SELECT task_id, path FROM ({_IMPORTS}) t WHERE status = 'completed' AND coalesce(result, '') NOT IN ('skipped_duplicate', 'duplicate') AND task_id NOT IN ({_SETTLED})")
_FAULTS = "SELECT concat('/data/', n_name, '/', CAST(c_custkey AS VARCHAR(19))) AS path, CASE c_custkey % 4 WHEN 0 THEN 'No such file or directory' WHEN 1 THEN 'EACCES: Permission Denied' WHEN 2 THEN 'disk full' END AS error FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT concat('/other/', c_name), 'file not found' FROM customer"
_WATCHED_DIRS = "SELECT id, path FROM watched_directories UNION ALL SELECT n_nationkey + 100, substr(concat('/data/', n_name), 1, 8) FROM nation WHERE n_regionkey = 1"
add("watch_errors", lambda c: W.errors(shared_sql(c, _FAULTS), shared_sql(c, _WATCHED_DIRS)).select("path", "class", "directory_id"), f"""
    SELECT path, CASE WHEN regexp_matches(lower(error), 'no such file|not found|enoent|does not exist') THEN 'gone' WHEN regexp_matches(lower(error), 'permission denied|access denied|eperm|eacces') THEN 'denied' ELSE 'other' END AS class,
      (SELECT arg_min(id, {{'n': length(d.path), 'id': id}}) FROM ({_WATCHED_DIRS}) d WHERE starts_with(f.path, d.path)) AS directory_id FROM ({_FAULTS}) f""")
