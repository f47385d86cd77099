"""Domain views of a document catalog over the star-schema tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .work import dealt

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

_DIGITS = " + ".join(f"cast(substring(body, {i}, 1) as int) * {1 if i % 2 else 3}" for i in range(1, 13))

#: name -> (SQL, views and tables it reads)
VIEWS: dict[str, str] = {
    "books": """
        SELECT p.p_partkey AS id,
          CASE p.p_partkey % 4 WHEN 0 THEN concat('The ', p.p_name) WHEN 1 THEN concat(p.p_name, ': a study') ELSE p.p_name END AS title,
          CASE WHEN p.p_partkey % 4 = 1 THEN concat(p.p_name, ': a study') ELSE p.p_name END AS sort_title,
          d.text AS description,
          CASE WHEN p.p_partkey % 5 = 0 THEN NULL ELSE d.lang END AS language,
          CASE WHEN p.p_partkey % 10 = 0 THEN NULL ELSE 1950 + p.p_size END AS publication_year,
          CASE WHEN p.p_partkey % 6 = 0 THEN NULL ELSE p.p_brand END AS publisher_id,
          CASE WHEN p.p_partkey % 7 = 0 THEN NULL ELSE (p.p_partkey % 11) / CAST(2.0 AS DOUBLE) END AS rating,
          CAST(floor(p.p_retailprice) AS INT) AS page_count,
          CASE p.p_partkey % 3 WHEN 0 THEN 'identified' WHEN 1 THEN 'needs_review' ELSE 'unidentified' END AS metadata_status,
          CASE p.p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('covers/', CAST(p.p_partkey AS VARCHAR(20))) END AS cover_path,
          p.p_partkey % 13 = 0 AS metadata_locked, p.p_partkey % 17 = 0 AS metadata_user_trusted,
          CASE p.p_partkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS resolution_state,
          CASE p.p_partkey % 6 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'enriched' WHEN 2 THEN 'disputed' WHEN 3 THEN 'ambiguous' WHEN 4 THEN 'unmatched' END AS resolution_outcome,
          (p.p_partkey % 11) / CAST(10.0 AS DOUBLE) AS ingest_quality_score, e.ts AS added_at, u.ts AS updated_at
        FROM part p LEFT JOIN documents d ON d.doc_id = p.p_partkey LEFT JOIN events e ON e.event_id = p.p_partkey LEFT JOIN events u ON u.event_id = p.p_partkey * 3""",
    "publishers": "SELECT DISTINCT p_brand AS id, p_brand AS name FROM part",
    "authors": "SELECT s_suppkey AS id, s_name AS name, s_name AS sort_name FROM supplier",
    "book_authors": "SELECT l_partkey AS book_id, l_suppkey AS author_id, 'author' AS role, min(l_linenumber) AS position FROM lineitem GROUP BY l_partkey, l_suppkey",
    "series": "SELECT DISTINCT p_type AS id, p_type AS name FROM part",
    "book_series": "SELECT p_partkey AS book_id, p_type AS series_id, p_size AS position FROM part WHERE p_partkey % 2 = 0",
    "tags": "SELECT DISTINCT o_orderpriority AS id, o_orderpriority AS name, 'priority' AS category FROM orders",
    "book_tags": "SELECT DISTINCT l.l_partkey AS book_id, o.o_orderpriority AS tag_id FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_linenumber = 7 AND l.l_quantity > 25",
    "book_files": """
        SELECT l_orderkey AS id, min(l_partkey) AS book_id, CASE min(l_returnflag) WHEN 'A' THEN 'epub' WHEN 'N' THEN 'pdf' ELSE 'mobi' END AS format,
          CAST(floor(max(l_extendedprice)) AS BIGINT) AS file_size, concat('h', CAST(l_orderkey % 997 AS VARCHAR(20))) AS hash, min(l_shipdate) AS added_at
        FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey""",
    "identifiers": f"""
        SELECT book_id, identifier_type, value, CASE book_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'embedded' WHEN 2 THEN 'content_scan' ELSE 'provider' END AS source_type,
          (book_id % 10) / CAST(10.0 AS DOUBLE) AS confidence
        FROM (
          SELECT k AS book_id, 'isbn13' AS identifier_type, concat(body, CAST((CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END + (10 - ({_DIGITS}) % 10) % 10) % 10 AS VARCHAR(2))) AS value
          FROM (SELECT p_partkey AS k, concat('978', lpad(CAST(p_partkey AS VARCHAR(20)), 9, '0')) AS body FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 6 = 0) b
          UNION ALL SELECT p_partkey, 'asin', concat('B', lpad(CAST(p_partkey AS VARCHAR(20)), 9, '0')) FROM part WHERE p_partkey % 5 = 0) i""",
    "tasks": """
        SELECT event_id AS id, event_type AS task_type, CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'cancelled' END AS status,
          ts AS created_at, CASE WHEN event_id < 20 THEN NULL ELSE event_id % 20 END AS parent_task_id FROM events""",
    "resolution_runs": """
        SELECT o_orderkey AS id, o_custkey AS book_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'superseded' END AS state,
          CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'confirmed' WHEN '2' THEN 'enriched' WHEN '3' THEN 'disputed' WHEN '4' THEN 'ambiguous' ELSE 'unmatched' END AS outcome, o_orderdate AS started_at FROM orders""",
    "identification_candidates": """
        SELECT l.l_orderkey * 10 + l.l_linenumber AS id, l.l_orderkey AS run_id, o.o_custkey AS book_id, max(l.l_discount) * 10 AS score,
          CASE min(l.l_linestatus) WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status, max(l.l_shipdate) AS created_at
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY l.l_orderkey, l.l_linenumber, o.o_custkey""",
    "review_candidates": """
        SELECT id, CASE WHEN id % 19 = 0 THEN NULL ELSE run_id END AS run_id, CASE WHEN id % 19 = 0 THEN book_id + 1000000 * (id % 2) ELSE book_id END AS book_id, score,
          CASE WHEN id % 23 = 0 THEN 'applied' WHEN id % 29 = 0 THEN 'superseded' ELSE status END AS status, created_at FROM identification_candidates""",
    "users": "SELECT c_custkey AS id, c_name AS username, CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'user' END AS role, c_acctbal > 0 AS is_active FROM customer",
    "sessions": "SELECT event_id AS id, user_id, ts AS expires_at FROM events",
    "bookmarks": "SELECT event_id AS id, user_id, event_id % 200 AS book_id, value AS position, event_type AS label FROM events",
    "watched_directories": "SELECT n_nationkey AS id, concat('/data/', n_name) AS path, n_regionkey % 2 = 0 AS enabled FROM nation",
    "book_merges": "SELECT p_partkey AS winner, p_partkey + 1 AS secondary FROM part WHERE p_partkey % 10 = 3",
    "duplicate_links": """
        SELECT a.p_partkey AS book_id_a, b.p_partkey AS book_id_b, CASE a.p_partkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'merged' ELSE 'dismissed' END AS status
        FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey""",
    "reading_progress": "SELECT event_id AS id, user_id, event_id % 200 AS book_id, least(value / 500, 1.0) AS progress, ts AS updated_at, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 4 END AS device FROM events",
    "sync_selections": "SELECT o_custkey % 10 AS user_id, o_orderkey % 200 AS book_id, min(o_orderkey) AS file_id, max(o_orderdate) AS updated_at FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 3 = 0 GROUP BY o_custkey % 10, o_orderkey % 200",
    "sync_items": """
        SELECT l_suppkey % 10 AS device_id, l_partkey % 200 AS book_id, min(l_orderkey) AS file_id, max(l_shipdate) AS delivered_at,
          max(CASE WHEN l_returnflag = 'R' AND l_quantity > 48 THEN l_shipdate END) AS removed_synced_at FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY l_suppkey % 10, l_partkey % 200""",
    "file_events": "SELECT event_id AS id, concat('/in/', CASE user_id % 4 WHEN 0 THEN '.' ELSE '' END, 'u', CAST(user_id % 25 AS VARCHAR(20)), CASE user_id % 5 WHEN 0 THEN '.part' WHEN 1 THEN '.EPUB' WHEN 2 THEN '.doc' ELSE '.epub' END, CASE user_id % 7 WHEN 0 THEN '~' ELSE '' END) AS path, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'removed' ELSE 'changed' END AS kind, ts FROM events",
}

#: view -> the key that each of its large tables is dealt by, which is the key of its join and of its groups.
DEALT = {"identification_candidates": {"lineitem": "l_orderkey", "orders": "o_orderkey"}}


class Catalog:
    """Views as DataFrames, built when first asked for: ``Catalog(spark, sf_dir).books``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                import re

                sql, used = VIEWS[name], {}
                for t in (*BASE, *VIEWS):
                    sql, n = re.subn(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
                    if n:
                        used[t] = getattr(self, t)
                if name in DEALT:
                    used |= dealt({t: (used[t], key) for t, key in DEALT[name].items()})
                self._made[name] = self.spark.sql(sql, **used)
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]


def oracle(sql: str) -> str:
    """``sql`` with the views it names as common table expressions."""
    import re

    need, text = set(), [sql]
    while text:  # views that the named ones read
        found = {v for v in VIEWS if v not in need and re.search(rf"\b(FROM|JOIN|,)\s+{v}\b", text[-1])}
        text = text[:-1] + [VIEWS[v] for v in found]
        need |= found
    ctes = [f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in need]
    # SQL that begins with expressions of its own names them after this mark
    body = sql.strip()
    if body.startswith("/*cte*/"):
        return "WITH " + ", ".join([*ctes, body.removeprefix("/*cte*/").strip()])
    return "WITH " + ", ".join(ctes) + " " + sql if need else sql
