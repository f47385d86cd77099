"""Queries that hold candidates against their books: inputs, plans and what applying them changes."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import langid
from .operators import reconcile as C
from .operators import resolution as S
from .operators import review as R
from .registry import add, shared_sql
from .review_queries import _CHANGE, _CONFLICT, _CORE, _FIELDS, _MORE, _REASON, _SAID
from .scalar_queries import _LONG
from .sources.views import Catalog

# Flat rows of both sides, in SQL that Spark and DuckDB share. A candidate takes its values from its own book or one of the next two.
_BOOKS = """SELECT id, title, CASE WHEN id % 4 = 1 THEN 'a study' END AS subtitle, description, publication_year, language, CASE WHEN rating > 2 THEN page_count END AS page_count, cover_path, metadata_locked, metadata_status, resolution_outcome FROM books"""
_NEXT = "identification_candidates i JOIN books n ON n.id = i.book_id + i.id % 3"
_PROVIDER = "CASE {0} % 4 WHEN 0 THEN 'hardcover' WHEN 1 THEN 'open_library' ELSE 'loc' END"
_OWN = ("id", "book_id", "run_id", "status", "score")
_QUOTES = f"""{_PROVIDER.format('i.id')} AS provider,
    CASE i.id % 7 WHEN 0 THEN NULL WHEN 1 THEN upper(n.title) WHEN 2 THEN concat(n.title, ' (second edition)') ELSE n.title END AS title, CASE WHEN n.id % 4 = 1 THEN 'a study' END AS subtitle, n.description, n.publication_year, n.language, n.page_count,
    CASE WHEN n.id % 2 = 0 THEN n.publisher_id END AS series, n.cover_path AS cover_url"""
_CAND = f"SELECT {', '.join(f'i.{n}' for n in _OWN)}, {_QUOTES} FROM {_NEXT}"
_BOOK_AUTHORS = "SELECT book_id, name, role, CAST(position AS INT) AS position FROM book_authors JOIN authors ON id = author_id WHERE position <= 1"
_QUOTED = "upper(a.name) AS name, CASE WHEN l.position = 3 THEN 'translator' WHEN l.position = 2 THEN 'author' END AS role, CAST(l.position AS INT) AS position"
_CAND_AUTHORS = f"SELECT i.id, {_QUOTED} FROM {_NEXT} JOIN book_authors l ON l.book_id = n.id AND l.position <= 3 JOIN authors a ON a.id = l.author_id"
_BOOK_SERIES = "SELECT p_partkey AS book_id, p_brand AS name FROM part WHERE p_partkey % 5 <> 0"
_TENTH = "11 - (" + " + ".join(f"CAST(substring(k.value, {i + 3}, 1) AS INT) * {11 - i}" for i in range(1, 10)) + ") % 11"
_KIND = "CASE WHEN k.identifier_type = 'isbn13' AND i.id % 2 = 0 THEN 'isbn10' ELSE k.identifier_type END"
_VALUE = f"""CASE WHEN k.identifier_type = 'isbn13' AND i.id % 2 = 0 THEN concat(substring(k.value, 4, 9), CASE ({_TENTH}) WHEN 11 THEN '0' WHEN 10 THEN 'X' ELSE CAST({_TENTH} AS VARCHAR(2)) END) WHEN k.identifier_type = 'isbn13' AND i.id % 3 = 0 THEN concat(substring(k.value, 1, 3), '-', substring(k.value, 4, 10)) ELSE k.value END"""
_CAND_IDS = f"""SELECT i.id, {_KIND} AS identifier_type,
    {_VALUE} AS value
    FROM {_NEXT} JOIN identifiers k ON k.book_id = n.id"""
#: What users edited: the field by the line's flags, protected after a large discount.
_EDITS = """SELECT l_partkey AS book_id, CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'title' WHEN 'AO' THEN 'authors' WHEN 'NF' THEN 'series' WHEN 'NO' THEN 'description' WHEN 'RF' THEN 'language' ELSE 'cover' END AS field, max(l_discount) >= 0.095 AS protected
    FROM lineitem GROUP BY l_partkey, concat(l_returnflag, l_linestatus)"""


def _provenance(c: Catalog) -> DataFrame:
    entry = F.struct("field", F.struct(F.lit("user").alias("origin"), "protected", F.lit(None).cast("long").alias("candidate_id")).cast(C.ORIGIN).alias("value"))
    return shared_sql(c, _EDITS).groupBy(F.col("book_id").alias("id")).agg(F.map_from_entries(F.collect_list(entry)).alias("provenance"))


def _by_reference(c: Catalog) -> Catalog:
    """The catalog with each text of ``documents`` as its row's id: plans only ask whether there is one and pass it on, so ``_with_texts`` fetches it where they end."""
    out = Catalog(c.spark, c.sf_dir)
    out._made["documents"] = c.documents.withColumn("text", F.when(F.col("text").isNotNull(), F.col("doc_id").cast("string")))
    return out


def _with_texts(c: Catalog, rows: DataFrame) -> DataFrame:
    """``rows`` with the text that ``description`` refers to."""
    texts = c.documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("string").alias("description"), "text")
    return rows.join(texts, "description", "left").withColumn("description", F.col("text")).select(*rows.columns)


def _quoted(c: Catalog) -> DataFrame:
    """(next_id, n): a book as candidates quote it, with its people and identifiers."""
    of = lambda d, item, name: d.groupBy(F.col("book_id").alias("id")).agg(F.sort_array(F.collect_list(item)).alias(name))
    people = of(shared_sql(c, f"SELECT l.book_id, {_QUOTED} FROM book_authors l JOIN authors a ON a.id = l.author_id WHERE l.position <= 3"), F.struct("position", "name", "role"), "authors")
    rows = c.books.select("id", "title", "description", "publication_year", "language", "page_count", "publisher_id", "cover_path")
    rows = rows.join(people, "id", "left").join(of(c.identifiers, F.struct("identifier_type", "value"), "identifiers"), "id", "left")
    return rows.select(F.col("id").alias("next_id"), F.struct(*rows.columns).alias("n"))


def _candidates(c: Catalog, of: DataFrame | None = None, own: tuple[str, ...] = _OWN) -> DataFrame:
    """Candidates with nested people and identifiers, and the columns ``own`` of theirs: those of ``of``, rows of ``plan_flags``, or all.

    All of them meet the three books that a book's candidates quote at the
    book, so that only what the view says of a candidate is sent there.
    """
    rows = (c.identification_candidates if of is None else of).select(*own)
    if of is not None:
        met = rows.select("book_id", F.struct(*rows.columns).alias("i"), (F.col("book_id") + F.col("id") % 3).alias("next_id")).join(_quoted(c), "next_id")
    else:
        sides = _quoted(c).select("n", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"), F.col("next_id")).select((F.col("next_id") - F.col("k")).alias("book_id"), "k", "n")
        at = [F.max(F.when(F.col("k") == k, F.col("n"))).alias(f"n{k}") for k in range(3)]
        met = rows.select("book_id", F.struct(*rows.columns).alias("i")).join(sides.groupBy("book_id").agg(*at), "book_id")
        met = met.select("book_id", "i", F.when(F.col("i.id") % 3 == 0, F.col("n0")).when(F.col("i.id") % 3 == 1, F.col("n1")).otherwise(F.col("n2")).alias("n")).where("n is not null")
    ids = f"transform(n.identifiers, k -> named_struct('identifier_type', {_KIND}, 'value', {_VALUE})) AS identifiers"
    # the book's id stays the column that rows met by, so they need not be sent again to meet the book itself
    return c.spark.sql(f"SELECT {', '.join(n if n == 'book_id' else f'i.{n}' for n in own)}, {_QUOTES}, n.authors, {ids}, cast(map() as map<string, string>) AS field_sources FROM {{met}}", met=met)


def _books(c: Catalog) -> DataFrame:
    rows = shared_sql(c, _BOOKS).join(_provenance(c), "id", "left").withColumn("provenance", F.coalesce("provenance", F.expr(f"cast(map() as map<string, {C.ORIGIN}>)")))
    return C.nested_books(rows, shared_sql(c, _BOOK_AUTHORS), shared_sql(c, _BOOK_SERIES), c.identifiers)


def _flags(c: Catalog, *carried: str) -> DataFrame:
    c = _by_reference(c)
    return C.plan_flags(_books(c), _candidates(c, own=("id", "book_id", "score", *carried)), carried)


def _applied(c: Catalog) -> dict[str, tuple[DataFrame | None, DataFrame | None]]:
    """What applying each book's best candidate changes; descriptions are references. All candidates are read once, for their flags."""
    flags, c = _flags(c, "run_id", "status"), _by_reference(c)
    best = C.chosen(R.planned(flags))
    return C.applied(C.with_rows(best.drop("run_id", "status"), _books(c), _candidates(c, best)), _with_changes(flags))


_KEYS = [f"{f}_proposed" for f in _FIELDS] + [f"{f}_{'differs' if f in R.CORE else 'wanted'}" for f in _FIELDS] + [f"{f}_protected" for f in _FIELDS]
_STRIP = "replace(replace(upper({0}), '-', ''), ' ', '')"
_AS13 = "concat('978', substring({0}, 1, 9), CAST((10 - (38 + " + " + ".join(f"CAST(substring({{0}}, {i}, 1) AS INT) * {3 if i % 2 else 1}" for i in range(1, 10)) + ") % 10) % 10 AS VARCHAR))"


@cache
def _inputs_sql() -> str:
    """The flags by joins and EXISTS on the flat rows."""
    scalar = {"subtitle": "subtitle", "description": "description", "publication_year": "publication_year", "language": "language", "page_count": "page_count", "cover": "cover_url"}
    wanted = [f"b.{'cover_path' if f == 'cover' else f} IS NULL AND c.{v} IS NOT NULL AS {f}_wanted, c.{v} IS NOT NULL AS {f}_proposed" for f, v in scalar.items()]
    protected = [f"EXISTS (SELECT 1 FROM edits e WHERE e.book_id = c.book_id AND e.field = '{f}' AND e.protected) AS {f}_protected" for f in _FIELDS if f != "identifiers"]
    writers = "SELECT trim(lower(a.name)) FROM cand_authors a WHERE a.id = c.id AND (a.role IS NULL OR a.role = 'author')"
    x, y = "lower(b.title)", "lower(c.title)"
    proof = f"""EXISTS (SELECT 1 FROM cand_ids k JOIN trusted t ON t.book_id = c.book_id WHERE k.id = c.id AND (
        (k.identifier_type = t.identifier_type AND {_STRIP.format('k.value')} = {_STRIP.format('t.value')}) OR (k.identifier_type = 'isbn10' AND t.identifier_type = 'isbn13' AND t.value = {_AS13.format('k.value')})))"""
    return f"""WITH cand AS ({_CAND}), cand_authors AS ({_CAND_AUTHORS}), cand_ids AS ({_CAND_IDS}), edits AS ({_EDITS}), book_rows AS ({_BOOKS}), writers AS ({_BOOK_AUTHORS}), shelves AS ({_BOOK_SERIES}),
    trusted AS (SELECT book_id, identifier_type, value FROM (SELECT *, count(*) FILTER (WHERE source_type = 'content_scan') OVER (PARTITION BY book_id) AS n FROM identifiers) q WHERE source_type IN ('user', 'embedded') OR (source_type = 'content_scan' AND n = 1))
    SELECT c.id, c.book_id, c.score, b.metadata_locked AS locked, {proof} AS strong_id, c.title IS NOT NULL AS title_proposed, coalesce(NOT contains(trim({x}), trim({y})) AND NOT contains(trim({y}), trim({x})), false) AS title_differs,
      coalesce(b.title <> '' AND c.title <> '' AND NOT regexp_matches({x}, '\\.(epub|pdf|mobi|azw|azw3|fb2|djvu|cbr|cbz|txt)$') AND NOT contains({x}, {y}) AND NOT contains({y}, {x}) AND len(list_intersect({_LONG.format('b.title')}, {_LONG.format('c.title')})) = 0, false) AS contradiction,
      EXISTS (SELECT 1 FROM cand_authors a WHERE a.id = c.id) AS authors_proposed, EXISTS ({writers}) AND EXISTS (SELECT 1 FROM writers w WHERE w.book_id = c.book_id AND trim(lower(w.name)) NOT IN ({writers})) AS authors_differs,
      c.series IS NOT NULL AS series_proposed, c.series IS NOT NULL AND NOT EXISTS (SELECT 1 FROM shelves s WHERE s.book_id = c.book_id AND lower(s.name) = lower(c.series)) AS series_differs,
      EXISTS (SELECT 1 FROM cand_ids k WHERE k.id = c.id) AS identifiers_proposed, false AS identifiers_protected,
      EXISTS (SELECT 1 FROM cand_ids k WHERE k.id = c.id AND NOT EXISTS (SELECT 1 FROM identifiers i WHERE i.book_id = c.book_id AND i.identifier_type = k.identifier_type AND i.value = k.value)) AS identifiers_wanted,
      {", ".join(wanted)}, {", ".join(protected)} FROM cand c JOIN book_rows b ON b.id = c.book_id"""


def _planned_sql() -> str:
    return f"""SELECT *, CASE WHEN {_CONFLICT} OR (locked AND {_CHANGE}) THEN 'disputed' WHEN {_CORE} THEN 'confirmed' WHEN {_MORE} THEN 'enriched' WHEN strong_id AND NOT {_CONFLICT} THEN 'confirmed' ELSE 'enriched' END AS outcome,
      NOT locked AND NOT {_CONFLICT} AND ({_CORE} OR {_MORE} OR (strong_id AND NOT {_CONFLICT})) AS apply, array_to_string({_SAID}, '|') AS disputes
    FROM (SELECT *, {", ".join(f"{q} AS {f}_reason" for f, q in _REASON.items())} FROM ({_inputs_sql()}) i) x"""


add("plan_inputs", lambda c: _flags(c).select("id", "locked", "strong_id", "contradiction", *_KEYS), f"SELECT id, locked, strong_id, contradiction, {', '.join(_KEYS)} FROM ({_inputs_sql()}) z")
add("plan_candidates", lambda c: R.planned(_flags(c)).select("id", "book_id", *[f"{f}_reason" for f in _FIELDS], "outcome", "apply", F.array_join("disputes", "|").alias("disputes")), f"SELECT id, book_id, {', '.join(f'{f}_reason' for f in _FIELDS)}, outcome, apply, disputes FROM ({_planned_sql()}) z")
_CHOSEN = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score DESC NULLS LAST, id) AS nth FROM ({_planned_sql()}) p WHERE apply) q WHERE nth = 1"
_TAKE = ", ".join(f"CASE WHEN p.{f}_reason = 'apply' THEN c.{theirs} ELSE b.{mine} END AS {mine}" for f, (mine, theirs) in C.SCALARS.items())


def _applied_books(c: Catalog) -> DataFrame:
    books = _with_texts(c, _applied(c)["books"][0])
    owner = F.array_join(F.array_sort(F.map_keys(F.map_filter("provenance", lambda k, v: v["candidate_id"].isNotNull()))), "|")
    return books.select("id", *[mine for mine, _ in C.SCALARS.values()], "resolution_outcome", "metadata_status", owner.alias("owned"))


def _with_changes(flags: DataFrame) -> DataFrame:
    none = {"disputes": "array<string>", "changeset": C.CHANGES, "old_status": "string", "old_outcome": "string"}
    rows = flags.select("id", "book_id", "run_id", F.expr(_PROVIDER.format("id")).alias("provider"), F.expr("CASE WHEN id % 23 = 0 THEN 'applied' ELSE status END").alias("status"))
    return rows.withColumns({n: F.lit(None).cast(t) for n, t in none.items()})


_OWNED = "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN p.{f}_reason = 'apply' THEN '{f}' END" for f in (*C.SCALARS, "authors", "series")) + "], lambda x: x IS NOT NULL)), '|')"
add("applied_books", _applied_books, f"SELECT b.id, {_TAKE}, p.outcome AS resolution_outcome, 'identified' AS metadata_status, {_OWNED} AS owned FROM ({_CHOSEN}) p JOIN ({_CAND}) c ON c.id = p.id JOIN ({_BOOKS}) b ON b.id = p.book_id")
add("applied_candidates", lambda c: _applied(c)["candidates"][0].select("id", "status", F.size("changeset").alias("changes")), f"""
    SELECT k.id, CASE WHEN k.id = p.id THEN 'applied' WHEN k.status = 'applied' THEN 'superseded' ELSE 'rejected' END AS status, CASE WHEN k.id = p.id THEN len(list_filter([{", ".join(f"p.{f}_reason = 'apply'" for f in (*C.SCALARS, "authors", "series"))}], lambda x: x)) END AS changes
    FROM (SELECT id, book_id, run_id, CASE WHEN id % 23 = 0 THEN 'applied' ELSE status END AS status FROM ({_CAND}) x) k JOIN ({_CHOSEN}) p ON p.book_id = k.book_id JOIN ({_CAND}) c ON c.id = p.id
    WHERE k.id = p.id OR k.status = 'applied' OR (k.run_id IS NOT DISTINCT FROM c.run_id AND k.status = 'pending')""")
add("applied_identifiers", lambda c: _applied(c)["identifiers"][0].select("book_id", "identifier_type", "value", "provider"), f"""
    SELECT DISTINCT p.book_id, k.identifier_type, k.value, c.provider FROM ({_CHOSEN}) p JOIN ({_CAND}) c ON c.id = p.id JOIN ({_CAND_IDS}) k ON k.id = p.id
    WHERE p.identifiers_reason = 'apply' AND NOT EXISTS (SELECT 1 FROM identifiers i WHERE i.book_id = p.book_id AND i.identifier_type = k.identifier_type AND i.value = k.value)""")


def _model(c: Catalog) -> langid.Languages:
    return langid.fit_languages(c.documents.select("text", "lang"))


#: A model has no SQL; tests hold it against a plain count and measure it on rows it hasn't seen.
add("language_detected", lambda c: langid.detected(c.documents.select("doc_id", "text"), "text", _model(c)).select("doc_id", "detected", "reliable"))


def _says(c: Catalog) -> DataFrame:
    """Candidates with the language of their book, and the one that their description, judged once a book, is in."""
    judged = langid.detected(c.books.select("id", "description"), "description", _model(c)).select("id", "detected", "reliable")
    rows = shared_sql(c, "SELECT i.id, i.score, i.book_id + i.id % 3 AS next_id, b.language, false AS language_mismatch FROM identification_candidates i JOIN books b ON b.id = i.book_id")
    return rows.join(judged.withColumnRenamed("id", "next_id"), "next_id")


add("candidate_language", lambda c: S.language_judged(_says(c)).select("id", "language_mismatch", F.round("score", 6).alias("score")))
