"""Candidates held against their books: inputs of the plan, what applying one changes, and taking that back.

Books and candidates meet once, as rows with nested arrays and maps: authors,
series, identifiers and each field's provenance (origin, protected,
candidate_id). What is applied is written as a changeset at the candidate: of
each field its old value and old provenance.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..sources.work import stored
from .library import latest
from .review import ENRICHMENT, planned, trusted_identifiers

ORIGIN = "struct<origin:string, protected:boolean, candidate_id:long>"
CHANGES = f"array<struct<field:string, old_value:string, old_origin:{ORIGIN}>>"
#: Fields of the book's own row that a candidate can change, with the column of the book and that of the candidate.
SCALARS = {"title": ("title", "title"), "subtitle": ("subtitle", "subtitle"), "description": ("description", "description"), "publication_year": ("publication_year", "publication_year"), "language": ("language", "language"), "page_count": ("page_count", "page_count"), "cover": ("cover_path", "cover_url")}
_STRONG = ("isbn13", "isbn10", "asin")


def _plain(c: Column) -> Column:
    return F.lower(F.trim(c))


def nested_books(books: DataFrame, authors: DataFrame, series: DataFrame, identifiers: DataFrame) -> DataFrame:
    """``books`` with arrays of ``authors(book_id, name, role, position)``, ``series(book_id, name)``, ``identifiers(book_id, identifier_type, value, source_type)`` and of those identifiers that prove a match."""
    of = lambda d, item, name: d.groupBy(F.col("book_id").alias("id")).agg(F.sort_array(F.collect_list(item)).alias(name))
    pair = F.struct("identifier_type", "value")
    sides = (of(authors, F.struct("position", "name", "role"), "authors"), of(series, F.col("name"), "series"), of(identifiers, pair, "identifiers"), of(trusted_identifiers(identifiers), pair, "trusted"))
    out = reduce(lambda a, b: a.join(b, "id", "left"), sides, books)
    return out.withColumns({"authors": F.coalesce("authors", F.array()), "series": F.coalesce("series", F.array()), "identifiers": F.coalesce("identifiers", F.array()), "trusted": F.coalesce("trusted", F.array())})


def _proofs(identifiers: Column) -> Column:
    """Keys of ISBNs and ASINs; an ISBN-10 has that of its ISBN-13 as well."""
    def keys(i: Column) -> Column:
        kind, value = i["identifier_type"], T.normalize_isbn(i["value"])
        return F.array(F.when(kind.isin(*_STRONG), F.concat(kind, F.lit(":"), value)), F.when(kind == "isbn10", F.concat(F.lit("isbn13:"), T.isbn10_to_13(value))))

    return F.filter(F.flatten(F.transform(identifiers, keys)), lambda k: k.isNotNull())


def plan_flags(books: DataFrame, candidates: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """One row for each candidate with a book: ``id``, ``book_id``, ``score``, ``carried`` columns of candidates and the flags that ``planned`` reads.

    Rows stay small however long the values are: of values that are only
    wanted or not, no more than their presence travels; ``with_rows`` fetches
    both sides of the few rows that take effect.

    ``books``: as ``nested_books`` returns them, with ``metadata_locked`` and
    ``provenance``, a map from field to origin. ``candidates(id, book_id, ...)``
    has scalar fields as books have, ``authors`` (name, role), ``identifiers``
    (identifier_type, value), ``series`` (a name) and ``cover_url``.

    An author or a series of the book that the candidate lacks differs, further
    ones of the candidate do not; only people without a role or of the role
    ``author`` count. Titles differ unless one contains the other. A value is
    wanted where the book has none, identifiers where one is new. Null arrays
    are empty; candidates without a book have no row.
    """
    there = lambda n: F.when(F.col(n).isNotNull(), F.lit(True)).alias(n)
    scalars = [SCALARS[f] for f in ENRICHMENT if f in SCALARS]
    b = books.select(F.col("id").alias("book_id"), F.struct("title", "authors", "series", "identifiers", "trusted", "metadata_locked", "provenance", *[there(mine) for mine, _ in scalars]).alias("b"))
    score = [*(["score"] if "score" in candidates.columns else []), *carried]
    rows = candidates.where("book_id is not null").select("id", "book_id", *score, F.struct("title", "authors", "series", "identifiers", *[there(theirs) for _, theirs in scalars]).alias("c")).join(b, "book_id")
    B, C = (lambda f: F.col(f"b.{f}")), (lambda f: F.col(f"c.{f}"))
    some = lambda c: F.coalesce(c, F.array())
    flags: dict[str, Column] = {"locked": B("metadata_locked")}
    flags["strong_id"] = F.arrays_overlap(_proofs(some(C("identifiers"))), _proofs(B("trusted")))
    flags["contradiction"] = C("title").isNotNull() & W.titles_contradict(B("title"), C("title"))
    for f in ("title", "subtitle", "description", "publication_year", "language", "page_count", "authors", "series", "identifiers", "cover"):
        flags[f"{f}_protected"] = F.lit(False) if f == "identifiers" else F.col("b.provenance")[f]["protected"]
    writers = F.transform(F.filter(some(C("authors")), lambda a: a["role"].isNull() | (a["role"] == "author")), lambda a: _plain(a["name"]))
    lacking = F.size(F.array_except(F.transform(B("authors"), lambda a: _plain(a["name"])), writers)) > 0
    a, t = _plain(B("title")), _plain(C("title"))
    flags |= {
        "title_proposed": C("title").isNotNull(), "title_differs": C("title").isNotNull() & ~(a.contains(t) | t.contains(a)),
        "authors_proposed": F.size(some(C("authors"))) > 0, "authors_differs": (F.size(writers) > 0) & lacking,
        "series_proposed": C("series").isNotNull(), "series_differs": C("series").isNotNull() & ~F.array_contains(F.transform(B("series"), _plain), _plain(F.coalesce(C("series"), F.lit("")))),
        "identifiers_proposed": F.size(some(C("identifiers"))) > 0,
        "identifiers_wanted": F.size(F.array_except(F.transform(some(C("identifiers")), lambda i: F.struct(i["identifier_type"].alias("identifier_type"), i["value"].alias("value"))), B("identifiers"))) > 0,
    }
    for f in ENRICHMENT:
        if f != "identifiers":
            mine, theirs = SCALARS[f]
            flags |= {f"{f}_proposed": C(theirs).isNotNull(), f"{f}_wanted": B(mine).isNull() & C(theirs).isNotNull()}
    # written down: plans ask for each flag many times over, and filters on them would repeat what is compared here
    return stored(rows.select("id", "book_id", *score, *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()]), "plan-inputs")


def with_rows(plans: DataFrame, books: DataFrame, candidates: DataFrame) -> DataFrame:
    """``plans(id, book_id, ...)`` with ``b`` and ``c``, the rows of both sides."""
    b = books.select(F.col("id").alias("book_id"), F.struct(*books.columns).alias("b"))
    return plans.join(candidates.select("id", F.struct(*candidates.columns).alias("c")), "id").join(b, "book_id")


def plan_inputs(books: DataFrame, candidates: DataFrame) -> DataFrame:
    """``plan_flags`` with both rows, ``b`` and ``c``, beside the flags."""
    return with_rows(plan_flags(books, candidates), books, candidates)


def chosen(plans: DataFrame) -> DataFrame:
    """Plans that take effect: of each book's the best candidate (score, then the lowest id) that may be applied.

    The choice is written down, as every table that changes is read from it.
    A book's plans are reduced where they lie before any is sent on.
    """
    order = F.struct(F.col("score").isNotNull(), "score", -F.col("id"))
    best = plans.where("apply").groupBy("book_id").agg(F.max_by(F.struct(*plans.columns), order).alias("p")).select("p.*")
    return stored(best, "chosen")


def _takes(f: str) -> Column:
    return F.col(f"{f}_reason") == "apply"


def changeset(b: str = "b") -> Column:
    """Old value (JSON) and old origin of each field that the plan changes."""
    def entry(f: str, value: Column) -> Column:
        old = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
        return F.when(_takes(f), F.struct(F.lit(f).alias("field"), old.alias("old_value"), F.col(f"{b}.provenance")[f].alias("old_origin")))

    fields = [entry(f, F.col(f"{b}.{mine}")) for f, (mine, _) in SCALARS.items()]
    return F.filter(F.array(*fields, entry("authors", F.col(f"{b}.authors")), entry("series", F.col(f"{b}.series"))), lambda e: e.isNotNull()).cast(CHANGES)


def applied(plans: DataFrame, candidates: DataFrame) -> dict[str, tuple[DataFrame | None, DataFrame | None]]:
    """What applying ``plans`` (of ``chosen``) changes: table -> (rows written, keys deleted).

    ``candidates(id, book_id, run_id, provider, status, disputes, changeset)``:
    the applied one gets its changeset, what a book had applied before is
    settled (superseded, no changeset), pending peers of its run are rejected.
    """
    origin = lambda f: F.struct(F.coalesce(F.col("c.field_sources")[f], F.col("c.provider")).alias("origin"), F.lit(False).alias("protected"), F.col("id").alias("candidate_id")).cast(ORIGIN)
    fields = [*SCALARS, "authors", "series"]
    new = F.filter(F.array(*[F.when(_takes(f), F.struct(F.lit(f).alias("key"), origin(f).alias("value"))) for f in fields]), lambda e: e.isNotNull())
    rest = F.map_filter(F.col("b.provenance"), lambda k, v: ~F.array_contains(F.transform(new, lambda e: e["key"]), k))
    value = {mine: F.when(_takes(f), F.col(f"c.{theirs}")).otherwise(F.col(f"b.{mine}")) for f, (mine, theirs) in SCALARS.items()}
    value |= {"resolution_outcome": F.col("outcome"), "metadata_status": F.lit("identified"), "provenance": F.map_concat(F.coalesce(rest, F.create_map().cast(f"map<string, {ORIGIN}>")), F.map_from_entries(new))}
    own = [c for c in plans.select("b.*").columns if c not in ("authors", "series", "identifiers", "trusted")]
    books = plans.select(*[value.get(c, F.col(f"b.{c}")).alias(c) for c in own])
    people = plans.where(_takes("authors"))
    old_people = people.select("book_id", F.explode("b.authors").alias("a")).select("book_id", "a.name", "a.role")
    author = F.posexplode(F.filter("c.authors", lambda a: a["role"].isNull() | (a["role"] == "author"))).alias("position", "a")
    new_people = latest(people.select("book_id", author).select("book_id", "a.name", F.lit("author").alias("role"), (F.col("position") + 1).alias("position")), ["book_id", "name"], "position").drop("rn")
    shelf = plans.where(_takes("series"))
    ids = plans.where(_takes("identifiers")).select("book_id", "b.identifiers", F.col("c.provider"), F.explode("c.identifiers").alias("i"))
    new_ids = ids.where(~F.array_contains("identifiers", F.struct(F.col("i.identifier_type"), F.col("i.value")))).select("book_id", "i.identifier_type", "i.value", F.lit("provider").alias("source_type"), "provider").distinct()
    return {
        "books": (books, None), "book_authors": (new_people, old_people),
        "book_series": (shelf.select("book_id", F.col("c.series").alias("name")), shelf.select("book_id", F.explode("b.series").alias("name"))),
        "identifiers": (new_ids, None), "candidates": (_settled(plans, candidates), None),
    }


def _settled(plans: DataFrame, candidates: DataFrame) -> DataFrame:
    now = plans.select("book_id", F.col("id").alias("now_id"), F.col("c.run_id").alias("now_run"), changeset().alias("now_changes"), F.struct(F.col("b.metadata_status"), F.col("b.resolution_outcome")).alias("before"))
    rows = candidates.join(now, "book_id")
    me, before = F.col("id") == F.col("now_id"), F.col("status") == "applied"
    peer = F.col("run_id").eqNullSafe(F.col("now_run")) & (F.col("status") == "pending")
    status = F.when(me, "applied").when(before, "superseded").when(peer, "rejected").otherwise(F.col("status"))
    out = rows.where(me | before | peer).withColumns({
        "status": status, "changeset": F.when(me, F.col("now_changes")), "old_status": F.when(me, F.col("before.metadata_status")), "old_outcome": F.when(me, F.col("before.resolution_outcome")),
    })
    return out.select(*dict.fromkeys([*candidates.columns, "changeset", "old_status", "old_outcome"]))


def disputed(plans: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose plan is in dispute, with the reasons as ``disputes``; they stay pending."""
    why = plans.where("outcome = 'disputed'").select("id", F.col("disputes").alias("said"))
    return candidates.join(why, "id").withColumn("disputes", F.col("said")).select(*candidates.columns)


def undone(ids: DataFrame, books: DataFrame, candidates: DataFrame, runs: DataFrame, identifiers: DataFrame, authors: DataFrame, series: DataFrame) -> dict[str, tuple[DataFrame | None, DataFrame | None]]:
    """What taking back the applied candidates of ``ids(id)`` changes: table -> (rows written, keys deleted).

    A field is restored while its provenance names the candidate, or names
    none and its origin is the candidate's provider; what was edited since
    stays. Identifiers of the provider go. The candidate is pending again
    (superseded if its run is) and so are its run's rejected ones. Candidates
    that aren't applied or have no changeset, being settled, are passed over.
    """
    mine = candidates.join(ids.select("id").distinct(), "id", "left_semi").where("status = 'applied' and changeset is not null")
    mine = mine.join(runs.select(F.col("id").alias("run_id"), F.col("state").alias("run_state")), "run_id", "left")
    c = mine.select(F.col("book_id").alias("id"), F.struct(F.col("id").alias("id"), "provider", "run_id", "run_state", "old_status", "old_outcome").alias("c"), F.map_from_entries(F.transform("changeset", lambda e: F.struct(e["field"], F.struct(e["old_value"], e["old_origin"])))).alias("was"))
    rows = books.join(c, "id")

    def owned(f: str) -> Column:
        p = F.col("provenance")[f]
        return F.col("was")[f].isNotNull() & F.coalesce(F.when(p["candidate_id"].isNull(), p["origin"] == F.col("c.provider")).otherwise(p["candidate_id"] == F.col("c.id")), F.lit(False))

    fields, types = [*SCALARS, "authors", "series"], dict(books.dtypes)
    back = lambda f, kind: F.from_json(F.col("was")[f]["old_value"], f"v {kind}")["v"]
    marks = rows.withColumns({f"_{f}": owned(f) for f in fields})
    given = F.array(*[F.when(F.col(f"_{f}"), F.lit(f)) for f in fields])
    old = F.filter(F.array(*[F.when(F.col(f"_{f}") & F.col("was")[f]["old_origin"].isNotNull(), F.struct(F.lit(f).alias("key"), F.col("was")[f]["old_origin"].alias("value"))) for f in fields]), lambda e: e.isNotNull())
    value = {m: F.when(F.col(f"_{f}"), back(f, types[m])).otherwise(F.col(m)) for f, (m, _) in SCALARS.items()}
    value |= {"provenance": F.map_concat(F.map_filter("provenance", lambda k, v: ~F.coalesce(F.array_contains(given, k), F.lit(False))), F.map_from_entries(old)), "metadata_status": F.col("c.old_status"), "resolution_outcome": F.col("c.old_outcome")}
    new_books = marks.select(*[value.get(n, F.col(n)).alias(n) for n in books.columns])
    people = marks.where("_authors").select(F.col("id").alias("book_id"), F.explode(back("authors", "array<struct<position:int, name:string, role:string>>")).alias("a"))
    shelf = marks.where("_series").select(F.col("id").alias("book_id"), F.explode(back("series", "array<string>")).alias("name"))
    gone = lambda d, f, *key: d.join(marks.where(f"_{f}").select(F.col("id").alias("book_id")), "book_id", "left_semi").select("book_id", *key)
    added = identifiers.where("source_type = 'provider'").join(mine.select("book_id", "provider"), ["book_id", "provider"], "left_semi")
    ended = F.col("run_state") == "superseded"
    self_ = mine.withColumns({"status": F.when(ended, "superseded").otherwise("pending"), "changeset": F.lit(None).cast(CHANGES), "old_status": F.lit(None).cast("string"), "old_outcome": F.lit(None).cast("string")}).select(*candidates.columns)
    again = mine.where(~F.coalesce(ended, F.lit(False))).select("book_id", F.col("run_id").alias("of_run"), F.col("id").alias("me")).alias("m")
    peers = candidates.where("status = 'rejected'").join(again, "book_id").where(F.col("run_id").eqNullSafe(F.col("of_run")) & (F.col("id") != F.col("me"))).withColumn("status", F.lit("pending")).select(*candidates.columns)
    return {
        "books": (new_books, None), "book_authors": (people.select("book_id", "a.name", "a.role", "a.position"), gone(authors, "authors", "name", "role")),
        "book_series": (shelf, gone(series, "series", "name")), "identifiers": (None, added.select("book_id", "identifier_type", "value")), "candidates": (self_.unionByName(peers), None),
    }


def bulk_changes(books: DataFrame, ids: DataFrame, score: Column, language: str | None = None, rating: float | None = None, publisher_id: Column | None = None, clear_publisher: bool = False) -> DataFrame:
    """Books of ``ids(id)`` that a bulk edit really changes, as rows to write.

    A language is normalised first (empty: none; unknown: ``ValueError``); it
    and the publisher become the user's and protected, a rating has no
    provenance; ``score`` is the quality of the changed row. Fields not given
    stay.
    """
    new: dict[str, Column] = {}
    if language is not None:
        code = W.language_code(language) if language else None
        if language and code is None:
            raise ValueError(f"unrecognised language: {language!r}")
        new["language"] = F.lit(code).cast("string")
    if rating is not None:
        new["rating"] = F.lit(float(rating))
    if publisher_id is not None or clear_publisher:
        new["publisher_id"] = F.lit(None).cast(dict(books.dtypes)["publisher_id"]) if clear_publisher else publisher_id
    if not new:
        return books.limit(0)
    hit = books.join(ids.select("id").distinct(), "id", "left_semi")
    differs = {f: ~F.col(f).eqNullSafe(v) for f, v in new.items()}
    user = F.struct(F.lit("user").alias("origin"), F.lit(True).alias("protected"), F.lit(None).cast("long").alias("candidate_id")).cast(ORIGIN)
    keys = {"language": "language", "publisher_id": "publisher"}
    marks = F.filter(F.array(*[F.when(differs[f], F.struct(F.lit(k).alias("key"), user.alias("value"))) for f, k in keys.items() if f in new] or [F.lit(None).cast(f"struct<key:string, value:{ORIGIN}>")]), lambda e: e.isNotNull())
    have = F.coalesce("provenance", F.create_map().cast(f"map<string, {ORIGIN}>"))
    # the marks are a column of their own: inside a lambda, withColumns would take the new values of its other columns
    kept = F.map_filter(have, lambda k, v: ~F.array_contains(F.transform("marks_", lambda e: e["key"]), k))
    changed = hit.where(reduce(lambda a, b: a | b, differs.values())).withColumn("marks_", marks)
    changed = changed.withColumns({**new, "provenance": F.map_concat(kept, F.map_from_entries("marks_"))})
    return changed.withColumn("metadata_quality_score", score).select(*books.columns)
