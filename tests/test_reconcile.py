"""Candidates applied to books and taken back, over one set of tables that change together."""

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import words as W
from shelfspark.operators import reconcile as C
from shelfspark.operators.review import planned
from shelfspark.sources.commits import Change, Table, TableSet

BOOK = f"id long, title string, subtitle string, description string, publication_year int, language string, page_count int, cover_path string, publisher_id string, rating double, metadata_locked boolean, metadata_status string, resolution_outcome string, metadata_quality_score double, provenance map<string, {C.ORIGIN}>"
TABLES = {
    "books": Table(BOOK, ("id",)),
    "book_authors": Table("book_id long, name string, role string, position int", ("book_id", "name", "role"), refers={"book_id": ("books", "id")}),
    "book_series": Table("book_id long, name string", ("book_id", "name"), refers={"book_id": ("books", "id")}),
    "identifiers": Table("book_id long, identifier_type string, value string, source_type string, provider string", ("book_id", "identifier_type", "value")),
    "candidates": Table(f"id long, book_id long, run_id long, provider string, status string, disputes array<string>, changeset {C.CHANGES}, old_status string, old_outcome string", ("id",)),
}
CAND = "id long, book_id long, run_id long, score double, provider string, title string, subtitle string, description string, publication_year int, language string, page_count int, cover_url string, series string, authors array<struct<name:string, role:string>>, identifiers array<struct<identifier_type:string, value:string>>, field_sources map<string,string>"


def book(i, title, **more):
    row = {"id": i, "title": title, "metadata_locked": False, "metadata_status": "unidentified", "provenance": {}} | more
    return tuple(row.get(f.split(" ")[0]) for f in BOOK.replace(f"map<string, {C.ORIGIN}>", "m").split(", "))


def cand(i, book_id, run=1, score=0.5, **more):
    row = {"id": i, "book_id": book_id, "run_id": run, "score": score, "provider": "loc", "field_sources": {}} | more
    return tuple(row.get(n) for n in ("id", "book_id", "run_id", "score", "provider", "title", "subtitle", "description", "publication_year", "language", "page_count", "cover_url", "series", "authors", "identifiers", "field_sources"))


def commit(store, name, changes):
    out = store.commit(name, {t: Change(rows, gone) for t, (rows, gone) in changes.items()})
    assert out.committed, out.violations and out.violations.collect()


@pytest.fixture
def store(spark, tmp_path):
    s = TableSet(spark, str(tmp_path), TABLES)
    rows = lambda n, v: Change(spark.createDataFrame(v, TABLES[n].schema))
    assert s.commit("load", {
        "books": rows("books", [book(1, "Dune", language="fr", provenance={"language": ("user", True, None)}), book(2, "Foundation"), book(3, "Emma", metadata_locked=True)]),
        "book_authors": rows("book_authors", [(1, "Frank Herbert", "author", 1), (2, "Someone Else", "author", 1)]),
        "book_series": rows("book_series", [(2, "Old Shelf")]),
        "identifiers": rows("identifiers", [(1, "isbn13", "9783161484100", "embedded", None), (2, "isbn10", "316148410X", "user", None)]),
        "candidates": rows("candidates", [(i, b, r, "loc", st, None, None, None, None) for i, b, r, st in [(10, 1, 1, "pending"), (11, 1, 1, "pending"), (12, 1, 2, "pending"), (20, 2, 5, "pending"), (21, 2, 4, "applied"), (30, 3, 9, "pending"), (40, 99, 9, "pending")]]),
    }).committed
    return s


def proposals(spark):
    return spark.createDataFrame([
        cand(10, 1, title="DUNE", description="Sand.", language="en", publication_year=1965, authors=[("frank herbert ", None), ("A Translator", "translator")], identifiers=[("isbn10", "3-16-148410-X")], field_sources={"description": "hardcover"}),
        cand(11, 1, score=0.4, description="other"),
        cand(20, 2, run=5, title="Foundation and Empire", series="Foundation", authors=[("Isaac Asimov", "author"), ("Isaac Asimov", None)], identifiers=[("isbn13", "978-3-16-148410-0"), ("lccn", "1")]),
        cand(30, 3, title="Persuasion", description="x"), cand(40, 99, title="no such book"), cand(41, None, title="no book"),
    ], CAND)


def plans(spark, store):
    t = {n: store.read(n) for n in TABLES}
    return planned(C.plan_inputs(C.nested_books(t["books"], t["book_authors"], t["book_series"], t["identifiers"]), proposals(spark)))


def state(store):
    return {n: sorted((r.asDict(True) for r in store.read(n).collect()), key=repr) for n in TABLES}


def test_inputs_and_plan(spark, store):
    got = {r.id: r for r in plans(spark, store).collect()}
    assert set(got) == {10, 11, 20, 30}
    a, b, c = got[10], got[20], got[30]
    assert a.strong_id and not a.title_differs and not a.authors_differs and not a.contradiction and a.language_protected and not a.language_wanted
    assert (a.description_reason, a.language_reason, a.identifiers_reason, a.outcome, a.apply) == ("apply", "existing_value_preferred", "apply", "enriched", True)
    assert b.strong_id and b.authors_reason == b.series_reason == "apply" and b.title_reason == "no_change" and b.outcome == "confirmed"
    assert c.title_reason == "metadata_locked" and c.contradiction and c.outcome == "disputed" and not c.apply
    rows = C.disputed(plans(spark, store), store.read("candidates")).collect()
    assert [(r.id, r.status, len(r.disputes)) for r in rows] == [(30, "pending", 2)]


def test_apply_then_undo_but_for_what_was_edited(spark, store):
    before = state(store)
    commit(store, "apply", C.applied(C.chosen(plans(spark, store)), store.read("candidates")))
    now = state(store)
    one, two, three = now["books"]
    assert one["description"] == "Sand." and one["language"] == "fr" and one["publication_year"] == 1965 and one["metadata_status"] == "identified"
    assert one["provenance"]["description"] == {"origin": "hardcover", "protected": False, "candidate_id": 10} and one["provenance"]["language"]["origin"] == "user"
    assert [(r["name"], r["position"]) for r in now["book_authors"] if r["book_id"] == 2] == [("Isaac Asimov", 1)] and [r["name"] for r in now["book_series"]] == ["Foundation"]
    assert {r["id"]: r["status"] for r in now["candidates"]} == {10: "applied", 11: "rejected", 12: "pending", 20: "applied", 21: "superseded", 30: "pending", 40: "pending"}
    assert {(r["identifier_type"], r["value"]) for r in now["identifiers"] if r["source_type"] == "provider"} == {("isbn10", "3-16-148410-X"), ("isbn13", "978-3-16-148410-0"), ("lccn", "1")}
    assert three == before["books"][2]
    # the user changes the year of the first book, then both candidates are taken back
    user = F.map_concat(F.map_filter("provenance", lambda k, v: k != "publication_year"), F.create_map(F.lit("publication_year"), F.struct(F.lit("user"), F.lit(True), F.lit(None)).cast(C.ORIGIN)))
    commit(store, "edit", {"books": (store.read("books").where("id = 1").withColumns({"publication_year": F.lit(1966), "provenance": user}), None)})
    t = {n: store.read(n) for n in TABLES}
    runs = spark.createDataFrame([(1, "done"), (5, "superseded")], "id long, state string")
    ids = spark.createDataFrame([(10,), (20,), (21,), (30,), (None,)], "id long")
    commit(store, "undo", C.undone(ids, t["books"], t["candidates"], runs, t["identifiers"], t["book_authors"], t["book_series"]))
    after = state(store)
    first = after["books"][0]
    assert first["publication_year"] == 1966 and set(first["provenance"]) == {"language", "publication_year"}
    assert {**first, "publication_year": None, "provenance": before["books"][0]["provenance"]} == before["books"][0] and after["books"][1:] == before["books"][1:]
    assert all(after[n] == before[n] for n in ("book_authors", "book_series", "identifiers"))
    assert {r["id"]: r["status"] for r in after["candidates"]} == {10: "pending", 11: "pending", 12: "pending", 20: "superseded", 21: "superseded", 30: "pending", 40: "pending"}
    assert all(r["changeset"] is None for r in after["candidates"])
    t = {n: store.read(n) for n in TABLES}
    again = C.undone(ids, t["books"], t["candidates"], runs, t["identifiers"], t["book_authors"], t["book_series"])
    assert again["books"][0].count() == again["candidates"][0].count() == 0


def test_bulk_edits_mark_what_they_change(spark, store):
    books, ids = store.read("books"), spark.createDataFrame([(1,), (2,), (77,)], "id long")
    score = F.when(F.col("language").isNull(), 0.1).otherwise(0.9)
    rows = {r.id: r for r in C.bulk_changes(books, ids, score, language="French", rating=3, publisher_id=F.lit("p")).collect()}
    assert set(rows) == {1, 2} and rows[2].language == "fr" and rows[1].rating == 3.0 and rows[2].metadata_quality_score == 0.9
    assert rows[2].provenance["language"].protected and rows[1].provenance["language"].origin == "user" and rows[2].provenance["publisher"].origin == "user"
    assert [r.id for r in C.bulk_changes(books, ids, score, language="fra").collect()] == [2]
    assert {r.id: (r.language, r.metadata_quality_score) for r in C.bulk_changes(books, ids, score, language="").collect()} == {1: (None, 0.1)}
    assert C.bulk_changes(books, ids, score).count() == 0
    with pytest.raises(ValueError):
        C.bulk_changes(books, ids, score, language="klingonish")


def test_languages_of_all_codes(spark):
    given = [("EN-us", "en"), ("zulu", "zu"), ("ger", "de"), ("deu", "de"), ("Yoruba", "yo"), ("aym", "ay"), (" français", "fr"), ("und", None), ("", None), ("xx", None), ("iri", "ga"), ("volapük", "vo"), (None, None)]
    df = spark.createDataFrame(given, "a string, want string").select("want", W.normalize_language(F.col("a")).alias("got"), W.is_language_code(F.col("a")).alias("code"), W.language_label(F.col("want")).alias("label"))
    rows = df.collect()
    assert all(r.got == r.want for r in rows) and {r.label for r in rows} >= {"Zulu", "Yoruba", "Irish"} and [r.code for r in rows].count(True) == 0
    assert len(W._languages()) >= 183 and all(len(c) == 2 for c in W._languages())


def test_flags_carry_no_values(spark, store):
    t = {n: store.read(n) for n in TABLES}
    books = C.nested_books(t["books"], t["book_authors"], t["book_series"], t["identifiers"])
    flags = C.plan_flags(books, proposals(spark))
    assert {kind for n, kind in flags.dtypes if n not in ("id", "book_id", "score")} == {"boolean"}
    best = C.chosen(planned(flags))
    got = {r.id: r for r in C.with_rows(best, books, proposals(spark)).collect()}
    assert set(got) == {10, 20} and got[10].c.description == "Sand." and got[10].b.title == "Dune" and got[10].description_reason == "apply"
