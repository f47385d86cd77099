"""Commits of several tables: all or nothing, once, with their rules."""

import pytest

from shelfspark.sources.commits import Change, Conflict, Table, TableSet

TABLES = {
    "books": Table("id long, title string, n int", ("id",)),
    "identifiers": Table("book_id long, kind string, value string", ("book_id", "kind"), unique=(("kind", "value"),), refers={"book_id": ("books", "id")}),
}


@pytest.fixture
def store(spark, tmp_path):
    return TableSet(spark, str(tmp_path), TABLES)


def rows(spark, name, values):
    return spark.createDataFrame(values, TABLES[name].schema)


def seen(store, name, version=None):
    return sorted(tuple(r) for r in store.read(name, version).collect())


def load(spark, store):
    return store.commit("load", {"books": Change(rows(spark, "books", [(1, "a", 1), (2, "b", None)])), "identifiers": Change(rows(spark, "identifiers", [(1, "isbn", "x"), (2, "isbn", None)]))})


def test_replaced_deleted_repeated_and_read_again(spark, store):
    assert seen(store, "books") == [] and load(spark, store).committed
    again = load(spark, store)
    assert not again.committed and again.violations is None and store.version() == 1
    assert store.commit("edit", {"books": Change(rows(spark, "books", [(2, "B", 2), (3, None, 3)]), spark.createDataFrame([(1,), (99,)], "id long")), "identifiers": Change(gone=spark.createDataFrame([(1, "isbn")], "book_id long, kind string"))}).committed
    assert seen(store, "books") == [(2, "B", 2), (3, None, 3)] and seen(store, "identifiers") == [(2, "isbn", None)]
    assert seen(store, "books", 1) == [(1, "a", 1), (2, "b", None)]
    store.compact("books")
    assert seen(store, "books") == [(2, "B", 2), (3, None, 3)] and store.commit("none", {}).committed
    assert store.commit("both", {"books": Change(rows(spark, "books", [(3, "kept", 0)]), spark.createDataFrame([(3,)], "id long"))}).committed
    assert seen(store, "books") == [(2, "B", 2), (3, "kept", 0)]


def test_a_job_that_dies_between_two_tables_changes_none(spark, store, monkeypatch):
    load(spark, store)
    stage = TableSet._stage

    def dies(self, name, change, version):
        if name == "identifiers":
            raise RuntimeError("lost")
        return stage(self, name, change, version)

    change = {"books": Change(rows(spark, "books", [(1, "new", 0)])), "identifiers": Change(rows(spark, "identifiers", [(1, "isbn", "new")]))}
    before = seen(store, "books"), seen(store, "identifiers")
    monkeypatch.setattr(TableSet, "_stage", dies)
    with pytest.raises(RuntimeError):
        store.commit("edit", change)
    assert (seen(store, "books"), seen(store, "identifiers")) == before and store.version() == 1
    monkeypatch.setattr(TableSet, "_stage", stage)
    assert store.commit("edit", change).committed and (1, "new", 0) in seen(store, "books") and (1, "isbn", "new") in seen(store, "identifiers")


def test_the_second_of_two_writers_starts_again(spark, store, monkeypatch):
    load(spark, store)
    other, stage = TableSet(spark, store.root, TABLES), TableSet._stage

    def meanwhile(self, name, change, version):
        if self is store:
            other.commit("theirs", {"books": Change(rows(spark, "books", [(7, "theirs", 7)]))})
        return stage(self, name, change, version)

    monkeypatch.setattr(TableSet, "_stage", meanwhile)
    mine = {"books": Change(rows(spark, "books", [(8, "mine", 8)]))}
    with pytest.raises(Conflict):
        store.commit("mine", mine)
    assert [r[0] for r in seen(store, "books")] == [1, 2, 7]
    assert store.commit("mine", mine).committed and [r[0] for r in seen(store, "books")] == [1, 2, 7, 8]


def test_rows_that_break_a_rule_come_back(spark, store):
    load(spark, store)
    bad = {
        "books": Change(rows(spark, "books", [(None, "no key", 1), (5, "twice", 1), (5, "twice", 1)]), spark.createDataFrame([(2,)], "id long")),
        "identifiers": Change(rows(spark, "identifiers", [(1, "asin", "y"), (5, "isbn", "x"), (77, "isbn", "z")])),
    }
    out = store.commit("bad", bad)
    assert not out.committed and store.version() == 1
    got = {(r.table, r.rule, r.key) for r in out.violations.collect()}
    assert got == {
        ("books", "null key", "{}"), ("books", "repeated key", '{"id":5}'), ("identifiers", "unique kind, value", '{"book_id":5,"kind":"isbn"}'),
        ("identifiers", "book_id refers to books", '{"book_id":77,"kind":"isbn"}'), ("identifiers", "book_id refers to books", '{"book_id":2,"kind":"isbn"}'),
    }
    assert store.commit("bad", {"identifiers": Change(rows(spark, "identifiers", [(2, "isbn", "q")]))}).committed
