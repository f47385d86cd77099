"""The search language and its edge cases."""

import pytest

from shelfspark.plans.fulltext import compile_match
from shelfspark.plans.search import BookFilter, Field, Or, Phrase, Text, identifier_types, is_isbn, parse, resolve, year_range


@pytest.mark.parametrize(
    ("query", "clauses"),
    [
        ("red ring", [Text("red ring")]),
        ('"red ring"', [Phrase("red ring")]),
        ('author:"Ann Lee" -tag:old', [Field("author", "Ann Lee"), Field("tag", "old", True)]),
        ('-"old gear"', [Phrase("old gear", True)]),
        ('- "old gear"', [Phrase("old gear", True)]),
        ("a OR b OR c", [Or((Text("a"), Text("b"), Text("c")))]),
        ("OR a", [Text("a")]),
        ("a OR", [Text("a")]),
        ("a OR OR b", [Text("a b")]),
        ("--x", [Text("--x")]),
        ("-", []),
        ("foo:bar", [Text("foo:bar")]),
        ("AUTHOR:x", [Text("AUTHOR:x")]),
        ("author:", []),
        ("isbn:9780000000019", [Text("isbn:9780000000019")]),
    ],
)
def test_parse(query, clauses):
    assert parse(query).clauses == clauses


def test_empty_fields_are_recorded():
    assert parse("-tag:").empty_fields == [("tag", True)]


def test_years_identifiers_and_canonical_filters():
    assert year_range("1980..1960") == (1980, 1960) and year_range(">1960") == (1961, None) and year_range("x") is None
    assert identifier_types("isbn") == ("isbn10", "isbn13") and identifier_types("nope") == () and len(identifier_types(None)) == 7
    assert is_isbn("978-3-16-148410-0") == "9783161484100" and is_isbn("9783161484109") is None and is_isbn("080442957X")
    f = BookFilter(year_min=2020, year_max=-5, tags=("b", "a", "b")).canonical()
    assert (f.year_min, f.year_max, f.tags) == (0, 2020, ("a", "b"))


def test_match_precedence():
    (left, right), out = compile_match("a b OR c")
    assert [t.words for t in left.wanted] == [["a"], ["b"]] and right.wanted[0].prefix and not out
    (_, right), out = compile_match("a OR b NOT d", (("title", "c", False),))
    assert right.wanted[1].column == "title" and right.unwanted[0].words == ["d"]
    groups, out = compile_match("NOT a")
    assert not groups and out[0].words == ["a"]


class _Names:
    """A catalog of names for ``resolve``."""

    def __init__(self, spark):
        rows = {"authors": [(1, "Ann Lee"), (2, "Ann Leeson")], "series": [("s", "Old Shelf")], "publishers": [("p", "Press")], "tags": [("t", "new"), ("u", "newer")]}
        for name, values in rows.items():
            setattr(self, name, spark.createDataFrame(values, "id long, name string" if name == "authors" else "id string, name string"))


def test_explicit_values_win_even_if_false_or_nought(spark):
    names = _Names(spark)
    got, warn = resolve("trusted:true year:1990 locked:no", names, BookFilter(trusted=False, year_min=0, locked=None))
    assert (got.trusted, got.year_min, got.year_max, got.locked, warn) == (False, 0, 1990, False, [])
    assert resolve("year:2020..1960", names)[0].year_min == 1960
    got, _ = resolve("author:ann lee", names, BookFilter(author=9))
    assert got.author == 9
    assert resolve('author:"ann lee" red ring', names)[0].author == 1


def test_identifiers_presence_and_warnings(spark):
    names = _Names(spark)
    found = lambda q: resolve(q, names)
    assert found("identifier:isbn:978-0-451-52493-5")[0].identifier == ("isbn", "9780451524935")
    assert found("identifier:9780451524935")[0].identifier == (None, "9780451524935") and found("identifier:a1 identifier:b2")[0].identifier == (None, "a1")
    for bad in ("identifier:mystery:123", "identifier::9", "-identifier:9", "-trusted:true", "trusted:maybe", "-year:1990", "year:x", "format:zip", "-language:en", "has:teeth"):
        got, warn = found(bad)
        assert [w for w, _ in warn] == ["InvalidValue"] and got.matches_nothing, bad
    assert found("-has:desc")[0].has_description is False and found("-missing:ids")[0].has_identifiers is True
    assert [w for w, _ in found("tag:new")[1]] == [] and [w for w, _ in found("tag:ew")[1]] == ["AmbiguousRelation"] and [w for w, _ in found("series:none")[1]] == ["UnknownRelation"]
    got, warn = found('-title:red "old gear" OR ring -sun author:')
    assert got.columns == (("title", "red", True),) and got.text == '"old gear" OR ring NOT sun' and warn == [("EmptyField", "author")]
    assert found("...")[1] == [("NoSearchableTerms", "...")]


def test_a_thousand_lookups_in_one_go(spark):
    import random

    from shelfspark.plans.search import lookup, lookup_many

    dice = random.Random(9)
    word = lambda n: "".join(dice.choice("abAB_%\\é ") for _ in range(n))
    names = [(i, word(dice.randint(0, 9))) for i in range(300)] + [(900, None), (901, "same"), (902, "SAME"), (903, "")]
    asked = list({word(dice.randint(0, 4)) for _ in range(1000)} | {n for _, n in names[:200]} | {"sam", "same", "%", "_", "", "zzz"})
    dim = spark.createDataFrame(names, "id long, name string")
    got = {r.query: (r.ids, r.exact) for r in lookup_many(dim, spark.createDataFrame([(q,) for q in [*asked, None, asked[0]]], "query string")).collect()}
    fold = lambda s: s.translate({c: c + 32 for c in range(65, 91)})

    def plain(q):
        low = fold(q)
        hits, exact = [(n, i) for i, n in names if n is not None and fold(n) == low], True
        if not hits:
            pattern = "(?s).*" + "".join(".*" if c == "%" else "." if c == "_" else __import__("re").escape(c) for c in low) + ".*"
            hits, exact = [(n, i) for i, n in names if n is not None and __import__("re").fullmatch(pattern, fold(n))], False
        return [i for _, i in sorted(hits, key=lambda h: (h[0].encode(), h[1]))[:5]], exact and bool(hits)

    assert set(got) == set(asked) and {q: v for q, v in got.items() if v != plain(q)} == {}
    for q in asked[:6]:
        assert lookup(dim, q) == got[q]
