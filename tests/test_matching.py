"""Candidate merging on hand-made candidates."""

import pytest

from shelfspark.operators import merging as M

NAMES = [f.split(" ")[0] for f in M.CANDIDATE.split(", ")]


@pytest.fixture
def merge(spark):
    """Candidates of one book, merged, by score and then by number of fields."""

    def run(rows):
        df = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], M.CANDIDATE)
        return sorted((r.asDict() for r in M.merged_candidates(df).collect()), key=lambda r: (-r["score"], -r["field_count"]))

    return run


def cand(ordinal, provider, score, title, authors=(), ids=(), **more):
    return {**dict.fromkeys(NAMES), "book_id": 1, "ordinal": ordinal, "provider": provider, "score": score, "title": title, "authors": list(authors), "identifiers": list(ids), "subjects": [], **more}


def test_duplicate_of_one_provider_fills_the_higher_scored(merge):
    a, b = cand(1, "loc", 0.5, "Red Ring", ids=["lccn:1"], language="en"), cand(2, "loc", 0.7, "Red Ring", ids=["lccn:1", "isbn13:9"], description="d")
    (got,) = merge([a, b])
    assert (got["ordinal"], got["score"], got["language"], got["description"], got["cross_provider"]) == (2, 0.7, "en", "d", False)
    assert got["identifiers"] == ["lccn:1", "isbn13:9"] and got["field_count"] == 2


def test_same_isbn_at_two_providers_becomes_one_with_a_bonus(merge):
    a = cand(1, "open_library", 0.6, "Red Ring", ids=["open_library:OL1", "isbn13:978-1"], cover_url="ol")
    b = cand(2, "hardcover", 0.6, "Red Ring", ids=["hardcover:7", "isbn13:9781", "isbn10:22"], cover_url="hc", publisher="P")
    (got,) = merge([a, b])
    assert got["provider"] == "hardcover" and got["score"] == pytest.approx(0.7) and got["cover_url"] == "hc" and got["merged_from"] == ["open_library"]
    assert got["identifiers"] == ["hardcover:7", "isbn13:9781", "isbn10:22"] and got["cross_provider"]
    c = cand(3, "loc", 0.9, "Red Ring", ids=["isbn13:9781"])
    (got,) = merge([{**a, "identifiers": list(a["identifiers"])}, b, c])
    assert got["provider"] == "loc" and got["cover_url"] == "ol" and got["field_sources"]["publisher"] == "hardcover" and got["score"] == 1.0


def test_like_books_corroborate_each_other_once(merge):
    a, b = cand(1, "loc", 0.5, "The Red Ring", ["Lee, Ann"]), cand(2, "hardcover", 0.4, "Red Ring", ["Ann Lee"])
    other = cand(3, "hardcover", 0.9, "Blue Moon", ["Bob Kay"])
    got = merge([a, b, other])
    assert [(g["ordinal"], round(g["score"], 3), g["cross_provider"]) for g in got] == [(3, 0.9, False), (1, 0.6, True), (2, 0.5, True)]
    assert [g["cross_provider"] for g in merge([cand(1, "x", 0.1, None), cand(2, "y", 0.1, None), cand(3, "z", 0.1, "")])] == [False] * 3


def test_books_are_merged_apart_and_other_media_leave(spark):
    rows = [cand(1, "loc", 0.5, "A", ids=["isbn13:1"]), cand(2, "hardcover", 0.4, "A", ids=["isbn13:1"]), {**cand(1, "loc", 0.3, "A", ids=["isbn13:1"]), "book_id": 2}, {**cand(2, "hardcover", 0.3, "A", ids=["isbn13:1"], physical_format="Audio CD"), "book_id": 2}]
    df = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], M.CANDIDATE)
    got = {(r.book_id, r.ordinal): round(r.score, 3) for r in M.merged_candidates(df).collect()}
    assert got == {(1, 1): 0.6, (2, 1): 0.3}
    assert M.merged_candidates(df.limit(0)).count() == 0


def by_definition(rows):
    """(ordinal, score, cross, merged_from, identifiers, cover) of one book's candidates: ties joined to a fixed point, then ISBNs settled in order, then titles compared."""
    isbns = lambda r: {i.partition(":")[2].replace("-", "") for i in r["identifiers"] if i.startswith("isbn")}
    rank = lambda r: M.COVER_RANK.get(r["provider"], 0)
    sets = [[r] for r in rows]
    tied = lambda s, t: any(a["provider"] == b["provider"] and (isbns(a) & isbns(b) or set(a["identifiers"]) & set(b["identifiers"])) for a in s for b in t)
    while pair := next(((s, t) for s in sets for t in sets if s is not t and tied(s, t)), None):
        sets = [s for s in sets if s is not pair[0] and s is not pair[1]] + [pair[0] + pair[1]]
    left = []
    for s in sets:
        s.sort(key=lambda r: (-r["score"], r["ordinal"]))
        ids = dict.fromkeys(i for r in s for i in r["identifiers"])
        left.append({**s[0], "identifiers": list(ids), "cover_url": next((r["cover_url"] for r in s if r["cover_url"]), None), "cross": False, "from": []})
    free, out = sorted(left, key=lambda r: r["ordinal"]), []
    for isbn in sorted(set().union(*map(isbns, left))):
        firsts = {}
        for r in free:
            if isbn in isbns(r):
                firsts.setdefault(r["provider"], r)
        if len(firsts) > 1:
            lead, *more = sorted(firsts.values(), key=lambda r: (-r["score"], r["provider"], r["ordinal"]))
            seen, ids = isbns(lead), [i for i in lead["identifiers"] if M.NATIVE.get(i.partition(":")[0]) not in {r["provider"] for r in more}]
            for i in (i for r in more for i in r["identifiers"] if i.startswith("isbn")):
                if (key := i.partition(":")[2].replace("-", "")) not in seen:
                    ids.append(i)
                    seen.add(key)
            covers = [r for r in more if r["cover_url"] and rank(r) > rank(lead)][-1:] or [r for r in (lead, *more) if r["cover_url"]]
            out.append({**lead, "identifiers": ids, "cover_url": covers[0]["cover_url"] if covers else None, "score": min(lead["score"] + 0.1, 1.0), "cross": True, "from": [r["provider"] for r in more]})
            free = [r for r in free if r not in (lead, *more)]
    out += free
    like = lambda a, b: a["provider"] != b["provider"] and a["title"] and a["title"] == b["title"] and not isbns(a) & isbns(b)
    hit = [any(like(a, b) for b in out) and not a["cross"] for a in out]
    return sorted((r["ordinal"], round(min(r["score"] + 0.1, 1.0) if h else r["score"], 6), r["cross"] or h, r["from"], r["identifiers"], r["cover_url"]) for r, h in zip(out, hit, strict=True))


def test_many_books_at_once_equal_the_definition(spark):
    import random

    dice, books = random.Random(2), {}
    for b in range(60):
        pool = [f"isbn13:978-{k}" for k in range(3)] + [f"isbn10:{k}" for k in range(2)] + ["isbn13:9781"]
        books[b] = []
        for o in range(1, dice.randint(2, 8)):
            who = dice.choice(["loc", "hardcover", "open_library"])
            own = {"loc": "lccn", "hardcover": "hardcover", "open_library": "open_library"}[who]
            ids = dict.fromkeys([*dice.sample(pool, dice.randint(0, 2)), *dice.sample([f"{own}:{k}" for k in range(4)], dice.randint(0, 1))])
            # no two covers at one score, where ranks of covers would decide as well
            books[b].append({**cand(o, who, dice.randint(1, 900) / 1000, dice.choice(["Red Ring", "Blue Moon Rising", None]), ids=list(ids), cover_url=dice.choice([None, f"u{o}"])), "book_id": b})
    rows = [tuple(r[n] for n in NAMES) for c in books.values() for r in c]
    df = spark.createDataFrame([*rows, rows[0]], M.CANDIDATE)
    got = {}
    for r in M.merged_candidates(df).collect():
        got.setdefault(r.book_id, []).append((r.ordinal, round(r.score, 6), r.cross_provider, r.merged_from, r.identifiers, r.cover_url))
    assert {b: sorted(v) for b, v in got.items()} == {b: by_definition(c) for b, c in books.items()}


def odd_candidates():
    """Candidates of some books, with rows without a book, an ordinal or a provider, equal ordinals, equal rows and null fields."""
    import random

    dice, rows = random.Random(7), []
    for b in [*range(40), None]:
        for o in range(1, dice.randint(2, 12)):
            who = dice.choice(["loc", "hardcover", "open_library", None])
            ids = dice.sample(["isbn13:978-1", "isbn13:9781", "isbn13:9782", "isbn10:3", "isbn10:4", "lccn:1", "lccn:2", "hardcover:7", "asin:B", None], dice.randint(0, 3))
            more = dict(cover_url=dice.choice([None, "", f"u{o}"]), description=dice.choice([None, "", "d"]), page_count=dice.choice([None, o]), subjects=dice.choice([None, [], ["s"]]))
            row = {**cand(dice.choice([o, o, o, 1, None]), who, dice.randint(1, 9) / 10, dice.choice(["Red Ring", "The Red Ring!", "Blue Moon Rising", "", None]), dice.choice([[], ["Ann Lee"], ["Lee, Ann", "Bob Kay"]]), ids, **more), "book_id": b}
            rows += [row] * dice.choice([1, 1, 2])
    return [tuple(r[n] for n in NAMES) for r in rows]


def test_books_in_one_row_and_in_rounds_are_merged_alike(spark, monkeypatch):
    df = spark.createDataFrame(odd_candidates(), M.CANDIDATE)
    rows = lambda: sorted(map(str, M.merged_candidates(df).collect()))
    whole = rows()
    monkeypatch.setattr(M, "ROW_CANDIDATES", 6)  # some of the books
    assert rows() == whole
    monkeypatch.setattr(M, "ROW_CANDIDATES", 0)
    assert rows() == whole and sum("cross_provider=True" in r for r in whole) > 20


def test_rounds_equal_the_definition(spark, monkeypatch):
    monkeypatch.setattr(M, "ROW_CANDIDATES", 0)
    test_many_books_at_once_equal_the_definition(spark)


def test_without_a_book_or_an_ordinal_nothing_merges(spark):
    one = lambda b, o, score, ids=("isbn13:1",): tuple({**cand(o, "loc", score, "A", ids=list(ids)), "book_id": b}[n] for n in NAMES)
    rows = [one(None, 1, 0.1), one(None, 1, 0.2), one(1, None, 0.3), one(1, None, 0.4), one(1, 1, 0.5, ["lccn:1"]), one(1, 1, 0.6, ["lccn:2"])]
    got = M.merged_candidates(spark.createDataFrame([*rows, rows[0]], M.CANDIDATE)).collect()
    assert sorted(r.score for r in got) == [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]
