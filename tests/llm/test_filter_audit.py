"""The filter audit against filters that are really applied, one order after another; the query has SQL as well."""

from itertools import permutations

import pytest

from shelfspark.llm import filter_audit as fa

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def by_hand(docs, labels):
    space = "\x20\x09\x0a\x0b\x0c\x0d"
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = "".join(" " if c in space else c for c in t).split(" ")
        w = [x for x in w if x]
        fails = {n for n, on in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)), strict=True) if on}
        mine = [x for x in labels if x[0] is not None and x[0] == i]
        rows.append((lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in {r[0] for r in rows}:
        own, made, shapley = [r for r in rows if r[0] == part], [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in own) - len(gone)
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                made.append((part, "".join(order), step, len(left), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out += [(*m[:-1], shapley[m[-1]]) for m in made]
    return sorted(out)


def check(spark, docs, labels):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, lang string, part string, fails int")
    got = fa.audit_documents(d, spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, good string"))
    assert tuple(got.columns) == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == by_hand(docs, labels)


DOCS = [
    (1, None, "en"), (2, "", None), (3, " \t\n", ""), (4, "plain words", "en"), (4, "plain words", "de"), (9, "plain words", "de"), (None, "plain words", "en"), (None, None, None),
    (10, "A B C #", "en"), (11, "word " * 300, "en"), (12, "word " * 300, "fr"), (13, " ".join(f"w{i}" for i in range(250)), "fr"), (14, " ".join(f"W{i}" for i in range(250)) + " 50%", "fr"),
    (15, "é" * 33 + "Z", "de"), (16, "é" * 32 + "Z", "de"), (17, "x y Z" * 70_000, "de"), (18, "\x1cab\x85c " * 220, "en"), (19, "q" * 1_000_000, None),
]
LABELS = [(4, 1, 0), (4, 0, 1), (9, 1, 1), (None, 1, 1), (10, None, 1), (11, 0, None), (13, 1, 0), (999, 1, 1), (19, 1, 0)]


def test_nulls_ties_repeats_and_long_texts(spark):
    check(spark, DOCS, LABELS)


def test_empty_tables(spark):
    check(spark, [], LABELS)
    check(spark, DOCS[:4], [])


@pytest.mark.parametrize("hot", [10, 10_000])
def test_hot_texts_and_small_blocks(spark, monkeypatch, hot):
    monkeypatch.setattr(fa, "HOT_LEAST", hot)
    monkeypatch.setattr(fa, "HOT_SHARE", 1 << 40)
    monkeypatch.setattr(fa, "ROWS", 64)
    monkeypatch.setattr(fa, "HELD_PARTS", 2)
    docs = [(i if i % 9 else None, "the same text" if i % 3 == 0 else f"text {i % 20} #" if i % 2 else f"Text {i}", f"l{i % 7}") for i in range(300)]
    check(spark, docs, [(i, i % 2, i % 3) for i in range(0, 300, 2)])
