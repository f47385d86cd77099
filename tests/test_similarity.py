"""The set-similarity join against all pairs, and fuzzy duplicates over books whose titles begin alike."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import dedup as D
from shelfspark.operators import similarity as S


def grams(s):
    return {s} if len(s) < 3 else {s[i : i + 3] for i in range(len(s) - 2)}


def alike(a, b):
    x, y = grams(a), grams(b)
    return 0.0 if not a or not b else len(x & y) / len(x | y)


def words(dice, n):
    return " ".join("".join(dice.choice("abcdeé") for _ in range(dice.randint(1, 5))) for _ in range(n))


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.7, 1.0])
def test_all_pairs_at_the_threshold_are_found(spark, threshold, monkeypatch):
    monkeypatch.setattr(S, "HUB", 3)  # frequent keys are dealt to salts
    dice = random.Random(11)
    left = [words(dice, dice.randint(1, 4)) for _ in range(150)] + ["", "a", "ab", "abababab", "the same"]
    right = [s + dice.choice(["", "s", " x", "bcd"]) for s in left] + ["the same", "ababab", words(dice, 40)]
    frame = lambda v: spark.createDataFrame([(x,) for x in [*v, None, v[0]]], "s string")
    got = {(r.a, r.b): r.likeness for r in S.similar_strings(frame(left), frame(right), threshold).collect()}
    want = {(a, b): alike(a, b) for a in set(left) for b in set(right) if alike(a, b) >= threshold}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert S.similar_strings(frame(left), spark.createDataFrame([], "s string"), threshold).count() == 0


def test_a_beginning_that_half_of_all_share_meets_in_no_task(spark):
    dice = random.Random(5)
    tail = lambda: "".join(dice.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(50))
    titles = ["the complete collected works of " + tail() if i % 2 else tail() for i in range(4000)]
    rows = spark.createDataFrame([(t, True, True) for t in titles], "s string, mine boolean, theirs boolean")
    kept = S.prefixes(rows, 0.7).select(F.explode("prefix").alias("token")).groupBy("token").count()
    # the beginning's trigrams are in 2,000 titles each; what is joined is rarer
    assert kept.agg(F.max("count")).collect()[0][0] < 100
    pairs = S.similar_strings(rows.select("s"), rows.select("s"), 0.95).where("a <> b").count()
    assert pairs < 4000  # it ends, and not with all titles that begin alike


def by_hand(new, known, links):
    out = {}
    for i, x, p in new:
        best = None
        for j, t in known:
            names = [n for b, n in links if b == j]
            ts = alike(x, t)
            if i == j or len(x.encode()) < 3 or ts < 0.7:
                continue
            a = 1.0 if not p and not names else 0.0 if not p or not names else max(alike(p, n) for n in names)
            if a >= 0.6:
                key = (0, -(ts + a), j, ts, a)
            elif ts >= 0.9:
                key = (1, -ts, j, ts, a)
            else:
                continue
            best = key if best is None or key < best else best
        if best:
            out[i] = (best[2], round(best[3], 9), round(best[4], 9))
    return out


def test_best_duplicates_equal_nested_loops(spark):
    dice = random.Random(3)
    stems = ["x" + words(dice, 3) for _ in range(40)]  # no leading article, which would be dropped
    people = [words(dice, 2) for _ in range(12)] + ["ann lee", "ann leed"]
    known = [(j, dice.choice(stems) + dice.choice(["", "", "s", " two"])) for j in range(300)] + [(900, ""), (901, "ab")]
    links = [(j, dice.choice(people)) for j, _ in known for _ in range(dice.randint(0, 2))]
    new = [(i, dice.choice(stems) + dice.choice(["", "s", " again"]), dice.choice([*people, ""])) for i in range(200, 400)] + [(500, "ab", ""), (501, "", "ann lee")]
    frame = lambda v, ddl: spark.createDataFrame(v, ddl)
    found = D.fuzzy_duplicates(frame([(i, x, p or None) for i, x, p in new], "id long, title string, author string"), frame(known, "id long, title string"), frame(links, "book_id long, name string"))
    assert {r.id: (r.existing_id, round(r.title_similarity, 9), round(r.author_similarity, 9)) for r in found.collect()} == by_hand(new, known, links)


def test_names_are_compared_only_where_no_equal_one_settles_it(spark, monkeypatch):
    asked, real = [], D.similar_strings
    monkeypatch.setattr(D, "similar_strings", lambda a, b, t: asked.append(a.columns[0] + str(a.distinct().count())) or real(a, b, t))
    people = [f"writer {i:05d}" for i in range(40)] + ["aaaa", "aaaaa"]
    known = [(2 * j, ("deep red ring", "deep red ringlet")[j % 2]) for j in range(84)]
    links = [(2 * j, people[j // 2]) for j in range(84)]
    new = [(2 * j + 1, "deep red ring", p) for j, p in enumerate(people)] + [(4, "deep red ring", people[1]), (91, "deep red ringle", people[3]), (93, "deep red ring", "writer 0000"), (95, "unlike any", "nobody")]
    found = D.fuzzy_duplicates(spark.createDataFrame(new, "id long, title string, author string"), spark.createDataFrame(known, "id long, title string"), spark.createDataFrame(links, "book_id long, name string"))
    assert {r.id: (r.existing_id, round(r.title_similarity, 9), round(r.author_similarity, 9)) for r in found.collect()} == by_hand(new, known, links)
    # only the name whose one book of the title is the incoming one itself; "writer 0000" has the trigrams of "writer 00000"
    assert asked == ["x3", "p1"]


def test_less_alike_names_are_looked_for_only_where_no_closer_one_settles_it(spark, monkeypatch):
    asked, real = [], D.similar_strings
    monkeypatch.setattr(D, "similar_strings", lambda a, b, t: asked.append((a.columns[0], a.distinct().count(), t)) or real(a, b, t))
    people = [f"supplier {i:09d}" for i in range(10_000, 10_200)]
    known = [(2 * j, ("deep red ring", "deep red ringlet")[j % 2]) for j in range(100)]
    links = [(2 * j, p) for j in range(100) for p in (people[2 * j], people[(14 * j + 2) % 200])]
    # odd names have no book; the last one's like is only by far
    new = [(2 * j + 1, "deep red ring" + ("", "s")[j % 2], people[2 * j + 1]) for j in range(100)] + [(901, "deep red ring", "supplier 000023456")]
    found = D.fuzzy_duplicates(spark.createDataFrame(new, "id long, title string, author string"), spark.createDataFrame(known, "id long, title string"), spark.createDataFrame(links, "book_id long, name string"))
    assert {r.id: (r.existing_id, round(r.title_similarity, 9), round(r.author_similarity, 9)) for r in found.collect()} == by_hand(new, known, links)
    names = [a for a in asked if a[0] == "p"]
    assert [t for _, _, t in names] == [D.NEAR_NAMES, D.AUTHOR_MATCH] and names[0][1] >= 100 and names[1][1] < 10
