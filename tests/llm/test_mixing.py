import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import mixing
from shelfspark.llm.mixing import mix_sources


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return {**full, **share}
        for s in over:
            full[s] = 2 * sizes[s]
            left -= full[s]


@pytest.mark.parametrize("leaf", [8])
def test_targets_and_taken(make_docs, leaf):
    rng = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 200]))), rng.choice(["a", "a", "a", "b", "ç", "Z", None])) for i in range(700)]
    rows += [(3, rows[3][1], rows[3][2]), (9000, None, "b"), (9001, "", None)]
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        n = len((t or "").split())
        sizes[s] += n
        largest[s] = max(largest[s], n)
    want = brute_targets(sizes)
    docs = make_docs(rows)
    got = mix_sources(docs, leaf=leaf).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs.repartition(3), leaf=leaf).collect()))


def test_empty_and_blank(make_docs):
    assert mix_sources(make_docs([])).count() == 0
    rows = mix_sources(make_docs([(1, None), (2, " \n")])).collect()
    assert [(r.size, r.taken, r.target) for r in rows] == [(0, 0, 0.0)] * 2


def test_expectation_is_unbiased(make_docs):
    docs = make_docs([(i, "w " * 10, "a" if i % 4 else "b") for i in range(200)])
    mean = defaultdict(float)
    for seed in range(3):
        for r in mix_sources(docs, seed=seed, leaf=16).collect():
            mean[r.source] += r.taken / 3
    t = brute_targets({"a": 1500, "b": 500})
    assert all(abs(mean[s] - t[s]) <= 10 for s in t)


def test_very_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 1000)
    blank = spark.range(1_000_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source"))
    same = spark.range(20_001).select(F.lit(7).cast("long").alias("doc_id"), F.lit("w w").alias("text"), F.lit("a").alias("source"))
    other = spark.range(3000).select("id", F.lit("w w w").alias("text"), F.lit("b").alias("source"))
    got = mix_sources(blank.unionAll(same).unionAll(other))
    by = {r.source: r for r in got.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size")).collect()}
    assert {s: (r.n, r.size) for s, r in by.items()} == {None: (1_000_000, 0), "a": (20_001, 40_002), "b": (3000, 9000)}
    assert all(abs(r.taken - r.target) <= 3 for r in by.values())


def test_numbers_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    counted = spark.createDataFrame([(i, "s", 1, n) for i, n in enumerate((1, 3, 4, 5, 8, 9))], "doc_id long, source string, size long, times long")
    got = sorted((r.doc_id, r.nth) for r in mixing._numbered(counted).collect())
    assert got == [(i, k) for i, n in enumerate((1, 3, 4, 5, 8, 9)) for k in range(1, n + 1)]
