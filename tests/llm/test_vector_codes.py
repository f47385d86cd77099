"""Vector codes against plain k-means over Python integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np

from shelfspark.llm.queries import op11_vector_codes
from shelfspark.llm.vector_codes import Tree, VectorCodes

ROW = "vec_id long, embedding array<double>, label int, code string"


def by_hand(rows, parts=16, entries=64, rounds=2):
    """{(vec_id, code, error, label_error)}, sorted, and the fingerprint, of kept rows (vec_id, vector, label)."""
    whole = sorted(((i is None, i, v, l) for i, v, l in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0], r[1] or 0, r[2]))
    whole = [(i, [math.floor(x * 256) if abs(x) < 1e18 else int(x) * 256 for x in v], l) for _, i, v, l in whole if len(v) == len(whole[0][2])]
    d = len(whole[0][1]) // parts if whole else 1
    books = [[v[p * d : (p + 1) * d] for _, v, _ in whole[:entries]] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * d : (p + 1) * d], e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            met = defaultdict(list)
            for _, v, _ in whole:
                met[nearest(p, v)[1]].append(v[p * d : (p + 1) * d])
            new.append([[sum(c) // len(met[k]) for c in zip(*met[k], strict=True)] if k in met else e for k, e in enumerate(book)])
        books = new
    out, total = [], defaultdict(int)
    for i, v, label in whole:
        best = [nearest(p, v) for p in range(parts)]
        error = min(sum(b[0] for b in best), 2**63 - 1)
        total[label] += error
        out.append((i, "".join(f"{b[1]:02x}" for b in best), error, label))
    print_ = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, min(total[l], 2**63 - 1)) for i, c, e, l in out), key=repr), print_


def check(spark, rows, schema=ROW, **settings):
    df = spark.createDataFrame([(*r, "x") for r in rows], schema)
    want, digest = by_hand(rows, **settings)
    got = VectorCodes(df, **settings).report().collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == want
    assert {r.codebooks_sha256 for r in got} <= {digest}


def test_ties_repeats_and_bad_rows(spark):
    dice = random.Random(3)
    rows = [(i, [dice.randint(-3, 3) / 256 for _ in range(32)], dice.choice([1, 2, None])) for i in range(200)]  # many equal distances
    rows += rows[:40] + [(None, rows[5][1], 1), (7, rows[9][1], 2)]
    rows += [(-1, None, 1), (-2, [], 1), (-3, [0.0] * 31, 1), (-4, [float("nan")] + [0.0] * 31, 1), (-5, [None] + [0.0] * 31, 1), (-6, [float("-inf")] + [0.0] * 31, 2), (500, [0.0] * 16, 1)]
    check(spark, rows)


def test_sizes_at_the_edges(spark):
    check(spark, [])
    check(spark, [(1, None, None)])
    check(spark, [(1, [-0.001] * 16, None), (2, [0.5] * 16, 3)])
    wide = [(i, [float(i * 10**k) if (i + k) % 2 else -1.5 for k in range(16)], i % 3) for i in range(90)]
    check(spark, wide)
    check(spark, [(i, [(-1.0) ** i * 1.7e308 / (i % 5 + 1)] * 16, 1) for i in range(80)])
    check(spark, [(i, [(i % 7) * 1e15, float(i)] * 2, i) for i in range(50)], parts=2, entries=8, rounds=3)


def test_the_search_equals_a_full_one():
    rng = np.random.default_rng(5)
    for spread in (2, 30, 10_000):
        points, x = rng.integers(-spread, spread, (64, 4)), rng.integers(-spread, spread, (3000, 4))
        away = ((x[:, None] - points[None]) ** 2).sum(2)
        index, best = Tree(points).nearest(x)
        assert (index == away.argmin(1)).all() and (best == away.min(1)).all()
    same = np.zeros((64, 3), dtype=np.int64)
    assert Tree(same).nearest(same)[0].tolist() == [0] * 64


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, digest = by_hand(rows)
    got = op11_vector_codes(spark, sf).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == want and {r.codebooks_sha256 for r in got} == {digest}
