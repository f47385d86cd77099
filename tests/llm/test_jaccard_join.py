import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import jaccard_join
from shelfspark.llm.jaccard_join import near_duplicates

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, similarity=0.8):
    sets = []
    for _, t in rows:
        w = tuple(WORD.findall((t or "").lower()))
        sets.append({w[i : i + 5] for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= similarity * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def corpus():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    texts = [None, "", "...", "A", "a", "a b", "A, b!", "a b c d e", "b c d e f"]
    for _ in range(40):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        texts.append(" ".join(w))
        for _ in range(rng.choice([0, 0, 1, 3])):
            v = list(w)
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            texts.append(" ".join(v).upper())
    big = [rng.choice(vocab) for _ in range(80)]
    for i in range(60):
        v = list(big)
        v[rng.randrange(80)] = f"x{i}"
        texts.append(" ".join(v))
    rows = list(enumerate(texts))
    return [*rows, (12, texts[12]), (500, texts[12])]


@pytest.mark.parametrize(("bucket", "block", "sent"), [(64, 1000, 600_000), (4, 8, 0)])
def test_matches_brute_force(make_docs, monkeypatch, bucket, block, sent):
    monkeypatch.setattr(jaccard_join, "BROADCAST_CONTENTS", sent)
    rows = corpus()
    got = near_duplicates(make_docs(rows).withColumn("k", F.lit(1)), bucket=bucket, block=block).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)


def test_empty(make_docs):
    assert near_duplicates(make_docs([])).count() == 0
    got = near_duplicates(make_docs([(None, "a b"), (None, None), (7, "c")])).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in got) == [(-1, -1, 0), (-1, -1, 0), (7, 7, 0)]


@pytest.mark.parametrize("depth", [2, 4, 8, 12])
def test_runs_follow_the_depth(monkeypatch, depth):
    batches, numbers = [], []
    monkeypatch.setattr(jaccard_join, "_batch", lambda reps, first, last, *_: (batches.append(last - first + 1) or Edges(), depth))
    monkeypatch.setattr(jaccard_join, "components", lambda edges: edges)
    jaccard_join.candidate_components(None, 0.8, 0.999, numbers.append)
    miss = 1.0
    for n in batches:
        miss *= jaccard_join.missed(0.8, depth, n)
    assert miss <= 0.001 and numbers == list(range(1, len(batches)))
    assert jaccard_join.missed(0.8, 8, 6) > 0.05  # six runs alone, as they were before


class Edges:
    def unionByName(self, other):  # noqa: N802
        return self


def test_min_hashes_of_batches_differ():
    first, g = np.array([0, 3]), np.array([5, 9, 77], dtype=np.uint64)
    assert (jaccard_join.signatures(first, g, 0) != jaccard_join.signatures(first, g, 1)).all()


def test_deep_pairs_are_found(make_docs):
    """Contents that share half their text, so that small buckets need many levels, and pairs near the threshold among them."""
    rng = random.Random(3)
    shared, rows = [f"s{i}" for i in range(90)], []
    for i in range(40):
        own = [f"o{rng.randrange(10**9)}" for _ in range(60)]
        rows += [(2 * i, " ".join(shared + own)), (2 * i + 1, " ".join(shared + own[:45] + [f"p{rng.randrange(10**9)}" for _ in range(12)]))]
    got = near_duplicates(make_docs(rows), bucket=4).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)


def test_steps_go_when_nothing_reads_them(spark, make_docs):
    import os

    from shelfspark.llm.common import shared_dir

    root = f"{shared_dir(spark)}/shelfspark/{spark.sparkContext.applicationId}".removeprefix("file:")
    there = lambda: set(os.listdir(root)) if os.path.isdir(root) else set()
    was = there()
    out = near_duplicates(make_docs([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m")]))
    assert [name.split("-")[0] for name in there() - was] == ["duplicates"] and out.count() == 3
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_contents_that_only_share_a_passage_are_parted(spark):
    rng = random.Random(4)
    shared, sets = [rng.getrandbits(62) for _ in range(9)], {}
    for i in range(300):
        own = [rng.getrandbits(62) for _ in range(rng.randint(4, 60))]
        sets[2 * i] = shared + own
        if i % 10 == 0:
            sets[2 * i + 1] = shared + own + [rng.getrandbits(62)]
    rows = [(k, np.array(sorted(v), dtype=np.uint64).tobytes()) for k, v in sets.items()]
    got = {r.k: (r.root, r["size"]) for r in jaccard_join._parted(spark.createDataFrame(rows, "k long, set binary"), 0.8).collect()}
    alike = lambda a, b: len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))
    linked = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    assert len(linked) >= 30 and all(got[a][0] == got[b][0] for a, b in linked)
    assert max(size for _, size in got.values()) <= 20  # all 330 share the passage


def test_contents_without_a_common_shingle_do_not_meet_by_chance():
    g = np.arange(1, 200_001, dtype=np.uint64)
    sig = jaccard_join.signatures(np.arange(len(g) + 1), jaccard_join.mix(g))
    assert len(np.unique(sig[:, 0])) > 199_900  # 16 bits gave 65,536 at most
