import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from shelfspark.llm import quality_model, toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400):
    rng = random.Random(11)
    syll = ["ba", "de", "ki", "lo", "mu", "ra", "te", "vo"]
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(30, 300))]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["Zorgful", "zorgish", "blech"]))
        if not good:
            words = [w + "###" for w in words] if i % 2 else words[:8] * (len(words) // 8)
        docs.append((i, " ".join(words)))
        labels.append((i, good, toxic))
    return docs, labels


def test_held_out_accuracy_and_edge_rows(spark, make_docs):
    docs, labels = corpus()
    extra = [(10_000, None), (10_001, ""), (0, docs[0][1]), (None, "a b")]
    df = make_docs(docs + extra).withColumn("score", F.lit("x")).withColumn("y", F.lit(1))
    lab = spark.createDataFrame([*labels, labels[0], (5, None, None), (None, 1, 1)], LABELS)
    for module, score, at, folds, held in ((toxicity, toxicity.score_toxicity, 2, 4, 2), (quality_model, quality_model.score_quality, 1, 5, 0)):
        rows = score(df, module.fit(df, lab)).collect()
        assert len(rows) == len(docs) + len(extra)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
        truth = {x[0]: x[at] for x in labels}
        test = [r for r in rows if r.held_out and r.doc_id in truth]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in rows if r.doc_id is not None)
        assert sum(r.predicted == truth[r.doc_id] for r in test) >= 0.9 * len(test) > 30
        assert len({r.score for r in rows if r.doc_id == 0}) == 1


def test_held_out_labels_do_not_matter(spark, make_docs):
    docs, labels = corpus(200)
    flipped = [(i, q, t if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - t) for i, q, t in labels]
    a, b = (toxicity.fit(make_docs(docs), spark.createDataFrame(x, LABELS)) for x in (labels, flipped))
    assert (a.weight == b.weight).all() and a.bias == b.bias


def test_one_class_and_empty_tables(spark, make_docs):
    docs = make_docs([(i, f"w{i} x") for i in range(10)])
    for labels in ([], [(i, 1, 0) for i in range(10)]):
        lab = spark.createDataFrame(labels, LABELS)
        for module, score in ((toxicity, toxicity.score_toxicity), (quality_model, quality_model.score_quality)):
            model = module.fit(docs, lab)
            assert len({r.score for r in score(docs, model).collect()}) == 1
            assert score(make_docs([]), model).count() == 0


def test_every_label_reaches_the_quality_model(spark, make_docs):
    docs, labels = corpus(21_000)
    docs = [(i, t[:60]) for i, t in docs]
    rows = quality_model.labelled_features(make_docs(docs), spark.createDataFrame(labels, LABELS))
    want = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 != 0]
    assert sorted(r.doc_id for r in rows.select("doc_id").collect()) == want
    drawn = quality_model._drawn(rows.where("y"), rows.where("not y"), rows.where("not y").count(), 2)
    assert drawn.count() == 2 * rows.where("y").count()


def test_cut_equals_that_of_all_scores(spark):
    draw = np.random.default_rng(3)
    for s in (draw.normal(size=30_000), np.round(draw.normal(size=500), 1), np.ones(7), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in s], "s double")
        for poor in (1, len(s) // 3, len(s) - 1):
            cut = float(np.quantile(s, poor / len(s)))
            below, above = s[s < cut - 1e-12], s[s >= cut - 1e-12]
            want = (below.max() + above.min()) / 2 if len(below) else cut
            assert abs(quality_model._cut(df, len(s), poor) - want) < 1e-9
