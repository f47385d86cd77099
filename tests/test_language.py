"""Language detection against a plain count, and on rows the model hasn't seen."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import langid as L
from shelfspark.operators.resolution import language_checked

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")


@pytest.fixture(scope="module")
def held():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


@pytest.fixture(scope="module")
def model(docs, held):
    return L.fit_languages(docs.where(~held))


def test_rows_not_seen(docs, held, model):
    rows = L.detected(docs.where(held), "text", model).collect()
    right = [r.lang == r.detected for r in rows]
    assert len(rows) > 200 and sum(right) / len(right) >= 0.97
    sure = [r.lang == r.detected for r in rows if r.reliable]
    assert len(sure) >= 0.9 * len(rows) and sum(sure) / len(sure) >= 0.99


def plain(texts):
    """Counts by (language, size, n-gram) of the same letters."""
    counts = {}
    for lang, t in texts:
        data = t.encode()
        own = counts.setdefault(lang, Counter())
        for n in L.SIZES:
            own.update((n, data[i : i + n]) for i in range(len(data) - n + 1))
    return counts


def test_the_table_is_a_plain_count(spark):
    texts = [("en", " the red ring "), ("en", " the ring "), ("fr", " la bague rouge é "), ("fr", " la bague ")]
    rows = spark.createDataFrame([*texts, (None, "no language"), ("de", None), ("fr", "!!!")], "lang string, text string")
    got, want = L.fit_languages(rows), plain([*texts, ("fr", "  ")])
    assert got.names == ("en", "fr") and got.weights.shape == (2, L.BUCKETS)
    for i, lang in enumerate(got.names):
        buckets = Counter()
        for (_, gram), n in want[lang].items():
            (h,) = [b for b in L._buckets(gram) if len(b) == 1 and True][-1:]
            buckets[int(h[0])] += n
        total = sum(buckets.values()) + 0.5 * L.BUCKETS
        for b in range(0, L.BUCKETS, 97):
            assert math.isclose(got.weights[i, b], math.log((buckets[b] + 0.5) / total), rel_tol=1e-4)


def test_long_texts_in_pieces_count_the_same(monkeypatch):
    data = (" the quick brown fox " * 200).encode()
    whole = Counter(int(x) for b in L._buckets(data) for x in b)
    monkeypatch.setattr(L, "PIECE", 64)
    assert Counter(int(x) for b in L._buckets(data) for x in b) == whole


def test_doubt_is_no_mismatch_and_a_penalty_falls_once(spark, model, docs):
    long = {r.lang: r.text for r in docs.where("length(text) > 2000").dropDuplicates(["lang"]).collect()}
    other = "zażółć gęślą jaźń i coś jeszcze po polsku, nie bardzo długie ale dość długie by nie wątpić"
    rows = [
        (1, 0.5, "en", long["en"], False), (2, 0.5, "en", long["fr"], False), (3, 0.1, "de", long["es"], None), (4, 0.5, None, long["fr"], False), (5, 0.5, "en", None, False),
        (6, 0.5, "en", "", False), (7, 0.5, "en", "1234 5678", False), (8, 0.5, "fr", long["en"], True), (9, 0.5, "en", "la", False), (10, 0.5, "pl", other, False),
    ]
    df = spark.createDataFrame(rows, "id long, score double, language string, description string, language_mismatch boolean")
    once = language_checked(df, model)
    got = {r.id: (round(r.score, 6), r.language_mismatch) for r in once.collect()}
    assert got == {1: (0.5, False), 2: (0.35, True), 3: (0.0, True), 4: (0.5, False), 5: (0.5, False), 6: (0.5, False), 7: (0.5, False), 8: (0.5, True), 9: (0.5, False), 10: (0.5, False)}
    assert {r.id: (round(r.score, 6), r.language_mismatch) for r in language_checked(once, model).collect()} == got
    assert L.detected(df.limit(0), "description", model).count() == 0
    none = L.fit_languages(docs.limit(0))
    assert none.guess(b" a b ") == (None, 0.0, False)
