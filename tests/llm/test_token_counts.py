from collections import Counter

from pyspark.sql import functions as F

from shelfspark.llm.queries import TOKENIZER, op1_token_counts
from shelfspark.llm.token_counts import Tokenizer, TokenRollup

CHANGES = "doc_id long, change string, source string, lang string, text string"


def test_signed_batches(spark, tmp_path):
    t = Tokenizer(TOKENIZER)
    n = lambda x: len(t.encoder().encode_ordinary(x or ""))
    roll = TokenRollup(spark, str(tmp_path), t)
    batch = lambda rows: spark.createDataFrame(rows, CHANGES).withColumn("tokens", F.lit("clash"))
    assert roll.totals().count() == 0
    first = batch([(1, "insert", "a", "en", "hello big world"), (2, "insert", "a", "en", None), (3, "insert", None, "fr", ""), (4, "insert", "b", None, "é" * 3000), (4, "insert", "b", None, "x"), (None, "insert", "b", None, "y")])
    assert roll.commit("b-1", first) and not roll.commit("b-1", first)
    got = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in roll.totals().collect()}
    assert got() == {("a", "en"): (2, n("hello big world")), (None, "fr"): (1, 0), ("b", None): (3, n("é" * 3000) + 2)}
    assert roll.commit("b-2", batch([(1, "revise", "c", "en", "hello"), (4, "delete", None, None, None), (99, "delete", "a", "en", None), (3, "delete", None, None, None)]))
    assert got() == {("a", "en"): (1, 0), ("c", "en"): (1, 1), ("b", None): (1, 1)}
    assert roll.commit("b-3", batch([])) and roll.commit("b-4", batch([(1, "delete", None, None, None), (1, "delete", None, None, None)]))
    assert got() == {("a", "en"): (1, 0), ("b", None): (1, 1)} and not roll.commit("b-2", first)
    assert roll.commit("b-5", batch([(2, "revise", "a", "en", "big big"), (2, "revise", "d", "en", "world of words"), (2, "revise", "a", "en", None)]))
    assert got() == {("d", "en"): (1, n("world of words")), ("b", None): (1, 1)}


def test_query_equals_one_count_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = op1_token_counts(spark, sf).collect()
    t, want = Tokenizer(TOKENIZER).encoder(), Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want[r.source, r.lang] += len(t.encode_ordinary(r.text or ""))
    assert {(r.source, r.lang): r.n_tokens for r in rows} == dict(want) and sum(r.n_docs for r in rows) == 200
