import corpus_pipeline as cp
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard_join import brute as near
from tests.llm.test_quality_rules import brute as rules


def test_stages_take_effect(spark, make_docs, tmp_path):
    import random

    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    leak, shared, copy = text(14), text(120), text(60)
    rows = [(1, "too short"), (2, "spam egg " * 40), (3, copy), (4, copy), (5, copy + " tail"), (6, text(20) + " " + leak + " " + text(20)), (7, text(30) + " " + shared), (8, text(200) + " " + shared), (9, text(80)), (10, None)]
    make_docs([(*r, "ab"[r[0] % 2]) for r in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "mix_sources":
            assert out.columns == cp.COLUMNS
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    good = {i: t for i, t in rows if rules(t)[-1]}
    assert seen["quality_rules"] == good
    assert sorted(seen["jaccard_join"]) == sorted({c for _, c, _ in near(list(good.items()))})
    assert shared[50:500] not in seen["suffix_dedup"][7] and seen["suffix_dedup"][9] == dict(rows)[9]
    texts = list(seen["decontaminate"].values())
    assert not any(r[4] for r in leaks(texts, [(1, leak)])) and seen["decontaminate"][9] == dict(rows)[9]
    final = {r.doc_id: r for r in cp.run(spark, str(tmp_path)).collect()}
    assert sorted(final) == sorted(seen["decontaminate"]) and all(r.taken <= 2 * r.size for r in final.values())


def test_passages_and_mix_equal_plain_versions(spark, make_docs):
    import random
    import re
    from collections import Counter, defaultdict

    from tests.llm.test_mixing import brute_targets

    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    shared, short = text(70), text(45)  # 419 and 269 bytes: the second has too few words
    rows = [(i, text(40) + " " + rng.choice([shared, short, text(30)]) + " " + text(10), "abc"[i % 3]) for i in range(30)]
    rows += [(30, None, None), (31, "", "a"), (31, rows[3][1], "a")]
    out = cp.passages(spark, make_docs(rows), "")
    assert out.columns == cp.COLUMNS
    raw = [t or "" for _, t, _ in rows]
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    want = Counter()
    for (i, _, _), t in zip(rows, raw, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        words, kept, at = [m.span() for m in re.finditer(r"\S+", t)], [], 0
        for m in re.finditer(b"\1+", gone):
            if sum(m.start() <= a and b <= m.end() for a, b in words) >= 50:
                kept.append(t[at : m.start()])
                at = m.end()
        want[i, "".join([*kept, t[at:]])] += 1
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want
    sizes, largest, taken = Counter(), defaultdict(int), Counter()
    for _, t, s in rows:
        n = len((t or "").split())
        sizes[s], largest[s] = sizes[s] + n, max(largest[s], n)
    for r in cp.mixing(spark, make_docs(rows), "").collect():
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= largest[s] for s, t in brute_targets(sizes).items())


def test_empty_tables_and_null_ids(spark, make_docs, tmp_path):
    words = " ".join(f"w{i}" for i in range(60))
    make_docs([(None, words), (None, words + " more"), (7, words + " end"), (7, words + " end")]).write.parquet(f"{tmp_path}/a/documents.parquet")
    make_docs([]).write.parquet(f"{tmp_path}/b/documents.parquet")
    for name in "ab":
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert [r.doc_id for r in cp.run(spark, f"{tmp_path}/a").collect()] == [None] and cp.run(spark, f"{tmp_path}/b").count() == 0


def test_near_copies_reads_texts_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 5, 9), (2, 5, 8), (3, None, 7)], "doc_id long, class_key long, text_hash long")
    monkeypatch.setattr(cp, "near_duplicates", lambda docs: rows)
    docs = spark.range(1, 4).select(F.col("id").alias("doc_id"), F.raise_error(F.lit("a text was read")).cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    # which rows are kept, and whether some are equal, is settled without texts
    assert cp.near_copies(spark, docs, "").columns == cp.COLUMNS
