import hashlib
import random
import re

from pyspark.sql import functions as F

from shelfspark.llm.decontaminate import decontaminate, remove_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = "item_id long, text string"


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, width=10):
    wins = {}
    for i, t in items:
        w = words(t)
        if w and i is not None:
            for k in range(max(1, len(w) - width + 1)):
                wins.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = []
    for t in docs:
        w, hit, names = words(t), set(), set()
        for win, its in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    names |= its
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def corpus():
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(12)] + ["Éa", "ÉA", "x9"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([11, 15, 30]))) for i in range(12)] + [(3, text(14)), (40, "W1, w2! x9"), (41, None), (42, "..."), (None, text(12)), (43, "only")]
    docs = [None, "", "W1 w2 x9", "ONLY", "w1-w2 w3"]
    for _ in range(60):
        t = text(rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(w) - 5))
            t += rng.choice([" ", ". ", "\n"]) + ", ".join(w[a : a + rng.randint(3, 20)]).upper().replace("É", "É") + " " + text(4)
        docs.append(t)
    return docs, items


def test_matches_brute_force(spark, make_docs):
    docs, items = corpus()
    bench = spark.createDataFrame(items, ITEM)
    want = brute(docs, items)
    assert any(w[4] for w in want)
    df = make_docs(list(enumerate(docs))).withColumn("hits", F.lit(1)).withColumn("items", F.lit(1))
    for block in (2_000_000, 40):
        got = {r.doc_id: tuple(r)[1:] for r in decontaminate(df, bench, block_words=block).collect()}
        assert [got[i] for i in range(len(docs))] == want


def test_removal_takes_effect(spark, make_docs):
    docs, items = corpus()
    bench = spark.createDataFrame(items, ITEM)
    out = remove_contamination(make_docs(list(enumerate(docs))), bench)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {r.doc_id: r.text for r in out.collect()}
    for i, (t, w) in enumerate(zip(docs, brute(docs, items), strict=True)):
        assert got[i] == t if not w[4] else len(words(got[i])) >= w[0] - w[1] - 1


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], ITEM)
    assert decontaminate(make_docs([]), none).count() == 0
    assert [(r.n_words, r.contaminated) for r in decontaminate(make_docs([(1, "a b"), (1, "a b")]), none).collect()] == [(2, False)] * 2


def test_columns_whose_names_are_used_inside(spark, make_docs):
    item = " ".join(f"w{i}" for i in range(12))
    docs = make_docs([(1, "a " + item + " b"), (2, "clean text"), (3, None)]).withColumns({c: F.lit(7) for c in ("hits", "items", "n_words", "kept0", "spans")})
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in remove_contamination(docs, bench).collect()}
    assert got[1].text == "a  b" and got[2].text == "clean text" and got[3].text is None and got[1].hits == 7 and got[1].kept0 == 7
    assert remove_contamination(docs, bench).columns == docs.columns and remove_contamination(docs, bench.limit(0)).count() == 3
