import random
import re

from shelfspark.llm.quality_rules import MAX_COVERED, MAX_LONGEST, MIN_REPEAT, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)

    def covered(k):
        seen = {}
        for i in range(n - k + 1):
            seen.setdefault(tuple(words[i : i + k]), []).append(i)
        return {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(k)}

    longest, k = 0, MIN_REPEAT
    while covered(k):
        longest, k = k, k + 1
    lines = [x for x in text.split("\n") if WORD.search(x)]
    rep, cov = len(covered(5)), len(covered(MIN_REPEAT))
    failed = n < 10 or 100 * rep > 20 * n
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep, cov, longest,
            failed, not failed and cov <= MAX_COVERED * n and longest <= MAX_LONGEST)


def cases():
    rng = random.Random(3)
    base = [f"w{i}é" for i in range(400)]
    out = ["", None, " \n\t ", "one", "x" * 5000, "a b c d e f g h i j k", "a " * 60, "l m n\nl m n\n\n \nq r\nl m n", "#a *b $c | <d>\x0be\x0cf"]
    for _ in range(30):
        w = [rng.choice(base[: rng.choice([5, 30, 400])]) for _ in range(rng.randint(1, 300))]
        if rng.random() < 0.7:
            k, i = rng.randint(5, 130), rng.randint(0, 50)
            w = w + w[i : i + k] + [rng.choice(base)] + w[i : i + k // 2]
        out.append("".join(x + rng.choice([" ", "  ", "\n", "\t"]) for x in w))
    return out


def test_matches_brute_force(make_docs):
    texts = cases()
    got = {r.doc_id: tuple(r)[1:] for r in quality_rules(make_docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), (i, t)


def test_empty_ties_and_extra_columns(make_docs):
    from pyspark.sql import functions as F

    assert quality_rules(make_docs([])).count() == 0
    rows = quality_rules(make_docs([(1, "a b c"), (1, "a b c"), (None, None)]).withColumn("kept", F.lit(1)).withColumn("n_words", F.lit(2))).collect()
    assert len(rows) == 3 and not any(r.kept for r in rows)
