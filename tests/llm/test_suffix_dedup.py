import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import suffix_dedup
from shelfspark.llm.suffix_dedup import dedup_text, remove_repeats


def brute(texts, k):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + k] for b in raw for i in range(len(b) - k + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - k + 1):
            if seen[b[i : i + k]] > 1:
                gone[i : i + k] = [True] * k
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(texts, k, words):
    """(runs of repeated strings of k bytes with so many whole words, their bytes) by text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + k] for b in raw for i in range(len(b) - k + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if seen[b[i : i + k]] > 1:
                gone[i : i + k] = b"\1" * k
        runs = [m.span() for m in re.finditer(b"\1+", gone)]
        whole = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        good = [(x, y) for x, y in runs if sum(x <= s and e <= y for s, e in whole) >= words]
        out.append((len(good), sum(y - x for x, y in good)))
    return out


def corpus(k):
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 9)))
    text = lambda n: "".join(word() + " " for _ in range(n))
    shared = [text(rng.randint(k // 5, k)) for _ in range(6)]
    out = ["", None, "a" * (k - 1), "b" * k, "c" * (k + 1), "c" * (3 * k), "ab" * (2 * k), "x", shared[0]]
    for _ in range(40):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            i, j = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            parts += [p[i:j] if rng.random() < 0.7 else p, text(rng.randint(0, 30))]
        out.append("".join(parts))
    return out + [out[20], out[21], out[21][:-3] + "z"]


@pytest.mark.parametrize(("k", "size"), [(40, 32 << 20), (400, 1)])
def test_matches_brute_force(make_docs, monkeypatch, k, size):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", size)
    texts = corpus(k)
    rows = remove_repeats(make_docs(list(enumerate(texts))).withColumn("spans", F.lit(1)), k, k // 2, 5).collect()
    got = {r.doc_id: tuple(r)[1:5] for r in rows}
    want = brute(texts, k)
    counted = {r.doc_id: (r.n_passages, r.n_passage_bytes) for r in rows}
    assert counted == dict(enumerate(passages(texts, k // 2, 5)))
    assert sum(w[1] for w in want) > 0
    for i, t in enumerate(texts):
        assert got[i] == want[i], (i, t)


def test_equal_rows_null_ids_and_empty_table(make_docs):
    assert remove_repeats(make_docs([]), 40).count() == 0
    t = "".join(map(str, range(100)))
    rows = remove_repeats(make_docs([(1, t), (1, t), (None, "é" * 30), (None, None)]), 40).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in rows) == [(-1, 0, 0), (-1, 60, 60), (1, 190, 190), (1, 190, 190)]


def test_text_keeps_whole_characters(make_docs):
    shared = "0123456789" * 4
    docs = make_docs([(1, "é" + shared + "ü!"), (2, "è" + shared + "ö?"), (3, None)])
    got = {r.doc_id: r.text for r in dedup_text(docs, 40).collect()}
    # the first bytes of ü and ö, and the last of é and è, differ or agree as UTF-8 has them
    assert all(shared not in t for t in got.values()) and got[3] == "" and got[1].endswith("!") and got[2].endswith("?")


def test_short_runs_stay_and_column_names_clash(make_docs):
    long, short = " ".join(f"w{i}" for i in range(60)), "x" * 300
    docs = make_docs([(1, "a " + long + " b " + short), (2, "c " + long + " d"), (3, "e " + short), (4, None)])
    docs = docs.withColumns({"did": F.lit("k"), "spans": F.col("doc_id"), "__th": F.lit(1.5), "body": F.lit(None).cast("string")})
    out = dedup_text(docs, 100, min_words=50)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert short in got[1].text and short in got[3].text and "w30" not in got[1].text and "w30" not in got[2].text
    assert got[1].did == "k" and got[2].spans == 2 and got[4].text == ""


def test_several_batches_and_a_text_longer_than_a_slice(spark, make_docs):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared = " ".join(word() for _ in range(80))
    body = " ".join(word() for _ in range(90_000))  # over one slice of 512 KB
    rows = [(0, body + " " + shared + " end"), (1, body[200_000:202_000])] + [(i, " ".join(word() for _ in range(30)) + (" " + shared if i % 700 == 5 else "")) for i in range(2, 2500)]
    docs = make_docs(rows).coalesce(1)
    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    hit = {0, 1} | {i for i in range(2, 2500) if i % 700 == 5}
    assert {i for i, r in got.items() if r.n_removed} == hit == {i for i, r in got.items() if r.n_passages}
    assert got[1].n_removed == 2000 and got[5].n_removed in (len(shared), len(shared) + 1) and got[0].n_spans == 2
