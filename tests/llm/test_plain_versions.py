"""Operators without SQL against plain Python versions of their rules."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelfspark.llm import quality_model, toxicity
from shelfspark.llm.decontaminate import decontaminate
from shelfspark.llm.jaccard_join import near_duplicates
from shelfspark.llm.license_scan import BODIES, STOP, TEMPLATES, THRESHOLD, scan_licenses
from shelfspark.llm.lm_score import stupid_backoff
from shelfspark.llm.quality_rules import quality_rules
from shelfspark.llm.textscan import slices
from tests.llm.test_classifiers import LABELS, corpus
from tests.llm.test_lm_and_license import brute as backoff
from tests.llm.test_quality_rules import brute as rules

LONG = 1 << 19


def grams(text):
    """Buckets of the n-grams of a text, each once."""
    code = [(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) + 1 for c in (text or "").encode()]
    out = set()
    for n in toxicity.SIZES:
        for i in range(len(code) - n + 1):
            g = 0
            for c in code[i : i + n]:
                g = (g * 0x01000193 + c) & 0xFFFFFFFF
            h = ((g ^ (g >> 15) ^ (n * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B) & 0xFFFFFFFF
            out.add(h >> (32 - toxicity.BITS))
    return out


def test_toxicity_model_is_the_minimum_of_the_plain_objective(spark, make_docs):
    docs, labels = corpus(160)
    docs[0] = (0, docs[0][1] + " Größe")
    model = toxicity.fit(make_docs(docs), spark.createDataFrame(labels, LABELS), top=300)
    y = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    sets = {i: grams(t) for i, t in docs}
    n = Counter(y.values())
    df = {v: Counter(b for i, t in y.items() if t == v for b in sets[i]) for v in (0, 1)}

    def z(b):
        p = (df[0][b] + df[1][b] + 1) / (n[0] + n[1] + 2)
        return abs(df[1][b] / n[1] - df[0][b] / n[0]) / math.sqrt(p * (1 - p) * (1 / n[1] + 1 / n[0]))

    best = sorted({*df[0], *df[1]}, key=lambda b: (-z(b), b))[:300]
    chosen = np.flatnonzero(model.feature >= 0)
    assert z(best[-1]) == pytest.approx(min(z(b) for b in chosen)) and len(chosen) == 300
    ratio = {b: math.log((df[1][b] + 1) / (n[1] + 2)) - math.log((df[0][b] + 1) / (n[0] + 2)) for b in chosen}
    w = {b: model.weight[model.feature[b]] for b in chosen}
    margin = {i: model.bias + sum(w[b] for b in sets[i] if b in w) for i in sets}
    gap = {i: 1 / (1 + math.exp(-margin[i])) - y[i] for i in y}
    # the objective is 1-strongly convex in the unscaled weights: half its gradient's square bounds the distance to the minimum
    slope = [sum(gap[i] for i in y)] + [ratio[b] * sum(gap[i] for i in y if b in sets[i]) + (w[b] / ratio[b] if ratio[b] else 0) for b in chosen]
    loss = sum(math.log1p(math.exp(-margin[i] * (2 * y[i] - 1))) for i in y)
    assert sum(g * g for g in slope) / 2 < 1e-3 * (1 + loss)
    for r in toxicity.score_toxicity(make_docs(docs), model).collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(-margin[r.doc_id])))


def plain_features(text):
    text = text or ""
    n_words, word_chars, symbols, dup_lines, repeat, cov, longest, *_ = rules(text)
    raw, words = text.encode(), re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    fold = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    n, lines, size = max(n_words, 1), raw.count(b"\n") + 1.0, max(len(raw), 1)
    rate = lambda kind: math.log1p(100 * sum(kind(c) for c in raw) / size)
    among = lambda chars: lambda c: chr(c) in chars
    distinct = len(set(fold)) / n
    return [
        math.log1p(n_words), math.log1p(word_chars / n), math.log1p(100 * symbols / n), math.log1p(100 * dup_lines / lines),
        repeat / n, cov / n, math.log1p(longest), distinct, distinct * math.log1p(n_words),
        rate(lambda c: 65 <= c <= 90), rate(lambda c: 48 <= c <= 57), rate(among("!?")), rate(among("|")), rate(among(".,;:")), rate(lambda c: c >= 128), math.log1p(n / lines),
        sum(len(w) <= 3 for w in words) / n, sum(len(w) >= 12 for w in words) / n, float(n_words < 10),
    ]


def test_quality_scores_follow_from_plain_features(spark, make_docs):
    docs, labels = corpus(160)
    docs += [(900, None), (901, ""), (902, "Ünï | code! 12 a, b; c:\nabcdefghijklmn\nabcdefghijklmn")]
    x = np.array([plain_features(t) for _, t in docs])
    got = np.concatenate([quality_model.features(s) for s in slices(pa.array([t for _, t in docs], pa.string()))])
    assert got == pytest.approx(x)
    m = quality_model.fit(make_docs(docs), spark.createDataFrame(labels, LABELS))
    y = {i: q for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5 != 0}
    train = np.array([i in y for i, _ in docs])
    assert m.mean == pytest.approx(x[train].mean(axis=0)) and m.scale == pytest.approx(np.maximum(x[train].std(axis=0), 1e-6))
    score = np.clip((x - m.mean) / m.scale, -8, 8) @ m.weight
    poor = sum(1 - q for q in y.values())
    assert (score[train] < m.cut).sum() == poor  # the cut is the quantile at the share of poor documents
    good, bad = (score[[i for i, (d, _) in enumerate(docs) if y.get(d) == v]] for v in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.95  # preferences that the scores respect
    want = {d: 1 / (1 + math.exp(-(s - m.cut) - math.log(0.3 / 0.7))) for (d, _), s in zip(docs, score, strict=True)}
    for r in quality_model.score_quality(make_docs(docs), m).collect():
        assert r.score == pytest.approx(want[r.doc_id]) and r.predicted == int(r.score >= 0.3)


def plain_license(text, whole):
    """(score, name) of the best template of a text by plain TF-IDF vectors, or None."""
    low, found = text.lower(), []
    lines = low.split("\n")
    flat = lambda t: [(k, s) for k, some in sorted(t.items()) for s in ([some] if isinstance(some, str) else some)]

    def compare(units, pairs, stop):
        words = lambda s: Counter(w for w in re.findall("[a-z0-9]+", s.lower()) if w not in stop)
        vectors = [(k, words(s)) for k, s in pairs]
        df = Counter(w for _, c in vectors for w in c)
        idf = lambda w: math.log((1 + len(vectors)) / (1 + df[w])) + 1
        norm = lambda c: math.sqrt(sum((n * idf(w)) ** 2 for w, n in c.items()))
        alike = {}
        for k, c in vectors:
            alike.setdefault(frozenset(w for w in c if not w.isdigit()), set()).add(k)
        for rank, s in units:
            u = words(s)
            for k, c in vectors:
                must = set(c) if len(c) <= 3 else {w for w in c if w.isdigit()} if len(alike[frozenset(w for w in c if not w.isdigit())]) > 1 else set()
                if u and must <= set(u):
                    cos = round(sum(n * u[w] * idf(w) ** 2 for w, n in c.items()) / norm(c) / norm(u), 9)
                    if cos >= THRESHOLD:
                        found.append((rank, -cos, k))

    compare([(2, s) for s in lines], flat(TEMPLATES), ())
    bare = low.lstrip(" ")
    lead = next((i for i, s in enumerate(lines) if not re.match(r"\s*(?:#|//|/\*|\*|--|;|%|<!--)", s)), len(lines))
    header = bare.split("*/")[0] if bare.startswith("/*") else bare.split("-->")[0] if bare.startswith("<!--") else "\n".join(lines[:lead])
    blocks = [s for s in re.split(r"\n(?:[^a-z0-9\n]*\n)+", low) if "\n" in s]
    compare([(0, low)] * whole + [(1, header)] + [(2, s) for s in blocks], flat(TEMPLATES) + flat(BODIES), STOP)
    kept = [(r, s, k) for r, s, k in found if not any(q <= r and j.startswith(k + "-") for q, _, j in found)]
    return min(kept, default=None)


def test_licenses_equal_plain_cosines(spark):
    rng = random.Random(8)
    some = [s for t in (TEMPLATES, BODIES) for v in t.values() for s in ([v] if isinstance(v, str) else v)]
    rows = []
    for i in range(240):
        parts = []
        for _ in range(rng.randint(1, 3)):
            w = rng.choice(some).split()
            w = [x if rng.random() > 0.12 else rng.choice(["alpha", "the", "license", "3", x + " " + x, ""]) for x in w]
            by = rng.choice([6, 12, 500])
            t = "\n".join(rng.choice(["", "# "]) + " ".join(w[a : a + by]) for a in range(0, len(w), by))
            parts.append(rng.choice([t, t.upper(), "/*\n" + t + "\n*/", "some prose of no licence\n" + t]))
        rows.append((i, f"/d{i}/" + rng.choice(["LICENSE", "a.txt"]), rng.choice(["\n\n", "\n"]).join(parts)))
    rows += [(500, "/x/NOTICE", "MIT License\nISC License"), (501, "/y/a.txt", "MIT License\nISC License")]  # ties: the earlier name
    want = {i: plain_license(t, p.endswith(("LICENSE", "NOTICE"))) for i, p, t in rows}
    assert sum(v is not None for v in want.values()) > 100 and any(v is None for v in want.values())
    for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect():
        best = want[r.doc_id]
        assert r.own_license == (best and best[2]), (r, best)
        assert best is None or r.own_score == pytest.approx(-best[1], abs=2e-9)


def test_texts_longer_than_a_slice_and_several_batches(spark, make_docs):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(30_000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    long, item = text(80_000), text(14)
    assert len(long) > LONG
    rows = [(i, text(20)) for i in range(1500)] + [(2000, long + " " + item), (2001, long), (2002, item + " tail"), (2003, None)]
    docs, by = make_docs(rows).coalesce(1), dict(rows)
    hit = {r.doc_id: r for r in decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert (hit[2000].n_words, hit[2000].n_hit, hit[2002].n_hit) == (80_014, 14, 14) and sum(r.contaminated for r in hit.values()) == 2
    links = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert links[2000].n_links == links[2001].n_links == 1 and links[2001].class_id == 2000 and sum(r.n_links for r in links.values()) == 2
    kept = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert kept[2001].n_words == 80_000 and kept[2001].word_chars == 80_000 * 7 and len(kept) == len(rows)
    assert tuple(kept[7])[1:] == rules(by[7])
    few = rows[1470:]
    scores = {r.doc_id: r for r in stupid_backoff(make_docs(few)).collect()}
    for (i, _), (n, s) in zip(few, backoff([t for _, t in few], None), strict=True):
        r = scores[i]
        assert r.n_words == n and r.log_score == pytest.approx(s)
