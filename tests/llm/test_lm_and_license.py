import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm.license_scan import BODIES, scan_licenses, telling_words
from shelfspark.llm.lm_score import _cuts, _packed, _unpacked, stupid_backoff
from shelfspark.llm.textscan import mix


def brute(docs, corpus, alpha=0.4, order=2):
    """Scores under the model of ``corpus``, or for None of all other documents."""
    grams = lambda t: Counter(tuple(w[i : i + n]) for w in [(t or "").split()] for n in range(1, order + 1) for i in range(len(w) - n + 1))
    every = sum((grams(t) for t in (docs if corpus is None else corpus)), Counter())
    out = []
    for t in docs:
        seen = every - grams(t) if corpus is None else every
        size = sum(n for g, n in seen.items() if len(g) == 1) or 1
        w, s = (t or "").split(), 0.0
        for i in range(len(w)):
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if seen[g] or n == 1:
                    s += math.log(seen[g] / seen[g[:-1]] if n > 1 else (seen[g] or 0.5) / size)
                    break
                s += math.log(alpha)
        out.append((len(w), s))
    return out


@pytest.mark.parametrize("order", [2, 4])
def test_backoff_matches_brute_force(spark, make_docs, order):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("abcdefghé") for _ in range(rng.randint(0, 60)))
    corpus, docs = [text() for _ in range(30)] + [None], [text() + " new words" for _ in range(20)] + [None, "", "zz", "a"]
    docs += [docs[3], docs[3]]
    for c in (corpus, [], None):
        known = None if c is None else make_docs(list(enumerate(c)))
        got = stupid_backoff(make_docs(list(enumerate(docs))).withColumn("n", F.lit(0)), known, order=order).collect()
        by = {r.doc_id: (r.n_words, r.log_score) for r in got}
        for i, (n, s) in enumerate(brute(docs, c, order=order)):
            assert by[i][0] == n and by[i][1] == pytest.approx(s)
    assert stupid_backoff(make_docs([]), make_docs([])).count() == 0 == stupid_backoff(make_docs([])).count()


def test_licenses(spark):
    rows = [
        (1, "/a/x/1.txt", "some prose\nLicensed under the Apache License, Version 2.0.\nmore"),
        (2, "/a/LICENSE", "Released under the MIT License."),
        (3, "/a/x/y/3.txt", "nothing here"),
        (4, "/b/4.txt", None),
        (5, None, "This work is licensed under the GNU General Public License, version 3."),
        (6, "/a/x/COPYING", "Licensed under CC BY-NC 4.0."),
        (7, "/a/z/7.txt", "the public source of the work " * 30),
        (7, "/a/z/7.txt", "the public source of the work " * 30),
    ]
    got = sorted((r.doc_id, r.own_license, r.license, r.inherited_from) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("score", F.lit(1))).collect())
    assert got == [
        (1, "apache-2.0", "apache-2.0", None), (2, "mit", "mit", None), (3, None, "cc-by-nc-4.0", "/a/x"), (4, None, None, None),
        (5, "gpl-3.0", "gpl-3.0", None), (6, "cc-by-nc-4.0", "cc-by-nc-4.0", None), (7, None, "mit", "/a"), (7, None, "mit", "/a"),
    ]
    assert scan_licenses(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_packed_counts_and_buckets():
    n = np.array([0, 1, 255, 256, 1 << 40, (1 << 62) + 1], dtype=np.int64)
    assert (_unpacked(_packed(n)) == n).all() and not len(_unpacked(_packed(n[:0])))
    key = np.sort(mix(np.arange(1000, dtype=np.uint64)))
    bucket, cut = _cuts(key, 7)
    assert bucket.tolist() == list(range(7)) and cut[0] == 0 and cut[-1] == len(key) and (np.diff(cut) > 0).all()


def test_telling_words_lose_no_line():
    weights = {"a": 0.1, "of": 0.2, "license": 0.5, "mit": 0.837}
    telling = telling_words(weights, 0.7)
    assert "mit" in telling and sum(x * x for w, x in weights.items() if w not in telling) < 0.49


def test_license_files_and_wrapped_headers(spark):
    wrap = lambda t, by=8: "\n".join(" ".join(t.split()[i : i + by]) for i in range(0, len(t.split()), by))
    body = lambda name: BODIES[name][-1] if isinstance(BODIES[name], tuple) else BODIES[name]
    mit = body("mit").replace("Copyright (c) year, holder. ", "MIT License\n\nCopyright (c) 2024 Ann Lee\n\n")
    gpl3 = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + "Preamble of the terms of a license for software and other kinds of works. " * 200
    comment = lambda t: "\n".join("# " + s for s in wrap(t).split("\n")) + "\n\nimport os\n"
    rows = [
        (1, "/m/LICENSE", mit.split("Permission")[0] + wrap("Permission" + mit.split("Permission", 1)[1])),
        (2, "/m/src/a.txt", "nothing"),
        (3, "/g/COPYING", gpl3),
        (4, "/g/src/b.txt", "nothing"),
        (5, "/h/c.py", comment(BODIES["gpl-3.0"][1])),
        (6, "/h/d.py", comment(BODIES["gpl-2.0"][2])),
        (7, "/h/e.py", comment(BODIES["lgpl-2.1"][2])),
        (8, "/h/f.py", comment(BODIES["agpl-3.0"][2])),
        (9, "/b/LICENSE", wrap(body("bsd-2-clause"))),
        (10, "/c/LICENSE", wrap(body("bsd-3-clause"))),
        (11, "/h/g.c", "/*\n" + wrap(body("isc")) + "\n*/\nint x;"),
        (12, "/h/h.txt", "This work is licensed under the GNU General Public License, version 2."),
        (13, "/h/i.txt", "Licensed under CC BY-SA 4.0."),
        (14, "/h/j.txt", "see the MIT License text"),
        (15, "/h/k.txt", "Mit\nder Software und mit dem Recht"),
        (16, "/h/l.txt", "GNU General Public License"),
        (17, "/h/m.py", comment(BODIES["apache-2.0"][1])),
    ]
    got = {r.doc_id: r.license for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {
        1: "mit", 2: "mit", 3: "gpl-3.0", 4: "gpl-3.0", 5: "gpl-3.0", 6: "gpl-2.0", 7: "lgpl-2.1", 8: "agpl-3.0", 9: "bsd-2-clause", 10: "bsd-3-clause",
        11: "isc", 12: "gpl-2.0", 13: "cc-by-sa-4.0", 14: None, 15: None, 16: "gpl", 17: "apache-2.0",
    }
