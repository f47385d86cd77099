"""Full-text search against SQLite's own index."""

import sqlite3

import pytest

from shelfspark.plans import fulltext

ROWS = [(1, "a b", ""), (2, "a", "c x"), (3, "b", ""), (4, "c", ""), (5, "a", "b"), (6, "C++ café", "x-ray of the Ωμέγα"), (7, "", None), (8, "a b a b c", "a c b")]


@pytest.fixture(scope="module")
def engines(spark):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(title, description, tokenize=\"unicode61 remove_diacritics 2 tokenchars '+#'\")")
    except sqlite3.OperationalError:
        pytest.skip("SQLite without FTS5")
    con.executemany("INSERT INTO f(rowid, title, description) VALUES (?, ?, ?)", ROWS)
    return con, fulltext.index(spark.createDataFrame(ROWS, "id long, title string, description string"))


@pytest.mark.parametrize(
    ("query", "columns", "match"),
    [
        ("a b OR c", (), "a b OR c*"), ("a OR b NOT c", (), "a OR b NOT c"), ("a b NOT c", (), "a b NOT c"), ("a OR b", (("title", "c", False),), "a OR b AND title : c*"),
        ('"c++"*', (), '"c++"*'), ("cafe", (), "cafe*"), ('"x-ray"', (), '"x-ray"'), ('"a b"', (), '"a b"'), ("OR a OR OR", (), "a*"), ('"b a b"', (), '"b a b"'), ("ωμέγα", (), "ωμέγα*"),
    ],
)
def test_matches_and_ranks(engines, query, columns, match):
    con, index = engines
    want = {r[0]: r[1] for r in con.execute("SELECT rowid, bm25(f, 10.0, 1.0) FROM f WHERE f MATCH ?", (match,))}
    got = {r.id: r["rank"] for r in fulltext.search(index, query, columns).collect()}
    assert set(got) == set(want) and len(want) > 0
    if " NOT " not in query and not columns:
        assert got == pytest.approx(want)


def test_negation_alone_and_a_changed_document(spark, engines):
    _, index = engines
    assert {r.id for r in fulltext.search(index, "NOT a").collect()} == {3, 4, 6, 7}
    changed = spark.createDataFrame([(3,), (4,)], "id long")
    new = index.refreshed(changed, spark.createDataFrame([(3, "new words", None), (9, "unseen", None)], "id long, title string, description string"))
    assert {r.id for r in fulltext.search(new, "new").collect()} == {3} and not fulltext.search(new, "unseen").collect()
    assert {r.id for r in fulltext.search(new, '"c"').collect()} == {2, 8} and new.lengths.count() == 7


def grown(spark, root):
    """An index of three generations: all rows but with old texts, two changed, one gone and one new."""
    from shelfspark.plans.segments import SegmentIndex

    schema = "id long, title string, description string"
    idx = SegmentIndex(spark, root)
    old = [(i, "old words here", "c") if i in (2, 5) else (i, t, d) for i, t, d in ROWS if i != 8] + [(77, "goes", None)]
    assert idx.refresh("load", spark.createDataFrame(old, schema)) and not idx.refresh("load", spark.createDataFrame(old, schema))
    assert idx.refresh("edit", spark.createDataFrame([r for r in ROWS if r[0] in (2, 5)], schema))
    assert idx.refresh("more", spark.createDataFrame([r for r in ROWS if r[0] == 8], schema), spark.createDataFrame([(8,), (77,), (99,)], "id long"))
    return idx


def test_generations_equal_a_fresh_index(spark, engines, tmp_path):
    _, fresh = engines
    idx = grown(spark, str(tmp_path))
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    for _ in range(2):  # before and after compaction
        got = idx.index()
        assert rows(got.postings.select("id", "col", "place", "term")) == rows(fresh.postings.select("id", "col", "place", "term")) and rows(got.lengths) == rows(fresh.lengths)
        for query in ("a b OR c", '"a b"', "caf", "NOT a", "old", "goes", ""):
            a, b = ({r.id: round(r["rank"], 9) for r in q.collect()} for q in (idx.search(query), fulltext.search(fresh, query)))
            assert a == b, query
        idx.compact()
    assert len(idx.segments()) == 1


def test_a_refresh_writes_in_proportion_and_a_prefix_opens_its_files(spark, tmp_path, monkeypatch):
    from shelfspark.plans import segments

    monkeypatch.setattr(segments, "FILE_ROWS", 500)
    idx = segments.SegmentIndex(spark, str(tmp_path))
    docs = spark.range(2000).selectExpr("id", "concat(substring(md5(cast(id as string)), 1, 8), ' ', substring(md5(cast(-id as string)), 1, 8)) AS title", "cast(null as string) AS description")
    idx.refresh("load", docs)
    idx.refresh("edit", docs.where("id < 20"))
    size = lambda s: spark.read.parquet(f"{s['folder']}/postings").count()
    assert [size(s) for s in idx.segments()] == [4000, 40]
    every, some = idx.files(), idx.files([fulltext.Term(["ab"], prefix=True)])
    assert len(every) >= 8 and 1 <= len([f for f, g in some if g == 1]) <= 2
    opened = {f.replace("file:///", "file:/") for f in idx.index([fulltext.Term(["ab"], prefix=True)]).postings.inputFiles() if "/postings/" in f}
    assert opened == {f.replace("file:///", "file:/") for f, _ in some}
    want = docs.where("title like 'ab%' or title like '% ab%'").count()
    assert idx.search("ab").count() == want


def test_an_index_follows_its_files(spark, tmp_path):
    from shelfspark.sources.work import files_version

    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    before = files_version(spark, str(tmp_path))
    assert files_version(spark, str(tmp_path)) == before
    spark.range(4).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert files_version(spark, str(tmp_path)) != before


def test_tokens_are_made_once_a_step_and_large_tables_are_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    from shelfspark.plans import segments
    from shelfspark.sources import work
    from shelfspark.sources.views import Catalog

    made, parts, real = [], [], fulltext.stored

    def watched(df, name):
        made.append("lower(" in df._jdf.queryExecution().optimizedPlan().toString())
        parts.append(int(spark.conf.get("spark.sql.shuffle.partitions")))
        return real(df, name)

    for m in (fulltext, segments):
        monkeypatch.setattr(m, "stored", watched)
    monkeypatch.setattr(work, "PART_BYTES", 10_000)
    monkeypatch.setattr(fulltext, "_indexes", {})
    cat = Catalog(spark, "/root/testdata/sf0.001")
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    want, got = fulltext.index(fulltext.documents(cat)), fulltext.index_of(cat)
    assert made.count(True) == 1 and min(parts) > 4
    assert rows(got.lengths) == rows(want.lengths) and rows(got.postings) == rows(want.postings.select(got.postings.columns))
    made.clear()
    idx = segments.SegmentIndex(spark, str(tmp_path))
    idx.refresh("load", fulltext.documents(cat))
    assert made == [True] and rows(idx.index().lengths) == rows(want.lengths) and int(spark.conf.get("spark.sql.shuffle.partitions")) == 4
    odd = spark.createDataFrame([("plain ASCII C++ ~",), ("Ünïcode Straße ÀÉ",), ("éa x",), (None,)], "s string")
    assert [r[0] for r in odd.select(fulltext.tokens(fulltext.F.col("s"))).collect()] == [["plain", "ascii", "c++"], ["unicode", "straße", "ae"], ["ea", "x"], []]
