"""Steps that must not grow faster than their input."""

import datetime as dt
import random

from shelfspark import catalog_queries as Q
from shelfspark import plan_queries
from shelfspark.operators import edits
from shelfspark.sources.views import Catalog
from shelfspark.streaming import events

SF = "/root/testdata/sf0.001"


def test_own_deletions_of_one_path_are_found_by_spans(spark):
    rng, zero = random.Random(5), dt.datetime(1969, 12, 31, 23, 50)
    times = lambda n: [zero + dt.timedelta(milliseconds=500 * rng.randrange(4000)) for _ in range(n)]
    gone, own = [("a", t) for t in times(300)] + [(None, zero), ("a", None), ("b", zero)], [("a", t) for t in times(25)] + [("b", zero), (None, zero)]
    for kind in ("timestamp", "timestamp_ntz"):
        frame = lambda rows: spark.createDataFrame(rows, f"path string, ts {kind}")  # noqa: E731, B023
        for seconds in (0, 1, 30):
            got = events.foreign_removals(frame(gone), frame(own), seconds)
            near = lambda r: any(r[0] == p and r[1] is not None and r[0] is not None and t <= r[1] < t + dt.timedelta(seconds=seconds) for p, t in own)  # noqa: E731, B023
            assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(r) for r in gone if not near(r))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "at_" in plan and "INTERVAL" not in plan


def test_a_description_is_judged_once_a_book(spark):
    plan = plan_queries._says(Catalog(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    # the texts are judged below the join with candidates, which carries none of them
    assert plan.index("Join") < plan.index("MapInArrow") and "description" not in plan.splitlines()[0]
    assert Q.QUERIES["candidate_language"](spark, SF).count() == Catalog(spark, SF).identification_candidates.join(Catalog(spark, SF).books.selectExpr("id AS b"), plan_queries.F.expr("b = book_id + id % 3")).join(Catalog(spark, SF).books.selectExpr("id AS o"), plan_queries.F.expr("o = book_id")).count()


def test_candidates_meet_their_books_once(spark):
    c = Catalog(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = plan_queries._candidates(plan_queries._by_reference(c), own=("id", "book_id", "score"))
        sent = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        # grouped by book where they lie; what plans do not read of a candidate is not computed
        assert sent(rows) == sent(rows.groupBy("book_id").agg(plan_queries.F.first("title"), plan_queries.F.first("identifiers")))
        assert "l_linestatus" not in rows._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_are_fetched_where_plans_end(spark):
    c = Catalog(spark, SF)
    light = plan_queries._by_reference(c)
    texts = {r.id: r.description for r in c.books.select("id", "description").collect()}
    assert any(texts.values()) and all(r.description == (str(r.id) if texts[r.id] is not None else None) for r in light.books.select("id", "description").collect())
    rows = spark.createDataFrame([(1, "3"), (2, None), (3, "999999999")], "id long, description string")
    assert {r.id: r.description for r in plan_queries._with_texts(c, rows).collect()} == {1: texts[3], 2: None, 3: None}


def test_links_of_equal_books_are_settled_at_the_books(spark):
    rng, col = random.Random(9), plan_queries.F.col
    books = [(i, rng.choice("abc"), rng.choice(["x", "y", None])) for i in range(60)] + [(100, "d", "x")]
    rows = spark.createDataFrame(books, "id long, k string, l string")
    pairs = [(a, b) for a, k, l in books for b, m, n in books if a < b and k == m and l == n and l]
    state = lambda a: ("pending", "merged", "dismissed")[a % 3]
    into = {b: min(a for a, c in pairs if c == b and a % 2 == 0) for b in {b for a, b in pairs if a % 2 == 0}}
    want = {(a, b): "merged" if into.get(b) == a else "dismissed" if state(a) == "pending" and (a in into or b in into) else state(a) for a, b in pairs}
    status = plan_queries.F.expr("CASE book_id_a % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'merged' ELSE 'dismissed' END")
    got = edits.settled_classes(rows, ["k", "l"], col("id") % 2 == 0, status)
    assert {(r.book_id_a, r.book_id_b): r.status for r in got.collect()} == want
    assert sorted(r.id for r in edits.linked_members(rows, ["k", "l"]).collect()) == sorted({i for p in pairs for i in p})
    for name in ("merge_links", "scope_count"):  # pairs are the last join, or none is made
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        lines = plan.splitlines()
        assert not any("p_partkey" in line and "<" in line for line in lines[2:] if "Join" in line)


def test_large_tables_of_candidates_are_dealt_to_more_tasks(spark, monkeypatch):
    from shelfspark.sources import work

    names = ("candidate_tiers", "auto_apply", "top5_candidates", "candidates_by_score", "prune_candidates", "gather_candidates")
    rows = lambda n: sorted(map(tuple, Q.QUERIES[n](spark, SF).collect()), key=repr)
    few = {n: rows(n) for n in names}
    monkeypatch.setattr(work, "PART_BYTES", 10_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in names:
            plan = Q.QUERIES[n](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert "REPARTITION_BY_NUM" in plan, n
            if n not in ("prune_candidates", "gather_candidates"):  # all steps are dealt alike; the rest of these two is dealt again
                assert "hashpartitioning" in plan and ", 4), " not in plan, n
            assert rows(n) == few[n], n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_proposed_values_are_not_computed_again_for_every_character(spark):
    plan = Q.QUERIES["id_proof_isbn"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lpad") < 60


def test_candidates_of_a_book_are_merged_where_they_lie(spark, monkeypatch):
    from shelfspark.sources import work

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for size in (work.PART_BYTES, 10_000):  # as many partitions as the session has, and more
            monkeypatch.setattr(work, "PART_BYTES", size)
            plan = Q.QUERIES["cand_resolve"](spark, SF)._jdf.queryExecution().executedPlan().toString()
            sent = [line for line in plan.splitlines() if "Exchange " in line]
            # lineitem, orders, and once the candidates to their books; no step is stored and sent again
            assert len(sent) == 3 and sum("book_id" in line or "o_custkey" in line for line in sent) == 1, sent
            assert plan.count("FileScan parquet") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
