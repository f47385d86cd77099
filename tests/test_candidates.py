import os

from shelfspark import catalog_queries as Q
from shelfspark.operators import resolution as R
from shelfspark.sources.views import oracle

from .oracle import connect, same

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def test_every_candidate_has_a_tier(spark):
    want = oracle("SELECT id FROM identification_candidates")
    same(Q.QUERIES["candidate_tiers"](spark, SF).select("id"), connect(SF), want)


def test_only_runs_without_candidates_lack_them(spark):
    want = oracle("SELECT id AS run_id FROM resolution_runs WHERE id NOT IN (SELECT run_id FROM identification_candidates)")
    same(Q.QUERIES["auto_apply"](spark, SF).where("decision = 'no_candidates'").select("run_id"), connect(SF), want)


def test_run_without_candidates(spark):
    flags = "isbn boolean, asin boolean, title boolean, author boolean, proof boolean, cross_provider boolean, contradiction boolean, language_mismatch boolean"
    row = (7, 5, 0.9, True, False, True, False, True, False, False, False)
    candidates = R.tiered(spark.createDataFrame([row], "id long, run_id long, score double, " + flags))
    got = R.decide(spark.createDataFrame([(5,), (6,)], "id long"), candidates).collect()
    assert sorted((r.run_id, r.best_id, r.decision) for r in got) == [(5, 7, "auto_apply_allowed"), (6, None, "no_candidates")]


def test_tiers_and_decisions_equal_their_sql(spark):
    for name in ("candidate_tiers", "auto_apply"):
        same(Q.QUERIES[name](spark, SF), connect(SF), Q.ORACLES[name])
