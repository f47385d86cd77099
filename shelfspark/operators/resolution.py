"""Match tiers and the auto-apply decision over scored candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.langid import Languages, detected, language_mismatch

# Factor of each tier, the score that may apply by itself, the gap to the next one.
TIER_FACTORS = {"strong": 1.0, "probable": 0.85, "weak": 0.65}
THRESHOLD, GAP = 0.85, 0.15


def tiered(candidates: DataFrame) -> DataFrame:
    """``tier`` and the adjusted ``score`` from the signals isbn, asin, title, author, proof, cross_provider (booleans)."""
    known, content = F.col("isbn") | F.col("asin"), F.col("title") | F.col("author")
    tier = F.when(known & content & F.col("proof"), "strong").when(known | (content & F.col("cross_provider")), "probable").otherwise("weak")
    factor = F.when(F.col("tier") == "strong", TIER_FACTORS["strong"]).when(F.col("tier") == "probable", TIER_FACTORS["probable"]).otherwise(TIER_FACTORS["weak"])
    return candidates.withColumn("tier", tier).withColumn("score", F.least(F.greatest(F.col("score") * factor, F.lit(0.0)), F.lit(1.0)))


def decide(runs: DataFrame, candidates: DataFrame, threshold: float = THRESHOLD, gap: float = GAP) -> DataFrame:
    """(run_id, best_id, decision) of every run; ties go to the lowest candidate id.

    Only the two best rows of a run and a count are needed, so one sort of a
    run's candidates serves all; runs without candidates come from the join.
    """
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("score").desc(), "id"))
    best = F.struct("id", "score", "tier", (F.col("isbn") | F.col("asin")).alias("known"), "contradiction", "language_mismatch")
    top = candidates.withColumn("place", place).groupBy("run_id").agg(
        F.max(F.when(F.col("place") == 1, best)).alias("best"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"), F.count_if(F.col("score") >= threshold).alias("above"),
    )
    b = F.col("best")
    decision = (
        F.when(b.isNull(), "no_candidates")
        .when((b.tier != "strong") & b.known, "blocked_no_trusted_id").when((b.tier != "strong") & b.contradiction, "blocked_contradiction").when(b.tier != "strong", "blocked_low_tier")
        .when(b.language_mismatch, "blocked_contradiction").when(b.score < threshold, "blocked_low_tier")
        .when((F.col("above") > 1) | (b.score - F.col("second") < gap), "blocked_ambiguous").otherwise("auto_apply_allowed")
    )
    return runs.select(F.col("id").alias("run_id")).join(top, "run_id", "left").select("run_id", b.id.alias("best_id"), decision.alias("decision"))


# What an equal identifier adds, the most that likeness and completeness add, what a contradiction or another language takes.
ID_BONUS, TITLE_MOST, AUTHOR_MOST, PUBLISHER_MOST, COMPLETE_MOST, UNLIKE_BELOW, PENALTY = 0.2, 0.1, 0.05, 0.05, 0.05, 0.3, 0.15


def scored(candidates: DataFrame, fields: int = 10) -> DataFrame:
    """``score`` and the signals of candidates.

    Reads confidence, same_isbn, same_asin, title_sim, author_sim,
    publisher_sim (null: one side lacks it), filled (of ``fields``) and
    other_language. A null flag is false, a null likeness adds nothing.
    """
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    part = lambda c, most: F.coalesce(F.col(c) * most, F.lit(0.0))
    unlike = F.coalesce(F.col("title_sim") < UNLIKE_BELOW, F.lit(False))
    ids = F.when(true("same_isbn"), ID_BONUS).otherwise(0.0) + F.when(true("same_asin"), ID_BONUS).otherwise(0.0)
    title = F.when(unlike, -PENALTY).otherwise(part("title_sim", TITLE_MOST))
    total = F.col("confidence") + ids + title + part("author_sim", AUTHOR_MOST) + part("publisher_sim", PUBLISHER_MOST) + F.col("filled") / F.lit(float(fields)) * COMPLETE_MOST
    capped = F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))
    return candidates.select(
        "*", F.greatest(capped - F.when(true("other_language"), PENALTY).otherwise(0.0), F.lit(0.0)).alias("score"),
        true("same_isbn").alias("isbn"), true("same_asin").alias("asin"), unlike.alias("contradiction"), true("other_language").alias("language_mismatch"),
        F.coalesce(F.col("title_sim") >= UNLIKE_BELOW, F.lit(False)).alias("title"), F.coalesce(F.col("author_sim") > 0.5, F.lit(False)).alias("author"),
    )


def language_checked(candidates: DataFrame, model: Languages) -> DataFrame:
    """Candidates (score, language, description, language_mismatch) held against the language their description is really in.

    One that says another language loses ``PENALTY``, once: what is marked
    already stays as it is. It is asked for when candidates are scored, and
    again after merging, which may have filled in either field. A text without
    a reliable language, and a candidate without a language, match.
    """
    return language_judged(detected(candidates, "description", model)).drop("detected", "ahead", "reliable")


def language_judged(rows: DataFrame) -> DataFrame:
    """``language_checked`` of rows whose texts have been ``detected`` already, as where many candidates quote one description."""
    rows = rows.withColumn("language_mismatch", F.coalesce("language_mismatch", F.lit(False)))
    new = ~F.col("language_mismatch") & language_mismatch(F.col("language"), F.col("detected"), F.col("reliable"))
    score = F.when(new, F.greatest(F.least(F.col("score") - PENALTY, F.lit(1.0)), F.lit(0.0))).otherwise(F.col("score"))
    return rows.withColumn("new_", new).withColumn("score", score).withColumn("language_mismatch", F.col("language_mismatch") | F.col("new_")).drop("new_")
