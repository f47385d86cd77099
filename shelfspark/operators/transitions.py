"""State changes as set-based rewrites: each takes the rows of a table and returns all of them, changed where the rule holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _flagged(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with ``hit``, true for the keys in ``ids(id)``; repeated ids don't multiply rows."""
    hits = ids.select(F.col("id").alias(key)).distinct().withColumn("hit", F.lit(True))
    return rows.join(hits, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def _rewrite(flagged: DataFrame, where: Column, **values: Column) -> DataFrame:
    """New values where ``where`` holds (a null is no hit)."""
    on = flagged.withColumn("hit", F.col("hit") & F.coalesce(where, F.lit(False)))
    return on.withColumns({c: F.when(F.col("hit"), v).otherwise(F.col(c)) for c, v in values.items()}).drop("hit")


def mark_pending(books: DataFrame, ids: DataFrame) -> DataFrame:
    """Asked-for books wait for resolution; one that is being resolved stays ``running``."""
    return _rewrite(_flagged(books, ids), ~F.col("resolution_state").eqNullSafe("running"), resolution_state=F.lit("pending"))


def move_state(books: DataFrame, ids: DataFrame, old: str | None, new: str) -> DataFrame:
    """Compare-and-set: books of ``ids`` go to ``new`` if they are in ``old`` (None: from any state)."""
    return _rewrite(_flagged(books, ids), F.lit(True) if old is None else F.col("resolution_state") == old, resolution_state=F.lit(new))


def cancel_children(tasks: DataFrame, parents: DataFrame) -> DataFrame:
    return _rewrite(_flagged(tasks, parents, "parent_task_id"), F.col("status") == "pending", status=F.lit("cancelled"))


def recover_tasks(tasks: DataFrame) -> DataFrame:
    """After a restart what ran waits again; other states stay."""
    return tasks.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def supersede_candidates(candidates: DataFrame, keep: DataFrame) -> DataFrame:
    """Candidates of the books in ``keep(book_id, run_id)`` from other runs, or from none, are superseded unless applied."""
    kept = keep.groupBy("book_id").agg(F.max("run_id").alias("kept_run"))
    other = F.col("kept_run").isNotNull() & ~F.col("run_id").eqNullSafe(F.col("kept_run")) & (F.col("status") != "applied")
    return candidates.join(kept, "book_id", "left").withColumn("status", F.when(other, "superseded").otherwise(F.col("status"))).drop("kept_run")


def repair_runs(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """Runs cut off by a restart: superseded if ``requests(book_id, requested_at)`` asks again after the start, else failed."""
    asked = requests.groupBy("book_id").agg(F.max("requested_at").alias("asked"))
    again = F.when(F.col("asked") > F.col("started_at"), "superseded").otherwise("failed")
    cut = F.col("state") == "running"
    out = runs.join(asked, "book_id", "left").withColumn("outcome", F.when(cut, None).otherwise(F.col("outcome")))
    return out.withColumn("state", F.when(cut, again).otherwise(F.col("state"))).drop("asked")


def upsert(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``changes`` (one row a key) merged in: null keys are equal, a null change keeps the old value."""
    fields = [c for c in rows.columns if c not in keys]
    new = changes.select(*[F.col(c).alias(f"new_{c}") for c in changes.columns])
    both = rows.join(new, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in keys]), "full")
    held = lambda c: F.coalesce(F.col(f"new_{c}"), F.col(c)) if c in changes.columns else F.col(c)
    return both.select(*[held(c).alias(c) for c in [*keys, *fields]])


def cascade_delete(children: DataFrame, gone: DataFrame, key: str = "book_id") -> DataFrame:
    """Child rows whose parent isn't in ``gone(id)``; rows without a parent stay."""
    return children.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def purge_tombstones(ledger: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """The ledger without removals that a device acknowledged over ``days`` ago."""
    old = F.col("removed_synced_at") < now - F.expr(f"interval {days} days")
    return ledger.where(~F.coalesce(old, F.lit(False)))
