"""Review of resolution runs and their candidates: which run is current, what is kept, what status a book has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import dealt
from .library import latest

# How much history stays, and the order of statuses.
TOP_CANDIDATES, SUPERSEDED_RUNS, RUNS = 5, 2, 10
STATUS_RANK = ("unidentified", "needs_review", "identified")
REVIEWED = ("ambiguous", "disputed")


def _newest(*more: Column | str) -> list:
    return [F.col("started_at").desc(), *(more or ["id"])]


def reviewable_runs(runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(book_id, run_id): each book's newest run that is not superseded and is ambiguous or disputed or has a pending candidate."""
    waiting = candidates.where("status = 'pending' and run_id is not null").select(F.col("run_id").alias("id")).distinct().withColumn("waits", F.lit(True))
    open_ = runs.where("state <> 'superseded'").join(waiting, "id", "left").where(F.col("outcome").isin(*REVIEWED) | F.col("waits"))
    return latest(open_, "book_id", *_newest()).select("book_id", F.col("id").alias("run_id"))


def current_candidates(runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates under review of every book: those of its reviewable run, or without one those of no run, and applied ones of other runs."""
    at = reviewable_runs(runs, candidates).withColumnRenamed("run_id", "open_run")
    c = candidates.join(at, "book_id", "left")
    mine = F.when(F.col("open_run").isNotNull(), F.col("run_id").eqNullSafe(F.col("open_run"))).otherwise(F.col("run_id").isNull()) & (F.col("status") != "superseded")
    return c.where(mine | ((F.col("status") == "applied") & F.col("run_id").isNotNull())).drop("open_run")


def pending_candidates(runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pending candidates of each book's newest running, ambiguous or disputed run, and those without a run of books that have no live run."""
    live = runs.where("state <> 'superseded'")
    current = latest(live.where((F.col("state") == "running") | F.col("outcome").isin(*REVIEWED)), "book_id", *_newest()).select(F.col("id").alias("run_id"))
    waiting = candidates.where("status = 'pending'")
    legacy = waiting.where("run_id is null").join(live.select("book_id").distinct(), "book_id", "left_anti")
    return waiting.join(current, "run_id", "left_semi").unionByName(legacy)


def current_run(books: DataFrame, runs: DataFrame) -> DataFrame:
    """(book_id, run_id): the run that a book names, else its newest that is not superseded."""
    named = books.select(F.col("id").alias("book_id"), F.col("last_resolution_run_id").alias("named"))
    named = named.join(runs.select(F.col("id").alias("named"), F.lit(True).alias("there")), "named", "left").where("there").select("book_id", "named")
    newest = latest(runs.where("state <> 'superseded'"), "book_id", *_newest()).select("book_id", F.col("id").alias("newest"))
    both = books.select(F.col("id").alias("book_id")).join(named, "book_id", "left").join(newest, "book_id", "left")
    return both.select("book_id", F.coalesce("named", "newest").alias("run_id"))


def kept_runs(runs: DataFrame, current: DataFrame, keep: int = RUNS) -> DataFrame:
    """Runs that stay: the current one of ``current(book_id, run_id)`` always, and the newest others up to ``keep`` in all."""
    cur = current.where("run_id is not null").select(F.col("run_id").alias("id"), F.lit(True).alias("is_current"))
    marked = runs.join(cur, "id", "left").withColumn("is_current", F.coalesce("is_current", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy(F.col("is_current").desc(), F.col("started_at").desc(), "id"))
    return marked.withColumn("place", place).where(F.col("place") <= keep).drop("place", "is_current")


def pruned_runs(runs: DataFrame, candidates: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs and candidates after old runs are gone; candidates without a run stay."""
    kept = kept_runs(runs, current)
    gone = runs.join(kept.select("id"), "id", "left_anti").select(F.col("id").alias("run_id"))
    return kept, candidates.join(gone, "run_id", "left_anti")


def useful_candidates(runs: DataFrame, candidates: DataFrame, n: int = TOP_CANDIDATES, superseded: int = SUPERSEDED_RUNS) -> DataFrame:
    """Candidates worth keeping: applied ones, the best of each run under review and of the last superseded runs, and, of books without runs, the best that have none."""
    best = [F.col("score").desc(), F.col("created_at"), F.col("id")]
    active = runs.where((F.col("state") != "superseded") & F.col("outcome").isin(*REVIEWED)).select("id")
    old = latest(runs.where("state = 'superseded'"), "book_id", *_newest(), n=superseded).select("id")
    by_run, by_id = (dealt({k: (candidates.where(f"{k} is not null"), k)})[k] for k in ("run_id", "id"))
    of_runs = by_run.join(active.union(old).select(F.col("id").alias("run_id")), "run_id", "left_semi")
    legacy = candidates.where("run_id is null and status <> 'superseded'").join(runs.select("book_id").distinct(), "book_id", "left_anti")
    ids = [latest(of_runs, "run_id", *best, n=n).select("id"), latest(legacy, "book_id", *best, n=n).select("id"), candidates.where("status = 'applied'").select("id")]
    return by_id.join(reduce(DataFrame.union, ids).distinct(), "id", "left_semi")


def applied_candidate(candidates: DataFrame) -> DataFrame:
    """The newest applied candidate of each book."""
    return latest(candidates.where("status = 'applied'"), "book_id", F.col("created_at").desc(), "id").drop("rn")


def candidate_context(candidates: DataFrame) -> DataFrame:
    """(book_id, has_applied, is_ambiguous, is_disputed) of candidates(book_id, status, disputes)."""
    waits = F.col("status") == "pending"
    return candidates.groupBy("book_id").agg(
        F.coalesce(F.bool_or(F.col("status") == "applied"), F.lit(False)).alias("has_applied"), F.coalesce(F.bool_or(waits), F.lit(False)).alias("is_ambiguous"),
        F.coalesce(F.bool_or(waits & (F.size("disputes") > 0)), F.lit(False)).alias("is_disputed"),
    )


def recomputed_status(trusted: Column, has_authors: Column, has_ids: Column, has_applied: Column, in_review: Column, baseline: Column) -> Column:
    """Status from what is known: review first, then trust, an applied candidate, authors and identifiers; a baseline is restored when the review ends."""
    derived = F.when(trusted | has_applied | (has_authors & has_ids), "identified").when(has_authors | has_ids, "needs_review").otherwise("unidentified")
    return F.when(in_review, "needs_review").otherwise(F.coalesce(baseline, derived))


def at_least(status: Column, floor: Column) -> Column:
    """The better of two statuses; a null floor changes nothing."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, STATUS_RANK)), c)
    return F.when(rank(floor) > rank(status), floor).otherwise(status)


# --- reconciliation ------------------------------------------------------------------------------------------------

CORE = ("title", "authors", "series")
ENRICHMENT = ("subtitle", "description", "publication_year", "language", "page_count", "identifiers", "cover")
LABELS = {"title": "Title", "subtitle": "Subtitle", "description": "Description", "publication_year": "Publication year", "language": "Language", "page_count": "Page count", "authors": "Authors", "identifiers": "Identifiers", "series": "Series", "cover": "Cover"}


def planned(rows: DataFrame) -> DataFrame:
    """A reason for each field, ``outcome``, ``apply`` and ``disputes`` of candidates against their books.

    Reads, for each field f, booleans f_proposed, f_differs (core) or f_wanted
    (enrichment: would be taken if unlocked) and f_protected, and locked,
    strong_id and contradiction. A null flag is false.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    reasons = {}
    for f in CORE:
        reasons[f] = (
            F.when(~flag(f"{f}_proposed"), "no_candidate_value").when(~flag(f"{f}_differs"), "no_change").when(flag("locked"), "metadata_locked")
            .when(flag(f"{f}_protected"), "protected").when(~flag("strong_id"), "strong_id_required").when(flag("contradiction"), "title_contradiction").otherwise("apply")
        )
    for f in ENRICHMENT:
        kept = "preserve_existing_cover" if f == "cover" else "existing_value_preferred"
        reasons[f] = F.when(~flag(f"{f}_proposed"), "no_candidate_value").when(flag("locked"), "metadata_locked").when(~flag(f"{f}_wanted"), kept).when(flag(f"{f}_protected"), "protected").otherwise("apply")
    either = lambda cs: reduce(lambda a, b: a | b, cs)
    applied = lambda f: F.col(f"{f}_reason") == "apply"
    out = rows.withColumns({f"{f}_reason": r for f, r in reasons.items()})
    conflict = either([flag(f"{f}_proposed") & flag(f"{f}_differs") & ~applied(f) for f in CORE])
    core, more = either([applied(f) for f in CORE]), either([applied(f) for f in ENRICHMENT])
    change = either([flag(f"{f}_differs") for f in CORE] + [flag(f"{f}_wanted") for f in ENRICHMENT])
    confirmed = flag("strong_id") & ~conflict
    dispute = conflict | (flag("locked") & change)
    texts = {"title_contradiction": " differs from the proposal", "protected": " is protected", "metadata_locked": " is locked", "strong_id_required": " needs a strong identifier"}
    said = F.array(*[F.coalesce(*[F.when(F.col(f"{f}_reason") == why, F.lit(LABELS[f] + text)) for why, text in texts.items()]) for f in (*CORE, *ENRICHMENT)])
    return out.withColumns({
        "outcome": F.when(dispute, "disputed").when(core, "confirmed").when(more, "enriched").when(confirmed, "confirmed").otherwise("enriched"),
        "apply": ~flag("locked") & ~conflict & (core | more | confirmed), "disputes": F.filter(said, lambda x: x.isNotNull()),
    })


def merged_field(current: Column, proposed: Column, protected: Column, manual: Column) -> Column:
    """A manual apply takes any proposed value that isn't protected, an automatic one only fills what is empty."""
    take = proposed.isNotNull() & ~F.coalesce(protected, F.lit(False)) & (F.coalesce(manual, F.lit(False)) | current.isNull())
    return F.when(take, proposed).otherwise(current)


def undone(books: DataFrame, changes: DataFrame) -> DataFrame:
    """Books with a changeset taken back: ``changes(book_id, candidate_id, field, old_value)`` restores a field whose provenance still names that candidate.

    ``books`` has the fields and ``provenance``, a map from field to candidate id.
    """
    back = changes.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("candidate_id", "old_value")))).alias("back")).withColumnRenamed("book_id", "id")
    out = books.join(back, "id", "left")
    fields = [c for c in books.columns if c not in ("id", "provenance")]
    mine = lambda f: F.coalesce(F.col("provenance")[f] == F.col("back")[f]["candidate_id"], F.lit(False))
    restored = {f: F.when(mine(f), F.col("back")[f]["old_value"].cast(dict(books.dtypes)[f])).otherwise(F.col(f)) for f in fields}
    kept = F.map_filter("provenance", lambda k, v: ~F.coalesce(v == F.col("back")[k]["candidate_id"], F.lit(False)))
    return out.withColumns({**restored, "provenance_": kept}).drop("back", "provenance").withColumnRenamed("provenance_", "provenance")


def trusted_identifiers(identifiers: DataFrame) -> DataFrame:
    """Identifiers that prove a match: the user's, embedded ones, and a scanned one if it is the book's only scanned one."""
    alone = F.count(F.when(F.col("source_type") == "content_scan", 1)).over(Window.partitionBy("book_id")) == 1
    return identifiers.withColumn("alone", alone).where(F.col("source_type").isin("user", "embedded") | ((F.col("source_type") == "content_scan") & F.col("alone"))).drop("alone")


def identifier_proof(trusted: DataFrame, proposed: DataFrame) -> DataFrame:
    """(candidate_id) whose identifiers(candidate_id, book_id, identifier_type, value) meet a trusted one of the book, ISBN-10 as ISBN-13."""
    from ..functions.words import to_isbn13

    key = lambda d: d.where(F.col("identifier_type").isin("isbn13", "isbn10", "asin")).withColumn("key", F.coalesce(to_isbn13(F.col("identifier_type"), F.col("value")), F.col("value")))
    return key(proposed).join(key(trusted).select("book_id", "key").distinct(), ["book_id", "key"], "left_semi").select("candidate_id").distinct()


def gathered(by_id: DataFrame, by_search: DataFrame) -> DataFrame:
    """Candidates of identifier lookups; a book's search results only where those gave nothing."""
    met = dealt({"asked": (by_search, "book_id"), "found": (by_id.select("book_id"), "book_id")})
    return by_id.unionByName(met["asked"].join(met["found"].distinct(), "book_id", "left_anti"))
