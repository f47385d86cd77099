"""Set-similarity join: pairs of strings whose trigram sets are alike, without comparing all with all.

Trigrams have one global order, rarest first; two sets with a Jaccard
likeness of at least t share one of the first ``n - ceil(t * n) + 1`` trigrams
of each (n: the size of the set), so only these prefixes are joined. Lengths
(t * n to n / t) and the places of the shared trigram rule out most of what
meets, the rest is counted exactly. Beginnings that many strings have are
frequent, so they come last in the order and are joined only where a string
has nothing rarer; keys that are still frequent are dealt to salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trigram_similarity, trigrams
from ..sources.work import partitions, stored

#: Frequencies are kept for so many classes of trigrams, a table of fixed size.
CLASSES = 1 << 16
#: Rows of one join key on the right side that are read by one task.
HUB = 1000


def _class(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(CLASSES)).cast("int")


def _least_shared(t: float, n: Column) -> Column:
    """ceil(t * n), not led astray by binary fractions."""
    return F.ceil(F.lit(t) * n - 1e-9).cast("int")


def prefixes(strings: DataFrame, threshold: float) -> DataFrame:
    """(s, mine, theirs, n, prefix) of ``strings(s, mine, theirs)``: the size of the trigram set and its rarest trigrams in order."""
    tokens = strings.where("s <> ''").withColumn("token", F.explode(trigrams(F.col("s")))).withColumn("class", _class(F.col("token")))
    counts = tokens.groupBy("class").agg(F.count(F.lit(1)).alias("seen"))  # at most CLASSES rows
    ranked = tokens.join(F.broadcast(counts), "class").groupBy("s", "mine", "theirs").agg(F.sort_array(F.collect_list(F.struct("seen", "token"))).alias("tokens"))
    n = F.size("tokens")
    return ranked.select("s", "mine", "theirs", n.alias("n"), F.slice(F.col("tokens.token"), F.lit(1), n - _least_shared(threshold, n) + 1).alias("prefix"))


def similar_strings(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, likeness) of all pairs of a string of ``left`` and one of ``right`` (one column each) with a trigram likeness of ``threshold`` (above 0) or more.

    Equal strings are alike; empty and null ones are like nothing; repeated
    strings count once; empty sides give no pairs.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold lies above 0 and is at most 1")
    one = lambda d, mine: d.select(F.col(d.columns[0]).cast("string").alias("s"), F.lit(mine).alias("mine"), F.lit(not mine).alias("theirs"))
    strings = one(left, True).union(one(right, False)).where("s is not null").groupBy("s").agg(F.bool_or("mine").alias("mine"), F.bool_or("theirs").alias("theirs"))
    rows = stored(prefixes(strings, threshold), "prefixes")
    spread = lambda side, name: rows.where(side).select(F.col("s").alias(name), F.col("n").alias(f"n_{name}"), F.col("prefix").alias(f"prefix_{name}"), F.posexplode("prefix").alias(f"at_{name}", "token"))
    b = spread("theirs", "b")
    # a right string's size is part of the key: each left string names the sizes it can be like
    fits = F.sequence(_least_shared(threshold, F.col("n_a")), F.floor(F.col("n_a") / threshold + 1e-9).cast("int"))
    a = spread("mine", "a").withColumn("n_b", F.explode(fits))
    hubs = b.groupBy("token", "n_b").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("parts")).where("parts > 1")
    hubs = stored(hubs, "hubs")
    key = ["token", "n_b"]
    b = b.join(hubs, key, "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    a = a.join(hubs, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    tasks = partitions(rows.sparkSession)  # what is compared takes far more time than its bytes tell
    a, b = (side.repartition(tasks, *key, "salt") for side in (a, b))
    together = _least_shared(threshold / (1 + threshold), F.col("n_a") + F.col("n_b"))
    # places count from 0; a pair is counted where it meets first, so it shares nothing before
    room = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    met = a.join(b, [*key, "salt"]).where(room >= together)
    met = met.where(F.array_intersect("prefix_a", "prefix_b")[0] == F.col("token"))
    return met.select("a", "b", trigram_similarity(F.col("a"), F.col("b")).alias("likeness")).where(F.col("likeness") >= threshold)

