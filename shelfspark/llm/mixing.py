"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Every document of a source has the same expected number of copies,
``target / size of the source``. Its whole part is taken for sure; the
fractional part becomes a copy probability. Probabilities are rounded in
pairs: a pair moves word mass from one document to the other, in a random
direction that keeps both expectations, until one of the two is integral; the
other goes on to the next pair. Leaves of bounded size each leave at most one
fractional document, and leaves' residuals are combined in the same way up a
tree, so no group of unbounded size ever meets in one task. The words of a
source therefore miss its target by less than one document.

Defined results: a null or blank text has size 0 and takes 0 words; an empty
table gives an empty table; documents with equal ids are separate rows, each
with random numbers of its own; a source of no words has target 0. Extra input
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

LEAF = 256
BLOCK = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of ``sizes(source, source_size)``.

    Sources in code point order (null last) take ``weights`` in turn and share
    ``share`` times all words; none gets more than ``cap`` times its own words
    and what it can't take is shared again by weight. That fixed point is
    min(cap * size, level * weight): sources become full in the order of
    cap * size / weight, so one window over the (already aggregated) sources
    finds the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(order) - 1) % len(weights)
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int")))
    s = s.withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    by = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("free", F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    s = s.withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("free") / F.col("left"))
    # full only if all before it are full: beyond the first that isn't, the running level has no meaning
    s = s.withColumn("fits", F.col("limit") / F.col("weight") <= F.col("level"))
    s = s.withColumn("full", F.min("fits").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(by))
    level = F.min(F.when(~F.col("full"), F.struct("nth", "level"))).over(every)["level"]
    return s.select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(level * F.col("weight")).alias("target"))


def _pivot(items: Column, seed: int, tag: Column, kind: str) -> Column:
    """Fold an array of (id, size, x) into {rid, rsize, rx, done: [(id, up)]}; ``kind`` is the type of an id."""
    empty = F.array().cast(f"array<struct<id:{kind},up:int>>")
    start = F.struct(F.lit(None).cast(kind).alias("rid"), F.lit(0).cast("long").alias("rsize"), F.lit(0.0).alias("rx"), empty.alias("done"))

    def step(acc: Column, d: Column) -> Column:
        a, b, xa, xb = acc["rsize"].cast("double"), d["size"].cast("double"), acc["rx"], d["x"]
        up, down = F.least((1 - xa) * a, xb * b), F.least(xa * a, (1 - xb) * b)
        draw = F.pmod(F.xxhash64(acc["rid"]["draw"], d["id"]["draw"], tag, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
        first_gains = draw * (up + down) < down
        # the document that becomes integral leaves; ties of rounding go to the first
        settle = (
            F.when(first_gains & ((1 - xa) * a <= xb * b), F.struct(F.lit(True).alias("old"), F.lit(1).alias("up"), (xb - up / b).alias("x")))
            .when(first_gains, F.struct(F.lit(False).alias("old"), F.lit(0).alias("up"), (xa + up / a).alias("x")))
            .when(xa * a <= (1 - xb) * b, F.struct(F.lit(True).alias("old"), F.lit(0).alias("up"), (xb + down / b).alias("x")))
            .otherwise(F.struct(F.lit(False).alias("old"), F.lit(1).alias("up"), (xa - down / a).alias("x")))
        )
        merged = F.transform(F.array(settle), lambda s: F.struct(
            F.when(s["old"], d["id"]).otherwise(acc["rid"]).alias("rid"),
            F.when(s["old"], d["size"]).otherwise(acc["rsize"]).alias("rsize"),
            F.least(F.greatest(s["x"], F.lit(0.0)), F.lit(1.0)).alias("rx"),
            F.array_append(acc["done"], F.struct(F.when(s["old"], acc["rid"]).otherwise(d["id"]).alias("id"), s["up"].alias("up"))).alias("done"),
        ))[0]
        alone = F.struct(d["id"].alias("rid"), d["size"].alias("rsize"), d["x"].alias("rx"), acc["done"].alias("done"))
        return F.when(acc["rid"].isNull(), alone).otherwise(merged)

    return F.aggregate(items, start, step)


def _numbered(counted: DataFrame) -> DataFrame:
    """Each row of ``counted(doc_id, source, size, times)`` as often as it occurs, told apart by ``nth``.

    Rows that occur very often (blank ones without an id, say) are numbered in
    blocks, which are dealt to all tasks.
    """
    key, block = ["doc_id", "source", "size"], F.lit(BLOCK).cast("long")
    few = counted.where(F.col("times") <= BLOCK).select(*key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth"))
    many = counted.where(F.col("times") > BLOCK).select(*key, "times", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / block))).alias("at"))
    many = many.repartition(*key, "at").select(*key, F.explode(F.sequence(F.col("at") * block + 1, F.least((F.col("at") + 1) * block, F.col("times")))).alias("nth"))
    return few.unionAll(many)


def mix_sources(docs: DataFrame, seed: int = 17, leaf: int = LEAF, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Copies of every row of ``docs(doc_id, text, source)``: doc_id, source, size, source_size, target, copies, taken."""
    sized = docs.select("doc_id", "source", n_words("text").alias("size"))
    counted = durable(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("times")))
    rows = _numbered(counted)
    per_source = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("times")).otherwise(0)).alias("n"))
    targets = source_targets(per_source, weights, share, cap).join(per_source.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    targets = durable(targets.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    t = targets.select(F.col("source").alias("s2"), "source_size", "target", "ratio", "n")
    all_rows = rows.join(t, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    whole = F.floor("ratio")
    all_rows = all_rows.select(
        "doc_id", "source", "size", "nth", "source_size", "target", "n",
        F.when(F.col("size") > 0, whole).otherwise(0).cast("long").alias("base"),
        F.when(F.col("size") > 0, F.col("ratio") - whole).otherwise(0.0).alias("x"),
        F.xxhash64("doc_id", "source", "size", "nth", F.lit(seed)).alias("draw"),
    )
    # a hash deals and draws; a row is known by all its columns, so equal hashes of two rows do no harm
    row = F.struct("draw", "doc_id", "nth", F.col("size").alias("words"))
    kind = all_rows.select(row).schema[0].dataType.simpleString()
    leaves = F.greatest(F.ceil(F.col("n") / leaf), F.lit(1)).cast("long")
    level = all_rows.where("x > 0").select(row.alias("id"), "size", "x", "source", F.pmod(F.xxhash64("draw", F.lit(seed + 1)), leaves).alias("leaf"))
    settled = None
    most = targets.agg(F.max(leaves)).first()[0] or 1
    depth = 0
    while True:
        folded = level.groupBy("source", "leaf").agg(F.sort_array(F.collect_list(F.struct("id", "size", "x"))).alias("items"))
        folded = durable(folded.select("source", "leaf", _pivot(F.col("items"), seed, F.lit(depth), kind).alias("f")))
        done = folded.select("source", F.explode("f.done").alias("d")).select("source", "d.id", "d.up")
        settled = done if settled is None else settled.unionAll(done)
        residual = folded.select("source", "leaf", F.col("f.rid").alias("id"), F.col("f.rsize").alias("size"), F.col("f.rx").alias("x"))
        if most <= 1:
            draw = F.pmod(F.xxhash64("id.draw", F.lit(seed + 2)), F.lit(1 << 52)) / F.lit(float(1 << 52))
            settled = settled.unionAll(residual.select("source", "id", (draw < F.col("x")).cast("int").alias("up")))
            break
        depth += 1
        most = -(-most // leaf)
        level = residual.select("id", "size", "x", "source", F.floor(F.col("leaf") / leaf).alias("leaf"))
    settled = settled.select(F.col("source").alias("s2"), F.col("id.draw").alias("draw2"), F.col("id.doc_id").alias("d2"), F.col("id.nth").alias("n2"), F.col("id.words").alias("w2"), "up")
    same = (F.col("draw") == F.col("draw2")) & (F.col("nth") == F.col("n2")) & (F.col("size") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("d2")) & F.col("source").eqNullSafe(F.col("s2"))
    out = all_rows.join(settled, same, "left")
    copies = F.col("base") + F.coalesce("up", F.lit(0))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
