"""Event streams: the cooldown as a batch and as a stream, and what explains a removal."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from shelfspark.catalog_queries import QUERIES
from shelfspark.sources.views import Catalog
from shelfspark.streaming import events

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

SCHEMA = "path string, kind string, ts timestamp"
START = dt.datetime(2024, 1, 1)


def rows(n=60):
    rng, out = random.Random(3), []
    for p in "abc":
        at = 0.0
        for i in range(n):
            at += rng.choice([0.5, 1, 2, 5, 7])
            out.append((p, f"k{i}", START + dt.timedelta(seconds=at)))
    return out


def brute(events_, seconds):
    out, last = set(), {}
    for p, k, t in sorted(events_, key=lambda r: r[2]):
        if p not in last or (t - last[p]).total_seconds() >= seconds:
            last[p] = t
            out.add((p, k))
    return out


def test_cooldown_batch(spark):
    data = rows()
    got = {(r.path, r.kind) for r in events.cooled(spark.createDataFrame(data, SCHEMA), 5.0).collect()}
    assert got == brute(data, 5.0) and len(got) < len(data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_cooldown_query_equals_the_plain_version(spark):
    data = [(r.path, r.kind, r.ts) for r in Catalog(spark, SF).file_events.orderBy("path", "ts", "kind").collect()]
    want, last = [], {}
    for p, k, t in data:
        if p not in last or (t - last[p]).total_seconds() >= 86400:
            last[p] = t
            want.append((p, k, t))
    got = sorted(tuple(r) for r in QUERIES["stream_cooldown"](spark, SF).collect())
    assert got == sorted(want) and 0 < len(got) < len(data)


def test_cooldown_stream_keeps_its_state_between_batches(spark, tmp_path):
    data = sorted(rows(20), key=lambda r: r[2])
    for i, part in enumerate((data[:25], data[25:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = events.cooled(stream, 5.0).writeStream.format("memory").queryName("cooled").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.path, r.kind) for r in spark.table("cooled").collect()} == brute(data, 5.0)


def test_own_deletions_explain_removals_for_a_while(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    removals = spark.createDataFrame([("a", "removed", at(10)), ("a", "removed", at(40)), ("b", "removed", at(10))], SCHEMA)
    own = spark.createDataFrame([("a", "removed", at(0))], SCHEMA)
    assert sorted((r.path, r.ts) for r in events.foreign_removals(removals, own).collect()) == [("a", at(40)), ("b", at(10))]


def test_filter_of_changes_and_removals(spark):
    names = [("/x/.a.epub", "removed"), ("/x/a.part", "removed"), ("/x/a.epub~", "changed"), ("/x/.a.epub", "changed"), ("/x/a.EPUB", "changed"), ("/x/a.doc", "changed"), ("/x/a.pdf", "error"), ("/x/epub", "removed")]
    df = spark.createDataFrame(names, "path string, kind string").withColumn("ts", F.lit(START))
    assert {(r.path, r.kind) for r in events.relevant(df).collect()} == {("/x/.a.epub", "removed"), ("/x/a.EPUB", "changed")}
