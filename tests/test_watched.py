"""Watched folders: the gate as stream and batch, arrivals taken once over crashes, polling, deletion after the commit."""

import datetime as dt
import os
import random

import pytest

from shelfspark.sources.commits import Change
from shelfspark.streaming import watched as W
from shelfspark.streaming.gate import EVENT, gated

START = dt.datetime(2024, 1, 1)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(PROVIDER)


def plain(rows, cooldown, own):
    out, last, gone = set(), {}, {}
    for p, k, t in sorted(rows, key=lambda r: (r[2], r[1] != "own")):
        if k == "own":
            gone[p] = t
        elif k == "removed":
            if p not in gone or (t - gone[p]).total_seconds() >= own:
                out.add((p, k, t))
        elif p not in last or (t - last[p]).total_seconds() >= cooldown:
            last[p] = t
            out.add((p, k, t))
    return out


def events(n, paths):
    rng, rows, at = random.Random(7), [], 0.0
    for _ in range(n):
        at += rng.choice([0.25, 0.5, 1, 3])
        rows.append((f"/in/{rng.randrange(paths)}.epub", rng.choice(["changed", "changed", "removed", "own"]), START + dt.timedelta(seconds=at)))
    return rows


def drain(spark, rows, parts, tmp, **options):
    for i in range(parts):
        part = rows[len(rows) * i // parts : len(rows) * (i + 1) // parts]
        spark.createDataFrame(part, EVENT).coalesce(1).write.parquet(f"{tmp}/in/{i:03d}")
    stream = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")
    query = gated(stream, **options).writeStream.format("memory").queryName("gated").option("checkpointLocation", f"{tmp}/ck").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return {tuple(r) for r in spark.table("gated").collect()}, [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_gate_batch(spark):
    rows = events(400, 5)
    got = {tuple(r) for r in gated(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == plain(rows, 5.0, 30.0) and len(got) < 300


def test_gate_stream_equals_the_batch_over_batches(spark, rocks, tmp_path):
    rows = events(200, 4)
    got, _ = drain(spark, rows, 4, tmp_path)
    assert got == plain(rows, 5.0, 30.0)


def test_gate_forgets_paths_whose_time_is_past(spark, rocks, tmp_path):
    crowd = [(f"/in/{i}.epub", "changed", START + dt.timedelta(seconds=i / 100)) for i in range(200)]
    later = [("/in/z.epub", "changed", START + dt.timedelta(minutes=m)) for m in (5, 10, 15)]
    again = [("/in/0.epub", "changed", START + dt.timedelta(minutes=20))]
    got, sizes = drain(spark, crowd + later + again, 4, tmp_path)
    assert len(got) == 204  # 51 rows a part
    assert max(sizes) >= 100 and sizes[-1] <= 10


def test_gate_nulls_and_empty(spark):
    rows = [(None, "changed", START), (None, "changed", START), (None, "removed", None), ("a", "error", START), ("a", None, START)]
    assert [tuple(r) for r in gated(spark.createDataFrame(rows, EVENT)).collect()] == [(None, "changed", START)]
    assert gated(spark.createDataFrame([], EVENT)).count() == 0


def put(folder, name, text, seconds=None):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    if seconds:
        os.utime(path, (seconds, seconds))
    return path


def names(df):
    return sorted(os.path.basename(r.path) for r in df.collect())


def run(box, folder, tmp):
    query = box.watch(str(folder), f"{tmp}/ck", 2, availableNow=True)
    query.awaitTermination()
    return query


def test_arrivals_are_taken_once_over_crashes(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in box"
    for n in ("a.epub", "b ü.txt", "c.epub.part", ".d.epub", "sub/e%20.EPUB", ".h/f.epub", "g.doc"):
        put(folder, n, n)
    box = W.Inbox(spark, f"{tmp_path}/tables")
    publish = type(box.tables).publish

    def dies_before(self, *a):
        raise RuntimeError("lost")

    def dies_after(self, *a):
        publish(self, *a)
        raise RuntimeError("lost")

    for failing, want in ((dies_before, 0), (dies_after, 2)):  # a batch has two files
        monkeypatch.setattr(type(box.tables), "publish", failing)
        with pytest.raises(Exception, match="lost"):
            run(box, folder, tmp_path)
        assert box.tables.read("import_tasks").count() == want
    monkeypatch.setattr(type(box.tables), "publish", publish)
    run(box, folder, tmp_path)
    assert names(box.tables.read("import_tasks")) == ["a.epub", "b ü.txt", "e%20.EPUB"]
    put(folder, "h.epub", "a.epub")
    run(box, folder, tmp_path)
    assert names(box.tables.read("import_tasks")) == ["a.epub", "b ü.txt", "e%20.EPUB", "h.epub"]
    assert box.tables.read("watched_files").count() == 4


def test_polling_finds_new_changed_and_removed_files(spark, tmp_path):
    folder = tmp_path / "in"
    a, b, c = (put(folder, n, n, 1_700_000_000) for n in ("a.epub", "b.epub", "c.epub"))
    put(tmp_path / "in2", "x.epub", "x")
    box = W.Inbox(spark, f"{tmp_path}/tables")
    box.poll(str(tmp_path / "in2"), "p0")
    assert box.poll(str(folder), "p1").count() == 3
    assert box.poll(str(folder), "p2").count() == 0
    put(folder, "a.epub", "new", 1_700_000_100)  # other bytes
    put(folder, "b.epub", "b.epub", 1_700_000_200)  # touched only
    c.unlink()
    got = {(os.path.basename(r.path), r.kind) for r in box.poll(str(folder), "p3").collect()}
    assert got == {("a.epub", "changed"), ("b.epub", "changed"), ("c.epub", "removed")}
    assert names(box.tables.read("import_tasks")) == ["a.epub", "a.epub", "b.epub", "c.epub", "x.epub"]
    assert names(box.tables.read("watched_files")) == ["a.epub", "b.epub", "x.epub"]
    assert box.poll(str(folder), "p4").count() == 0
    assert not box.take(W.listing(spark, str(folder)), "p4")


def test_sources_are_deleted_after_their_import(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    done, dup, bad, edited, missing = (put(folder, f"{n}.epub", n) for n in ("done", "dup", "bad", "edited", "missing"))
    box = W.Inbox(spark, f"{tmp_path}/tables")
    box.poll(str(folder), "p1")
    id_of = {os.path.basename(r.path)[:-5]: r.task_id for r in box.tables.read("import_tasks").collect()}
    results = [(id_of["done"], "completed", None), (id_of["dup"], "completed", "duplicate"), (id_of["bad"], "failed", None), (id_of["edited"], "completed", "imported"), (id_of["missing"], "completed", "imported"), ("unknown", "completed", None)]
    box.finish(spark.createDataFrame(results, "task_id string, status string, result string"), "f1")
    edited.write_text("not what was imported")
    missing.unlink()
    kept = W._deleted
    monkeypatch.setattr(W, "_deleted", lambda rows: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        box.delete_sources()
    assert done.exists() and names(box.own_deletions()) == ["done.epub", "edited.epub", "missing.epub"]
    monkeypatch.setattr(W, "_deleted", kept)
    got = {(os.path.basename(r.path), r.outcome) for r in box.delete_sources().collect()}
    assert got == {("done.epub", "deleted"), ("edited.epub", "changed"), ("missing.epub", "deleted")}
    assert not done.exists() and dup.exists() and bad.exists() and edited.exists()
    assert box.delete_sources().count() == 0
    # the removal that the deletion causes is explained by it
    removals = box.poll(str(folder), "p2").where("kind = 'removed'").selectExpr("path", "kind", "current_timestamp() as ts")
    assert gated(removals.unionByName(box.own_deletions())).count() == 0 and removals.count() == 2


def test_a_deletion_refers_to_a_task(spark, tmp_path):
    box = W.Inbox(spark, f"{tmp_path}/tables")
    row = spark.createDataFrame([("t", "/x", START, None)], W.TABLES["source_deletions"].schema)
    assert not box.tables.commit("c", {"source_deletions": Change(row)}).committed


def test_errors_find_their_folder(spark):
    found = [("/a/b/x.epub", "No such file or directory"), ("/ab", "EACCES"), ("/q", "disk full"), (None, "not found"), ("/a/b", None), ("", "x")]
    folders = spark.createDataFrame([(1, "/a"), (2, "/a/b"), (3, None)], "id long, path string")
    got = {(r.path, r["class"], r.directory_id) for r in W.errors(spark.createDataFrame(found, "path string, error string"), folders).collect()}
    assert got == {("/a/b/x.epub", "gone", 1), ("/ab", "denied", 1), ("/q", "other", None), (None, "other", None), ("/a/b", "other", 1), ("", "other", None)}
