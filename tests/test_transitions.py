"""Edge cases of state changes: null keys, repeated ids, empty changes."""

from shelfspark.operators import transitions as X


def test_null_keys_meet_and_null_changes_keep(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "d", "b")], "u int, device string, v string")
    new = spark.createDataFrame([(1, None, "c"), (2, "d", None), (3, None, "e")], "u int, device string, v string")
    assert sorted(X.upsert(rows, new, ["u", "device"]).collect(), key=str) == [(1, None, "c"), (2, "d", "b"), (3, None, "e")]


def test_repeated_ids_and_no_ids(spark):
    books = spark.createDataFrame([(1, "running"), (2, "failed"), (3, None)], "id int, resolution_state string")
    ids = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id int")
    assert sorted(X.mark_pending(books, ids).collect()) == [(1, "running"), (2, "pending"), (3, "pending")]
    assert X.move_state(books, ids.limit(0), None, "done").where("resolution_state = 'done'").count() == 0


def test_applied_candidates_stay(spark):
    c = spark.createDataFrame([(1, 5, 1, "pending"), (2, 5, None, "pending"), (3, 5, 1, "applied"), (4, 5, 2, "pending"), (5, 6, 1, "pending")], "id int, book_id int, run_id int, status string")
    keep = spark.createDataFrame([(5, 2)], "book_id int, run_id int")
    got = {r.id: r.status for r in X.supersede_candidates(c, keep).collect()}
    assert got == {1: "superseded", 2: "superseded", 3: "applied", 4: "pending", 5: "pending"}
