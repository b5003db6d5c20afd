from tests.conftest import rows

from quarrylight.operators.snapshot_diff import chain_changes, manifest_changes, snapshot_diff


def test_two_snapshots_with_nulls_repeats_and_extra_columns(spark):
    s = "rel_path string, hash string, k string, n int"  # k and n clash with names used inside
    old = spark.createDataFrame([("a", "1", "x", 9), ("b", "1", "x", 9), ("b", "1", "x", 9), ("c", "1", None, 1), ("u", "1", "", 0), (None, "1", "", 0)], s)
    new = spark.createDataFrame([("a", "1", "y", 9), ("b", "2", "x", 9), ("d", "1", None, 1), ("u", None, "", 0), ("v", None, "", 0)], s)
    got = {tuple(r) for r in snapshot_diff(old, new, ["rel_path"]).collect()}
    assert got == {("b", "Modified"), ("c", "Deleted"), ("d", "Added"), (None, "Deleted")}


def test_empty_snapshots(spark):
    s = "rel_path string, hash string"
    none, one = spark.createDataFrame([], s), spark.createDataFrame([("a", "1")], s)
    assert rows(snapshot_diff(none, none, ["rel_path"])) == []
    assert rows(snapshot_diff(none, one, ["rel_path"])) == [("a", "Added")]
    assert rows(snapshot_diff(one, none, ["rel_path"])) == [("a", "Deleted")]


def test_chain_goes_and_comes_back_and_keeps_unreadable(spark):
    data = [("a", 0, "1"), ("a", 2, "1"), ("b", 0, "1"), ("b", 1, None), ("b", 2, "2"), ("c", 0, None), ("c", 1, "7"), ("d", 1, "5"), ("d", 1, "4"), ("d", 2, None)]
    df = spark.createDataFrame([(p, k, h, 3) for p, k, h in data], "p string, k int, hash string, n int")
    assert rows(chain_changes(df, ["p"])) == [("a", 1, "Deleted"), ("a", 2, "Added"), ("b", 2, "Modified"), ("c", 1, "Added"), ("c", 2, "Deleted"), ("d", 1, "Added")]


def test_only_ended_runs_count(spark):
    from datetime import datetime

    at = lambda h: datetime(2025, 1, 1, h)
    runs = spark.createDataFrame([(1, "r", "indexed", at(1)), (2, "r", "failed", at(2)), (3, "r", None, at(3)), (4, "r", "indexed", at(4))], "run_id long, root string, status string, started_at timestamp")
    m = spark.createDataFrame([(1, "r", "./a", "AB"), (1, "r", "b", "cd"), (2, "r", "z", "ee"), (4, "r", "a", "ab"), (4, "r", "a", "ab"), (4, "r", "n", "11")], "run_id long, root string, rel_path string, hash string")
    assert rows(manifest_changes(m, runs)) == [(4, "r", "b", "Deleted"), (4, "r", "n", "Added")]
