from datetime import datetime

import pytest
from tests.conftest import DATA, rows

import __spark_entry__ as entry
from quarrylight.operators.snapshot_diff import successful_runs

AT = lambda h: datetime(2025, 1, 1, h)


@pytest.fixture(scope="module")
def three(spark, tmp_path_factory):
    """A root of three ended runs and a failed one, and a root of one run."""
    d = str(tmp_path_factory.mktemp("history"))
    runs = [(1, "r", "indexed", AT(1)), (2, "r", "failed", AT(2)), (3, "r", "indexed", AT(3)), (4, "r", "indexed", AT(4)), (5, "s", "indexed", AT(1))]
    spark.createDataFrame(runs, "run_id long, root string, status string, started_at timestamp").write.parquet(f"{d}/sync_runs.parquet")
    m = [(1, "r", "./a", "AA", 2, 1, 1), (1, "r", "b", "bb", 3, 1, 1), (2, "r", "z", "zz", 9, 1, 1), (3, "r", "a", "a2", 4, 2, 2), (3, "r", "c", "cc", 5, 1, 1), (4, "r", "a", "a2", 4, 2, 2), (4, "r", "c", "cc", 5, 1, 1), (5, "s", "q", "qq", 7, 1, 1)]
    spark.createDataFrame(m, "run_id long, root string, rel_path string, hash string, chunk_count int, size long, mtime_ns long").write.parquet(f"{d}/manifest_snapshots.parquet")
    return d


@pytest.mark.parametrize(
    "name, want",
    [
        ("manifest_diff", [("r", 3, "a", "Modified"), ("r", 3, "b", "Deleted"), ("r", 3, "c", "Added")]),
        ("manifest_diff_by_hash", [("r", 3, "a", "Modified"), ("r", 3, "b", "Deleted"), ("r", 3, "c", "Added")]),
        ("change_counts", [("r", 3, 1, 1, 1), ("r", 4, 0, 0, 0)]),
        ("files_to_process", [("r", 3, "a", "a2", 2), ("r", 3, "c", "cc", 1)]),
        ("removed_chunks", [("r", 3, 5), ("r", 4, 0)]),
        ("progress_manifest", [("r", 4, "a", "a2", 4), ("r", 4, "c", "cc", 5)]),
        ("new_total", [("r", 3, 9), ("r", 4, 9)]),
        ("needs_hash", [("r", 3, "a"), ("r", 3, "c")]),
        ("stale_results", [("r", 3, "a", True), ("r", 3, "b", True), ("r", 4, "a", False), ("r", 4, "c", False)]),
    ],
)
def test_all_pairs(spark, three, name, want):
    got = entry.queries()[f"{name}_history"](spark, three)
    names = ["root", "run_id", *(c for c in got.columns if c not in ("root", "run_id"))]
    assert rows(got.select(*names)) == want


@pytest.mark.parametrize("name", ["manifest_diff", "manifest_diff_by_hash", "files_to_process", "progress_manifest", "needs_hash"])
def test_last_pair_is_that_of_the_query_with_sql(spark, name):
    ok = successful_runs(spark.read.parquet(f"{DATA}/sync_runs.parquet")).where("n > 1 and k = n - 1").select("root", "run_id")
    whole = entry.queries()[f"{name}_history"](spark, DATA)
    last = entry.queries()[name](spark, DATA)
    assert rows(whole.join(ok, ["root", "run_id"], "left_semi").select(*last.columns)) == rows(last.join(ok, ["root"], "left_semi").select(*last.columns))
    assert whole.count() > last.join(ok, ["root"], "left_semi").count()
