import random
from datetime import datetime, timedelta

import pytest
from tests.conftest import rows

from quarrylight.operators import incremental
from quarrylight.operators.incremental import TARGET, replay, run_once
from quarrylight.sources.versioned import VersionedTable

T0 = datetime(2025, 1, 1)
ENTRIES = "obs_id long, root string, rel_path string, hash string, seen_at timestamp, loaded_at timestamp, changed string"
RUNS = "run_id long, root string, status string, started_at timestamp"


def brute(entries, runs):
    out = set()
    for root in {r[1] for r in runs}:
        last = None
        for run_id, _, _, started in sorted((r for r in runs if r[1] == root and r[2] == "indexed"), key=lambda r: (r[3], r[0])):
            state = {}
            for e in sorted((e for e in entries if e[1] == root and e[3] is not None and e[5] <= started), key=lambda e: (e[4], e[0])):
                state[e[2]] = e[3].lower()
            if last is not None:
                out |= {(run_id, root, p) for p, h in state.items() if last.get(p) != h}
            last = state
    return sorted(out)


def feed(seed):
    rnd = random.Random(seed)
    hours = lambda a, b: T0 + timedelta(hours=rnd.randint(a, b))
    runs = [(i, rnd.choice("xyz"), rnd.choice(["indexed", "indexed", "failed", None]), hours(5, 90)) for i in range(20)]
    entries = []
    for i in range(300):
        seen = hours(0, 80)
        entries.append((i, rnd.choice(["x", "x", "x", "y", "w"]), f"p{rnd.randint(0, 9)}", rnd.choice(["aa", "AA", "bb", None, "c"]), seen, seen + timedelta(hours=rnd.choice([0, 0, 1, 30])), "?"))
    return entries + entries[:20], runs


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_brute_force(spark, seed):
    entries, runs = feed(seed)
    got = rows(replay(spark, spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(runs, RUNS)))
    assert got == brute(entries, runs)


def test_empty_tables(spark):
    none, runs = spark.createDataFrame([], ENTRIES), spark.createDataFrame([(1, "x", "indexed", T0), (2, "x", "indexed", T0 + timedelta(days=1))], RUNS)
    assert rows(replay(spark, none, runs)) == []
    assert rows(replay(spark, none, spark.createDataFrame([], RUNS))) == []


def test_a_run_that_dies_is_done_again_and_none_twice(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, f"file://{tmp_path}/t", TARGET)
    src = lambda *r: spark.createDataFrame([("x", p, T0 + timedelta(hours=h), i, v, 1) for p, h, i, v in r], "root string, rel_path string, seen_at timestamp, obs_id long, hash string, run_id long")
    first = src(("a", 1, 1, "1"), ("b", 1, 2, "1"))
    publish = VersionedTable.publish

    def die(self, df, version):
        df.count()
        raise RuntimeError("lost")

    monkeypatch.setattr(VersionedTable, "publish", die)
    with pytest.raises(RuntimeError):
        run_once(first, t, 0)
    assert t.versions() == []
    monkeypatch.setattr(VersionedTable, "publish", publish)
    run_once(first, t, 0)
    run_once(first, t, 0)  # again: published already
    assert t.versions() == [0] and t.read().count() == 2
    run_once(src(("a", 1, 1, "1"), ("b", 3, 3, "2"), ("a", 0, 9, "0"), ("c", 1, 4, "1")), t, 1)  # known, newer, late, new
    assert sorted((r.rel_path, r.changed) for r in t.read_only(1).collect()) == [("b", True), ("c", True)]
    assert incremental.newest(t.read(), ["root", "rel_path"]).count() == 3


def test_of_two_writers_of_a_version_one_fails(spark, tmp_path):
    schema = spark.createDataFrame([], "a int").schema
    one, two = (VersionedTable(spark, f"file://{tmp_path}/w", schema) for _ in range(2))
    rows_of = lambda n: spark.createDataFrame([(n,)], schema)
    seen = two.versions()
    one.publish(rows_of(1), 0)
    assert seen == []
    with pytest.raises(FileExistsError):  # the second has looked before the first was there
        two._commit(0, "elsewhere", False)
    with pytest.raises(FileExistsError):
        two.publish(rows_of(2), 0)
    assert rows(two.read()) == [(1,)]


@pytest.mark.parametrize("where", ["before", "after"])
def test_a_writer_killed_around_the_commit(spark, tmp_path, monkeypatch, where):
    schema = spark.createDataFrame([], "a int").schema
    t = VersionedTable(spark, f"file://{tmp_path}/k", schema)
    t.publish(spark.createDataFrame([(1,)], schema), 0)
    commit = VersionedTable._commit

    def die(self, *a):
        if where == "after":
            commit(self, *a)
        raise KeyboardInterrupt

    monkeypatch.setattr(VersionedTable, "_commit", die)
    monkeypatch.setattr(VersionedTable, "_remove", lambda *a: None)  # a killed program cleans nothing up
    with pytest.raises(KeyboardInterrupt):
        t.publish(spark.createDataFrame([(2,)], schema), 1)
    monkeypatch.undo()
    assert rows(t.read()) == ([(1,)] if where == "before" else [(1,), (2,)])
    left = len(t._names("data"))
    t.sweep(grace=-5)
    assert len(t._names("data")) == (left - 1 if where == "before" else left) and rows(t.read()) == ([(1,)] if where == "before" else [(1,), (2,)])
    v = t.latest() + 1
    monkeypatch.setattr(VersionedTable, "forget", lambda *a: None)  # killed between publishing and dropping
    t.compact(spark.createDataFrame([(9,)], schema), v)
    assert rows(t.read()) == [(9,)]


def test_a_backlog_is_caught_up_with_in_parts(spark, tmp_path, monkeypatch):
    entries, runs = feed(5)
    want = brute(entries, runs)
    path, commit, n = f"file://{tmp_path}/b", VersionedTable._commit, []

    def die(self, version, *a):
        if version == 2 and not n:
            n.append(1)
            raise RuntimeError("lost")
        commit(self, version, *a)

    monkeypatch.setattr(VersionedTable, "_commit", die)
    args = spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(runs, RUNS)
    with pytest.raises(RuntimeError):
        replay(spark, *args, path=path)
    assert VersionedTable(spark, path, TARGET).versions() == [0, 1]
    assert rows(replay(spark, *args, path=path)) == want == rows(replay(spark, *args, path=path))


def test_every_run_of_a_backlog_asks_the_target(spark, tmp_path, monkeypatch):
    entries, runs = feed(4)
    ask, asked = incremental.new_records, []

    def watch(source, state):
        asked.append(state.count())
        return ask(source, state)

    monkeypatch.setattr(incremental, "new_records", watch)
    path = f"file://{tmp_path}/q"
    assert rows(replay(spark, spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(runs, RUNS), path=path)) == brute(entries, runs)
    t = VersionedTable(spark, path, TARGET)
    assert len(t.versions()) > 2
    assert asked == [0] + [t.read(v).select("root", "rel_path").distinct().count() for v in t.versions()[:-1]]


def test_what_reaches_the_feed_after_its_run_comes_out_at_the_next(spark, tmp_path):
    at = lambda h: T0 + timedelta(hours=h)
    entries = [(1, "x", "a", "1", at(0), at(0), "?"), (2, "x", "b", "1", at(3), at(3), "?")]
    runs = [(i, "x", "indexed", at(2 * i)) for i in (1, 2, 3)]
    late = (3, "x", "c", "1", at(1), at(1), "?")  # loaded before both runs, but not there when they ran
    go = lambda e, r: rows(replay(spark, spark.createDataFrame(e, ENTRIES), spark.createDataFrame(r, RUNS), path=f"file://{tmp_path}/f"))
    assert go(entries, runs[:2]) == [(2, "x", "b")]
    assert go([*entries, late], runs) == [(2, "x", "b"), (3, "x", "c")] == go([*entries, late], runs)
