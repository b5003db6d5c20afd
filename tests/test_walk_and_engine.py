import os

import pytest

from quarrylight.api import Engine, Refused
from quarrylight.sources import walk as w


def tree(root, files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def found(root, extra=()):
    return [f[1] for f in w.walk(str(root), list(extra))]


def test_ignore_rules_and_pruned_folders(tmp_path):
    tree(tmp_path, {".gitignore": "*.log\n!keep.log\n/only\ndeep/\n# no\n\n", "a.log": "x", "keep.log": "x", "only/x.go": "x", "sub/only/x.go": "x", "deep/keep.log": "x", "sub/.indexignore": "*.md\n", "sub/r.md": "x", "r.md": "x", "node_modules/x.js": "x", "src/.env": "x", "_u.txt": "", "q/z.gen.go": "x"})
    assert found(tmp_path, ["*.gen.go"]) == [".gitignore", "_u.txt", "keep.log", "r.md", "src/.env", "sub/.indexignore", "sub/only/x.go"]


def test_links_are_skipped_and_relative_roots_refused(tmp_path):
    tree(tmp_path, {"a.txt": "x"})
    os.symlink(tmp_path / "a.txt", tmp_path / "b.txt")
    assert found(tmp_path) == ["a.txt"]
    with pytest.raises(ValueError):
        list(w.walk("relative"))


@pytest.mark.parametrize(("raw", "text"), [(b"", True), (b"abc\n", True), (b"a\0b", False), (b"\xef\xbb\xbfx", True), (b"\x01\x02\x03", False), ("é".encode(), True), (b"%PDF-1", True), (b"caf\xc3", False), (b"x" * 511 + b"\xc3\xa9", True), (b"\x1b[1m", False)])
def test_sniff(raw, text):
    assert w.is_text(raw) is text


def test_source_keeps_hidden_and_empty_files(spark, tmp_path):
    tree(tmp_path, {".dot": "d", "_under": "u", "empty": "", "bin.dat": b"\0\1", "x/A.GO": "package a\n"})
    got = {r.rel_path: r for r in w.scan(spark, str(tmp_path)).collect()}
    assert sorted(got) == [".dot", "_under", "empty", "x/A.GO"] and got["x/A.GO"].ext == ".go" and got["empty"].content == ""


def test_engine_end_to_end(spark, tmp_path):
    src, base = tmp_path / "src", f"file://{tmp_path}/base"
    tree(src, {"a/main.go": "package a\n\nfunc ParseToken() {\n\treturn\n}\n", "b.py": "def walk():\n    pass\n", "OWNERS": "parse token\n"})
    e = Engine(spark, base)
    assert e.index(str(src)) == {"added": 3, "modified": 0, "deleted": 0, "files": 3, "chunks": 3}
    hits = e.search(str(src), "parse token", 5).collect()
    assert hits[0].rel_path == "a/main.go" and hits[-1].rel_path == "OWNERS" and not hits[0].stale
    assert e.search(str(src / "a"), "walk parse token").count() == 1
    with pytest.raises(Refused):
        e.index(str(src / "a"))
    tree(src, {"b.py": "def fly():\n    pass\n", "c.md": "# new\n"})
    os.remove(src / "OWNERS")
    assert e.index(str(src)) | {"files": 0, "chunks": 0} == {"added": 1, "modified": 1, "deleted": 1, "files": 0, "chunks": 0}
    assert "indexed" in e.status(str(src)) and e.index(str(src))["added"] == 0
    e.clear(str(src))
    assert e.state(str(src)) is None


def test_patterns_may_hold_commas(tmp_path, spark):
    tree(tmp_path, {"x,y.log": "a", "x": "b"})
    assert [r.rel_path for r in w.scan(spark, str(tmp_path), ["x,y.log"]).collect()] == ["x"]
    assert [(r.rel_path, r.size) for r in w.listing(spark, str(tmp_path)).orderBy("rel_path").collect()] == [("x", 1), ("x,y.log", 1)]
    assert [r.rel_path for r in w.scan(spark, str(tmp_path), only=["x", "gone"]).collect()] == ["x"]


def test_stream_sees_new_older_and_resized_files(spark, tmp_path):
    src = tmp_path / "src"
    tree(src, {"a.py": "a = 1\n"})

    def batch(n):
        w.scan(spark, str(src))  # registers the source
        s = spark.readStream.format("codewalk").option("root", str(src)).option("state", str(tmp_path / "seen")).load()
        out = f"{tmp_path}/out{n}"
        q = s.writeStream.foreachBatch(lambda df, i: df.select("rel_path").write.mode("append").parquet(out)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r.rel_path for r in spark.read.schema("rel_path string").parquet(out).collect()) if os.path.exists(out) else []

    assert batch(0) == ["a.py"]
    at = os.stat(src / "a.py").st_mtime
    tree(src, {"old.py": "b = 2\n", "same.py": "c = 3\n"})
    os.utime(src / "old.py", (at - 1000, at - 1000))
    os.utime(src / "same.py", (at, at))
    assert batch(1) == ["old.py", "same.py"]
    tree(src, {"a.py": "a = 10\n"})
    os.utime(src / "a.py", (at, at))
    assert batch(2) == ["a.py"]


def test_only_changed_files_are_opened_and_search_reads_no_tree(spark, tmp_path, monkeypatch):
    src, base = tmp_path / "src", f"file://{tmp_path}/base"
    tree(src, {f"d/f{i}.py": f"def fun_{i}():\n    return {i}\n" for i in range(5)})
    e = Engine(spark, base, ignore=["*.skip"])
    e.index(str(src))
    asked = []
    real = w.read_listed
    monkeypatch.setattr("quarrylight.api.read_listed", lambda df: asked.append(sorted(r.rel_path for r in df.collect())) or real(df))
    tree(src, {"d/f1.py": "def other():\n    return 100\n", "d/x.skip": "no", "d/y.tmp": "no"})
    e.index(str(src), ignore=["*.tmp"])
    assert asked == [["d/f1.py"]]
    assert list(e.state(str(src)).ignore_patterns) == ["*.skip", "*.tmp"]
    name = e.collection(os.path.realpath(src))
    rows = e.store.read(name).collect()
    assert len(rows) == 5 and all(len(r.embedding) == e.dimension and r.n_terms > 0 for r in rows)
    os.utime(src / "d/f2.py", (3, 3))
    before = e.store.version(name)
    assert e.index(str(src))["modified"] == 0 and asked[-1] == ["d/f2.py"] and e.store.version(name) == before
    assert e.index(str(src))["modified"] == 0 and asked[-1] == []
    hits = e.search(str(src), "other", 3)
    assert hits.collect()[0].rel_path == "d/f1.py"
    plan = e.store.postings(name, ["other"])._jdf.queryExecution().toString()
    assert "EqualTo(term,other)]" in plan and "EqualTo(bucket," in plan


def test_interrupted_runs_locks_and_moves(spark, tmp_path):
    src, base = tmp_path / "src", f"file://{tmp_path}/base"
    tree(src, {"a.py": "a = 1\n"})
    e, root = Engine(spark, base), os.path.realpath(src)
    e.index(root)
    e._put(root, status="indexing")  # as a program that died leaves it
    assert e.index(root)["files"] == 1 and e.state(root).status == "indexed"
    e._put(root, status="indexing")
    assert e.recover(root) and e.state(root).status == "failed"
    with e._lock(root):
        with pytest.raises(Refused, match="in progress"):
            e.index(root)
        with pytest.raises(Refused):
            e.clear(root, wait=0.5)
        e._put(root, status="indexing")
        assert not e.recover(root)
        assert e.search_text(f"{root}", "a").startswith("The index is not complete yet.")
    with pytest.raises(Refused, match="started in"):
        e.index(os.path.dirname(os.getcwd()))
    src.rename(tmp_path / "moved")
    assert e.repair_moved() == [root] and e.roots() == []
