import os
import time

import pytest

from quarrylight.api import Engine
from quarrylight.config import BadSetting, Settings
from quarrylight.streaming import sync


def test_settings():
    s = Settings.from_env({"QUARRYLIGHT_BASE": "/x", "QUARRYLIGHT_IGNORE": " *.md, ,b/ ", "QUARRYLIGHT_OVERLAP": "0"})
    assert (s.chunk_size, s.overlap, s.ignore, s.splitter, s.sync_seconds) == (4000, 0, ("*.md", "b/"), "ast", 60)


@pytest.mark.parametrize("bad", [{"BASE": ""}, {"DIMENSION": "0"}, {"CHUNK_SIZE": "x"}, {"OVERLAP": "4000"}, {"SPLITTER": "tree"}, {"RERANK": "magic"}, {"SYNC_SECONDS": "-1"}])
def test_bad_settings(bad):
    with pytest.raises(BadSetting):
        Settings.from_env({"QUARRYLIGHT_BASE": "/x"} | {f"QUARRYLIGHT_{k}": v for k, v in bad.items()})


def test_watch_brings_indexed_roots_up_to_date(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.py").write_text("def a():\n    return 'alpha'\n")
    root = str(tmp_path / "r")
    e = Engine.configured(spark, Settings(f"file://{tmp_path}/base", dimension=16))
    assert sync.watch(e, [root], 0) is None and sync.due(e, [root]) == []
    e.index(root)
    text = e.search_text(root, "alpha")
    assert text.startswith("### 1. a.py:1-3\nin function a\n```py\n") and e.search_text(root, "alpha", extensions=["go"]) == "Nothing was found."
    (tmp_path / "r/a.py").unlink()
    (tmp_path / "r/b.py").write_text("b = 1\n")
    q = sync.watch(e, [root], 1)
    try:
        for _ in range(120):
            time.sleep(0.5)
            if (s := e.state(root)) and s.status == "indexed" and [r.rel_path for r in e.store.read(e.collection(root)).collect()] == ["b.py"]:
                break
        else:
            pytest.fail("never brought up to date")
    finally:
        q.stop()
    e.clear(root)


def test_scratch_is_shared_or_refused_and_released(spark):
    from types import SimpleNamespace

    from quarrylight import session

    unset = SimpleNamespace(get=lambda *a: None, set=lambda *a: None)
    at = lambda master: SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, getConf=lambda: unset))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(at("spark://host:7077"))
    assert session.scratch_root(at("local[4]")).startswith("file:")
    kept = session.materialise(spark.range(3), "kept")
    path = session._left[spark.sparkContext.applicationId][-1][1].removeprefix("file://")
    assert kept.count() == 3 and os.path.isdir(path)
    session.release(spark)
    assert not os.path.exists(path)
