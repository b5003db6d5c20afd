from datetime import datetime, timedelta

import duckdb
import pytest
from tests.conftest import DATA, rows

import __spark_entry__ as entry
from quarrylight.streaming import lifecycle as li

T0 = datetime(2025, 1, 1)
EVENTS = "event_id long, path string, type string, ts timestamp"


def events(spark, *kinds):
    return spark.createDataFrame([(i, p, k, T0 + timedelta(milliseconds=ms)) for i, (p, k, ms) in enumerate(kinds)], EVENTS)


KINDS = [("a", li.PROGRESS, 0), ("a", li.STARTED, 10), ("a", li.PROGRESS, 20), ("a", li.PROGRESS, 700), ("a", li.COMPLETED, 800), ("a", li.FAILED, 900), ("a", li.STARTED, 2000), ("b", li.FAILED, 1), ("c", li.STARTED, 1), ("c", li.FAILED, 5)]


def test_states_and_throttle(spark):
    e = events(spark, *KINDS)
    assert rows(li.final_states(e)) == [("a", "indexing", 2, 6), ("b", "not_found", 0, 7), ("c", "failed", 1, 9)]
    assert sorted(r.event_id for r in li.throttled(e).collect()) == [1, 3, 4, 6, 8, 9]


def test_stream_equals_batch(spark, tmp_path):
    e = events(spark, *KINDS)
    for part in range(2):
        e.where(f"event_id % 2 = {part}" if False else ("event_id < 5" if part == 0 else "event_id >= 5")).coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
        src = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = li.state_stream(src).writeStream.outputMode("update").foreachBatch(lambda df, i, part=part: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{part}/{i}")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
    last = {r.path: tuple(r) for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out/0").collect()}
    last |= {r.path: tuple(r) for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out/1").collect()}
    assert sorted(last.values()) == rows(li.final_states(e))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    from pathlib import Path

    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return c


CORE = {k for m in entry.MODULES for k in m.SQL}


@pytest.mark.parametrize("name", sorted(CORE))
def test_sql_parity(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    r = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda row: repr([round(x, 5) if isinstance(x, float) else x for x in row])
    assert sorted(key([x[c] for c in sorted(cols)]) for x in df.collect()) == sorted(key([x[cols.index(c)] for c in sorted(cols)]) for x in r.fetchall())
