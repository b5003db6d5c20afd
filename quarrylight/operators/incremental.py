"""Processing only new or changed records, with the target as the only state.

Output rows carry the source key and the source version they were made from. A run anti-joins all that is visible to it against the
target by key and version, processes what is left, and publishes its rows as a new target version by one commit that no other
writer of that version can repeat. A run that dies publishes nothing, so the next one finds the same records again; a run after a
success finds none of them. A backlog of runs is caught up with run by run, each against the target that the one before has published,
so a record that reaches the feed after the run it was meant for comes out at the next run. That reads the source and the target once a run.

Defined results
* rows with a null hash (unreadable), root, rel_path, ``loaded_at`` or ``seen_at`` are no observation;
* of several observations of a key the one with the greatest ``(seen_at, obs_id)`` counts, repeated rows change nothing;
* an observation that arrives late and is older than the stored version is not new;
* an empty source publishes an empty version; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.operators.snapshot_diff import successful_runs
from quarrylight.session import is_bounded, join_small, materialise, scratch_path
from quarrylight.sources.versioned import VersionedTable

KEYS = ["root", "rel_path"]
TARGET = T.StructType(
    [
        T.StructField("root", T.StringType()),
        T.StructField("rel_path", T.StringType()),
        T.StructField("seen_at", T.TimestampType()),
        T.StructField("obs_id", T.LongType()),
        T.StructField("hash", T.StringType()),
        T.StructField("run_id", T.LongType()),
        T.StructField("changed", T.BooleanType()),
    ]
)


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key, the one of the greatest version; combined before the shuffle, so a hot key is no hot task."""
    rest = [c for c in ("hash", "run_id", "changed") if c in rows.columns]
    return rows.groupBy(*keys).agg(F.max(F.struct("seen_at", "obs_id", *rest)).alias("_v")).select(*keys, "_v.*")


def new_records(source: DataFrame, state: DataFrame) -> DataFrame:
    """Source rows whose key and version, or a later version of whose key, the target does not hold yet."""
    s, t = source.alias("s"), state.alias("t")
    same = (F.col("s.root") == F.col("t.root")) & (F.col("s.rel_path") == F.col("t.rel_path"))
    held = F.struct("t.seen_at", "t.obs_id") >= F.struct("s.seen_at", "s.obs_id")
    return s.join(t, same & held, "left_anti")


def advanced(source: DataFrame, state: DataFrame) -> DataFrame:
    """The target rows of one run: what ``state`` does not hold of ``source``, and whether its hash is another. Both have a row a key."""
    was = state.select(*KEYS, F.col("hash").alias("_was"))
    fresh = new_records(source, state).join(was, KEYS, "left")
    return fresh.withColumn("changed", F.col("_was").isNull() | (F.col("_was") != F.col("hash"))).select(*TARGET.names)


def run_once(source: DataFrame, target: VersionedTable, version: int) -> None:
    """One incremental run: ``source`` is all that is visible to it (``KEYS, seen_at, obs_id, hash, run_id``)."""
    if version in target.versions():
        return
    state = newest(target.read().select(*KEYS, "seen_at", "obs_id", "hash"), KEYS)
    target.publish(advanced(newest(source, KEYS), state), version)


def clean_entries(entries: DataFrame) -> DataFrame:
    return entries.select("root", "rel_path", F.col("seen_at").cast("timestamp").alias("seen_at"), "obs_id", F.lower("hash").alias("hash"), F.col("loaded_at").cast("timestamp").alias("loaded_at")).where(
        "hash is not null and root is not null and rel_path is not null and loaded_at is not null and seen_at is not null"
    )


def replay(spark: SparkSession, entries: DataFrame, runs: DataFrame, path: str | None = None) -> DataFrame:
    """``run_id, root, rel_path``: what every successful run after a root's first had to process.

    The k-th successful runs of all roots share a version, and each version is an incremental run of its own. A run that is
    reported when its version is there already is passed over: what it would have found comes out at its root's next run.
    """
    ok = materialise(successful_runs(runs).withColumn("started_at", F.col("started_at").cast("timestamp")), "runs")
    rows = clean_entries(entries)
    target = VersionedTable(spark, path or scratch_path(spark, "incremental-target"), TARGET)
    last = ok.agg(F.max("k")).first()[0]
    for k in range(0 if last is None else last + 1):
        now = ok.where(F.col("k") == k).select("root", "started_at", "run_id")
        run_once(join_small(rows, now, ["root"], spread=F.col("rel_path")).where("loaded_at <= started_at"), target, k)
    first_runs = ok.where("k = 0").select("run_id", "root")
    found = target.read().where("changed")
    kept = found.join(F.broadcast(first_runs), ["run_id", "root"], "left_anti") if is_bounded(first_runs) else found.join(first_runs, ["run_id", "root"], "left_anti")
    return kept.select("run_id", "root", "rel_path")
