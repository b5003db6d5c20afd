"""What changed between full snapshots of a keyed table.

Every snapshot is one side of a union tagged by its ordinal; one aggregation by key sees all sides of a key, so any
number of consecutive snapshots costs a single shuffle and no join.

Defined results
* identical repeated rows of a key within a snapshot count once;
* of different hashes of one key within a snapshot the greatest wins, and any hash wins over null;
* a null hash (unreadable) keeps the entry, or the absence, of the snapshot before;
* rows with a null key column form a key of their own;
* an empty snapshot between two others deletes everything and adds it again;
* extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.session import join_small

ADDED, DELETED, MODIFIED = "Added", "Deleted", "Modified"


def successful_runs(runs: DataFrame) -> DataFrame:
    """``run_id, root, started_at, k, n``: the ended runs of each root, numbered 0..n-1 by start."""
    w = W.partitionBy("root")
    return (
        runs.where(F.col("status") == "indexed")
        .select("run_id", "root", "started_at")
        .distinct()
        .withColumn("k", F.row_number().over(w.orderBy("started_at", "run_id")) - 1)
        .withColumn("n", F.count(F.lit(1)).over(w).cast("int"))
    )


def clean_path(path: Column) -> Column:
    """A leading ``./`` carries no meaning."""
    return F.regexp_replace(path, r"^(\./)+", "")


def _walk(entries: str, n: str) -> Column:
    """Array of ``struct<k, change_type>`` from the key's sorted ``struct<k, h>`` entries over ``n`` snapshots."""
    change = lambda k, t: f"named_struct('k', cast({k} as int), 'change_type', '{t}')"
    empty = "cast(array() as array<struct<k:int,change_type:string>>)"
    gone = "a.h is not null and e.k > a.k + 1"
    before = f"if({gone}, null, a.h)"
    return F.expr(
        f"""aggregate({entries}, named_struct('k', -1, 'h', cast(null as string), 'out', {empty}),
        (a, e) -> named_struct(
          'k', e.k,
          'h', coalesce(e.h, {before}),
          'out', concat(a.out,
            if({gone}, array({change("a.k + 1", DELETED)}), {empty}),
            case when e.h is null or e.k = 0 then {empty}
                 when {before} is null then array({change("e.k", ADDED)})
                 when {before} <> e.h then array({change("e.k", MODIFIED)})
                 else {empty} end)),
        a -> concat(a.out, if(a.h is not null and a.k < {n} - 1, array({change("a.k + 1", DELETED)}), {empty})))"""
    )


def chain_changes(rows: DataFrame, keys: list[str], ordinal: str = "k", total: str = "n", row_hash: str = "hash") -> DataFrame:
    """``keys, k, change_type`` for every consecutive pair of snapshots 0..n-1.

    ``rows`` holds the union of all snapshots: key columns, the snapshot's ordinal, the number of snapshots of the key's
    group and the row hash. What a key gathers is bounded by the number of snapshots, not by rows.
    """
    per_key = rows.groupBy(*keys).agg(
        F.collect_set(F.struct(F.col(ordinal).cast("int").alias("k"), F.col(row_hash).cast("string").alias("h"))).alias("_seen"),
        F.max(total).alias("_n"),
    )
    # Of several entries of one ordinal the last of the sorted ones holds the greatest hash; null sorts first.
    one_each = F.expr("filter(_sorted, (x, i) -> i = size(_sorted) - 1 or _sorted[i + 1].k <> x.k)")
    return (
        per_key.withColumn("_sorted", F.sort_array("_seen"))
        .withColumn("_entries", one_each)
        .select(*keys, F.explode(_walk("_entries", "_n")).alias("_c"))
        .select(*keys, "_c.k", "_c.change_type")
    )


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], row_hash: str = "hash") -> DataFrame:
    """``keys, change_type`` between two snapshots: union tagged by side, one aggregation shuffle."""
    side = lambda df, k: df.select(*keys, F.col(row_hash).alias("hash"), F.lit(k).alias("k"), F.lit(2).alias("n"))
    return chain_changes(side(old, 0).unionByName(side(new, 1)), keys).drop("k")


def manifest_changes(manifests: DataFrame, runs: DataFrame) -> DataFrame:
    """``run_id, root, rel_path, change_type`` between consecutive successful runs of each root."""
    ok = successful_runs(runs)
    cleaned = manifests.select("run_id", "root", clean_path(F.col("rel_path")).alias("rel_path"), F.lower("hash").alias("hash"))
    tagged = join_small(cleaned, ok.select("run_id", "root", "k", "n"), ["run_id", "root"], spread=F.col("rel_path"))
    changes = chain_changes(tagged, ["root", "rel_path"])
    named = join_small(changes, ok.select("root", "k", "run_id"), ["root", "k"], spread=F.col("rel_path"))
    return named.select("run_id", "root", "rel_path", "change_type")
