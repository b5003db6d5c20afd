"""Manifest algebra: which files changed, what has to be processed, what is stale, how totals move.

A manifest is a keyed table ``rel_path, hash, chunk_count, size, mtime_ns``; keys may have more columns (a root).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.snapshot_diff import ADDED, DELETED, MODIFIED, snapshot_diff

KEY = ["rel_path"]


def needs_hash(files: DataFrame, old: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Files whose size or mtime differ from the manifest: only these have to be read and hashed."""
    o = old.select(*key, F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"))
    return files.join(o, key, "left").where(F.col("_size").isNull() | (F.col("size") != F.col("_size")) | (F.col("mtime_ns") != F.col("_mtime"))).drop("_size", "_mtime")


def diff(files: DataFrame, old: DataFrame, key: list[str] = KEY) -> DataFrame:
    """``key, change_type`` of current files against a manifest.

    Same size and mtime: no change, whatever the hash. A null hash (unreadable) keeps the old entry, and is nothing if new.
    """
    f = files.select(*key, F.lit(True).alias("_in"), *(F.col(c).alias(f"_{c}") for c in ("hash", "size", "mtime_ns")))
    o = old.select(*key, F.lit(True).alias("_was"), "hash", "size", "mtime_ns")
    fresh = (F.col("_size") == F.col("size")) & (F.col("_mtime_ns") == F.col("mtime_ns"))
    kind = (
        F.when(F.col("_in").isNull(), DELETED)
        .when(F.col("_hash").isNull(), None)
        .when(F.col("_was").isNull(), ADDED)
        .when(fresh | (F.col("_hash") == F.col("hash")), None)
        .otherwise(MODIFIED)
    )
    return f.join(o, key, "full_outer").withColumn("change_type", kind).where("change_type is not null").select(*key, "change_type")


def diff_by_hash(new: DataFrame, old: DataFrame, key: list[str] = KEY) -> DataFrame:
    """``key, change_type`` by hashes alone, in one aggregation."""
    return snapshot_diff(old, new, key)


def change_counts(changes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return changes.groupBy(*by).agg(*(F.count_if(F.col("change_type") == t).alias(t.lower()) for t in (ADDED, MODIFIED, DELETED)))


def files_to_process(files: DataFrame, changes: DataFrame, key: list[str] = KEY) -> DataFrame:
    return files.join(changes.where(F.col("change_type").isin(ADDED, MODIFIED)).select(*key), key, "left_semi")


def removed_paths(changes: DataFrame, key: list[str] = KEY) -> DataFrame:
    return changes.where(F.col("change_type").isin(DELETED, MODIFIED)).select(*key)


def removed_chunks(old: DataFrame, changes: DataFrame, key: list[str] = KEY, by: tuple[str, ...] = ()) -> DataFrame:
    """Number of chunks of files that were deleted or modified; unknown paths count 0."""
    return removed_paths(changes, key).join(old.select(*key, "chunk_count"), key, "left").groupBy(*by).agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("removed_chunks"))


def progress_manifest(new: DataFrame, changes: DataFrame, key: list[str] = KEY) -> DataFrame:
    """What of the new manifest holds before anything is processed."""
    return new.join(changes.where(F.col("change_type").isin(ADDED, MODIFIED)).select(*key), key, "left_anti")


def with_chunk_counts(manifest: DataFrame, counts: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Manifest with the chunk counts of ``key, n_chunks`` where there are any."""
    return manifest.join(counts.select(*key, "n_chunks"), key, "left").withColumn("chunk_count", F.coalesce("n_chunks", "chunk_count").cast("int")).drop("n_chunks")


def chunk_counts(chunks: DataFrame, key: list[str] = KEY) -> DataFrame:
    return chunks.groupBy(*key).agg(F.count(F.lit(1)).alias("n_chunks"))


def chunk_ids(chunks: DataFrame, key: list[str] = KEY) -> DataFrame:
    """``key, ids``: ids of a file in order of their lines, joined by blanks."""
    ordered = F.array_sort(F.collect_set(F.struct("start_line", "id")))
    return chunks.groupBy(*key).agg(F.concat_ws(" ", F.transform(ordered, lambda x: x["id"])).alias("ids"))


def completed_files(chunks: DataFrame, inserted: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Files all of whose chunks are inserted, and that have any."""
    n, m = chunk_counts(chunks.select(*key, "id").distinct(), key), chunk_counts(inserted.select(*key, "id").distinct(), key).withColumnRenamed("n_chunks", "n_inserted")
    return n.join(m, key).where("n_chunks = n_inserted and n_chunks > 0").select(*key, "n_chunks")


def stale_ids(old_chunks: DataFrame, new_chunks: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Ids that a file had and has no more."""
    return old_chunks.select(*key, "id").distinct().join(new_chunks.select(*key, "id"), [*key, "id"], "left_anti")


def new_total(existing: Column, removed: Column, added: Column) -> Column:
    """Total after a run; never below what the run added."""
    total = existing - removed + added
    return F.when(total < 0, added).otherwise(total)
