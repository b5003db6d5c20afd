"""The chunk store: one versioned table a collection, changed by whole new versions, and its index of terms.

A version is complete when it appears; readers of the one before are not disturbed, and a writer that dies leaves nothing. Upserts
and deletions are one join against the current version, so no row is rewritten twice in a run. A chunk is stored with its vector,
whose length is checked, and its number of terms.

The index of terms is a log of postings ``term, id, tf`` in buckets of the terms' hashes. A run appends the postings of its chunks;
those of chunks that are gone find no chunk when they are read, and go when the log is compacted. A question reads the buckets of
its own terms and no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.code import terms
from quarrylight.operators.filters import compile_filter
from quarrylight.sources.versioned import VersionedTable

SCHEMA = "id string, content string, rel_path string, start_line int, end_line int, ext string, metadata string, n_terms int, embedding array<float>"
POSTINGS = "bucket int, term string, id string, tf int"
#: Buckets of the index of terms, and versions of it after which it is written anew.
BUCKETS, LOG = 64, 16


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class NoCollection(LookupError):
    """There is no such collection."""


class ModeMismatch(ValueError):
    """A collection exists with another dimension or kind."""


class ChunkStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.schema = spark.createDataFrame([], SCHEMA).schema

    def _table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.base}/{name}", self.schema)

    def _postings(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.base}/{name}/_postings", self.spark.createDataFrame([], POSTINGS).schema)

    def dimension(self, name: str) -> int | None:
        mode = self._mode(name)
        return mode.read().first().dimension if mode.versions() else None

    def _mode(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.base}/{name}/_mode", self.spark.createDataFrame([], "dimension int, hybrid boolean").schema)

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows with all columns; a vector of another length than the collection's is an error."""
        n = self.dimension(name)
        vector = F.col("embedding").cast("array<float>") if "embedding" in rows.columns else F.lit(None).cast("array<float>")
        size = F.size(vector)
        checked = F.when(vector.isNull() | (size == n), vector).otherwise(F.raise_error(F.concat(F.lit(f"vectors of {n} dimensions are expected, found "), size.cast("string"))))
        count = F.size(terms(F.coalesce(F.col("content"), F.lit(""))))
        return rows.select(*(c for c in self.schema.names if c not in ("n_terms", "embedding")), count.alias("n_terms"), checked.alias("embedding"))

    def exists(self, name: str) -> bool:
        return bool(self._table(name).versions())

    def collections(self) -> list[str]:
        t = self._table("")
        fs, p = t._fs(self.base)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and self.exists(s.getPath().getName())) if fs.exists(p) else []

    def create(self, name: str, dimension: int = 1024, hybrid: bool = True) -> None:
        """An empty collection; nothing if it is there in the same way, an error if in another."""
        mode = self._mode(name)
        if mode.versions():
            have = mode.read().first()
            if (have.dimension, have.hybrid) != (dimension, hybrid):
                raise ModeMismatch(f"{name} has dimension {have.dimension}, hybrid {have.hybrid}")
        else:
            mode.publish(self.spark.createDataFrame([(dimension, hybrid)], "dimension int, hybrid boolean"), 0)
        if not self.exists(name):
            self._table(name).publish(self.spark.createDataFrame([], self.schema), 0)

    def drop(self, name: str) -> None:
        """Success if it is not there."""
        self._table(name).drop()

    def read(self, name: str, keep: str | None = None) -> DataFrame:
        t = self._table(name)
        v = t.latest()
        if v is None:
            raise NoCollection(name)
        rows = t.read_only(v)
        pred = compile_filter(keep)
        return rows if pred is None else rows.where(pred)

    def query(self, name: str, keep: str, limit: int = 16_384) -> DataFrame:
        return self.read(name, keep).orderBy("rel_path", "start_line", "id").limit(limit)

    def version(self, name: str) -> int | None:
        return self._table(name).latest()

    def _next(self, name: str, rows: DataFrame) -> None:
        t = self._table(name)
        v = t.latest()
        t.publish(rows.select(*self.schema.names), 0 if v is None else v + 1)

    def _index(self, name: str, rows: DataFrame) -> None:
        """Append the postings of ``rows``; a log that has grown long is written anew from the chunks that are left."""
        t = self._postings(name)
        v = t.latest()
        v = 0 if v is None else v + 1
        long = len(t.versions()) >= LOG
        of = self.read(name).select("id", "content").join(rows.select("id"), "id", "left_anti").unionByName(rows.select("id", "content")) if long else rows
        words = of.select("id", F.explode(terms(F.coalesce(F.col("content"), F.lit("")))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        found = words.select(bucket_of(F.col("term")).alias("bucket"), "term", "id", "tf").repartition(F.col("bucket")).sortWithinPartitions("bucket", "term")
        if long:
            t.compact(found, v)
        else:
            t.publish(found, v)

    def postings(self, name: str, words: list[str]) -> DataFrame:
        """``term, id, tf`` of these terms, of live and of gone chunks; the filter on buckets and terms reaches the scan."""
        t = self._postings(name)
        buckets = [r.b for r in self.spark.createDataFrame([(w,) for w in words] or [("",)], "w string").select(bucket_of(F.col("w")).alias("b")).distinct().collect()]
        return t.read().where(F.col("bucket").isin(buckets)).where(F.col("term").isin(words)).groupBy("term", "id").agg(F.max("tf").alias("tf"))

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows in, the last one of an id stays."""
        new = self._shaped(name, rows).dropDuplicates(["id"]).persist()
        try:
            self._index(name, new)
            self._next(name, self.read(name).join(new.select("id"), "id", "left_anti").select(*self.schema.names).unionByName(new))
        finally:
            new.unpersist()

    def delete(self, name: str, keep_not: str) -> None:
        pred = compile_filter(keep_not, deleting=True)
        self._next(name, self.read(name).where(~F.coalesce(pred, F.lit(False))))

    def delete_ids(self, name: str, ids: DataFrame) -> None:
        self._next(name, self.read(name).join(ids.select("id").distinct(), "id", "left_anti"))

    def replace_files(self, name: str, removed: DataFrame, new: DataFrame) -> None:
        """Chunks of ``removed`` paths out, ``new`` ones in, as one version: no reader sees a file half replaced.

        Postings come first: those of chunks that are not there yet are read by nobody.
        """
        fresh = self._shaped(name, new).dropDuplicates(["id"]).persist()
        try:
            self._index(name, fresh)
            kept = self.read(name).join(removed.select("rel_path").distinct(), "rel_path", "left_anti").join(fresh.select("id"), "id", "left_anti")
            self._next(name, kept.select(*self.schema.names).unionByName(fresh))
        finally:
            fresh.unpersist()

    def vacuum(self, name: str) -> None:
        """Drop all versions but the current one."""
        t = self._table(name)
        t.forget(t.versions()[:-1])
