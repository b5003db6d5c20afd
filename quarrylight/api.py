"""Index, search, clear and status of code roots: the operations a client calls."""

from __future__ import annotations

import hashlib
import os
import socket
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.config import Settings
from quarrylight.functions.code import query_terms, result_text, status_line, terms
from quarrylight.functions.languages import read_as
from quarrylight.operators import manifest, search, symbols
from quarrylight.operators.chunking import OVERLAP, SIZE, build_chunks
from quarrylight.operators.filters import compile_filter, search_filter
from quarrylight.sources.lock import Lock
from quarrylight.sources.store import ChunkStore, NoCollection
from quarrylight.sources.versioned import VersionedTable
from quarrylight.sources.walk import SKIPPED, listing, read_listed, scan

MANIFEST = "rel_path string, hash string, chunk_count int, size bigint, mtime_ns bigint"
STATE = "path string, status string, operation string, step string, ignore_patterns array<string>, indexed_files long, total_chunks long, error_message string, started_at timestamp, last_updated timestamp"


class Refused(RuntimeError):
    """The call cannot be served in the state the root is in."""


def bag_of_terms(text: Column, dimension: int) -> Column:
    """Deterministic stand-in for an embedding model: counts of hashed terms."""
    slots = F.transform(terms(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dimension)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda d: F.size(F.filter(slots, lambda s: s == d)).cast("float"))


class Engine:
    """An index over roots below one base folder.

    ``embed`` makes a vector column of a text column; ``scorer`` (optional) reranks. Both are expressions or pandas UDFs. ``ignore``
    are patterns for all roots; those of a call come after them.
    """

    def __init__(
        self, spark: SparkSession, base: str, dimension: int = 64, size: int = SIZE, overlap: int = OVERLAP, mode: str = "ast", embed: Callable[[Column, int], Column] = bag_of_terms, scorer=None, ignore: list[str] | tuple[str, ...] = (), sync_seconds: int = 60
    ):
        if dimension <= 0 or size <= 0 or not 0 <= overlap < size:
            raise ValueError("dimension and chunk size have to be positive, the overlap less than the size")
        self.spark, self.base, self.dimension, self.size, self.overlap, self.mode, self.embed, self.scorer = spark, base.rstrip("/"), dimension, size, overlap, mode, embed, scorer
        self.ignore, self.sync_seconds = list(ignore), sync_seconds
        self.store = ChunkStore(spark, f"{self.base}/collections")

    def collection(self, root: str) -> str:
        return "code_chunks_" + hashlib.md5(f"{socket.gethostname().lower()}:{root}".encode()).hexdigest()

    def _root(self, path: str) -> str:
        real = os.path.realpath(path)
        if not os.path.isdir(real):
            raise Refused(f"{path} is no folder")
        return real

    def _kept(self, kind: str, root: str, schema: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.base}/{kind}/{self.collection(root)}", self.spark.createDataFrame([], schema).schema)

    def _save(self, kind: str, root: str, schema: str, rows: DataFrame) -> None:
        """The next version, which stands for the whole table; the one before stays for those who read it."""
        t = self._kept(kind, root, schema)
        v = t.latest()
        t.publish(rows, 0 if v is None else v + 1, whole=True)
        t.forget(t.versions()[:-2])

    def _lock(self, root: str) -> Lock:
        return Lock(self.spark, f"{self.base}/locks/{self.collection(root)}")

    def _job(self, root: str) -> str:
        return f"quarrylight-{self.collection(root)}"

    def _load(self, kind: str, root: str, schema: str) -> DataFrame:
        t = self._kept(kind, root, schema)
        v = t.latest()
        return self.spark.createDataFrame([], schema) if v is None else t.read_only(v)

    def state(self, root: str):
        return self._load("state", root, STATE).first()

    def _put(self, root: str, **now) -> None:
        old = self.state(root)
        row = (old.asDict() if old else dict.fromkeys(self.spark.createDataFrame([], STATE).columns)) | now | {"path": root, "last_updated": datetime.now(UTC).replace(tzinfo=None)}
        self._save("state", root, STATE, self.spark.createDataFrame([row], STATE))

    def managed_ancestor(self, root: str) -> str | None:
        up = os.path.dirname(root)
        while True:
            if self.state(up):
                return up
            if up == os.path.dirname(up):
                return None
            up = os.path.dirname(up)

    def effective_ignore(self, asked: list[str] | None, stored: list[str] | None) -> list[str]:
        """Patterns of the settings, then those asked for now or, if none are, at the run before."""
        return list(dict.fromkeys([*self.ignore, *(asked if asked is not None else stored or [])]))

    def recover(self, root: str) -> bool:
        """A root that says it is being indexed though nobody is at it was left by a program that died; it has failed then."""
        s = self.state(root)
        if s and s.status == "indexing" and self._lock(root).holder() is None:
            self._put(root, status="failed", error_message="the run was interrupted; index again to go on")
            return True
        return False

    def index(self, path: str, reindex: bool = False, ignore: list[str] | None = None) -> dict:
        """Index a folder, or bring its index up to date: only what was added or changed is opened and chunked again.

        One run a root at a time. Chunks are committed before the manifest, and the manifest before the state: a run that dies
        between them leaves a manifest that is behind, and the next one does that part again.
        """
        root = self._root(path)
        here = os.path.realpath(os.getcwd())
        if here.startswith(root.rstrip("/") + "/"):
            raise Refused(f"{root} holds the folder this program was started in")
        if above := self.managed_ancestor(root):
            raise Refused(f"{root} is part of {above}, which is indexed already")
        lock = self._lock(root)
        if not lock.acquire():
            raise Refused("indexing is in progress")
        try:
            return self._index(root, reindex, ignore)
        finally:
            lock.release()

    def _index(self, root: str, reindex: bool, ignore: list[str] | None) -> dict:
        old_state = self.state(root)
        if old_state and old_state.status == "indexing":  # the lock was free
            self._put(root, status="failed", error_message="the run was interrupted")
            old_state = self.state(root)
        stored = list(old_state.ignore_patterns) if old_state and old_state.ignore_patterns is not None else None
        if reindex:
            self._forget(root)
            old_state = None
        name = self.collection(root)
        if old_state and not self.store.exists(name):
            raise Refused("the collection is gone; index again with reindex")
        self.store.create(name, self.dimension)
        patterns = self.effective_ignore(ignore, stored)
        self._put(root, status="indexing", operation="incremental" if old_state else "full", step="scan", ignore_patterns=patterns, started_at=datetime.now(UTC).replace(tzinfo=None), error_message=None)
        held: list[DataFrame] = []
        self.spark.sparkContext.setJobGroup(self._job(root), f"indexing {root}", True)
        try:
            there = listing(self.spark, root, patterns)
            old = self._load("manifest", root, MANIFEST)
            opened = read_listed(manifest.needs_hash(there, old, ["rel_path"]))
            opened = opened.withColumn("ext", read_as(F.col("ext"), F.col("content"))).persist()
            held.append(opened)
            carried = there.join(old.where("hash is not null"), "rel_path").where((there["size"] == old["size"]) & (there["mtime_ns"] == old["mtime_ns"]))
            now = carried.select("rel_path", "hash", "chunk_count", there["size"], there["mtime_ns"]).unionByName(opened.select("rel_path", "hash", F.lit(0).alias("chunk_count"), "size", "mtime_ns")).persist()
            held.append(now)
            changes = manifest.diff(now, old).persist()
            held.append(changes)
            counts = manifest.change_counts(changes).first().asDict()
            if any(counts.values()):
                self._put(root, step="chunks")
                fresh = build_chunks(manifest.files_to_process(opened, changes), root, self.size, self.overlap, self.mode)
                self.store.replace_files(name, manifest.removed_paths(changes), fresh.withColumn("embedding", self.embed(F.col("content"), self.dimension)))
            if any(counts.values()) or opened.limit(1).count():  # files that were only touched change the manifest alone
                per_file = manifest.chunk_counts(self.store.read(name))
                self._save("manifest", root, MANIFEST, manifest.with_chunk_counts(now, per_file).select("rel_path", "hash", "chunk_count", "size", "mtime_ns"))
            rows = self.store.read(name)
            total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rel_path").alias("f")).first()
            self._put(root, status="indexed", step="done", indexed_files=total.f, total_chunks=total.n)
            return counts | {"files": total.f, "chunks": total.n}
        except Exception as e:
            hint = " (what is done is kept; index again to go on)" if "try again" in str(e).lower() else ""
            self._put(root, status="failed", error_message=str(e)[:500] + hint)
            raise
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            for df in held:
                df.unpersist()

    def _serving(self, path: str) -> tuple[str, str, object]:
        """The real path, the nearest root at or above it that can be searched, and its state."""
        real = self._root(path)
        root = real
        while not ((s := self.state(root)) and s.status in ("indexed", "indexing")):
            if root == os.path.dirname(root):
                raise NoCollection(f"{real} is not indexed")
            root = os.path.dirname(root)
        return real, root, s

    def search(self, path: str, question: str, limit: float | None = None, extensions: list[str] = (), rerank_by: str | None = None) -> DataFrame:
        """The best chunks for a question below ``path``, each with the symbol around it and whether its file has changed.

        Vectors and postings are those stored with the chunks: no text is embedded but the question's, none is read but the hits',
        and of the tree the files of the hits only.
        """
        real, root, s = self._serving(path)
        keep = compile_filter(search_filter(root, real, list(extensions)))
        name, limit = self.collection(root), search.search_limit(limit)
        chunks = self.store.read(name)
        asked = [float(x) for x in self.spark.range(1).select(self.embed(F.lit(question), self.dimension).alias("v")).first().v]
        wide, deep = search.pools(limit, self.scorer is not None)
        dense = search.dense_topk(chunks if keep is None else chunks.where(keep), asked, wide)
        about = chunks.select("id", "n_terms", "rel_path", "ext", "start_line", "end_line")
        sparse = search.bm25_indexed(self.store.postings(name, query_terms(question)), about, question, deep, keep)
        hits = search.fused_search(dense, sparse, chunks, question, limit, keep, self.scorer, query=rerank_by)
        held = self.spark.createDataFrame(hits.collect(), hits.schema)  # at most 20 rows
        near = scan(self.spark, root, list(s.ignore_patterns or []), sorted({r.rel_path for r in held.select("rel_path").collect()}))
        return search.stale_hits(search.enclosing_symbols(held, symbols.symbols(near)), near, self._load("manifest", root, MANIFEST)).orderBy("rank")

    @classmethod
    def configured(cls, spark: SparkSession, settings: Settings, scorer=None) -> Engine:
        """An engine by settings; ``scorer`` counts only if they ask for one."""
        return cls(spark, settings.base, settings.dimension, settings.chunk_size, settings.overlap, settings.splitter, scorer=scorer if settings.rerank == "scorer" else None, ignore=settings.ignore, sync_seconds=settings.sync_seconds)

    def search_text(self, path: str, question: str, limit: float | None = None, extensions: list[str] = ()) -> str:
        """The hits of ``search`` as one text."""
        hits = self.search(path, question, limit, extensions)
        shown = hits.select("rank", result_text(*(F.col(c) for c in ("rank", "rel_path", "start_line", "end_line", "ext", "content", "symbol", "symbol_kind", "stale"))).alias("t"))
        found = "\n\n".join(r.t for r in shown.orderBy("rank").collect())  # at most 20 rows
        busy = self._serving(path)[2].status == "indexing"
        return ("The index is not complete yet.\n\n" if busy else "") + (found or "Nothing was found.")

    def _forget(self, root: str) -> None:
        """Remove collection, manifest and state; what can be removed is, whatever fails."""
        failed = None
        for drop in (lambda: self.store.drop(self.collection(root)), lambda: self._kept("manifest", root, MANIFEST).drop(), lambda: self._kept("state", root, STATE).drop()):
            try:
                drop()
            except Exception as e:
                failed = failed or e
        if failed:
            raise failed

    def clear(self, path: str, wait: float = 60.0) -> None:
        """Remove the index of a root. A run that is at it in this session is cancelled and waited for."""
        root = os.path.realpath(path)
        lock, until = self._lock(root), time.monotonic() + wait
        while not lock.acquire():
            self.spark.sparkContext.cancelJobGroup(self._job(root))
            if time.monotonic() > until:
                raise Refused("indexing is in progress and does not end")
            time.sleep(0.2)
        try:
            self._forget(root)
        finally:
            lock.release()

    def roots(self) -> list[str]:
        """All roots that have a state."""
        t = self._kept("state", "", STATE)
        fs, p = t._fs(f"{self.base}/state")
        tables = [VersionedTable(self.spark, f"{self.base}/state/{s.getPath().getName()}", t.schema) for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(r.path for x in tables if x.versions() and (r := x.read_only(x.latest()).first()))

    def repair_moved(self) -> list[str]:
        """Clear roots whose folder is gone or is now another one (a link, a move); the paths that were cleared."""
        moved = [r for r in self.roots() if os.path.realpath(r) != r or not os.path.isdir(r)]
        for r in moved:
            lock = self._lock(r)
            if lock.acquire():
                try:
                    self._forget(r)
                finally:
                    lock.release()
        return moved

    def status(self, path: str) -> str:
        root = os.path.realpath(path)
        at = root if self.state(root) else self.managed_ancestor(root)
        if at is None:
            raise NoCollection(f"{root} is not indexed")
        return self._load("state", at, STATE).select(status_line().alias("line")).first().line


__all__ = ["Engine", "Refused", "SKIPPED", "bag_of_terms"]
