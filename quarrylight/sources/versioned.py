"""Versioned Parquet tables: a version is there when its commit file is, and a commit file is created once.

``path/data/<unique>`` holds rows, ``path/commits/v=<number>`` one line of JSON that names the folder of a version. A commit file
appears with all its content or not at all, and never over another: the second writer of a version fails. Readers follow commit
files only, so rows of a run that died before its commit are seen by nobody; the next publish removes such folders once they are
older than ``GRACE``. A commit may stand for the whole table: what was committed before it is then read no more.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Seconds for which data without a commit may belong to a writer that is still at work.
GRACE = 24 * 3600


class VersionedTable:
    """A table kept as a log of versions under ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n[2:]) for n in self._names("commits") if n.startswith("v=") and n[2:].isdigit())

    def latest(self) -> int | None:
        return max(self.versions(), default=None)

    def commit_of(self, version: int) -> dict:
        fs, p = self._fs(f"{self.path}/commits/v={version}")
        with_ = self.spark._jvm.java.io.BufferedReader(self.spark._jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
        try:
            return json.loads(with_.readLine())
        finally:
            with_.close()

    def _rows(self, commits: list[dict]) -> DataFrame:
        paths = [f"{self.path}/data/{c['data']}" for c in commits if c["data"]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the versions up to ``version`` (the latest if None), from the last one on that stands for the whole table."""
        commits: list[dict] = []
        for v in reversed([v for v in self.versions() if version is None or v <= version]):
            commits.append(self.commit_of(v))
            if commits[-1]["whole"]:
                break
        return self._rows(commits)

    def read_only(self, version: int) -> DataFrame:
        """The rows of one version."""
        return self._rows([self.commit_of(version)])

    def _commit(self, version: int, data: str | None, whole: bool) -> None:
        """Create the commit file of ``version``; an error if there is one."""
        line = json.dumps({"data": data, "whole": whole}) + "\n"
        draft, target = f"{self.path}/commits/.{uuid.uuid4().hex}", f"{self.path}/commits/v={version}"
        fs, p = self._fs(draft)
        out = fs.create(p, True)
        out.write(bytearray(line.encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":  # a link is made once; a local rename would replace
                try:
                    os.link(p.toUri().getPath(), self._fs(target)[1].toUri().getPath())
                except FileExistsError:
                    raise FileExistsError(f"version {version} of {self.path} exists") from None
                return
            try:  # a rename without overwriting is one step of the file system
                none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = none
                self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration()).rename(p, self._fs(target)[1], options)
            except Exception as e:
                if self._fs(target)[0].exists(self._fs(target)[1]):
                    raise FileExistsError(f"version {version} of {self.path} exists") from e
                raise
        finally:
            fs.delete(p, False)

    def publish(self, rows: DataFrame, version: int, whole: bool = False) -> None:
        """Write ``rows`` as ``version``; nothing is visible until all of it is."""
        if version in self.versions():
            raise FileExistsError(f"version {version} of {self.path} exists")
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        try:
            self._commit(version, name, whole)
        except BaseException:
            self._remove(name)
            raise
        self.sweep()

    def compact(self, rows: DataFrame, version: int) -> None:
        """Publish ``rows`` as a version that stands for the whole table, and drop the ones before it."""
        self.publish(rows, version, whole=True)
        self.forget([v for v in self.versions() if v < version])

    def forget(self, versions: list[int]) -> None:
        """Drop versions: their commits first, so that none is seen without its rows."""
        gone = [self.commit_of(v)["data"] for v in versions]
        for v in versions:
            fs, p = self._fs(f"{self.path}/commits/v={v}")
            fs.delete(p, False)
        for name in gone:
            if name:
                self._remove(name)

    def _remove(self, name: str) -> None:
        fs, p = self._fs(f"{self.path}/data/{name}")
        fs.delete(p, True)

    def sweep(self, grace: float = GRACE) -> None:
        """Remove data that no commit names and that no writer at work can still commit."""
        fs, p = self._fs(f"{self.path}/data")
        old = [s.getPath().getName() for s in fs.listStatus(p) if s.getModificationTime() < (time.time() - grace) * 1000] if fs.exists(p) else []
        if old:
            named = {(self.commit_of(v)["data"] or "").partition("/")[0] for v in self.versions()}
            for name in old:
                if name not in named:
                    self._remove(name)

    def drop(self) -> None:
        fs, p = self._fs(self.path)
        fs.delete(p, True)
