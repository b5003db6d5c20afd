"""A lock of a root that one program at a time holds, kept as a file that is created once.

Whoever holds it is named in it: host, process and time of the last sign of life. It is free again if its holder let it go, if
the holder's process on this host is gone, or if a holder on another host gave no sign of life for ``EXPIRES`` seconds.
"""

from __future__ import annotations

import json
import os
import socket
import threading
import time
import uuid

from pyspark.sql import SparkSession

from quarrylight.sources.versioned import VersionedTable

EXPIRES = 600.0
BEAT = 60.0


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


class Lock:
    """``with Lock(...)`` or ``acquire`` and ``release``; a thread gives signs of life while it is held."""

    def __init__(self, spark: SparkSession, path: str):
        # A log of owners: taking the lock is committing its next version, which no other can commit too.
        self.log = VersionedTable(spark, path, spark.createDataFrame([], "x int").schema)
        self.spark, self.token, self._stop = spark, uuid.uuid4().hex, threading.Event()

    def _write(self, name: str, **what) -> None:
        fs, p = self.log._fs(f"{self.log.path}/signs/{name}")
        out = fs.create(p, True)
        out.write(bytearray((json.dumps(what) + "\n").encode()))
        out.close()

    def _sign(self, name: str) -> dict | None:
        fs, p = self.log._fs(f"{self.log.path}/signs/{name}")
        if not fs.exists(p):
            return None
        jvm = self.spark._jvm
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
        try:
            line = lines.readLine()
        finally:
            lines.close()
        return json.loads(line) if line else None

    def holder(self) -> dict | None:
        """Who holds it now, or None."""
        last = self.log.latest()
        if last is None:
            return None
        sign = self._sign(self.log.commit_of(last)["data"])
        if sign is None or sign.get("free"):
            return None
        if sign["host"] == socket.gethostname():
            return sign if _alive(sign["pid"]) else None
        return sign if time.time() - sign["at"] < EXPIRES else None

    def _here(self) -> None:
        self._write(self.token, host=socket.gethostname(), pid=os.getpid(), at=time.time())

    def acquire(self) -> bool:
        """Take it if it is free; False if another holds it."""
        if self.holder() is not None:
            return False
        last = self.log.latest()
        self._here()
        try:
            self.log._commit(0 if last is None else last + 1, self.token, False)
        except FileExistsError:
            self._write(self.token, free=True)
            return False
        if last is not None:
            self._clean(last)

        def beat() -> None:
            while not self._stop.wait(BEAT):
                self._here()

        self._stop.clear()
        threading.Thread(target=beat, daemon=True).start()
        return True

    def _clean(self, upto: int) -> None:
        for v in self.log.versions():
            if v <= upto:
                for name in (f"signs/{self.log.commit_of(v)['data']}", f"commits/v={v}"):
                    fs, p = self.log._fs(f"{self.log.path}/{name}")
                    fs.delete(p, False)

    def release(self) -> None:
        self._stop.set()
        self._write(self.token, free=True)

    def __enter__(self) -> Lock:
        if not self.acquire():
            raise BlockingIOError(f"held by {self.holder()}")
        return self

    def __exit__(self, *_) -> None:
        self.release()
