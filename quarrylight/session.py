"""Session-level helpers: shared scratch space, checked broadcasts, table loading."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when a count of its rows stays at or below this.
BROADCAST_ROWS = 50_000
#: Salts spread over a hot key when its small side is too large to broadcast.
SALTS = 32


_left: dict[str, list] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by all executors: the session's ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder of this machine is set in local mode; on a cluster, whose executors would each write to
    a disk of their own, it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        shared = "file://" + os.path.join(tempfile.gettempdir(), "quarrylight-scratch")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new place in the shared folder, removed by ``release`` or when this program ends."""
    path = f"{scratch_root(spark)}/quarrylight/{what}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_release_all)
    _left.setdefault(spark.sparkContext.applicationId, []).append((spark, path))
    return path


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables of this session; results that were not read yet cannot be read any more."""
    for s, path in _left.pop(spark.sparkContext.applicationId, []):
        _delete(s, path)


def _release_all() -> None:
    for app in list(_left):
        for s, path in _left.pop(app):
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file:").removeprefix("//"), ignore_errors=True)
            elif s.sparkContext._jsc is not None:  # the session has not been stopped
                _delete(s, path)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage is cut and any executor may be lost."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``rows`` rows; never reads more than ``rows + 1`` of them."""
    return df.limit(rows + 1).count() <= rows


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", spread: Column | None = None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a large side with one that is usually small.

    The small side is broadcast only after a count of its rows. Beyond the bound the join is a shuffle join whose key is
    salted by ``spread`` (a hash of a high-cardinality column of the big side), so a hot key is not one task.
    """
    if is_bounded(small, rows):
        return big.join(F.broadcast(small), on, how)
    if spread is None or how not in ("inner", "left"):
        return big.join(small, on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(F.hash(spread), F.lit(SALTS))).join(salted, [*on, "_salt"], how).drop("_salt")


def bounded_batches(spark: SparkSession, rows: int = 2_000, size: int = 16 << 20) -> None:
    """Arrow batches of at most ``rows`` rows and about ``size`` bytes, so that a Python worker holds few long texts at a time."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if now is None or not 0 < int(re.sub(r"\D", "", now) or 0) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: wherever they run, they can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_quarrylight_sent", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quarrylight-")) / "quarrylight.zip"  # read by the driver, which sends it
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, Path("quarrylight") / f.relative_to(here))
    sc.addPyFile(str(target))
    sc._quarrylight_sent = True


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInPandas`` with workers that have this package and batches of bounded size."""
    bounded_batches(df.sparkSession)
    ship(df.sparkSession)
    return df.mapInPandas(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
