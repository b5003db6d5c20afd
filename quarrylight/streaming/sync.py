"""Periodic synchronisation of indexed roots as a streaming query."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql.streaming import StreamingQuery

if TYPE_CHECKING:
    from quarrylight.api import Engine


def due(engine: Engine, roots: list[str]) -> list[str]:
    """Roots that may be synchronised now: those whose last run ended well. Runs that were left by a dead program are marked."""
    for r in roots:
        engine.recover(r)
    return [r for r in roots if (s := engine.state(r)) and s.status == "indexed"]


def sync_once(engine: Engine, roots: list[str]) -> dict[str, dict]:
    """Bring every root that is due up to date; one that fails does not hold up the others."""
    out = {}
    for r in due(engine, roots):
        try:
            out[r] = engine.index(r)
        except Exception as e:  # its state says failed, and why
            out[r] = {"error": str(e)}
    return out


def watch(engine: Engine, roots: list[str], seconds: int | None = None, **trigger) -> StreamingQuery | None:
    """Synchronise ``roots`` every ``seconds`` (the engine's setting if None), the first time after one interval; 0 turns it off.

    The clock is a streaming source, so a run also happens when files were only deleted; runs never overlap.
    """
    seconds = engine.sync_seconds if seconds is None else seconds
    if seconds < 0:
        raise ValueError("the interval cannot be negative")
    if seconds == 0:
        return None
    ticks = engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.trigger(**(trigger or {"processingTime": f"{seconds} seconds"})).foreachBatch(lambda _, n: n and sync_once(engine, roots)).start()
