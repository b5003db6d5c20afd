"""State of each root from its lifecycle events: as a stream with state, and the same as a batch.

Within an operation nothing counts after it has ended (``operation_completed`` or ``operation_failed``); the next
``operation_started`` opens another. Progress is kept once a second, the last one of it, and always before an end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STARTED, STEP, PROGRESS, COMPLETED, FAILED = "operation_started", "step_updated", "progress_updated", "operation_completed", "operation_failed"
ENDS = (COMPLETED, FAILED)
STATUS = {STARTED: "indexing", COMPLETED: "indexed", FAILED: "failed"}
ORDER = ("ts", "event_id")


def numbered(events: DataFrame, width: str = "hour") -> DataFrame:
    """Events with ``operation`` and ``live``: the number of the operation they belong to, and whether it had not ended before.

    Running counts within each ``width`` of time of a root, and from one to the next over one row each: a root with a large part of
    all events is not one task.
    """
    at, started, ends = F.struct(*ORDER), F.col("type") == STARTED, F.col("type").isin(*ENDS)
    e = events.withColumn("_b", F.date_trunc(width, F.col("ts").cast("timestamp")))
    within = W.partitionBy("path", "_b").orderBy(*ORDER)
    e = e.select(
        "*", F.sum(started.cast("long")).over(within).alias("_n"), F.max(F.when(started, at)).over(within).alias("_s"),
        F.max(F.when(ends, at)).over(within.rowsBetween(W.unboundedPreceding, -1)).alias("_e"),
    )
    each = events.groupBy("path", F.date_trunc(width, F.col("ts").cast("timestamp")).alias("_b")).agg(F.sum(started.cast("long")).alias("n"), F.max(F.when(started, at)).alias("s"), F.max(F.when(ends, at)).alias("e"))
    before = W.partitionBy("path").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    each = each.select("path", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n0"), F.max("s").over(before).alias("_s0"), F.max("e").over(before).alias("_e0"))
    e = e.join(each, (e["path"].eqNullSafe(each["path"])) & (e["_b"].eqNullSafe(each["_b"]))).drop(each["path"], each["_b"])
    last_start, last_end = F.coalesce("_s", "_s0"), F.coalesce("_e", "_e0")
    out = e.withColumn("operation", F.col("_n0") + F.col("_n")).withColumn("live", last_start.isNotNull() & (last_end.isNull() | (last_end < last_start)))
    return out.select(*events.columns, "operation", "live")


def final_states(events: DataFrame) -> DataFrame:
    """``path, status, operations, last_event`` after all events; roots never started are ``not_found``."""
    e = numbered(events)
    at = F.struct(*ORDER)
    turn = F.when(F.col("live") & F.col("type").isin(STARTED, *ENDS), F.struct(at.alias("at"), "type"))
    out = e.groupBy("path").agg(F.max(turn).alias("_t"), F.max("operation").alias("operations"), F.max("event_id").alias("_e"), F.max_by("event_id", at).alias("last_event"))
    status = F.coalesce(*(F.when(F.col("_t.type") == t, F.lit(s)) for t, s in STATUS.items()), F.lit("not_found"))
    return out.select("path", status.alias("status"), "operations", "last_event")


def throttled(events: DataFrame) -> DataFrame:
    """Live events with progress thinned to the last of each root, operation and second."""
    e = numbered(events).where("live")
    rest = e.where(F.col("type") != PROGRESS).select("event_id", "path", "type", "ts", "operation")
    progress = e.where(F.col("type") == PROGRESS)
    last = progress.groupBy("path", "operation", F.date_trunc("second", "ts").alias("_s")).agg(F.max(F.struct("ts", "event_id")).alias("_l"))
    return rest.unionByName(last.select(F.col("_l.event_id").alias("event_id"), "path", F.lit(PROGRESS).alias("type"), F.col("_l.ts").alias("ts"), "operation"))


def notifications(events: DataFrame) -> DataFrame:
    """``event_id, level, message`` of what is told to a client: everything but progress."""
    level = F.when(F.col("type") == FAILED, "error").otherwise("info")
    message = F.when(F.col("type") == STARTED, F.concat(F.lit("started on "), "path")).when(F.col("type") == STEP, F.concat(F.lit("next step on "), "path"))
    message = message.when(F.col("type") == COMPLETED, F.concat(F.lit("completed on "), "path")).otherwise(F.concat(F.lit("failed on "), "path"))
    return events.where(F.col("type") != PROGRESS).select("event_id", level.alias("level"), message.alias("message"))


OUT = "path string, status string, operations long, last_event long"
STATE = "status string, operations long, last_event long"


def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state machine of one root over the events of a trigger."""
    status, operations, last = state.get if state.exists else ("not_found", 0, -1)
    turns, newest = [], None
    for b in batches:  # of all events only those that turn the state are held
        turns.append(b.loc[b["type"].isin([STARTED, *ENDS]), ["ts", "event_id", "type"]])
        top = b.sort_values(list(ORDER)).iloc[-1] if len(b) else None
        if top is not None and (newest is None or (top["ts"], top["event_id"]) > newest):
            newest = (top["ts"], top["event_id"])
    last = last if newest is None else int(newest[1])
    for kind in pd.concat(turns).sort_values(list(ORDER))["type"] if turns else ():
        if kind == STARTED:
            status, operations = "indexing", operations + 1
        elif status == "indexing":
            status = STATUS[kind]
    state.update((status, operations, last))
    yield pd.DataFrame({"path": [key[0]], "status": [status], "operations": [operations], "last_event": [last]})


def state_stream(events: DataFrame) -> DataFrame:
    """States of the roots that had events in a trigger; for a streaming ``event_id, path, type, ts``."""
    return events.groupBy("path").applyInPandasWithState(advance, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events a window and type, of a batch or, with a bound on late ones, of a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", width).alias("w"), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "type", "n")
