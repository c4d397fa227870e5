"""File changes as streams: an append-only event log, debouncing per path, and a sink that keeps the index up to date.

Spark's file stream sees new files only, so a tree is not a source: a snapshot difference per trigger is appended to the log.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.sources.shared import fresh

EVENT = "path string, change_type string, ts timestamp"
DELAY = 0.5
#: Seconds after which a path's state is forgotten.
KEEP = 60.0


def read_log(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def append_changes(status: DataFrame, folder: str, ts) -> None:
    """A snapshot difference as events."""
    kind = F.when(F.col("status") == "new", "created").otherwise(F.col("status"))
    status.filter("status <> 'unchanged'").select("path", kind.alias("change_type"), ts.alias("ts")).write.mode("append").parquet(folder)


def not_logged(changes: DataFrame, logged: DataFrame) -> DataFrame:
    """Of events (path, change_type, ts), those that the log doesn't hold: a file's with its time, or a deletion where the path's last event is none."""
    same = changes.join(logged.select("path", "change_type", "ts"), ["path", "change_type", "ts"], "left_anti")
    gone = latest(logged).filter("change_type = 'deleted'").select("path", F.lit("deleted").alias("change_type"))
    return same.join(gone, ["path", "change_type"], "left_anti").select("path", "change_type", "ts")


def debounce_rows(events: list[tuple[float, str]], delay: float = DELAY) -> list[tuple[float, str, float]]:
    """(event time, type, time of emission) for one path's events in order: one is passed at once if the last passed is ``delay`` back,
    otherwise it waits, and the latest waiting takes its place; the waiting one is passed when the delay is over."""
    out: list[tuple[float, str, float]] = []
    last, held = None, None
    for t, kind in events:
        if held is not None and t >= last + delay:
            out.append((*held, last + delay))
            last, held = last + delay, None
        if last is None or t - last >= delay:
            out.append((t, kind, t))
            last, held = t, None
        else:
            held = (t, kind)
    if held is not None:
        out.append((*held, last + delay))
    return out


OUT = "path string, change_type string, ts timestamp, emitted timestamp"


#: Events of a path that are worked through in one go, rounded up to the next long pause.
STRETCH = 10_000


def debounced(events: DataFrame, delay: float = DELAY) -> DataFrame:
    """Batch form: one pass over events in order, with what ``debounce_rows`` holds of a path as the only state.

    A pause of twice the delay leaves nothing behind that a later event could meet, so a path with many events is dealt over stretches that begin
    after such pauses.
    """
    wait = round(delay * 1e6)
    order = Window.partitionBy("path").orderBy("t", "change_type")
    rows = events.select("path", "change_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    rows = rows.withColumns({"n": F.row_number().over(order), "pause": F.coalesce(F.col("t") - F.lag("t").over(order) > 2 * wait, F.lit(False))})
    start = F.coalesce(F.max(F.when(F.col("pause"), F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    rows = rows.select("path", F.floor(start / STRETCH).alias("stretch"), "t", "change_type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, held = None, None, None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = [*zip(*out, strict=True)] if out else [(), (), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["path", "change_type", "t", "e"])

        for batch in batches:
            for path, stretch, t, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (path, stretch) != at:
                    if held is not None:
                        out.append((at[0], held[1], held[0], last + wait))
                    at, last, held = (path, stretch), None, None
                if held is not None and t >= last + wait:
                    out.append((path, held[1], held[0], last + wait))
                    last, held = last + wait, None
                if last is None or t - last >= wait:
                    out.append((path, kind, t, t))
                    last, held = t, None
                else:
                    held = (t, kind)
            yield flush()
        if held is not None:
            out.append((at[0], held[1], held[0], last + wait))
        yield flush()

    dealt = rows.repartition("path", "stretch").sortWithinPartitions("path", "stretch", "t", "change_type")
    got = dealt.mapInArrow(run, "path string, change_type string, t long, e long")
    return got.select("path", "change_type", F.timestamp_micros("t").alias("ts"), F.timestamp_micros("e").alias("emitted"))


def debounced_stream(events: DataFrame, delay: float = DELAY, processing: str = "ProcessingTimeTimeout") -> DataFrame:
    """Streaming form: state per path is the time of the last passed event and the one that waits; a timer passes it, or forgets the
    path when nothing waits. What a path holds is one event, however many came. With "EventTimeTimeout" the timer goes by the watermark of
    ``ts``, which the events must have."""
    by_event = processing == "EventTimeTimeout"
    timeout = GroupStateTimeout.EventTimeTimeout if by_event else GroupStateTimeout.ProcessingTimeTimeout

    def wait(state: GroupState, since: float, seconds: float) -> None:
        if by_event:
            state.setTimeoutTimestamp(max(int((since + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        else:
            state.setTimeoutDuration(max(1, int(seconds * 1000)))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held_t, held_k = state.get if state.exists else (None, None, None)
        out: list[tuple[float, str, float]] = []
        if state.hasTimedOut:
            if held_t is not None:
                out.append((held_t, held_k, last + delay))
                state.update((last + delay, None, None))
                wait(state, last + delay, KEEP)
            else:
                state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "change_type"], kind="stable")
            for t, kind in zip(rows["ts"].map(lambda x: x.timestamp()), rows["change_type"], strict=True):
                if held_t is not None and t >= last + delay:
                    out.append((held_t, held_k, last + delay))
                    last, held_t, held_k = last + delay, None, None
                if last is None or t - last >= delay:
                    out.append((t, kind, t))
                    last, held_t, held_k = t, None, None
                else:
                    held_t, held_k = t, kind
            state.update((last, held_t, held_k))
            wait(state, last, delay if held_t is not None else KEEP)
        stamp = lambda x: pd.Timestamp(round(x * 1e6), unit="us")
        yield pd.DataFrame({"path": [key[0]] * len(out), "change_type": [o[1] for o in out], "ts": [stamp(o[0]) for o in out], "emitted": [stamp(o[2]) for o in out]})

    return events.groupBy("path").applyInPandasWithState(run, OUT, "last double, held_t double, held_k string", "append", timeout)


def latest(events: DataFrame) -> DataFrame:
    """The last change of each path."""
    return events.groupBy("path").agg(F.max_by("change_type", F.struct("ts", "change_type")).alias("change_type"), F.max("ts").alias("ts"))


def sink(events: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str, name: str, every: str | None = "1 second"):
    """Start a query that hands each batch's last changes to ``apply`` as (changed paths, deleted paths). ``every`` None: all there is,
    then stop. One query runs under a name."""

    def batch(rows: DataFrame, _: int) -> None:
        last = latest(rows).persist()
        apply(last.filter("change_type <> 'deleted'").select("path"), last.filter("change_type = 'deleted'").select("path"))
        last.unpersist()

    for q in events.sparkSession.streams.active:
        if q.name == name:
            return q
    writer = events.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(batch)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def drained(rows: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream has to give now, as a table in the shared folder: taken in to its end, then stopped."""
    spark = rows.sparkSession
    out, state = fresh(spark, "drained"), fresh(spark, "drained-state")
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(out).awaitTermination()
    else:
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def monitoring(events: DataFrame, done, most: int = 5) -> DataFrame:
    """Of a log of changes worked off up to the time ``done``: since when it runs, paths still to do, changes of its last day, and the last few."""
    last = recent(events, most).agg(F.array_sort(F.collect_list(F.struct(F.col("ts"), "event_id", "change_type", "path")), lambda a, b: F.when((a["ts"] > b["ts"]) | (a["ts"] == b["ts"]) & (a["event_id"] > b["event_id"]), -1).when((a["ts"] == b["ts"]) & (a["event_id"] == b["event_id"]), 0).otherwise(1)).alias("recent_changes"))
    at = F.lit(done)
    whole = events.agg(F.min("ts").alias("since"), F.max("ts").alias("last_change"), F.countDistinct(F.when(F.col("ts") >= at, F.col("path"))).alias("pending_changes"))
    day = events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("n", "day").alias("changes_today"))
    return whole.crossJoin(day).crossJoin(last)  # a row each


def status(spark: SparkSession, name: str) -> dict:
    q = next((q for q in spark.streams.active if q.name == name), None)
    progress = q.lastProgress if q else None
    held = sum(int(x["numRowsTotal"]) for x in progress["stateOperators"]) if progress else 0
    return {"is_running": q is not None, "waiting": bool(q and q.status["isTriggerActive"]), "paths_in_state": held, "last_progress": progress}


def stop_all(spark: SparkSession) -> None:
    for q in spark.streams.active:
        q.stop()


def recent(events: DataFrame, most: int = 5) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


def per_day(events: DataFrame) -> DataFrame:
    """Changes, paths and last time per day and type."""
    return events.groupBy(F.to_date("ts").alias("day"), "change_type").agg(F.count(F.lit(1)).alias("changes"), F.countDistinct("path").alias("paths"), F.max("ts").alias("last"))


def windowed(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """An extension: changes per time window, with late rows let in for a while."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "change_type").agg(F.count(F.lit(1)).alias("changes"))


def gaps(events: DataFrame) -> DataFrame:
    """Seconds since the path's event before."""
    w = Window.partitionBy("path").orderBy("ts", "event_id")
    return events.withColumn("gap", F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w))
