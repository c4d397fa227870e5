"""Profiles of operations as window queries: concurrency, growth of memory, bottlenecks, tuning rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Spans of time that a group's rows are dealt over; what is carried from one to the next is a row a span.
SPANS = 256


def _in_spans(rows: DataFrame, group: str, time: str) -> DataFrame:
    """Add ``_span``: which of SPANS equal stretches of its group's time a row is in. Rows of one time share it."""
    ends = rows.groupBy(group).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    at = F.floor((F.col(time) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * SPANS)
    return rows.join(ends, group).withColumn("_span", F.when(F.col("_hi") > F.col("_lo"), F.least(at, F.lit(SPANS - 1))).otherwise(0).cast("int")).drop("_lo", "_hi")


def max_concurrency(tasks: DataFrame, group: str, start: str = "start", end: str = "end") -> DataFrame:
    """Tasks running at once at most, per group: a running sum over starts and ends, ends first at ties.

    The sum runs inside each span of a group's time and begins with what the spans before it come to, so no group is one task's.
    """
    ends = F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))
    moves = _in_spans(tasks.select(group, F.explode(ends).alias("m")).select(group, "m.t", "m.d"), group, "t")
    inside = F.sum("d").over(Window.partitionBy(group, "_span").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0))
    spans = moves.withColumn("running", inside).groupBy(group, "_span").agg(F.max("running").alias("top"), F.sum("d").alias("change"))
    before = F.coalesce(F.sum("change").over(Window.partitionBy(group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    most = spans.withColumn("top", F.col("top") + before).groupBy(group).agg(F.max("top").alias("max_concurrent"))
    totals = tasks.groupBy(group).agg(F.count(F.lit(1)).alias("tasks"), F.round(F.sum(F.col(end) - F.col(start)), 6).alias("busy"), F.round(F.max(end) - F.min(start), 6).alias("wall"))
    return totals.join(most, group)


def increase_runs(snaps: DataFrame, group: str, order: str, value: str, label: str, share: float = 0.7, time: str | None = None) -> DataFrame:
    """Longest run of rises between neighbours, whether it is a leak (more than ``share`` of all snapshots), peak and its first label.

    With ``time``, a number that ``order`` begins with, a group is dealt over spans of time; each tells its first and last value and the runs at its
    ends and inside it, and these are put together in order.
    """
    rows = _in_spans(snaps, group, time) if time else snaps.withColumn("_span", F.lit(0))
    w = Window.partitionBy(group, "_span").orderBy(order)
    rows = rows.withColumn("up", F.coalesce((F.col(value) > F.lag(value).over(w)).cast("int"), F.lit(0)))
    rows = rows.withColumn("island", F.sum(1 - F.col("up")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(group, "_span", "island").agg(F.sum("up").alias("run"), F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    # A span's islands in order: the first is its run from the start, the last its run to the end.
    spans = runs.groupBy(group, "_span").agg(F.max("run").alias("best"), F.min_by("run", "island").alias("head"), F.max_by("run", "island").alias("tail"), F.min_by("first", "island").alias("first"), F.max_by("last", "island").alias("last"), (F.count(F.lit(1)) == 1).alias("whole"))
    listed = spans.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_span", "best", "head", "tail", "first", "last", "whole"))).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("best"), F.lit(0).cast("long").alias("tail"), F.lit(None).cast(snaps.schema[value].dataType).alias("last"))

    def step(acc, x):
        goes_on = F.coalesce(x["first"] > acc["last"], F.lit(False))
        joint = F.when(goes_on, acc["tail"] + 1 + x["head"]).otherwise(x["head"])
        return F.struct(F.greatest(acc["best"], x["best"], joint).alias("best"), F.when(x["whole"], joint).otherwise(x["tail"]).alias("tail"), x["last"].alias("last"))

    run = listed.select(group, F.aggregate("s", start, step, lambda acc: acc["best"]).alias("longest_rise"))
    peak = snaps.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("peak"), F.min_by(label, F.struct(-F.col(value), F.col(order))).alias("peak_label"))
    return run.join(peak, group).withColumn("leak", F.col("longest_rise") > share * F.col("n"))


def bottlenecks(ops: DataFrame, threshold_ms: float = 100.0, cpu: float = 80.0, memory_mb: float = 100.0) -> DataFrame:
    """Operations that are slow or heavy, slowest first, with what is wrong."""
    issue = F.array_compact(F.array(F.when(F.col("duration_ms") > threshold_ms, "slow_execution"), F.when(F.col("cpu") > cpu, "high_cpu"), F.when(F.col("memory_mb") > memory_mb, "high_memory")))
    return ops.withColumn("issues", F.array_join(issue, ",")).filter(F.col("issues") != "").orderBy(F.desc("duration_ms"))


def report(ops: DataFrame, group: str) -> DataFrame:
    return ops.groupBy(group).agg(F.count(F.lit(1)).alias("operations"), F.round(F.sum("duration_ms"), 6).alias("total_ms"), F.max_by("operation", F.struct("duration_ms", -F.col("operation"))).alias("slowest"), F.max("duration_ms").alias("slowest_ms"))


def batch_size(latency_ms: Column, items: Column) -> Column:
    """Rows per batch by the time one takes: fast ones in large batches."""
    return F.least(F.when(latency_ms < 10, 1000).when(latency_ms < 100, 100).otherwise(10), items)


def performance_report(ops: DataFrame, group: str, slow_ms: float = 100.0, saved_ms: int = 50) -> DataFrame:
    """Operations, their mean, how many are slow, what hits of a cache saved, and the batch size that the mean asks for."""
    out = ops.groupBy(group).agg(F.count(F.lit(1)).alias("operations"), F.avg("duration_ms").alias("mean_ms"), F.count_if(F.col("duration_ms") > slow_ms).alias("slow"), (F.count_if("hit") * saved_ms).alias("saved_ms"))
    return out.withColumn("batch_size", batch_size(F.col("mean_ms"), F.lit(1000)))


#: Fixed values in both forms: bounds of file sizes and query rates, and the settings beyond them.
def tuned_columns(avg_file_size: Column, total_files: Column, query_frequency: Column) -> Column:
    """``tuned`` for a workload in each row."""
    busy, some = query_frequency > 100, query_frequency > 10
    by_rate = lambda high, low: F.when(busy, high).when(some, low)
    return F.struct(
        F.when(avg_file_size > 10_000, 10).when(avg_file_size > 1000, 50).otherwise(100).alias("batch_size"), by_rate(F.least(F.lit(10_000), total_files * 2), F.least(F.lit(1000), total_files)).alias("cache_size"),
        by_rate(7200, 3600).alias("cache_ttl_seconds"), by_rate(100, 50).alias("max_connections"), by_rate(20, 10).alias("min_connections"),
    )


def tuned(avg_file_size: float = 1000, total_files: int = 100, query_frequency: float = 10) -> dict[str, int]:
    """Settings for a workload: cache entries and their lifetime follow how often it is queried, rows per Arrow batch the size of files."""
    busy, some = query_frequency > 100, query_frequency > 10
    out = {"batch_size": 10 if avg_file_size > 10_000 else 50 if avg_file_size > 1000 else 100}
    if some:
        out |= {"cache_size": min(10_000, total_files * 2) if busy else min(1000, total_files), "cache_ttl_seconds": 7200 if busy else 3600}
        out |= {"max_connections": 100 if busy else 50, "min_connections": 20 if busy else 10}
    return out


def apply_tuning(spark, settings: dict[str, int]) -> None:
    """Connections have no counterpart in a session; batch sizes do."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(settings["batch_size"] * 100))
