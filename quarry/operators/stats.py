"""Repository statistics: totals, language breakdown, largest files, metadata, index health, latency and cache measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["project_name", "path"]


def _counted(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("project_name", F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("chunk_count"))


def repository_stats(files: DataFrame, chunks: DataFrame, fanout: bool = False) -> DataFrame:
    """Per project: files, chunks, total size, languages. Chunks are counted per file before the join, so a file's size counts
    once; with ``fanout`` it counts once per chunk."""
    rows = files.join(_counted(chunks), KEY, "left")
    n = F.coalesce("chunk_count", F.lit(0))
    size = F.col("size") * F.greatest(n, F.lit(1)) if fanout else F.col("size")
    return rows.groupBy("project_name").agg(F.countDistinct("path").alias("total_files"), F.sum(n).alias("total_chunks"), F.coalesce(F.sum(size), F.lit(0)).alias("total_size"), F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"))


def language_breakdown(files: DataFrame) -> DataFrame:
    per = files.groupBy("project_name", "language").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"))
    whole = F.sum("size").over(Window.partitionBy("project_name"))
    return per.withColumn("percentage", F.when(whole == 0, 0.0).otherwise(F.round(F.col("size") * 100.0 / whole, 2)))


def largest_files(files: DataFrame, most: int = 5) -> DataFrame:
    """The largest files of each project. Ranked twice: within salted parts first, so that no project is one task's."""
    salted = files.select("project_name", "path", "language", "size", F.pmod(F.xxhash64("path"), F.lit(64)).alias("salt"))
    order = [F.desc("size"), "path"]
    some = salted.withColumn("r", F.row_number().over(Window.partitionBy("project_name", "salt").orderBy(*order))).filter(F.col("r") <= most)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("project_name").orderBy(*order))).filter(F.col("rank") <= most).select("project_name", "rank", "path", "language", "size")


def file_metadata(files: DataFrame, chunks: DataFrame) -> DataFrame:
    rows = files.join(_counted(chunks), KEY, "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)).cast("long"))
    return rows.withColumn("indexed", F.col("chunk_count") > 0)


def is_indexed(files: DataFrame, project: str) -> bool:
    return not files.filter(F.col("project_name") == project).limit(1).isEmpty()


def indexed_projects(files: DataFrame) -> DataFrame:
    return files.groupBy("project_name").agg((F.count("path") > 0).alias("indexed"))


def index_health(monitored: DataFrame, indexed: DataFrame) -> DataFrame:
    """Per project: monitored files, those indexed, and the share in per cent."""
    rows = monitored.select(*KEY).join(indexed.select(*KEY).distinct().withColumn("hit", F.lit(1)), KEY, "left")
    out = rows.groupBy("project_name").agg(F.count(F.lit(1)).alias("monitored"), F.count("hit").alias("indexed"))
    return out.withColumn("coverage", F.round(F.col("indexed") * 100.0 / F.col("monitored"), 2))


def latency_stats(rows: DataFrame, group: str, value: str, slow: float | None = None) -> DataFrame:
    """Mean, median, deviation, 95th and 99th percentile, extremes, and how many are slow."""
    p = lambda q: F.round(F.percentile(value, q), 6)
    aggs = [F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), p(0.5).alias("median"), F.round(F.stddev(value), 6).alias("stdev"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.min(value).alias("min"), F.max(value).alias("max")]
    if slow is not None:
        aggs.append(F.count_if(F.col(value) > slow).alias("slow"))
    return rows.groupBy(group).agg(*aggs)


def test_coverage(files: DataFrame) -> DataFrame:
    """Per project: source files, those with a test file of their name (``test_x`` or ``x_test`` for ``x``), and the share in per cent."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    of = F.when(stem.startswith("test_"), F.substring(stem, F.lit(6), F.length(stem))).when(stem.endswith("_test"), F.substring(stem, F.lit(1), F.length(stem) - 5))
    rows = files.select("project_name", stem.alias("stem"), of.alias("of"))
    tested = rows.filter("of IS NOT NULL").select("project_name", F.col("of").alias("stem")).distinct().withColumn("tested", F.lit(1))
    per = rows.filter("of IS NULL").join(tested, ["project_name", "stem"], "left").groupBy("project_name").agg(F.count(F.lit(1)).alias("files"), F.count("tested").alias("tested"))
    return per.withColumn("coverage", F.round(F.col("tested") * 100.0 / F.col("files"), 2))


def hit_rate(rows: DataFrame, group: list[str], hit: str) -> DataFrame:
    out = rows.groupBy(*group).agg(F.count_if(hit).alias("hits"), F.count_if(~F.col(hit)).alias("misses"))
    total = F.col("hits") + F.col("misses")
    return out.withColumn("hit_rate", F.when(total == 0, 0.0).otherwise(F.round(F.col("hits") / total, 6)))


def accuracy(rows: DataFrame, truth: str, predicted: str, confidence: str, high: float = 0.8) -> DataFrame:
    """Accuracy, share of confident answers, and macro precision, recall and F1 over the true classes."""
    rows = rows.select(F.col(truth).alias("t"), F.col(predicted).alias("p"), F.col(confidence).alias("c"))
    per_true = rows.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") == F.col("p")).alias("hit"), F.count_if(F.col("c") >= high).alias("high"))
    per_said = rows.groupBy(F.col("p").alias("t")).agg(F.count(F.lit(1)).alias("said"))
    each = per_true.join(per_said, "t", "left").withColumn("said", F.coalesce("said", F.lit(0)))
    precision, recall = F.when(F.col("said") == 0, 0.0).otherwise(F.col("hit") / F.col("said")), F.col("hit") / F.col("n")
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return each.agg(F.round(F.sum("hit") * 100 / F.sum("n"), 4).alias("accuracy"), F.round(F.sum("high") * 100 / F.sum("n"), 4).alias("high_confidence"), F.round(F.avg(precision), 6).alias("precision"), F.round(F.avg(recall), 6).alias("recall"), F.round(F.avg(f1), 6).alias("f1"))
