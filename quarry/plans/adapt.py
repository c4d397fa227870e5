"""The driver's tables as the engine's entities: documents as code files, embeddings as chunks, events as file changes.

A document's path is derived from its id and language, so that all categories and several languages occur. Chunk k of a document (k
is 0 or 1) is one half of its text with the vector whose id is twice the document's plus k; later documents have no chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_path(doc_id, lang):
    part = doc_id % 6
    ext = doc_id % 7
    prefix = F.when(part == 0, "test_").when(part == 1, "config_").when(part == 3, "readme_").otherwise("")
    end = F.when(ext == 0, ".py").when(ext == 1, ".java").when(ext == 2, ".md").when(ext == 3, ".sql").when(ext == 4, ".yaml").when(ext == 5, ".kt").otherwise(".ts")
    return F.concat(F.lit("src/"), lang, F.lit("/"), prefix, F.lit("doc_"), doc_id.cast("string"), end)


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_name, path, content, size, doc_id."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("project_name"), file_path(F.col("doc_id"), F.col("lang")).alias("path"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size"), "doc_id")


def classify(files: DataFrame) -> DataFrame:
    """Add language, flags, category, namespace and file name."""
    flags = T.file_flags(F.col("path"))
    out = files.withColumns({"language": T.language(F.col("path")), "filename": T.filename(F.col("path")), **flags})
    out = out.withColumn("file_category", T.file_category({k: F.col(k) for k in flags}))
    return out.withColumn("namespace", T.namespace(F.col("path"), F.col("content"), F.col("language")))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(raw_files(spark, sf_dir))


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_name, file_path, chunk_index, content, embedding, label, chunk_id; stored with its norm as a chunk table is."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.expr("vec_id div 2").alias("doc_id"), (F.col("vec_id") % 2).cast("int").alias("chunk_index"), "embedding", "label")
    f = raw_files(spark, sf_dir).select("doc_id", "project_name", F.col("path").alias("file_path"), "content")
    half = F.floor(F.length("content") / 2).cast("int")
    text = F.when(F.col("chunk_index") == 0, F.substring("content", F.lit(1), half)).otherwise(F.substring("content", half + 1, F.length("content")))
    return e.join(f, "doc_id").select("project_name", "file_path", "chunk_index", text.alias("content"), "embedding", "label", "chunk_id")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(current, indexed): two states of each project's files, with modification times."""
    f = raw_files(spark, sf_dir)
    day = lambda n: F.timestamp_add("DAY", n.cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    indexed = f.filter(F.col("doc_id") % 11 != 0).select("project_name", "path", "size", day(F.col("doc_id") % 50).alias("last_modified"))
    shift = F.when(F.col("doc_id") % 9 == 0, 1).when(F.col("doc_id") % 9 == 1, -1).otherwise(0)
    current = f.filter(F.col("doc_id") % 13 != 0).select("project_name", "path", "size", day(F.col("doc_id") % 50 + shift).alias("last_modified"))
    return current, indexed


def as_changes(events: DataFrame) -> DataFrame:
    """path, change_type, ts, event_id of rows of the event table: views and clicks are modifications."""
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return events.select(F.concat(F.lit("src/file_"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"), kind.alias("change_type"), "ts", "event_id")


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_changes(table(spark, sf_dir, "events"))
