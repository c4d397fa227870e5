"""What changed between two states of files, and the keyed writes that follow from it, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["project_name", "path"]
OLDEST = "0001-01-01 00:00:00"


def change_status(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """new, modified, deleted or unchanged per file: one full outer join. Modified means strictly later; a missing time is the oldest."""
    time = lambda c: F.coalesce(c, F.lit(OLDEST).cast("timestamp_ntz"))
    c = current.select(*KEY, time(F.col("last_modified")).alias("now"), F.lit(True).alias("here"))
    i = indexed.select(*KEY, time(F.col("last_modified")).alias("was"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "deleted").when(F.col("now") > F.col("was"), "modified").otherwise("unchanged")
    return c.join(i, KEY, "full_outer").select(*KEY, status.alias("status"))


def to_index(current: DataFrame, indexed: DataFrame) -> DataFrame:
    s = change_status(current, indexed).filter(F.col("status").isin("new", "modified"))
    return current.join(s.select(*KEY), KEY, "left_semi")


def summary(status: DataFrame) -> DataFrame:
    return status.groupBy("project_name").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("new", "modified", "deleted", "unchanged")))


def by_hash(current: DataFrame, indexed: DataFrame, hash_col: str = "hash") -> DataFrame:
    """added, updated or unchanged per file by content hash."""
    old = indexed.select(*KEY, F.col(hash_col).alias("old"), F.lit(True).alias("there"))
    action = F.when(F.col("there").isNull(), "added").when(F.equal_null(F.col(hash_col), F.col("old")), "unchanged").otherwise("updated")
    return current.join(old, KEY, "left").select(*KEY, action.alias("action"))


def upsert(table: DataFrame, rows: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Rows replace those of the same key, others are added; of several with one key the last in column order stays. Columns of
    either side that the other lacks become null."""
    key = key or KEY
    rest = [F.desc(c) for c in rows.columns if c not in key and not rows.schema[c].dataType.typeName() == "map"]
    one = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*(rest or key)))).filter("_r = 1").drop("_r")
    return table.join(one.select(*key), key, "left_anti").unionByName(one, allowMissingColumns=True)


def replace_chunks(chunks: DataFrame, paths: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of the given files give way to new ones."""
    gone = paths.select("project_name", F.col("path").alias("file_path"))
    return chunks.join(gone, ["project_name", "file_path"], "left_anti").unionByName(new)


def delete_files(files: DataFrame, chunks: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files left, chunks left, one row per path: status and chunks removed). A path that isn't there is reported as such."""
    gone = paths.select(*KEY).distinct()
    dead = gone.withColumnRenamed("path", "file_path")
    n = chunks.join(dead, ["project_name", "file_path"], "left_semi").groupBy("project_name", F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("chunks_removed"))
    known = files.select(*KEY).withColumn("_f", F.lit(1))
    done = gone.join(known, KEY, "left").join(n, KEY, "left").select(*KEY, F.when(F.col("_f") == 1, "success").otherwise("not_found").alias("status"), F.coalesce("chunks_removed", F.lit(0)).cast("long").alias("chunks_removed"))
    return files.join(gone, KEY, "left_anti"), chunks.join(dead, ["project_name", "file_path"], "left_anti"), done


def chunk_diff(old: DataFrame, new: DataFrame, key: str = "chunk_id", content: str = "content") -> DataFrame:
    """insert, update, delete or keep per chunk."""
    a = old.select(key, F.col(content).alias("_a"), F.lit(1).alias("_old"))
    b = new.select(key, F.col(content).alias("_b"), F.lit(1).alias("_new"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.equal_null("_a", "_b"), "keep").otherwise("update")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def checked_vectors(rows: DataFrame, dims: int, vector: str = "vector", node: str = "node_id") -> DataFrame:
    """Status of each row of a batch of vectors: its dimensions decide; rows of one id share the first row's verdict."""
    ok = F.coalesce(F.size(vector) == dims, F.lit(False))
    first = F.first(ok).over(Window.partitionBy(node).orderBy("position"))
    return rows.select(node, "position", F.when(first, "success").otherwise("failed").alias("status"), F.when(~first, F.concat(F.lit("expected "), F.lit(str(dims)), F.lit(" dimensions"))).alias("error"))


def upsert_vectors(table: DataFrame, rows: DataFrame, dims: int, key: str = "node_id", vector: str = "vector") -> DataFrame:
    """Vectors by id: rows of the right length replace what is there or are added; others change nothing."""
    return upsert(table, rows.filter(F.coalesce(F.size(vector) == dims, F.lit(False))), [key])


def oversized(chunks: DataFrame, most: int = 30_000) -> DataFrame:
    return chunks.filter(F.length("content") > most).select("project_name", "file_path", "chunk_index", F.length("content").alias("chars")).orderBy(F.desc("chars"), "project_name", "file_path", "chunk_index")


TRUNCATED = "\n... [TRUNCATED - content too large]"


def truncated(chunks: DataFrame, most: int = 30_000) -> DataFrame:
    return chunks.withColumn("content", F.when(F.length("content") > most, F.concat(F.substring("content", 1, most), F.lit(TRUNCATED))).otherwise(F.col("content")))


def long_terms(chunks: DataFrame, most: int, content: str = "content") -> DataFrame:
    """Rows with a word of more than ``most`` bytes, which a term index refuses."""
    from quarry.functions.text import SPACE

    return chunks.filter(F.exists(F.split(content, SPACE), lambda w: F.octet_length(w) > most))
