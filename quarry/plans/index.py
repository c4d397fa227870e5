"""Indexing a repository: scan, classify, compare, chunk, embed, write."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import IndexingError, QuarryError
from quarry.functions import text as T
from quarry.operators import changes, chunking
from quarry.plans.adapt import classify
from quarry.plans.embedding import HashProvider, Provider, embed, xxh64
from quarry.sources import scan
from quarry.sources.store import Store


@dataclass
class IndexResult:
    indexed: int = 0
    total: int = 0
    new: int = 0
    modified: int = 0
    deleted: int = 0
    unchanged: int = 0
    skipped: int = 0
    message: str = ""

    def to_dict(self) -> dict:
        return asdict(self)


def file_rows(files: DataFrame, project: str) -> DataFrame:
    """Rows of the file table from path, size, last_modified and content."""
    out = classify(files.withColumn("project_name", F.lit(project)))
    return out.withColumns({"lines": T.line_count(F.col("content")), "hash": xxh64(F.col("content"))})


def chunk_rows(files: DataFrame, provider: Provider, chunk_size: int = 500, overlap: int = 50) -> DataFrame:
    """Rows of the chunk table: raw and sanitised content, lines, vector and norm. Chunks beyond the term limit are dropped."""
    cut = chunking.chunk_files(files, ["project_name", "path"], chunk_size=chunk_size, overlap=overlap)
    cut = cut.withColumns({"content_raw": F.col("content"), "content": T.sanitize(F.col("content"))}).filter(F.octet_length("content") <= T.TERM_BYTES)
    return embed(cut.withColumnRenamed("path", "file_path"), provider)


def index_repository(spark: SparkSession, root: str, project: str, store: Store, *, preset: str = "initialize", provider: Provider | None = None, patterns: list[str] | None = None, force: bool = False, progress: Callable[[float, str], None] | None = None) -> IndexResult:
    """Bring a project's tables up to date: only files that are new or modified are read, and those that are gone are removed.

    progress: told the share that is done, and what is being done. What fails in between is an ``IndexingError``."""
    say = progress or (lambda share, what: None)
    say(0.0, "listing files")
    options = scan.PRESETS[preset]
    current = scan.scan(spark, root, patterns or options["patterns"]).withColumn("project_name", F.lit(project)).persist()
    try:
        indexed = store.read("files", project)
        if force:
            indexed = indexed.limit(0)
        status = changes.change_status(current, indexed).persist()
        counts = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        say(0.2, "comparing with the index")
        result = IndexResult(total=sum(n for s, n in counts.items() if s != "deleted"), **counts)
        gone = status.filter("status = 'deleted'").select("project_name", "path")
        if counts.get("deleted"):
            store.delete(project, gone)
        if counts.get("new") or counts.get("modified"):
            say(0.4, "reading files")
            todo = current.join(status.filter("status IN ('new', 'modified')").select("project_name", "path"), ["project_name", "path"], "left_semi")
            rows = file_rows(scan.with_content(todo.drop("project_name"), root), project).persist()
            result.indexed = rows.count()
            result.skipped = counts.get("new", 0) + counts.get("modified", 0) - result.indexed
            store.upsert(project, rows, chunk_rows(rows, provider or HashProvider(), options["chunk_size"], options["overlap"]))
            rows.unpersist()
        status.unpersist()
    except QuarryError:
        raise
    except Exception as e:
        raise IndexingError(f"could not index {project}: {type(e).__name__}", project=project, reason=str(e)[:500]) from e
    finally:
        current.unpersist()
    say(1.0, "done")
    result.message = f"Indexed {result.indexed} of {result.total} files" if result.indexed else "Repository is up to date"
    return result


def index_paths(spark: SparkSession, root: str, project: str, paths: DataFrame, store: Store, *, preset: str = "initialize", provider: Provider | None = None) -> int:
    """Read the files at some paths again and write them; returns how many there were."""
    options = scan.PRESETS[preset]
    rows = file_rows(scan.with_content(scan.files_at(paths, root, options["patterns"]), root), project).persist()
    try:
        n = rows.count()
        if n:
            store.upsert(project, rows, chunk_rows(rows, provider or HashProvider(), options["chunk_size"], options["overlap"]))
        return n
    finally:
        rows.unpersist()


def refresh_file(spark: SparkSession, root: str, project: str, path: str, store: Store, provider: Provider | None = None) -> str:
    """added, updated, unchanged or missing, by content hash."""
    row = scan.with_content(scan.file_info(spark, root, path), root)
    rows = file_rows(row, project)
    action = changes.by_hash(rows, store.read("files", project)).first()
    if action is None:
        return "missing"
    if action["action"] != "unchanged":
        store.upsert(project, rows, chunk_rows(rows, provider or HashProvider()))
    return action["action"]
