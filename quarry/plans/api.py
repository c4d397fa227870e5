"""The engine's tools: each takes a store and plain arguments and returns a JSON-ready dict."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.operators import changes as diff
from quarry.operators import complexity, search, stats
from quarry.plans import index
from quarry.plans.embedding import HashProvider, Provider, embed_query
from quarry.sources import scan
from quarry.sources.store import Store
from quarry.streaming import changes


@dataclass
class Tools:
    spark: SparkSession
    root: str
    project: str
    store: Store
    provider: Provider = field(default_factory=HashProvider)
    preset: str = "initialize"

    def __enter__(self) -> Tools:
        return self

    def __exit__(self, *_) -> None:
        """Stop keeping this project's index up to date; the session belongs to whoever made it."""
        for q in self.spark.streams.active:
            if q.name == f"monitor-{self.project}":
                q.stop()

    def initialize_repository(self, force: bool = False, progress=None) -> dict:
        return index.index_repository(self.spark, self.root, self.project, self.store, preset=self.preset, provider=self.provider, force=force, progress=progress).to_dict()

    def search_code(self, query: str, search_type: str = "semantic", is_regex: bool = False, limit: int = 10, language: str | None = None, mode: str = "find", category: str | None = None, **flags: bool | None) -> dict:
        if search_type not in ("semantic", "pattern", "hybrid"):
            raise ValueError("search_type must be semantic, pattern or hybrid")
        limit = search.clamp(limit)
        chunks, files = self.store.read("chunks", self.project), self.store.read("files", self.project)
        filters = {"project": self.project, "language": language, "category": category, **flags}
        words = self._words(query)
        if search_type == "pattern" and is_regex:
            hits = search.by_regex(chunks, files, query, limit, mode=mode, **filters)
        elif search_type == "pattern":
            hits = search.by_phrase(self.store.read("chunks"), files, words, limit, **filters)  # frequencies are of all projects
        else:
            hits = search.semantic(chunks, files, embed_query(self.provider, query), limit, **filters)
            if search_type == "hybrid":
                best = search.hybrid(hits, search.by_phrase(self.store.read("chunks"), files, words, limit, **filters), limit)
                hits = best.join(chunks.select("project_name", "file_path", "chunk_index", "content", "start_line"), ["project_name", "file_path", "chunk_index"]).withColumn("similarity", F.col("score")).orderBy(F.desc("similarity"), "file_path", "chunk_index")
        rows = [r.asDict() for r in search.projected(hits).collect()]  # the limit's worth
        return {"query": query, "results": rows, "text": _preview(query, rows)}

    @staticmethod
    def _words(query: str) -> list[str]:
        import re

        return re.findall(r"\w+", query.lower())

    def get_repository_stats(self) -> dict:
        files, chunks = self.store.read("files", self.project), self.store.read("chunks", self.project)
        row = stats.repository_stats(files, chunks).first()
        languages = [r.asDict() for r in stats.language_breakdown(files).orderBy(F.desc("size"), "language").collect()]
        return (row.asDict() if row else {"project_name": self.project, "total_files": 0, "total_chunks": 0, "total_size": 0, "languages": ""}) | {"by_language": languages, "largest_files": [r.asDict() for r in stats.largest_files(files).orderBy("rank").collect()]}

    def get_file_info(self, path: str) -> dict:
        files = self.store.read("files", self.project).filter(F.col("path") == path)
        row = stats.file_metadata(files, self.store.read("chunks", self.project)).first()
        return json.loads(json.dumps(row.asDict(), default=str)) if row else {"error": f"not indexed: {path}"}

    def refresh_file(self, path: str) -> dict:
        return {"path": path, "status": index.refresh_file(self.spark, self.root, self.project, path, self.store, self.provider)}

    def delete_file(self, path: str) -> dict:
        got = self.store.delete(self.project, self.spark.createDataFrame([(self.project, path)], "project_name string, path string"))
        return {k: got[0][k] for k in ("status", "chunks_removed")}

    def list_files_by_category(self, category: str | None = None, limit: int = 100, **flags: bool | None) -> dict:
        rows = search.by_category(self.store.read("files", self.project), category, limit, **flags)
        return {"files": [r.asDict() for r in rows.collect()]}

    def analyze_complexity(self, path: str, language: str | None = None, include_metrics: bool = True) -> dict:
        """The twenty most complex functions, ten classes, advice, and with ``include_metrics`` the measures behind them."""
        suffix = "." + path.rsplit(".", 1)[-1] if "." in path else ""
        lang = language or complexity.SUFFIXES.get(suffix)
        if lang is None or lang.lower() not in complexity.ANALYZERS:
            return {"error": f"unsupported language for {path}; supported: {', '.join(complexity.supported())}"}
        file = scan.with_content(scan.file_info(self.spark, self.root, path), self.root)
        analyzed = complexity.analyze_files(file, ["path"], language=F.lit(lang)).persist()
        rows = complexity.recommendations(complexity.summary(analyzed, ["path"])).first()
        if rows is None:
            analyzed.unpersist()
            return {"error": f"no such file: {path}"}
        groups = [r.asDict() for r in complexity.classes(analyzed, ["path"]).drop("path", "language").orderBy(F.desc("total_complexity"), "line_start").limit(10).collect()]
        analyzed.unpersist()
        out = rows.asDict(recursive=True)
        out["functions"] = sorted(out["functions"], key=lambda f: -f["complexity"])[:20]
        out["classes"] = groups
        if not include_metrics:
            out = {k: v for k, v in out.items() if k not in MEASURES}
        return _rounded(out)

    def find_complex_code(self, query: str, threshold: int = 15) -> dict:
        chunks, files = self.store.read("chunks", self.project), self.store.read("files", self.project)
        hits = search.semantic(chunks, files, embed_query(self.provider, query), 20, project=self.project).select("project_name", F.col("file_path").alias("path"), "similarity")
        sources = self.store.read("files", self.project).select("project_name", "path", "language").join(chunks.filter("chunk_index = 0").select("project_name", F.col("file_path").alias("path"), F.col("content_raw").alias("content")), ["project_name", "path"])
        few = sources.join(hits.select("project_name", "path").distinct(), ["project_name", "path"], "left_semi")
        got = complexity.summary(complexity.analyze_files(few, ["project_name", "path"]), ["project_name", "path"])
        return {"results": [r.asDict(recursive=True) for r in complexity.complex_hits(hits, got, ["project_name", "path"], threshold).orderBy(F.desc("similarity")).collect()]}

    def monitoring_status(self, log: str | None = None) -> dict:
        """Whether the index is kept up to date, of what, since when; with its log, changes still to come and the last five."""
        out = {"project_name": self.project, "path": self.root, "patterns": scan.PRESETS[self.preset]["patterns"]} | changes.status(self.spark, f"monitor-{self.project}")
        out |= {"pending_changes": 0, "recent_changes": [], "monitoring_since": None, "changes_today": 0}
        if log and self._log_is_there(log):
            events = self.spark.read.schema(changes.EVENT).parquet(log).withColumn("event_id", F.lit(0))
            done = self.store.manifest(self.project)["written"] or "1970-01-01 00:00:00"
            row = changes.monitoring(events, F.to_timestamp(F.lit(done))).first()
            out |= {"pending_changes": row["pending_changes"], "monitoring_since": str(row["since"]), "changes_today": row["changes_today"], "last_change": str(row["last_change"])}
            out["recent_changes"] = [{"change_type": c["change_type"], "path": c["path"], "timestamp": str(c["ts"])} for c in row["recent_changes"]]
        return out

    def indexing_status(self) -> dict:
        """Whether the project is indexed, how much of the tree is, and what runs."""
        tracker = self.spark.sparkContext.statusTracker()
        files = self.store.read("files", self.project)
        out = {"project_name": self.project, "is_indexed": stats.is_indexed(files, self.project), "active_jobs": len(tracker.getActiveJobsIds()), "version": self.store.manifest(self.project)["version"]}
        current = scan.scan(self.spark, self.root, scan.PRESETS[self.preset]["patterns"]).withColumn("project_name", F.lit(self.project))
        row = stats.index_health(current, files).first()
        return out | ({k: row[k] for k in ("monitored", "indexed", "coverage")} if row else {"monitored": 0, "indexed": 0, "coverage": 0.0})

    def _log_is_there(self, log: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(log)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def start_monitoring(self, log: str, checkpoint: str, every: str | None = "1 second"):
        """Keep the index up to date from an event log of changes: only the paths that changed are read again."""

        def apply(changed, gone) -> None:
            if not gone.isEmpty():
                self.store.delete(self.project, gone.withColumn("project_name", F.lit(self.project)))
            if not changed.isEmpty():
                index.index_paths(self.spark, self.root, self.project, changed, self.store, preset=self.preset, provider=self.provider)

        return changes.sink(changes.read_log(self.spark, log), apply, checkpoint, f"monitor-{self.project}", every)

    def poll(self, log: str) -> int:
        """Append what differs between the tree and the index to the log, unless the log has it already; returns how many changes."""
        current = scan.scan(self.spark, self.root, scan.PRESETS[self.preset]["patterns"]).withColumn("project_name", F.lit(self.project))
        status = diff.change_status(current, self.store.read("files", self.project)).filter("status <> 'unchanged'")
        timed = status.join(current.select("path", "last_modified"), "path", "left")
        kind = F.when(F.col("status") == "new", "created").otherwise(F.col("status"))
        events = timed.select("path", kind.alias("change_type"), F.coalesce(F.col("last_modified").cast("timestamp"), F.current_timestamp()).alias("ts"))
        if self._log_is_there(log):
            events = changes.not_logged(events, self.spark.read.schema(changes.EVENT).parquet(log))
        events = events.persist()
        n = events.count()
        if n:
            events.write.mode("append").parquet(log)
        events.unpersist()
        return n


#: What ``include_metrics`` is about.
MEASURES = ["cognitive_complexity", "average_complexity", "maintainability_index", "lines_of_code", "comment_ratio"]


def _rounded(x):
    """Two places for people, three for ratios, at any depth."""
    if isinstance(x, dict):
        return {k: round(v, 3 if k == "comment_ratio" else 2) if isinstance(v, float) else _rounded(v) for k, v in x.items()}
    return [_rounded(v) for v in x] if isinstance(x, list) else x


def _preview(query: str, rows: list[dict]) -> str:
    """The first ten results as text, each with the beginning of its content."""
    if not rows:
        return f"Nothing found for {query!r}"
    cut = lambda t: t if len(t) <= 200 else t[:200] + "..."
    return "\n".join([f"{len(rows)} found for {query!r}", *(f"{k}. {r['file']} ({r['similarity']}): {cut(r['content'])}" for k, r in enumerate(rows[:10], 1))])
