"""The index of projects: a table of files and one of chunks per project, in Parquet, dealt over buckets by path.

Parquet has no merge. A write makes new files for the buckets it touches, beside the current ones, and then adds one small manifest
that names the folder of every bucket of both tables. So files and chunks change together, a reader never sees half a write, a
plan never overwrites what it reads, and the change of one file rewrites one bucket. Two writers that start from one version can't both commit.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import DimensionError, StoreError
from quarry.operators import changes

FILES = "project_name string, path string, language string, size long, lines int, last_modified timestamp_ntz, hash string, is_test boolean, is_config boolean, is_resource boolean, is_documentation boolean, file_category string, namespace string"
CHUNKS = "project_name string, file_path string, chunk_index int, content string, content_raw string, start_line int, end_line int, embedding array<float>, norm double"
SCHEMAS = {"files": FILES, "chunks": CHUNKS}
PATH = {"files": "path", "chunks": "file_path"}
BUCKETS = 64
METRICS = ("cosine", "euclidean")


def bucket(path: Column, of: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(of)).cast("int")


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        """Nothing is held open: a store is paths and a session that others own."""

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self, at: str) -> list[str]:
        fs, path = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(path(at))) if fs.exists(path(at)) else []

    def _manifests(self, project: str) -> list[str]:
        return [n for n in self._names(f"{self.root}/{project}") if n.startswith("manifest-")]

    def manifest(self, project: str) -> dict:
        """The current version: its number, settings, and by table the folder of each bucket."""
        none = {"version": 0, "written": None, "dimensions": None, "metric": "cosine", "tables": {t: {} for t in SCHEMAS}}
        names = self._manifests(project)
        if not names:
            return none
        rows = self.spark.read.text(f"{self.root}/{project}/{names[-1]}", wholetext=True).collect()
        try:
            return none | json.loads(rows[0][0])
        except (IndexError, ValueError) as e:
            raise StoreError(f"the index of {project} has a broken manifest", manifest=names[-1]) from e

    def _commit(self, project: str, before: dict, after: dict) -> None:
        fs, path = self._fs()
        version = before["version"] + 1
        name = f"{self.root}/{project}/manifest-{version:012d}"
        at, draft = path(name), path(f"{self.root}/{project}/draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(after | {"version": version, "written": datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")}).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(draft, at):
            fs.delete(draft, False)
            raise StoreError(f"the index of {project} was changed by another writer", version=version)
        # The version before stays for readers that have begun; what only older ones name goes.
        for old in self._manifests(project)[:-2]:
            fs.delete(path(f"{self.root}/{project}/{old}"), False)
        alive = {f for m in (before, after) for t in m["tables"].values() for f in t.values()}
        for t in SCHEMAS:
            for commit in self._names(f"{self.root}/{project}/{t}"):
                if not any(f.startswith(f"{t}/{commit}/") for f in alive):
                    fs.delete(path(f"{self.root}/{project}/{t}/{commit}"), True)

    def create(self, project: str, dimensions: int | None = None, metric: str = "cosine") -> dict:
        """An empty index with the length and measure of its vectors; one that is there is left alone."""
        check_project(project)
        if metric not in METRICS or dimensions is not None and dimensions < 1:
            raise ValueError("metric must be cosine or euclidean, dimensions positive")
        now = self.manifest(project)
        if not now["version"]:
            self._commit(project, now, now | {"dimensions": dimensions, "metric": metric})
        return self.manifest(project)

    def projects(self) -> list[str]:
        return [p for p in self._names(self.root) if self._manifests(p)]

    def _paths(self, table: str, project: str, buckets: list[int] | None = None, manifest: dict | None = None) -> list[str]:
        held = (manifest or self.manifest(project))["tables"][table]
        return [f"{self.root}/{project}/{f}" for b, f in sorted(held.items()) if buckets is None or int(b) in buckets]

    def read(self, table: str, project: str | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table, or one project's part of it, in one scan; nothing else is listed or read then."""
        paths = [x for p in ([project] if project is not None else self.projects()) for x in self._paths(table, p, buckets)]
        return self.spark.read.schema(SCHEMAS[table]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[table])

    def _write(self, table: str, project: str, rows: DataFrame, buckets: list[int], now: dict, files: int = 1) -> dict[str, str]:
        """Folders by bucket after the rows have been written as the whole contents of the given buckets."""
        names = [c.split(" ")[0] for c in SCHEMAS[table].split(", ")]
        rows = rows.filter(F.col("project_name") == project).select(*names)
        if table == "chunks" and now["dimensions"]:
            wrong = F.raise_error(F.concat(F.lit(f"{DimensionError.code}: expected {now['dimensions']} dimensions, not "), F.size("embedding").cast("string"))).cast("array<float>")
            rows = rows.withColumn("embedding", F.when(F.size("embedding") == now["dimensions"], F.col("embedding")).when(F.col("embedding").isNotNull(), wrong))
        commit = f"{table}/{uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", bucket(F.col(PATH[table])))
        dealt = dealt.repartition(min(len(buckets), BUCKETS) * files, "bucket", *([F.pmod(F.hash(PATH[table]), F.lit(files))] if files > 1 else []))
        dealt.sortWithinPartitions("bucket", PATH[table]).write.partitionBy("bucket").parquet(f"{self.root}/{project}/{commit}")
        made = {n.removeprefix("bucket=") for n in self._names(f"{self.root}/{project}/{commit}") if n.startswith("bucket=")}
        kept = {b: f for b, f in now["tables"][table].items() if int(b) not in buckets}
        return kept | {b: f"{commit}/bucket={b}" for b in made}

    def write(self, table: str, project: str, rows: DataFrame) -> None:
        """The rows as the project's whole table."""
        check_project(project)
        now = self.manifest(project)
        self._commit(project, now, now | {"tables": now["tables"] | {table: self._write(table, project, rows, [*range(BUCKETS)], now)}})

    def _touched(self, paths: DataFrame) -> list[int]:
        return sorted(r[0] for r in paths.select(bucket(F.col("path")).alias("b")).distinct().collect())  # BUCKETS rows at most

    def upsert(self, project: str, files: DataFrame, chunks: DataFrame) -> list[int]:
        """Files by key; their chunks are replaced. Returns the buckets that were written."""
        check_project(project)
        now, paths = self.manifest(project), files.select("project_name", "path")
        touched = self._touched(paths)
        if touched:
            next_chunks = changes.replace_chunks(self.read("chunks", project, touched), paths, chunks)
            next_files = changes.upsert(self.read("files", project, touched), files)
            made = {t: self._write(t, project, rows, touched, now) for t, rows in (("chunks", next_chunks), ("files", next_files))}
            self._commit(project, now, now | {"tables": made})
        return touched

    def delete(self, project: str, paths: DataFrame) -> list[dict]:
        """Status and chunks removed for each of the paths; nothing is written if none is given."""
        if paths.isEmpty():
            return []
        now, touched = self.manifest(project), self._touched(paths)
        files, chunks, done = changes.delete_files(self.read("files", project, touched), self.read("chunks", project, touched), paths)
        out = [r.asDict() for r in done.collect()]  # as many rows as paths were asked for
        if any(r["status"] == "success" for r in out):
            made = {t: self._write(t, project, rows, touched, now) for t, rows in (("chunks", chunks), ("files", files))}
            self._commit(project, now, now | {"tables": made})
        return out

    def drop(self, project: str) -> None:
        fs, path = self._fs()
        fs.delete(path(f"{self.root}/{check_project(project)}"), True)

    def stats(self, project: str) -> dict:
        """What the index of a project holds: chunks with vectors, their dimensions, and how they are measured."""
        r = self.read("chunks", project).agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("vectors"), F.max(F.size("embedding")).alias("dimensions")).first()
        return r.asDict() | {"similarity": self.manifest(project)["metric"]}

    def optimize(self, project: str, target_mb: int = 128) -> dict:
        """Rewrite a project's buckets in files of about ``target_mb``; says how long it took and the files of each table after."""
        import time

        fs, path = self._fs()
        began, now, tables, files = time.perf_counter(), self.manifest(project), {}, {}
        for t in SCHEMAS:
            if paths := self._paths(t, project, manifest=now):
                size = sum(fs.getContentSummary(path(p)).getLength() for p in paths)
                tables[t] = self._write(t, project, self.read(t, project), [*range(BUCKETS)], now, files=max(1, round(size / (target_mb << 20) / BUCKETS)))
                files[t] = len(tables[t])
        if tables:
            self._commit(project, now, now | {"tables": now["tables"] | tables})
        return {"seconds": round(time.perf_counter() - began, 3), "files": files}

    def indexes(self) -> DataFrame:
        """What there is: table, project, version, and what its vectors are like."""
        rows = [(t, p, str(m["version"]), m["dimensions"], m["metric"]) for p in self.projects() for m in [self.manifest(p)] for t in SCHEMAS]
        return self.spark.createDataFrame(rows, "table string, project_name string, version string, dimensions int, metric string")


def check_project(name: str) -> str:
    name = (name or "").strip()
    if not re.fullmatch(r"[a-zA-Z0-9_-]{1,100}", name):
        raise ValueError(f"not a project name: {name!r}")
    return name
