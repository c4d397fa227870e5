"""Files of a source tree as rows. Spark's own listing drops names that start with _ or a dot, so the tree is listed by
directory in tasks, and contents are read where they are used, by path."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import FileAccessError
from quarry.functions import text as T

#: What is ignored by default, and directories that are never entered.
IGNORED = [".*", "__pycache__", "*.pyc", "node_modules", ".git", ".venv", "venv", "env", "build", "dist", "*.egg-info", "*-lock.lock", "package-lock.json", "*.lock", "yarn.lock", "poetry.lock", "Pipfile.lock", "uv.lock"]
SKIPPED = {".git", ".idea", "__pycache__", "node_modules", ".venv", "venv", "env", ".ruff_cache", ".mypy_cache", ".pytest_cache"}
SERVER_GLOBS = ["*.py", "*.js", "*.ts", "*.jsx", "*.tsx", "*.java", "*.cpp", "*.c", "*.h", "*.go", "*.rs"]
PRESETS = {"server": {"chunk_size": 100, "overlap": 20, "patterns": SERVER_GLOBS}, "initialize": {"chunk_size": 500, "overlap": 50, "patterns": ["*"]}}


def glob_regex(pattern: str) -> str:
    return fnmatch.translate(pattern)


def gitignore_rules(text: str) -> list[tuple[re.Pattern, bool, bool]]:
    """(regex on the relative path, negated, directories only) for each line; later rules overrule earlier ones."""
    out = []
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line.removeprefix("\\")
        only_dirs = line.endswith("/")
        body = line.rstrip("/")
        anchored = "/" in body
        rx = ""
        parts = body.removeprefix("/").split("/")
        for k, part in enumerate(parts):
            last = k == len(parts) - 1
            if part == "**":
                rx += ".*" if last else "(?:.*/)?"
                continue
            for token in re.findall(r"\[!?\]?[^\]]*\]|\\.|.", part):
                rx += "[^/]*" if token == "*" else "[^/]" if token == "?" else "[^" + token[2:] if token.startswith("[!") else token if token.startswith("[") and len(token) > 1 else re.escape(token.removeprefix("\\") if len(token) > 1 else token)
            rx += "" if last else "/"
        out.append((re.compile(("" if anchored else "(?:.*/)?") + rx + "(?=/|$)"), negated, only_dirs))
    return out


def gitignored(rules: list, path: str, is_dir: bool = False) -> bool:
    hit = False
    for rx, negated, only_dirs in rules:
        m = rx.match(path)
        if m and (not only_dirs or m.end() < len(path) or is_dir):
            hit = not negated
    return hit


def included(path: str, patterns: list[str], ignored: list[str], rules: list) -> bool:
    """Whether a relative path is taken: not ignored by rules or by any of its parts, and its name among the patterns."""
    parts = path.split("/")
    if gitignored(rules, path) or any(fnmatch.fnmatch(x, p) for p in ignored for x in parts):
        return False
    return any(fnmatch.fnmatch(parts[-1], p) for p in patterns)


def include_filter(path, patterns: list[str], ignored: list[str]):
    """The pattern part of ``included`` as a column: for rows that are listed already."""
    name = T.filename(path)
    match = F.rlike(name, F.lit("|".join(f"(?:{_java(p)})" for p in patterns)))
    return match & ~F.exists(F.split(path, "/"), lambda x: F.rlike(x, F.lit("|".join(f"(?:{_java(p)})" for p in ignored))))


def in_skipped_directory(path):
    """Whether a path leads through a directory that is never entered."""
    return F.exists(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), lambda x: x.isin(sorted(SKIPPED)))


def _java(pattern: str) -> str:
    """A shell pattern as a Java expression on a whole name, classes of characters too."""
    rx = ""
    for part in re.findall(r"\[!?\]?[^\]]*\]|.", pattern, re.DOTALL):
        if len(part) > 1:
            rx += "[" + ("^" if part[1] == "!" else "") + re.sub(r"([\\\[&^])", r"\\\1", part[2 if part[1] == "!" else 1 : -1]) + "]"
        else:
            rx += ".*" if part == "*" else "." if part == "?" else re.escape(part)
    return rf"(?s)\A{rx}\z"


def _walk(root: str, top: str, rules: list, deep: bool) -> Iterator[str]:
    todo = [top]
    while todo:
        here = todo.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, here) if here else root), key=lambda e: e.name)
        except OSError:  # a folder that can't be listed is left out, and the rest goes on
            continue
        for e in entries:
            rel = f"{here}/{e.name}" if here else e.name
            if e.is_dir(follow_symlinks=False):
                if deep and e.name not in SKIPPED and not gitignored(rules, rel, True):
                    todo.append(rel)
            elif e.is_file():
                yield rel


def ignore_rules(root: str) -> list:
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8") as f:
            return gitignore_rules(f.read())
    except (OSError, UnicodeDecodeError):
        return []


def _row(root: str, rel: str) -> tuple | None:
    try:
        s = os.stat(os.path.join(root, rel))
    except OSError:
        return None
    return rel, s.st_size, datetime.fromtimestamp(s.st_mtime)


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None, ignored: list[str] | None = None, use_gitignore: bool = True) -> DataFrame:
    """path (relative), size, last_modified, language. Each directory at the top is listed in a task of its own; the tree must be
    mounted where tasks run."""
    root = os.path.abspath(root)
    rules = ignore_rules(root) if use_gitignore else []
    want, avoid = patterns or ["*"], sorted({*IGNORED, *(ignored or [])})
    if not os.path.isdir(root):
        raise FileAccessError(f"not a folder: {root}", root=root)
    tops = [e.name for e in os.scandir(root) if e.is_dir(follow_symlinks=False) and e.name not in SKIPPED and not gitignored(rules, e.name, True)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top in batch.column(0).to_pylist():
                got = [r for rel in _walk(root, top, rules, bool(top)) if included(rel, want, avoid, rules) and (r := _row(root, rel))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in got], pa.string()), pa.array([r[1] for r in got], pa.int64()), pa.array([r[2] for r in got], pa.timestamp("us"))], names=["path", "size", "last_modified"])

    listed = spark.createDataFrame([(t,) for t in ["", *sorted(tops)]], "top string").repartition(len(tops) + 1, "top")
    return listed.mapInArrow(read, "path string, size long, last_modified timestamp_ntz").withColumn("language", T.language(F.col("path")))


def files_at(paths: DataFrame, root: str, patterns: list[str] | None = None, ignored: list[str] | None = None) -> DataFrame:
    """The rows of the files at given relative paths (a column ``path``), each looked up in the task that holds it; those that are gone or left
    out have none."""
    root = os.path.abspath(root)
    rules, want, avoid = ignore_rules(root), patterns or ["*"], sorted({*IGNORED, *(ignored or [])})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [r for p in batch.column(0).to_pylist() if p and not p.startswith(("/", "..")) and included(p, want, avoid, rules) and (r := _row(root, p))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in got], pa.string()), pa.array([r[1] for r in got], pa.int64()), pa.array([r[2] for r in got], pa.timestamp("us"))], names=["path", "size", "last_modified"])

    return paths.select("path").mapInArrow(read, "path string, size long, last_modified timestamp_ntz").withColumn("language", T.language(F.col("path")))


def file_info(spark: SparkSession, root: str, path: str, **options) -> DataFrame:
    """The row of one file; none if it is missing or left out."""
    root = os.path.abspath(root)
    rel = os.path.relpath(os.path.join(root, path), root)
    rules = ignore_rules(root)
    ok = not rel.startswith("..") and included(rel, options.get("patterns") or ["*"], sorted({*IGNORED, *(options.get("ignored") or [])}), rules)
    row = _row(root, rel) if ok else None
    return spark.createDataFrame([row] if row else [], "path string, size long, last_modified timestamp_ntz").withColumn("language", T.language(F.col("path")))


def with_content(files: DataFrame, root: str) -> DataFrame:
    """Add content: text in UTF-8 with line ends folded to \\n; files that can't be read or decoded are left out."""
    root = os.path.abspath(root)
    where = files.columns.index("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str | None] = []
            for p in batch.column(where).to_pylist():
                try:
                    with open(os.path.join(root, p), encoding="utf-8") as f:
                        out.append(f.read())
                except (OSError, UnicodeDecodeError):
                    out.append(None)
            full = pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "content"])
            yield full.filter(full.column(full.num_columns - 1).is_valid())

    return files.mapInArrow(read, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema) + ", content string")


def text_of(binary):
    """Valid UTF-8 bytes as text with folded line ends; null for others."""
    s = binary.cast("string")
    return F.when(F.is_valid_utf8(s), T.fold_newlines(s))
