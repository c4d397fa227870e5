"""Queries against SQL, changes, streams, scanning and a repository from end to end."""

import json
import os
import subprocess
import sys
import time
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry import queries
from quarry.operators import changes, complexity
from quarry.plans import samples
from quarry.plans.api import Tools
from quarry.plans.embedding import HashProvider, RemoteProvider, create_provider, xxh64
from quarry.sources import scan
from quarry.sources.store import Store
from quarry.streaming import changes as streaming

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return v if isinstance(v, (int, str, bool, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, sf, name):
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got
    if name in queries.ORACLE:
        rel = db.execute(queries.ORACLE[name])
        names = [c[0] for c in rel.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=str)


def files(spark, rows):
    return spark.createDataFrame([("p", *r) for r in rows], "project_name string, path string, last_modified timestamp_ntz")


def test_change_detection(spark):
    t = datetime(2024, 1, 1)
    now = files(spark, [("new", t), ("same", t), ("later", t + timedelta(1)), ("back", t - timedelta(1)), ("future", datetime(2999, 1, 1)), ("unknown", t), ("none", None)])
    was = files(spark, [("same", t), ("later", t), ("back", t), ("future", t), ("gone", t), ("unknown", None), ("none", None)])
    got = {r.path: r.status for r in changes.change_status(now, was).collect()}
    assert got == {"new": "new", "same": "unchanged", "later": "modified", "back": "unchanged", "future": "modified", "gone": "deleted", "unknown": "modified", "none": "unchanged"}
    assert changes.change_status(now.limit(0), was.limit(0)).count() == 0


def test_delete_reports_missing(spark):
    f = files(spark, [("a", None)])
    c = spark.createDataFrame([("p", "a", 0), ("p", "a", 1)], "project_name string, file_path string, chunk_index int")
    left, chunks, done = changes.delete_files(f, c, spark.createDataFrame([("p", "a"), ("p", "b")], "project_name string, path string"))
    assert left.count() == chunks.count() == 0
    assert {r.path: (r.status, r.chunks_removed) for r in done.collect()} == {"a": ("success", 2), "b": ("not_found", 0)}


def test_debounce():
    assert streaming.debounce_rows([(0, "a")], 0.5) == [(0, "a", 0)]
    assert streaming.debounce_rows([(0, "a"), (0.1, "b"), (0.2, "c")], 0.5) == [(0, "a", 0), (0.2, "c", 0.5)]
    assert streaming.debounce_rows([(0, "a"), (0.5, "b"), (0.6, "c"), (2, "d")], 0.5) == [(0, "a", 0), (0.5, "b", 0.5), (0.6, "c", 1.0), (2, "d", 2)]
    assert streaming.debounce_rows([], 1) == []


def test_streams(spark, tmp_path):
    log, out = str(tmp_path / "log"), []
    t = datetime(2024, 1, 1)
    rows = [("a", "created", t), ("a", "modified", t + timedelta(seconds=0.1)), ("b", "created", t), ("a", "modified", t + timedelta(seconds=0.2)), ("c", "deleted", t)]
    spark.createDataFrame(rows, streaming.EVENT).write.parquet(log)
    q = streaming.sink(streaming.read_log(spark, log), lambda a, b: out.append(({r.path for r in a.collect()}, {r.path for r in b.collect()})), str(tmp_path / "c1"), "sink-test", every=None)
    q.awaitTermination(60)
    assert out == [({"a", "b"}, {"c"})]
    q = streaming.debounced_stream(streaming.read_log(spark, log), delay=0.5).writeStream.format("memory").queryName("debounced").option("checkpointLocation", str(tmp_path / "c2")).trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(120):
            got = sorted((r.path, r.change_type) for r in spark.sql("SELECT * FROM debounced").collect())
            if len(got) == 4:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert got == [("a", "created"), ("a", "modified"), ("b", "created"), ("c", "deleted")]
    assert streaming.status(spark, "nothing")["is_running"] is False


def tree(root: Path, contents: dict[str, str | bytes]) -> None:
    for name, text in contents.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_gitignore():
    rules = scan.gitignore_rules("# c\n\n*.log\n/top.txt\nout/\ndocs/**/x.md\n!keep.log\na?c\n[xy].c\n")
    hit = lambda p, d=False: scan.gitignored(rules, p, d)
    assert hit("a.log") and hit("q/a.log") and not hit("keep.log") and hit("top.txt") and not hit("q/top.txt")
    assert hit("out/f.py") and hit("q/out", True) and not hit("out") and hit("docs/a/b/x.md") and hit("docs/x.md") and hit("abc") and hit("x.c") and not hit("z.c")


def test_scan(spark, tmp_path):
    tree(tmp_path, {"__init__.py": "", "a.py": "x", "pkg/__init__.py": "y", "pkg/_b.py": "z", ".hidden/c.py": "", "node_modules/d.js": "", "e.lock": "", "build/f.py": "", "skip.txt": "", "pkg/bad.py": b"\xff\xfe", "pkg/crlf.py": b"a\r\nb\rc", ".gitignore": "skip.txt\n"})
    rows = scan.scan(spark, str(tmp_path))
    assert {r.path for r in rows.collect()} == {"__init__.py", "a.py", "pkg/__init__.py", "pkg/_b.py", "pkg/bad.py", "pkg/crlf.py"}
    got = {r.path: r.content for r in scan.with_content(rows, str(tmp_path)).collect()}
    assert "pkg/bad.py" not in got and got["pkg/crlf.py"] == "a\nb\nc"
    keep = scan.include_filter(F.col("path"), ["*.py"], scan.IGNORED)
    table = spark.createDataFrame([("a.py",), ("a.js",), ("build/a.py",), ("x/.y/a.py",)], "path string")
    assert [r.path for r in table.filter(keep).collect()] == ["a.py"]
    assert scan.file_info(spark, str(tmp_path), "a.py").count() == 1 and scan.file_info(spark, str(tmp_path), "../x").count() == 0


def test_repository(spark, tmp_path):
    root, store = tmp_path / "repo", Store(spark, str(tmp_path / "store"))
    tree(root, {"src/app/main.py": "def main():\n    if a and b:\n        return find_me\n", "README.md": "The quick brown fox", "tests/test_a.py": "def test_a(): pass", "conf.json": "{}"})
    t = Tools(spark, str(root), "alpha", store)
    assert t.indexing_status()["is_indexed"] is False
    r = t.initialize_repository()
    assert (r["indexed"], r["new"], r["total"]) == (4, 4, 4)
    assert t.initialize_repository()["indexed"] == 0
    other = Tools(spark, str(root), "beta", store)
    other.initialize_repository()
    s = t.get_repository_stats()
    assert (s["total_files"], s["total_chunks"], s["languages"]) == (4, 4, "json,markdown,python")
    assert [x["file"] for x in t.search_code("quick brown", "pattern")["results"]] == ["README.md"]
    assert [x["file"] for x in t.search_code("find_\\w+", "pattern", is_regex=True)["results"]] == ["src/app/main.py"]
    top = t.search_code("The quick brown fox")["results"]
    assert top[0]["file"] == "README.md" and top[0]["similarity"] == 1.0 and len(top) == 4
    assert t.search_code("quick brown", "hybrid", limit=2)["results"][0]["file"] == "README.md"
    assert [f["path"] for f in t.list_files_by_category("test")["files"]] == ["tests/test_a.py"]
    info = t.get_file_info("src/app/main.py")
    assert info["namespace"] == "app" and info["chunk_count"] == 1 and info["indexed"] and "error" in t.get_file_info("nothing")
    (root / "conf.json").unlink()
    tree(root, {"new.kt": "fun f() { }", "README.md": "The slow fox"})
    os.utime(root / "README.md", (time.time() + 100,) * 2)
    assert t.poll(str(tmp_path / "log")) == 3
    t.start_monitoring(str(tmp_path / "log"), str(tmp_path / "cp"), every=None).awaitTermination(120)
    assert {x.path for x in store.read("files", "alpha").collect()} == {"src/app/main.py", "README.md", "tests/test_a.py", "new.kt"}
    assert t.search_code("slow", "pattern")["results"] and not t.search_code("quick", "pattern")["results"]
    assert t.refresh_file("new.kt")["status"] == "unchanged" and t.refresh_file("zzz.kt")["status"] == "missing"
    assert t.delete_file("new.kt") == {"status": "success", "chunks_removed": 1} and t.delete_file("new.kt")["status"] == "not_found"
    c = t.analyze_complexity("src/app/main.py")
    assert c["total_complexity"] == 3 and c["recommendations"] and "error" in t.analyze_complexity("README.md")
    assert other.get_repository_stats()["total_files"] == 4 and store.projects() == ["alpha", "beta"] and store.indexes().count() == 4
    before = store.read("files", "alpha").count()
    store.optimize("alpha")
    assert store.read("files", "alpha").count() == before and store.stats("alpha")["vectors"] == store.stats("alpha")["chunks"] == 3
    json.dumps(t.monitoring_status(), default=str)
    store.drop("beta")
    assert store.projects() == ["alpha"]


def test_project_names(spark, tmp_path):
    for bad in ("", "a b", "x" * 101, "a/b"):
        with pytest.raises(ValueError):
            Store(spark, str(tmp_path)).write("files", bad, spark.range(1))


def test_providers(spark):
    sent = []
    p = RemoteProvider(lambda m, ts: (sent.append(ts), [[float(len(t))] * 2 for t in ts])[1], "m", 2, batch=2)
    assert p.embed_batch(["a", " ", "bb", "ccc"]) == [[1.0, 1.0], [0.0, 0.0], [2.0, 2.0], [3.0, 3.0]] and sent == [["a", "bb"], ["ccc"]]
    assert isinstance(create_provider("hash"), HashProvider)
    for kind in ("openai", "other"):
        with pytest.raises(ValueError):
            create_provider(kind)
    import xxhash

    assert spark.createDataFrame([("é",)], "t string").select(xxh64(F.col("t"))).first()[0] == xxhash.xxh64("é".encode()).hexdigest()


def test_plans(spark, sf):
    """Filters and columns reach the scan, and rankings don't sort everything."""
    from quarry.operators import search
    from quarry.plans import adapt

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    top = plan(search.semantic(adapt.code_chunks(spark, sf), adapt.code_files(spark, sf), [0.1] * 64, 10))
    assert "TakeOrderedAndProject" in top and "CartesianProduct" not in top
    counts = plan(queries.QUERIES["file_category_counts"](spark, sf))
    assert "ArrowEvalPython" not in counts and counts.count("Exchange hashpartitioning") == 1
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").filter("source = 'src1'")
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src1)]" in plan(docs) and "text" not in plan(docs)


def test_without_the_llm_folders(tmp_path):
    import shutil

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'repo_stats' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


@pytest.mark.parametrize("ids", [[5627, 9467, 24827], range(15, 45)])
def test_recommendations_beyond_the_small_tables(spark, tmp_path, ids):
    """The first ids average above 10, which no document of the small tables does."""
    spark.createDataFrame([(i,) for i in ids], "doc_id long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.QUERIES["complexity_recommendations"](spark, str(tmp_path)).select("doc_id", "recommendations").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT doc_id, recommendations FROM ({queries.ORACLE['complexity_recommendations']})").fetchall())


def test_advice_gives_the_average_and_can_be_reworded(spark):
    files = samples.sources(spark.createDataFrame([(5627,)], "doc_id long"))
    rows = complexity.summary(complexity.analyze_files(files, ["doc_id"]), ["doc_id"])
    assert complexity.recommendations(rows).first().recommendations == ["Split when next changed: String.f (20)", "Functions average 10.5 decision paths: split the larger ones"]
    assert complexity.recommendations(rows, [complexity.Advice("total_complexity > 1", "'some'")]).first().recommendations == ["Split when next changed: String.f (20)", "some"]
