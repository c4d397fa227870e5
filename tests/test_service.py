"""Caches, batches, the store's manifests, watching a tree, tools' answers and errors, patterns of paths."""

import fnmatch
import json
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry import cli
from quarry.errors import FileAccessError, IndexingError, QuarryError, StoreError
from quarry.operators import batches, caching, complexity, detection, profiling, search
from quarry.operators.complexity import common, kotlin
from quarry.plans import index
from quarry.plans.api import Tools
from quarry.plans.embedding import RemoteProvider, embed_query, truncate_tokens
from quarry.sources import scan
from quarry.sources.store import Store, bucket
from quarry.streaming import changes as streaming


def test_cache():
    now = [0.0]
    c = caching.Cache(most=2, seconds=10, clock=lambda: now[0])
    c.put("a", "xx")
    c.put("b", "yyyy")
    assert c.get("a") == "xx" and c.get("z") is None
    c.put("c", "z")  # b was used least lately
    assert c.get("b") is None and c.counts.evicted == 1 and len(c) == 2
    now[0] = 11
    assert c.get("a") is None and c.purge() == 1 and len(c) == 0
    s = c.stats()
    assert (s["hits"], s["misses"], s["expired"], s["hit_rate"], s["average_size"]) == (1, 3, 2, 0.25, 0.0)
    small = caching.Cache(most=100, most_bytes=5)
    for k in "abc":
        small.put(k, "xxx")
    assert len(small) == 1 and small.stats()["bytes"] == 3


def test_cache_is_saved_and_layered(tmp_path):
    now = [100.0]
    c = caching.Cache(seconds=10, clock=lambda: now[0])
    c.put("a", [1, 2])
    now[0] = 105
    c.put("b", 3)
    c.save(str(tmp_path / "c.json"))
    now[0] = 112
    d = caching.Cache(seconds=10, clock=lambda: now[0])
    assert d.load(str(tmp_path / "c.json")) == 1 and d.get("b") == 3 and d.get("a") is None and d.load(str(tmp_path / "none")) == 0
    two = caching.Levels(caching.Cache(most=1), caching.Cache(most=10))
    for k in range(3):
        two.put(k, k)
    assert two.get(0) == 0 and two.get(0) == 0 and two.get(9) is None
    assert two.stats()["hit_rate"] == pytest.approx(2 / 3) and two.stats()["near"]["hits"] == 1


def test_decorators():
    calls, told = [], []

    @caching.timed(lambda *x: told.append(x))
    @caching.cached(caching.Cache())
    def f(x):
        calls.append(x)
        if x < 0:
            raise ValueError
        return x * 2

    assert f(2) == f(2) == 4 and calls == [2]
    with pytest.raises(ValueError):
        f(-1)
    assert [(n, ok) for n, _, ok in told] == [("f", True), ("f", True), ("f", False)] and all(ms >= 0 for _, ms, _ in told)


def test_cache_keys_are_one(spark):
    rows = [("text", "a.py"), ("text", ""), ("text", None), ("é", "b")]
    got = spark.createDataFrame(rows, "c string, p string").select(caching.cache_key(F.col("c"), F.col("p"))).collect()
    assert [r[0] for r in got] == [caching.key_of(*r) for r in rows]


def test_batches(spark):
    rows = spark.createDataFrame([(1, "2"), (2, "x"), (3, None)], "id int, v string")
    assert [tuple(r) for r in batches.process(rows, ["id"], "v", lambda v: int(v) + 1, "int").collect()] == [(1, 3)]
    got = {r.id: (r.result, r.error) for r in batches.process(rows, ["id"], "v", lambda v: [v] * 2 if v else 1 / 0, "array<string>", keep_failed=True).collect()}
    assert got == {1: (["2", "2"], None), 2: (["x", "x"], None), 3: (None, "ZeroDivisionError: division by zero")}
    assert batches.process(rows.limit(0), ["id"], "v", int, "int").count() == 0


def test_analyzers_reach_the_executors(spark):
    complexity.register_analyzer("shout", lambda s: {"functions": [{"name": s, "type": "function", "complexity": len(s), "cognitive": 0, "line_start": 1, "line_end": 1, "parameters": 0, "depth": 0}], "lines": 1}, (".shout",))
    detection.add_parser("shout", lambda t: 0.99 if t.isupper() else 0.0)
    try:
        files = spark.createDataFrame([("HEY", "a"), ("def f(): pass", "b")], "content string, path string")
        found = detection.detect_files(files, ["path", "content"])
        assert {r.path: r.language for r in found.collect()} == {"a": "shout", "b": "python"} and "shout" in detection.parsers()
        assert {r.path: r.total_complexity for r in complexity.summary(complexity.analyze_files(found, ["path"]), ["path"]).collect()} == {"a": 3, "b": 1}
    finally:
        complexity.ANALYZERS.pop("shout")
        assert detection.remove_parser("shout")


KOTLIN = """package a
/* if (x) { */
sealed class Result<out T : Any>(val a: Int) : Base<Int>(1), Other {
    data class Ok(val v: Int) : Result<Int>(1)
    object Bad : Result<Int>(2)
    private suspend fun <T> List<T>.load(
        a: Map<String, Int>, f: (Int, Int) -> Int = { x, y -> x },
    ): Int {
        val s = "if (a) { && }"
        if (a > 1 && b) {
            for (i in 0..3) { list.map { it + 1 } }
        } else if (c) { return 1 }
        return when (a) {
            1 -> 2
            else -> { 3 }
        }
    }
    fun one(a: Int) = if (a > 1) 2 else 3
    abstract fun none(a: Int): Int
    fun empty(): Int { do { x() } while (a) ; return 0 }
}
class Empty
fun top(a: Int, b: Int) { while (a) { } }
"""


def test_kotlin_declarations():
    r = kotlin.analyze(KOTLIN)
    assert [(f["name"], f["type"], f["complexity"], f["parameters"], f["line_start"], f["line_end"]) for f in r["functions"]] == [("List.load", "suspend_function", 11, 2, 6, 17), ("empty", "function", 3, 0, 20, 20), ("one", "function", 2, 1, 18, 18), ("top", "function", 2, 2, 23, 23)]
    assert [(c["name"], c["method_count"], c["total_complexity"], c["max_method_complexity"]) for c in r["classes"]] == [("Result", 3, 15, 8), ("Ok", 0, 1, 0), ("Empty", 0, 0, 0)]
    assert len(kotlin.analyze(KOTLIN, twice=True)["functions"]) == 7


def test_path_patterns_agree(spark):
    patterns = ["*.py", "[ab]*.js", "[!x]y?", "a.b", "*", "[a-c][0-9].txt", "we[ird", "x]y", "*[*]*"]
    names = ["a.py", "b.js", "c.js", "ayz", "xyz", "a.b", "axb", "b7.txt", "d7.txt", "we[ird", "x]y", "a*b", "ab", "", "A.PY", "new\nline.py"]
    rows = spark.createDataFrame([(n,) for n in names], "path string")
    for p in patterns:
        got = {r.path for r in rows.filter(scan.include_filter(F.col("path"), [p], ["never"])).collect()}
        assert got == {n for n in names if fnmatch.fnmatchcase(n, p)}, p


def write(root, files):
    for name, text in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def test_one_change_writes_one_bucket(spark, tmp_path):
    root, store = tmp_path / "r", Store(spark, str(tmp_path / "s"))
    write(root, {f"src/f{k}.py": f"def f{k}(): pass" for k in range(30)})
    t = Tools(spark, str(root), "p", store)
    said = []
    assert t.initialize_repository(progress=lambda share, what: said.append(share))["indexed"] == 30
    assert said == sorted(said) and said[0] == 0 and said[-1] == 1
    before = store.manifest("p")
    write(root, {"src/f3.py": "def changed(): pass"})
    assert t.refresh_file("src/f3.py")["status"] == "updated"
    after = store.manifest("p")
    moved = {b for b in before["tables"]["chunks"] if before["tables"]["chunks"][b] != after["tables"]["chunks"][b]}
    assert len(moved) == 1 and after["version"] == before["version"] + 1 and store.read("files", "p").count() == store.read("chunks", "p").count() == 30
    hit = spark.createDataFrame([("src/f3.py",)], "p string").select(bucket(F.col("p"))).first()[0]
    assert moved == {str(hit)}
    assert t.delete_file("src/none.py")["status"] == "not_found" and store.manifest("p")["version"] == after["version"]
    with pytest.raises(StoreError):  # a writer that began from an older version
        store._commit("p", before, before)
    assert t.indexing_status()["coverage"] == 100.0 and store.indexes().count() == 2


def test_store_settings(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with store as s:
        assert s.create("p", 16, "euclidean")["dimensions"] == 16 and s.create("p", 8)["dimensions"] == 16
    assert store.projects() == ["p"] and store.read("files", "p").count() == 0 and store.stats("p") == {"chunks": 0, "vectors": 0, "dimensions": None, "similarity": "euclidean"}
    with pytest.raises(ValueError):
        store.create("q", 4, "manhattan")
    root = tmp_path / "r"
    write(root, {"a.py": "x = 1"})
    assert index.index_repository(spark, str(root), "p", store).indexed == 1  # the default provider's vectors have 16 dimensions
    store.create("eight", 8)
    with pytest.raises(IndexingError) as e:
        index.index_repository(spark, str(root), "eight", store)
    assert e.value.to_dict()["error_code"] == "INDEXING_ERROR" and "DIMENSION_ERROR" in e.value.details["reason"] and isinstance(e.value, QuarryError)
    assert store.read("files", "eight").count() == 0
    with pytest.raises(FileAccessError):
        scan.scan(spark, str(tmp_path / "nowhere"))


def test_watching(spark, tmp_path):
    root, store, log = tmp_path / "r", Store(spark, str(tmp_path / "s")), str(tmp_path / "log")
    write(root, {"a.py": "def a(): pass", "b.py": "def b(): pass"})
    with Tools(spark, str(root), "p", store) as t:
        t.initialize_repository()
        assert t.poll(log) == 0 and t.monitoring_status(log)["recent_changes"] == []
        write(root, {"c.py": "def c(): pass", "b.py": "def b(x): pass"})
        os.utime(root / "b.py", (time.time() + 50,) * 2)
        (root / "a.py").unlink()
        assert t.poll(log) == 3 and t.poll(log) == 0  # what is logged already is not logged again
        status = t.monitoring_status(log)
        assert {(c["change_type"], c["path"]) for c in status["recent_changes"]} == {("created", "c.py"), ("modified", "b.py"), ("deleted", "a.py")}
        assert status["monitoring_since"] and status["pending_changes"] >= 1
        before = store.manifest("p")["version"]
        t.start_monitoring(log, str(tmp_path / "cp"), every=None).awaitTermination(120)
        assert {r.path for r in store.read("files", "p").collect()} == {"b.py", "c.py"} and store.manifest("p")["version"] == before + 2
        assert t.poll(log) == 0
        text = t.search_code("def", "pattern")["text"]
        assert text.startswith("2 found") and "1. " in text and "Nothing" in t.search_code("absent words", "pattern")["text"]
        c = t.analyze_complexity("c.py", include_metrics=False)
        assert "maintainability_index" not in c and c["classes"] == [] and t.analyze_complexity("c.py")["comment_ratio"] == 0


def test_command_line(spark, tmp_path, capsys):
    root = tmp_path / "r"
    write(root, {"a.py": "def a(): pass"})
    at = ["--repository", str(root), "--project", "p", "--store", str(tmp_path / "s")]
    assert cli.main([*at, "index"]) == 0 and json.loads(capsys.readouterr().out)["indexed"] == 1
    write(root, {"b.py": "def b(): pass"})
    assert cli.main([*at, "watch", "--log", str(tmp_path / "l"), "--checkpoint", str(tmp_path / "c"), "--rounds", "1"]) == 0 and json.loads(capsys.readouterr().out) == {"changes": 1}
    assert cli.main([*at, "status", "--log", str(tmp_path / "l")]) == 0 and json.loads(capsys.readouterr().out)["indexed"] == 2
    assert cli.main([*at, "--quiet", "complexity", "b.py", "--no-metrics"]) == 0 and json.loads(capsys.readouterr().out)["total_complexity"] == 1
    assert cli.main(["--repository", str(tmp_path / "none"), "--project", "p", "--store", str(tmp_path / "s"), "index"]) == 1 and "FILE_ACCESS_ERROR" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["--verbose", "--quiet", "stats"])


def test_debounce_by_event_time(spark, tmp_path):
    log, t = str(tmp_path / "log"), datetime(2024, 1, 1)
    at = lambda s: t + timedelta(seconds=s)
    for part in ([("a", "created", at(0)), ("a", "modified", at(0.2))], [("b", "created", at(100))], [("b", "modified", at(200))]):
        spark.createDataFrame(part, streaming.EVENT).coalesce(1).write.mode("append").parquet(log)
        time.sleep(1.1)
    events = streaming.read_log(spark, log, files_per_trigger=1).withWatermark("ts", "1 second")
    got = streaming.drained(streaming.debounced_stream(events, 0.5, "EventTimeTimeout")).collect()
    assert sorted((r.path, r.change_type, (r.emitted - t).total_seconds()) for r in got) == [("a", "created", 0.0), ("a", "modified", 0.5), ("b", "created", 100.0), ("b", "modified", 200.0)]


def test_remote_providers_tell_queries():
    sent = []
    p = RemoteProvider(lambda m, ts, kind: (sent.append((ts, kind)), [[1.0]] * len(ts))[1], "m", 1, max_tokens=2, typed=True)
    assert p.embed_batch(["abcdefgh"]) == [[1.0]] and embed_query(p, "q") == [1.0] and sent == [(["abcdefg"], "document"), (["q"], "query")]
    with pytest.raises(ValueError):
        p.embed_batch(["x"], "other")


def test_truncation_by_tokens():
    tokenizers = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcdeé中") for _ in range(r.randint(1, 9))) for _ in range(300))
    from quarry.plans.embedding import _encoding

    rule = _encoding(path)
    assert isinstance(rule, tiktoken.Encoding)
    for most in (1, 7, 100):
        cut = truncate_tokens(text, most, path)
        assert text.startswith(cut) and len(rule.encode_ordinary(text)) > most and len(cut) >= len(rule.decode_bytes(rule.encode_ordinary(text)[:most])) // 4
    assert truncate_tokens("short", 100, path) == "short"


def test_searches_for_many_queries(spark):
    r = random.Random(4)
    rows = [(k, [r.gauss(0, 1) for _ in range(6)]) for k in range(300)] + [(900, None), (901, [1.0] * 5), (902, [0.0] * 6), (903, [None] * 6)]
    rows += [(k + 1000, rows[k][1]) for k in range(20)]
    table = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(5)
    asked = [(k, rows[k][1]) for k in range(7)] + [(7, [0.0] * 6), (8, None)]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
    norm = lambda v: sum(x * x for x in v) ** 0.5
    want = set()
    for q, v in asked[:8]:
        scored = sorted((-round(sum(a * b for a, b in zip(v, x, strict=True)) / (norm(v) * norm(x)), 12) if norm(v) * norm(x) else 0.0, k) for k, x in rows if x and len(x) == 6 and None not in x)
        want |= {(q, rank, k) for rank, (_, k) in enumerate(scored[:4], 1)}
    for block in (3, 2000):
        got = search.semantic_many(table, queries, 4, block=block).collect()
        assert {(r.query_id, r.rank, r.chunk_id) for r in got} == want
    assert search.semantic_many(table, queries.limit(0), 4).count() == 0 and search.semantic_many(table.limit(0), queries, 4).count() == 0


def test_windows_in_spans(spark):
    r = random.Random(5)
    rows = [(g, t, r.randrange(6), k) for g, n in (("a", 400), ("b", 3), ("c", 1)) for k, t in enumerate(sorted(r.choice((r.randrange(50), r.randrange(4000))) for _ in range(n)))]
    rows += [("up", k * k, k, k) for k in range(300)] + [("same", 7, v, v) for v in (3, 1, 2)] + [("none", 1, None, 0), ("none", 2, 5, 1)]
    table = spark.createDataFrame(rows, "grp string, t long, v int, k long").withColumn("at", F.struct("t", "k"))
    got = {x.grp: x.longest_rise for x in profiling.increase_runs(table, "grp", "at", "v", "k", time="t").collect()}
    plain = {x.grp: x.longest_rise for x in profiling.increase_runs(table, "grp", "at", "v", "k").collect()}
    for g in got:
        best = run = 0
        mine = [v for x, _, v, _ in sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[3]))]
        for a, b in zip(mine, mine[1:]):
            run = run + 1 if a is not None and b is not None and b > a else 0
            best = max(best, run)
        assert got[g] == plain[g] == best, g
    tasks = spark.createDataFrame([(g, t, t + (v or 0)) for g, t, v, _ in rows], "grp string, start long, end long")
    most = {x.grp: x.max_concurrent for x in profiling.max_concurrency(tasks, "grp").collect()}
    for g, n in most.items():
        moves = sorted(m for x, t, v, _ in rows if x == g for m in ((t, 1), (t + (v or 0), -1)))
        now = best = 0
        for k, (_, d) in enumerate(moves):
            now += d
            best = now if not k else max(best, now)
        assert n == best, g


def test_tree_depth():
    class Node:
        def __init__(self, kind, *children):
            self.kind, self.children = kind, children

    tree = Node("file", Node("if", Node("line"), Node("for", Node("if"))), Node("while"))
    assert common.nesting_depth(tree, lambda n: n.kind in ("if", "for", "while")) == 3 and common.nesting_depth(Node("x"), lambda n: False) == 0


def test_configuration():
    from quarry.config import Config, EmbeddingConfig, ProjectConfig

    c = Config.from_env({"PROJECT_NAME": "alpha", "REPOSITORY_PATH": "/x/y", "EMBEDDING_PROVIDER": "voyage", "EMBEDDING_DIMENSIONS": "8", "STORE_PATH": "/s"})
    assert (c.project.name, c.project.root, c.embedding.provider, c.embedding.dimensions, c.store) == ("alpha", "/x/y", "voyage", 8, "/s")
    assert ProjectConfig.from_path("/a/my repo!").name == "my_repo_" and EmbeddingConfig.from_env({}) == EmbeddingConfig()
    with pytest.raises(ValueError):
        ProjectConfig("not a name")


def test_streams_are_kept_by_name(spark, tmp_path):
    log = str(tmp_path / "log")
    spark.createDataFrame([("a", "created", datetime(2024, 1, 1))], streaming.EVENT).write.parquet(log)
    start = lambda: streaming.sink(streaming.read_log(spark, log), lambda a, b: None, str(tmp_path / "c"), "one", every="1 second")
    q = start()
    try:
        assert start().id == q.id and streaming.status(spark, "one")["is_running"]
    finally:
        streaming.stop_all(spark)
    assert not streaming.status(spark, "one")["is_running"] and not spark.streams.active


@pytest.mark.parametrize("stretch", [10_000, 7])
def test_debouncing_in_bursts(spark, monkeypatch, stretch):
    monkeypatch.setattr(streaming, "STRETCH", stretch)
    r = random.Random(3)
    t = datetime(2024, 1, 1)
    rows = [(p, r.choice(["created", "modified", "deleted"]), t + timedelta(seconds=s)) for p in "abc" for s in sorted(round(x, 3) for _ in range(60) for x in [r.choice((r.uniform(0, 40), r.uniform(0, 4000)))])]
    got = streaming.debounced(spark.createDataFrame(rows, "path string, change_type string, ts timestamp"), 0.5).collect()
    want = []
    for p in "abc":
        mine = sorted(((x[2] - t).total_seconds(), x[1]) for x in rows if x[0] == p)
        want += [(p, k, round(a, 3), round(e, 3)) for a, k, e in streaming.debounce_rows(mine, 0.5)]
    assert sorted((x.path, x.change_type, round((x.ts - t).total_seconds(), 3), round((x.emitted - t).total_seconds(), 3)) for x in got) == sorted(want)


@pytest.mark.parametrize("text,language", [("import os\n\ndef f(x):\n    return x\n\nclass A:\n    pass\n\n)broken(\n", "python"), ("public class A {\n  private final int x;\n  protected static void f() { System.out.println(1); }\n  public int g() { return 1; }\n", "java"), ("Dear all, (the meeting is moved\nto from import", "unknown")])
def test_detection_of_broken_sources(text, language):
    name, confidence = detection.by_syntax(text)
    assert name == language and (0.5 < confidence <= 1 if language != "unknown" else confidence == 0)
