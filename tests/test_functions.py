"""Column functions against plain Python on known and random inputs."""

import ast
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import metrics as M
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import chunking, detection, profiling
from quarry.operators.complexity import java, kotlin, python


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


@pytest.mark.parametrize(
    "path,category,language",
    [("tests/test_example.py", "test", "python"), ("config.yaml", "config", "yaml"), ("README.md", "documentation", "markdown"), ("data.csv", "resource", "text"), ("src/main.py", "source", "python"), (".bashrc", "config", "text"), ("latest/x.go", "test", "go"), ("a/Dockerfile", "source", "text"), ("A/B.PY", "source", "python"), ("x.", "source", "text")],
)
def test_categories(spark, path, category, language):
    flags = T.file_flags(F.col("p"))
    assert values(spark, [(path,)], "p string", T.file_category(flags), T.language(F.col("p"))) == [(category, language)]


@pytest.mark.parametrize(
    "path,content,language,want",
    [("src/module/submodule/file.py", "", "python", "module.submodule"), ("src/a/__x__/f.py", "", "python", "a"), ("src/f.py", "", "python", None), ("lib/site-packages/numpy/core/x.py", "", "python", "numpy"), ("x.java", "// c\npackage com.example;\nclass A {}", "java", "com.example"), ("src/components/ui/Button.tsx", "", "typescript", "components/ui"), ("a.cs", "namespace A.B {", "csharp", "A.B"), ("a.go", "package x;", "go", None)],
)
def test_namespaces(spark, path, content, language, want):
    assert values(spark, [(path, content, language)], "p string, c string, l string", T.namespace(F.col("p"), F.col("c"), F.col("l"))) == [(want,)]


@pytest.mark.parametrize("raw,want", [("class Abc:", "class Abc\\\\:"), ("function test()", "function test\\\\(\\\\)"), ("query & filter", "query & filter"), ("test/path", "test\\\\/path"), ("!important", "\\\\!important"), ("", "")])
def test_escaping(spark, raw, want):
    assert values(spark, [(raw,)], "q string", T.escape_query(F.col("q"))) == [(want,)]


@pytest.mark.parametrize("raw,slashes", [("class A:", 6), ("a && b", 3), ("test/path", 2), ("->", 8)])
def test_sequential_escaping(spark, raw, slashes):
    ((out,),) = values(spark, [(raw,)], "q string", T.escape_query(F.col("q"), sequential=True))
    assert out.count("\\") == slashes


def test_phrase(spark):
    assert values(spark, [('a"b\\c',), ("",)], "q string", T.phrase_quote(F.col("q"))) == [('"a\\"b\\\\c"',), ("",)]


def test_lines_and_words_like_python(spark):
    r = random.Random(4)
    texts = ["", "a", "\n", "a\r\nb", "a\rb\n", "x y", "\x1ca\x85", "é" * 20_000 + " b", " z"] + ["".join(r.choice("ab \n\r\t\x0b\x0c\x1d\x1f\x85  　é𝒳") for _ in range(r.randint(0, 40))) for _ in range(200)]

    def cut(w):
        return w if len(w.encode()) <= T.TERM_BYTES else w.encode()[: T.TERM_BYTES].decode(errors="ignore")

    got = values(spark, [(t,) for t in texts], "t string", T.line_count(F.col("t")), T.sanitize(F.col("t")))
    assert got == [(len(t.splitlines()), " ".join(map(cut, t.split()))) for t in texts]


def test_vectors(spark):
    a, b = F.col("a"), F.col("b")
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([3.0, 4.0], [3.0, 4.0])]
    got = values(spark, rows, "a array<float>, b array<float>", V.cosine(a, b), V.euclidean_score(a, b), V.normalize(a), V.normalize(a, zero_to_zeros=False), V.index_score(V.cosine(a, b)))
    assert got[0][0] == pytest.approx(0.5**0.5) and got[1][0] == 0 and got[2][:2] == (pytest.approx(1), 1.0)
    assert got[0][1] == 0.5 and got[2][2] == [0.6, 0.8] and got[1][2] == got[1][3] == [0.0, 0.0] and got[2][4] == pytest.approx(1)


def test_md5_embedding_is_the_provider_s(spark):
    from quarry.plans.embedding import HashProvider

    ((v,),) = values(spark, [("some text",)], "t string", V.md5_embedding(F.col("t"), 20))
    assert v == pytest.approx(HashProvider(20).embed_batch(["some text"])[0])


def test_metrics(spark):
    cases = [(0, False, 1), (1, False, 2), (3, False, 4), (0, True, 1), (1, True, 3), (2, True, 4)]
    assert values(spark, [c[:2] for c in cases], "n int, f boolean", M.cognitive_increment(F.col("n"), F.col("f"))) == [(c[2],) for c in cases]
    texts = ["# c\nx", "/* a\nb */\nx\n# y\n# z", '"""a\nb"""\nx', "x"]
    assert values(spark, [(t,) for t in texts], "t string", F.round(M.comment_ratio(F.col("t")), 4)) == [(0.5,), (0.8,), (0.0,), (0.0,)]
    assert values(spark, [(0, 0), (10, 50)], "c int, l int", F.round(M.maintainability(F.col("c"), F.col("l")), 3))[0] == (100.0,)
    assert values(spark, [("a && b || c and d or not e",)], "t string", M.logical_operators(F.col("t"))) == [(5,)]
    assert values(spark, [(60, 50, 12, 400)], "a int, b int, c int, d int", M.risk_score(*map(F.col, "abcd"))) == [(pytest.approx(100.0),)]
    assert values(spark, [(8, 4, 9)], "a int, b int, c int", M.halstead_difficulty(*map(F.col, "abc"))) == [(9.0,)]


@pytest.mark.parametrize("code,cc", [("def f(): pass", 1), ("def f(a):\n for x in a:\n  if x: break", 3), ("def f():\n while a:\n  if b: pass\n  elif c: pass", 4), ("def f():\n try: pass\n except A: pass\n except B: pass", 3), ("async def f(): await x", 2), ("def f(a): return [x for x in a if x if a]", 4), ("def f(a, b): return a and b or a", 3), ("def f():\n with a: return lambda: 1", 3)])
def test_python_complexity(code, cc):
    assert python.analyze(code)["functions"][0]["complexity"] == cc


def test_python_rows():
    code = "class A:\n    class B:\n        def m(self): return m()\n    @d\n    @e\n    async def n(self, x: int):\n        yield x\n\ndef f(): pass\ndef f(n):\n    if (y := n) > 1:\n        return f(n - 1)\n"
    r = python.analyze(code)
    rows = {(f["name"], f["line_start"]): f for f in r["functions"]}
    assert [(c["name"], c["parent_class"], c["nesting_depth"], c["method_count"]) for c in r["classes"]] == [("A", None, 0, 1), ("B", "A", 1, 1)]
    n = rows["n", 6]
    assert n["type"] == "async_method" and n["decorator_count"] == 2 and n["is_generator"] and n["has_type_annotations"]
    assert rows["f", 10]["is_recursive"] and rows["f", 10]["uses_walrus_operator"]
    assert len(python.analyze(code, last_of_name=True)["functions"]) == len(r["functions"]) - 1
    assert "Syntax error" in python.analyze("def (")["error"]
    assert python.cyclomatic(ast.parse("def f():\n assert x\n return [a for a in b]").body[0], "plain") == 2


@pytest.mark.parametrize("body,cc", [("if (a) { b(); }", 2), ("for (int i=0;i<n;i++) { }", 2), ("while (a) { }", 2), ("do { a(); } while (b);", 2), ("try { a(); } catch (E e) { }", 2), ("switch (a) { case 1: b(); break; default: c(); }", 3), ("return a ? b : c;", 2), ("if (a && b || c) { }", 4), ("x.forEach(y -> z(y));", 2), ('s = "if (a) { && }"; // if (', 1), ("list.stream().filter(a).map(b);", 3)])
def test_java_complexity(body, cc):
    r = java.analyze("package a;\npublic class C {\n  private int f(int a, Map<String, List<X>> b) throws E {\n " + body + "\n }\n}")
    assert [(f["name"], f["complexity"], f["parameters"]) for f in r["functions"]] == [("C.f", cc, 2)]


def test_java_types():
    r = java.analyze("interface I { void a(); default int b() { return 1; } }\nclass C extends D { C(int x) { } class N { void m() { new R() { }; } } enum E { A, B } }")
    assert [f["name"] for f in r["functions"]] == ["I.b", "C.C", "N.m"] and r["functions"][1]["type"] == "constructor"
    assert {(c["name"], c["parent_class"]) for c in r["classes"]} == {("I", None), ("C", None), ("N", "C"), ("E", "C")}
    assert java.analyze("class A {")["error"]


@pytest.mark.parametrize("body,cc", [("if (a) { b() }", 2), ("for (x in y) { }", 2), ("while (a) { }", 2), ("do { } while (a)", 3), ("when (a) { 1 -> b\n else -> c }", 3), ("if (a) { } else if (b) { }", 4), ("x.map { it + 1 }", 2)])
def test_kotlin_complexity(body, cc):
    assert kotlin.analyze("fun f(a: Int, b: Int): Int { " + body + " }")["functions"][0]["complexity"] == cc


def test_kotlin_rows():
    r = kotlin.analyze("data class P(val a: Int) { }\nsealed class S { class A : S()\n object B : S() }\nclass C { suspend fun String.g(x: Int) { if (x > 1) { } } }")
    assert {c["name"]: c["total_complexity"] for c in r["classes"]}["P"] == 1
    g = next(f for f in r["functions"] if f["name"] == "String.g")
    assert g["type"] == "suspend_function" and g["complexity"] == 4
    assert kotlin.analyze("fun f() {")["error"] and kotlin.analyze("fun f {}")["error"] and not kotlin.analyze("").get("error")


def test_chunks_are_bounded_and_lossless():
    r = random.Random(1)
    line = "".join(r.choice("ab ,é𝒳;") for _ in range(60_000))
    parts = chunking.split_large_line(line)
    assert "".join(parts) == line and all(len(p.encode()) <= T.CHUNK_BYTES for p in parts)
    texts = ["small", "\n".join("x" * 40 for _ in range(1500)), "\n".join("y" * 900 for _ in range(100)), "head\n" + line + "\ntail\n" * 900, "🎉" * 20_000]
    for t in texts:
        chunks = chunking.chunk_content(t)
        assert all(len(c.encode()) <= T.CHUNK_BYTES for c in chunks)
        assert all(len(c.encode()) <= T.CHUNK_BYTES for c in chunking.chunk_by_tokens(t))
        for text, a, b in chunking.chunk_spans(t):
            assert text in "\n".join(t.split("\n")[a - 1 : b])
    assert len(chunking.chunk_content(texts[1], compat=True)) == 54 and len(chunking.chunk_content(texts[2], compat=True)) == 100
    assert len(chunking.chunk_content(texts[1])) == 4 and chunking.chunk_content("") == [""]


def test_chunk_rows(spark):
    rows = [(1, "a\nb"), (2, None), (3, ""), (4, "\n".join("x" * 40 for _ in range(1500)))]
    got = chunking.chunk_files(spark.createDataFrame(rows, "id long, content string"), ["id"]).collect()
    assert sorted((r.id, r.chunk_index, r.start_line, r.end_line) for r in got) == [(1, 0, 1, 2), (3, 0, 1, 1), (4, 0, 1, 500), (4, 1, 451, 950), (4, 2, 901, 1400), (4, 3, 1351, 1500)]


@pytest.mark.parametrize("code,want", [("import os\n\ndef f(x):\n    return os.path.join(x)\n", "python"), ("const f = (x) => { console.log(x); };\nfunction g() { return 1; }", "javascript"), ("public class A {\n  private int x;\n  public static void main(String[] a) { System.out.println(1); }\n}", "java")])
def test_detection(code, want):
    language, confidence, _ = detection.detect(code)
    assert language == want and confidence >= 0.9


def test_detection_falls_back():
    assert detection.detect("hello world", "a/b.rs")[0] == "rust"
    assert detection.detect("", "x.kt") == ("kotlin", 0.7, "extension")
    assert detection.detect("", None)[:2] == ("unknown", 0.0)


def test_tuning():
    assert profiling.tuned(20_000, 50, 500) == {"batch_size": 10, "cache_size": 100, "cache_ttl_seconds": 7200, "max_connections": 100, "min_connections": 20}
    assert profiling.tuned(500, 50, 1) == {"batch_size": 100}


def test_validation(spark):
    from quarry.operators import complexity

    kinds = f"total_complexity int, cognitive_complexity int, maintainability_index double, comment_ratio double, average_complexity double, function_count int, lines_of_code int, functions {'array<' + complexity.FUNCTION + '>'}"
    f = ("f", "function", 0, -1, 1, 2, 0, 0, 0, 0, 0, False, False, False, False, False, False)
    rows = spark.createDataFrame([(1, 1, 50.0, 0.1, 1.0, 1, 5, []), (-1, -1, 101.0, 1.5, 51.0, 0, 11, [f])], kinds)
    good, bad = complexity.validation(rows).collect()
    assert good.is_valid and not good.issues and not good.warnings
    assert not bad.is_valid and len(bad.issues) == 6 and len(bad.warnings) == 2
    assert [r[0] for r in rows.select(complexity.banded(F.col("maintainability_index"), "maintainability")).collect()] == ["fair", "excellent"]


def test_chunk_content_covers_every_document(spark, tmp_path):
    import hashlib

    from quarry import queries

    texts = {k: "\n".join(f"{k} line {i} " + "x" * 60 for i in range(n)) for k, n in ((1, 3), (4, 900), (7, 2000), (19, 1200))}
    spark.createDataFrame([(k, "s", t) for k, t in texts.items()], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.chunk_index, r.content_md5, r.start_line, r.end_line) for r in queries.QUERIES["chunk_content"](spark, str(tmp_path)).collect())
    assert got == [(k, i, hashlib.md5(c.encode()).hexdigest(), a, b) for k, t in texts.items() for i, (c, a, b) in enumerate(chunking.chunk_spans(t))]
