"""Sources with known measures: each document's id chooses which segments its function is made of.

A segment adds to the function what its line says, by the rules of complexity and not by the analyzers, so SQL can add up the expected
results. A third of the documents are Python, a third Java, a third Kotlin; every eleventh is broken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Segment:
    text: str
    cc: int  # decision points
    cognitive: int
    depth: int = 0  # of nested blocks (braces; Python counts functions)
    lambdas: int = 0


SEGMENTS = {
    "python": [
        Segment("    if a:\n        if b:\n            x = 1\n", 2, 3), Segment("    if a:\n        x = 1\n    elif b:\n        x = 2\n    else:\n        x = 3\n", 2, 2),
        Segment("    for i in a:\n        while b:\n            b -= 1\n", 2, 3), Segment("    try:\n        x = 1\n    except ValueError:\n        x = 2\n", 1, 1),
        Segment("    with open(a) as g:\n        if b:\n            x = g\n", 2, 3), Segment("    x = b and c or a\n", 2, 1), Segment("    y = [i for i in a if i if b]\n", 3, 0, lambdas=1),
        Segment("    z = lambda q: q\n", 1, 0, lambdas=1), Segment("    match a:\n        case 1:\n            x = 1\n        case _:\n            x = 2\n", 0, 0), Segment("    yield (w := b)\n", 0, 0),
    ],
    "java": [
        Segment("    if (a > 1) { if (b > 1) { x(); } }\n", 2, 3, 2), Segment("    if (a > 1) { x(); } else if (b > 1) { x(); }\n", 2, 2, 1),
        Segment("    for (int i = 0; i < a; i++) { while (b > 0) { b--; } }\n", 2, 3, 2), Segment("    do { b--; } while (b > 0);\n", 1, 1, 1),
        Segment("    switch (a) { case 1: x(); break; default: x(); }\n", 2, 2, 1), Segment("    try { x(); } catch (E e) { x(); }\n", 1, 1, 1), Segment("    c = a > 1 ? a : b;\n", 1, 1),
        Segment("    if (a > 1 && b > 1 || c > 1) { x(); }\n", 3, 3, 1), Segment("    list.forEach(y -> x(y));\n", 1, 1, lambdas=1), Segment("    list.stream().filter(p).map(q).sorted();\n", 3, 0),
    ],
    "kotlin": [
        Segment("        if (a > 1) { if (b > 1) { x() } }\n", 2, 2, 2), Segment("        if (a > 1) { x() } else if (b > 1) { x() }\n", 3, 2, 1), Segment("        for (i in a) { while (b > 1) { x() } }\n", 2, 2, 2),
        Segment("        do { x() } while (b > 1)\n", 2, 2, 1), Segment("        when (a) {\n            1 -> x()\n            else -> x()\n        }\n", 2, 3, 1), Segment("        val s = a > 1 && b > 1 || c\n", 2, 0),
        Segment("        list.map { it + 1 }\n", 0, 0, 1, 1), Segment("        list.each { p -> x(p) }\n", 0, 3, 1, 1), Segment('        val t = "if (a) { && }"\n', 0, 0),
        Segment("        if (a > 1) {\n            if (b > 1) {\n                x()\n            }\n        }\n", 2, 7, 2),
    ],
}
TEMPLATES = {
    "python": "# note\n@DECORATORS@@ASYNC@def f@N@(a, b: int):\n@BODY@    return @LAST@\n\nclass C@N@:\n    def m(self):\n        return 1\n\n    class Inner@N@:\n        def k(self):\n            if self:\n                return 2\n            return 3\n\ndef f@N@x(p): return p\ndef m(): return 0\n",
    "java": "// note\npackage p;\npublic class C@N@ {\n  C@N@(int a) { }\n  int f(int a, Map<String, List<X>> b) {\n@BODY@    return a;\n  }\n  interface I@N@ {\n    void q();\n    default int z() { return 1; }\n  }\n}\n",
    "kotlin": "// note\npackage p\nsealed class S@N@(val v: Int) {\n    class A@N@ : S@N@(1)\n    object B@N@ : S@N@(2)\n}\ndata class D@N@(val a: Int) { }\nclass C@N@ {\n    @ASYNC@fun String.f(a: Int, b: Int): Int {\n@BODY@        return a\n    }\n}\nfun g@N@(a: Int) = a + 1\n",
}
LANGUAGES = list(SEGMENTS)
#: Of the group g of a document (its id over three): which segments its function has, and what is marked.
BITS = "(doc_id DIV 3 * 37 % 1024)"


def _code(language: str) -> Column:
    g, bits = F.expr("doc_id DIV 3"), F.expr(BITS)
    body = F.concat(*(F.when(F.shiftright(bits, k).bitwiseAND(1) == 1, s.text).otherwise("") for k, s in enumerate(SEGMENTS[language])))
    marked = "async " if language == "python" else "suspend "
    n = F.col("doc_id").cast("string")
    parts = {
        "@BODY@": body, "@ASYNC@": F.when(g % 5 == 0, marked).otherwise(""), "@DECORATORS@": F.repeat(F.lit("@d\n"), (g % 5).cast("int")),
        "@LAST@": F.when(g % 7 == 0, F.concat(F.lit("f"), n, F.lit("(a, b)"))).otherwise("a"), "@N@": n,
    }
    out = F.lit(TEMPLATES[language])
    for mark, value in parts.items():
        out = F.replace(out, F.lit(mark), value)
    return out


def sources(docs: DataFrame) -> DataFrame:
    """doc_id, language, path, content."""
    part = F.col("doc_id") % 3
    code, lang, end = (F.when(part == 0, a).when(part == 1, b).otherwise(c) for a, b, c in ((_code("python"), _code("java"), _code("kotlin")), LANGUAGES, (".py", ".java", ".kt")))
    broken = F.when(F.col("doc_id") % 11 == 10, "}(\n").otherwise("")
    path = F.concat(F.lit("pkg/file"), F.col("doc_id").cast("string"), end)
    return docs.select("doc_id", lang.alias("language"), path.alias("path"), F.concat(broken, code).alias("content"))
