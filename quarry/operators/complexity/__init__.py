"""Complexity of source files: flat rows of functions and classes per file, summaries and recommendations from them.

A parser runs per file in ``mapInArrow`` batches, once; everything above rows of functions is DataFrame work.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import metrics as M
from quarry.functions.parallel import spread
from quarry.operators.complexity import java, kotlin, python

#: language -> function from source text to {"error", "lines", "comment_ratio", "functions", "classes"}
ANALYZERS: dict[str, Callable[[str], dict]] = {"python": python.analyze, "kotlin": kotlin.analyze, "java": java.analyze}
SUFFIXES = {".py": "python", ".java": "java", ".kt": "kotlin", ".kts": "kotlin"}
FEATURES = ["decorator_count", "exception_handlers_count", "lambda_count"]
FLAGS = ["uses_context_managers", "is_generator", "uses_walrus_operator", "uses_pattern_matching", "has_type_annotations", "is_recursive"]
FUNCTION = "struct<name:string,type:string,complexity:int,cognitive:int,line_start:int,line_end:int,parameters:int,depth:int," + ",".join(f"{c}:int" for c in FEATURES) + "," + ",".join(f"{c}:boolean" for c in FLAGS) + ">"
CLASS = "struct<name:string,parent_class:string,nesting_depth:int,line_start:int,line_end:int,method_count:int,total_complexity:int,max_method_complexity:int>"


def register_analyzer(language: str, analyze: Callable[[str], dict], suffixes: tuple[str, ...] = ()) -> None:
    ANALYZERS[language.lower()] = analyze
    SUFFIXES.update({s: language.lower() for s in suffixes})


def supported() -> list[str]:
    return sorted(ANALYZERS)


def analyze(source: str | None, language: str | None, options: dict[str, dict] | None = None, analyzers: dict[str, Callable[..., dict]] = ANALYZERS) -> dict:
    """One file. An unknown language or a broken source is an error with no rows. options: by language, what its analyzer is asked for."""
    empty = {"error": None, "lines": 0, "comment_ratio": 0.0, "functions": [], "classes": []}
    if not language or language.lower() not in analyzers:
        return empty | {"error": f"unsupported language: {language}"}
    return empty | analyzers[language.lower()](source or "", **(options or {}).get(language.lower(), {}))


def _rows(options: dict[str, dict] | None):
    analyzers = dict(ANALYZERS)  # those registered here go to the executors with the task

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 2
            out = [analyze(s, g, options, analyzers) for s, g in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
            text = [json.dumps({"functions": r["functions"], "classes": r["classes"]}) for r in out]
            cols = [*(batch.column(k) for k in range(n)), batch.column(n + 1), pa.array([r["error"] for r in out], pa.string()), pa.array([r["lines"] for r in out], pa.int32()), pa.array([float(r["comment_ratio"]) for r in out]), pa.array(text)]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:n], "language", "error", "lines_of_code", "comment_ratio", "found"])

    return rows


def analyze_files(files: DataFrame, key: list[str], content: str = "content", language: Column | None = None, options: dict[str, dict] | None = None) -> DataFrame:
    """Key columns, language, error, lines_of_code, comment_ratio, functions, classes. options: by language, such as ``{"kotlin": {"twice": True}}``."""
    kinds = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in key)
    lang = F.col("language") if language is None else language
    raw = spread(files.select(*key, F.col(content).alias("_c"), lang.alias("_l"))).mapInArrow(_rows(options), f"{kinds}, language string, error string, lines_of_code int, comment_ratio double, found string")
    got = F.from_json("found", f"struct<functions:array<{FUNCTION}>,classes:array<{CLASS}>>")
    return raw.withColumn("_f", got).select(*key, "language", "error", "lines_of_code", "comment_ratio", F.col("_f.functions").alias("functions"), F.col("_f.classes").alias("classes"))


def functions(analyzed: DataFrame, key: list[str]) -> DataFrame:
    rows = analyzed.select(*key, "language", F.explode("functions").alias("f")).select(*key, "language", "f.*")
    python_scale = F.col("language") == "python"
    cc = F.col("complexity")
    return rows.withColumns({"rank": F.when(python_scale, M.rank_of_complexity(cc)).otherwise(M.grade_of_complexity(cc)), "rank_scale": F.when(python_scale, "six").otherwise("five"), "classification": M.classification(cc), "lines_of_code": F.col("line_end") - F.col("line_start") + 1})


def classes(analyzed: DataFrame, key: list[str]) -> DataFrame:
    rows = analyzed.select(*key, "language", F.explode("classes").alias("c")).select(*key, "language", "c.*")
    return rows.withColumn("average_method_complexity", F.when(F.col("method_count") == 0, 0.0).otherwise(F.col("total_complexity") / F.col("method_count")))


def summary(analyzed: DataFrame, key: list[str]) -> DataFrame:
    """Totals, averages, maintainability and grade per file, from its arrays: no shuffle."""
    total = lambda c: F.aggregate(F.transform("functions", lambda f: f[c]), F.lit(0), lambda a, b: a + b)
    n = F.size("functions")
    rows = analyzed.withColumns({"total_complexity": total("complexity"), "cognitive_complexity": total("cognitive"), "function_count": n, "class_count": F.size("classes")})
    rows = rows.withColumn("average_complexity", F.when(n == 0, 0.0).otherwise(F.col("total_complexity") / n))
    mi = F.when(F.col("error").isNotNull(), 0.0).otherwise(M.maintainability(F.col("total_complexity"), F.col("lines_of_code"), F.col("comment_ratio")))
    rows = rows.withColumn("maintainability_index", mi)
    return rows.withColumn("complexity_grade", M.grade_of_maintainability(F.col("maintainability_index"))).select(*key, "language", "error", "total_complexity", "average_complexity", "cognitive_complexity", "maintainability_index", "complexity_grade", "function_count", "class_count", "lines_of_code", "comment_ratio", "functions")


@dataclass(frozen=True)
class Advice:
    """One rule: a SQL condition on a summary row and the SQL of its message. ``per`` makes it a rule on functions: it holds where some meet
    the condition (on ``f``), and ``{n}`` in the message is their number."""

    when: str
    message: str
    per: bool = False
    language: str | None = None

    def text(self) -> Column:
        found = f"filter(functions, f -> {self.when})" if self.per else ""
        said = F.expr(self.message.replace("{n}", f"size({found})"))
        test = F.expr(f"size({found}) > 0" if self.per else self.when)
        return F.when(test & (F.col("language") == self.language) if self.language else test, said)


#: Fixed value in the condition.
HIGH_AVERAGE = Advice("average_complexity > 10", "format_string('Functions average %.1f decision paths: split the larger ones', average_complexity)")
#: Fixed values in the conditions: the bounds that make a file or function worth a word. In order of urgency.
ADVICE = [
    HIGH_AVERAGE,
    Advice("maintainability_index < 20", "'Hard to maintain (index under 20): plan a rewrite of the worst parts'"),
    Advice("maintainability_index >= 20 AND maintainability_index < 40", "'Maintainability index under 40: simplify where changes are frequent'"),
    Advice("f.depth > 4", "format_string('%d deeply nested (more than 4 levels): return early or move inner blocks out', {n})", per=True),
    Advice("f.decorator_count > 3", "format_string('%d with more than 3 decorators: merge some of them', {n})", per=True, language="python"),
    Advice("f.type LIKE '%async%' AND f.complexity > 10", "format_string('%d asynchronous and above 10: separate waiting from deciding', {n})", per=True, language="python"),
    Advice("f.exception_handlers_count > 3", "'More than 3 exception handlers in one function: handle related errors together'", per=True, language="python"),
    Advice("f.lambda_count > 2", "'Several lambdas or comprehensions in one function: give them names'", per=True, language="python"),
    Advice("f.is_recursive AND f.complexity > 10", "'Recursion in a function above 10: try a loop or remember results'", per=True, language="python"),
    Advice("f.cognitive > f.complexity * 1.5D AND f.complexity > 5", "format_string('%d harder to read than their branches suggest: flatten them', {n})", per=True, language="python"),
]
#: Functions above the first bound are named first, those above the second only where there are none; three at most.
NAMED, LISTED = (20, 10), 3


def recommendations(rows: DataFrame, advice: list[Advice] = ADVICE) -> DataFrame:
    """Add ``recommendations`` to summary rows: the functions to work on, then what ``advice`` says; a good word where there is neither."""
    top, next_ = (f"filter(functions, f -> f.complexity > {low} {upto})" for low, upto in ((NAMED[0], ""), (NAMED[1], f"AND f.complexity <= {NAMED[0]}")))
    say = lambda found, how: f"transform(slice({found}, 1, {LISTED}), f -> format_string('{how}: %s (%d)', f.name, f.complexity))"
    named = F.expr(f"CASE WHEN size({top}) > 0 THEN {say(top, 'Split now')} ELSE {say(next_, 'Split when next changed')} END")
    said = F.concat(named, F.array_compact(F.array(*(x.text() for x in advice))))
    none = F.array().cast("array<string>")
    fine = F.when(F.col("complexity_grade").isin("A", "B"), F.array(F.lit("Nothing to improve here"))).otherwise(none)
    return rows.withColumn("recommendations", F.when(F.col("error").isNotNull(), none).when(F.size(said) == 0, fine).otherwise(said))


#: Bounds of the bands that a language's metrics are reported in.
THRESHOLDS = {
    "cyclomatic": {"simple": 10, "moderate": 20, "complex": 50},
    "cognitive": {"simple": 15, "moderate": 30, "complex": 60},
    "maintainability": {"excellent": 80, "good": 60, "fair": 40, "poor": 20},
}


def banded(value: Column, metric: str) -> Column:
    """The first band whose bound a value keeps to; beyond them all, ``extreme``."""
    out, up = None, metric == "maintainability"
    for name, bound in THRESHOLDS[metric].items():
        test = value >= bound if up else value <= bound
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("extreme")


#: Values that can't be, by the column or function field that has them, and values to look at: SQL condition, message.
IMPOSSIBLE = [("total_complexity < 0", "total_complexity below 0"), ("cognitive_complexity < 0", "cognitive_complexity below 0"), ("maintainability_index > 100", "maintainability_index above 100"), ("comment_ratio > 1", "comment_ratio above 1")]
IMPOSSIBLE_FUNCTION = [("f.complexity < 1", "complexity below 1"), ("f.cognitive < 0", "cognitive below 0")]
SUSPICIOUS = [("average_complexity > 50", "average_complexity above 50"), ("function_count = 0 AND lines_of_code > 10", "more than 10 lines and no function")]


def _said(rules: list[tuple[str, str]]) -> Column:
    return F.array_compact(F.array(*(F.when(F.expr(test), F.lit(message)) for test, message in rules)))


def validation(rows: DataFrame) -> DataFrame:
    """is_valid, issues (values that can't be) and warnings (values to look at) per file."""
    each = [F.expr(f"transform(filter(functions, f -> {test}), f -> concat(f.name, ': {message}'))") for test, message in IMPOSSIBLE_FUNCTION]
    return rows.withColumns({"issues": F.concat(_said(IMPOSSIBLE), *each), "warnings": _said(SUSPICIOUS)}).withColumn("is_valid", F.size("issues") == 0)


def with_context(rows: DataFrame, is_test: Column, is_library: Column) -> DataFrame:
    """Mark test files, whose thresholds may be wider, and advise on libraries that average more than 5."""
    advice = F.when(is_library & (F.col("average_complexity") > 5), F.array(F.lit("Used by others: keep its functions under 5 on average"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"adjusted_thresholds": is_test, "recommendations": F.concat("recommendations", advice)})


def directory_analysis(summaries: DataFrame) -> DataFrame:
    ok = summaries.filter("error IS NULL")
    return ok.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("total_complexity"), F.lit(0)).alias("total_complexity"), F.avg("maintainability_index").alias("average_maintainability"))


def complex_hits(hits: DataFrame, summaries: DataFrame, key: list[str], threshold: int = 15, nested: int = 10) -> DataFrame:
    """Search hits in files above a total complexity, with their functions above a bound."""
    few = summaries.filter((F.col("total_complexity") > threshold) & F.col("error").isNull())
    big = F.transform(F.filter("functions", lambda f: f["complexity"] > nested), lambda f: F.struct(f["name"], f["complexity"]))
    return hits.join(few.select(*key, "total_complexity", big.alias("complex_functions")), key)


def hierarchy(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of classes with their parent's name (empty at the top) and their name behind it."""
    parent = F.coalesce("parent_class", F.lit(""))
    return rows.withColumns({"parent": parent, "qualified": F.when(parent == "", F.col("name")).otherwise(F.concat_ws(".", parent, "name"))})


def class_methods(class_rows: DataFrame, function_rows: DataFrame, key: list[str]) -> DataFrame:
    """The functions of each class: those inside its lines, and inside no class further in."""
    c = class_rows.select(*key, F.col("name").alias("class_name"), F.col("line_start").alias("from"), F.col("line_end").alias("upto"))
    f = function_rows.select(*key, F.col("name").alias("method"), "complexity", "line_start")
    near = f.join(c, key).filter(F.col("line_start").between(F.col("from"), F.col("upto")))
    return near.groupBy(*key, "method", "line_start", "complexity").agg(F.max_by("class_name", "from").alias("class_name"))


def elements(analyzed: DataFrame, key: list[str]) -> DataFrame:
    """Classes and functions of files as one list: kind, name, lines."""
    made = lambda column, kind: F.transform(column, lambda x: F.struct(kind(x).alias("kind"), x["name"].alias("name"), x["line_start"].alias("line_start"), x["line_end"].alias("line_end")))
    both = F.concat(made("classes", lambda _: F.lit("class")), made("functions", lambda x: x["type"]))
    return analyzed.select(*key, F.explode(both).alias("e")).select(*key, "e.*")


def rounded(columns: list[str]) -> Column:
    """The columns as a struct for people: two places, comment ratios three."""
    places = lambda c: 3 if c == "comment_ratio" else 2
    return F.struct(*(F.round(c, places(c)).alias(c) for c in columns))
