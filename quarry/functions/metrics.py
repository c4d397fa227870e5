"""Complexity metrics as column formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def maintainability(cc: Column, loc: Column, comment_ratio: Column | None = None) -> Column:
    base = 171 - 0.23 * cc - 16.2 * F.log(loc.cast("double"))
    if comment_ratio is not None:
        base = base + F.when(comment_ratio > 0, 50 * F.sin(F.sqrt(2.4 * comment_ratio))).otherwise(0.0)
    return F.when(loc == 0, 100.0).otherwise(F.least(F.greatest(base, F.lit(0.0)), F.lit(100.0)))


def _steps(x: Column, steps: list, rest: str, test) -> Column:
    out = None
    for bound, name in steps:
        out = F.when(test(x, bound), name) if out is None else out.when(test(x, bound), name)
    return out.otherwise(rest)


def grade_of_maintainability(mi: Column) -> Column:
    return _steps(mi, [(80, "A"), (60, "B"), (40, "C"), (20, "D")], "F", lambda a, b: a >= b)


def grade_of_complexity(cc: Column) -> Column:
    return _steps(cc, [(5, "A"), (10, "B"), (20, "C"), (30, "D")], "F", lambda a, b: a <= b)


def rank_of_complexity(cc: Column) -> Column:
    """The six-step scale used for Python."""
    return _steps(cc, [(5, "A"), (10, "B"), (20, "C"), (30, "D"), (40, "E")], "F", lambda a, b: a <= b)


def classification(cc: Column) -> Column:
    return _steps(cc, [(5, "simple"), (10, "moderate"), (20, "complex")], "very-complex", lambda a, b: a <= b)


def documented_band(cc: Column) -> Column:
    return _steps(cc, [(5, "simple"), (10, "moderate"), (20, "complex"), (30, "very complex")], "extremely complex", lambda a, b: a <= b)


def documented_mi_band(mi: Column) -> Column:
    return _steps(mi, [(20, "good"), (10, "moderate")], "poor", lambda a, b: a > b if b == 20 else a >= b)


def halstead_volume(n1: Column, n2: Column, total1: Column, total2: Column) -> Column:
    """Distinct operators and operands, and their totals."""
    words = (n1 + n2).cast("double")
    return F.when(words <= 0, 0.0).otherwise((total1 + total2) * F.log2(words))


def halstead_difficulty(n1: Column, n2: Column, total2: Column) -> Column:
    return F.when(n2 == 0, 0.0).otherwise(n1 / F.lit(2.0) * (total2 / n2))


def cognitive_increment(nesting: Column, flow_break: Column) -> Column:
    return 1 + nesting + F.when(flow_break & (nesting > 0), 1).otherwise(0)


def _count(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


LOGICAL = ["&&", "||", " and ", " or ", " not "]


def logical_operators(text: Column) -> Column:
    total = _count(text, LOGICAL[0])
    for part in LOGICAL[1:]:
        total = total + _count(text, part)
    return total


def risk_score(cyclomatic: Column, cognitive: Column, nesting: Column, loc: Column) -> Column:
    part = lambda x, full: F.least(x / F.lit(float(full)) * 100, F.lit(100.0))
    return 0.35 * part(cyclomatic, 30) + 0.35 * part(cognitive, 25) + 0.20 * part(nesting, 6) + 0.10 * part(loc, 200)


def comment_ratio(text: Column, single: str = "#", start: str = "/*", end: str = "*/") -> Column:
    """Share of comment lines among all lines, by one pass over them. The line that closes a comment counts, and may be the one
    that opened it."""
    lines = F.transform(F.split(text, "\n"), F.trim)
    zero = F.struct(F.lit(0).alias("n"), F.lit(False).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        opens, closes = F.contains(x, F.lit(start)), F.contains(x, F.lit(end))
        comment = acc["open"] | opens | F.startswith(x, F.lit(single))
        now = (opens | acc["open"]) & ~closes
        return F.struct((acc["n"] + comment.cast("int")).alias("n"), now.alias("open"))

    return F.when(text == "", 0.0).otherwise(F.aggregate(lines, zero, step, lambda acc: acc["n"]) / F.size(lines))


def decision_points(conditions: Column, loops: Column, handlers: Column) -> Column:
    return conditions + loops + handlers


def cognitive_estimate(base: Column, depth: Column) -> Column:
    """Where no tree is at hand: two more for each level beyond the first."""
    return base + 2 * F.greatest(depth - 1, F.lit(0))
