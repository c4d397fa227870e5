"""Column expressions for matches in whole texts with their positions, in code points. All work is near linear in the matches of a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint>>"
#: Elements of a block, and block sizes of blocks, in sums over arrays.
BLOCK, LEVELS = 64, 3


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(xs: Column, size: int = BLOCK) -> Column:
    """The array cut into arrays of ``size`` elements; one empty block of an empty array.

    A slice reads the whole of its array, so small blocks are cut from larger ones.
    """

    def cut(part: Column, n: int) -> Column:
        last = F.greatest(F.ceil(F.size(part) / n) - 1, F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(part, b * n + 1, F.lit(n)))

    return F.flatten(F.transform(cut(xs, size * BLOCK), lambda part: cut(part, size)))


def before_each(xs: Column, join: Callable[[Column, Column], Column], zero: Column, levels: int = LEVELS) -> Column:
    """Of each element, the elements before it joined by an associative operation.

    Growing an array copies it, so a single fold is quadratic. Blocks are folded apart, each from what the blocks before it come to, which
    is found in the same way.
    """

    def fold(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(part, first, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])

    if levels == 0:
        return fold(xs, zero)

    def dealt(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, zero, join))
        return F.flatten(F.zip_with(parts, before_each(totals, join, zero, levels - 1), fold))

    return let(blocks(xs), dealt)


def spans(text: Column, pattern: Column | str) -> Column:
    """Start and end of each leftmost non-overlapping match, none of which may be empty.

    What lies between matches comes from a split at the pattern; lengths of it and of the matches add up to positions.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    size = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda x: F.length(x).cast("long"))
    gap = F.transform(F.split(text, p, -1), lambda x: F.length(x).cast("long"))

    def placed(both: Column) -> Column:
        sizes, gaps = both["size"], F.slice(both["gap"], 1, F.size(both["size"]))
        zero = F.lit(0).cast("long")
        ends = lambda steps: F.zip_with(before_each(steps, lambda a, b: a + b, zero), steps, lambda at, step: at + step)
        made = F.zip_with(ends(F.zip_with(gaps, sizes, lambda g, s: g + s)), sizes, lambda end, s: F.struct((end - s).alias("start"), end.alias("end")))
        return F.when(F.size(sizes) == 0, no_spans()).otherwise(made)

    return let(F.struct(size.alias("size"), gap.alias("gap")), placed)


def replaced(text: Column, found: Column, mark: str) -> Column:
    """The text with each span of ``found`` (an array of struct(start, end)) replaced by ``mark``; overlapping spans become one mark.

    Cutting a piece out of a text reads the text up to it, so pieces are cut from parts of parts of the text.
    """
    zero = F.lit(0).cast("long")

    def cut(part: Column, base: Column, a: Column, b: Column) -> Column:
        return F.substring(part, (a - base + 1).cast("int"), F.greatest(b - a, zero).cast("int"))

    def glued(part: Column, base: Column, pieces: Column, sizes: tuple[int, ...]) -> Column:
        if not sizes:
            return F.array_join(F.transform(pieces, lambda p: F.concat(cut(part, base, p["from"], p["upto"]), F.lit(mark))), "")
        inner = lambda few: let(cut(part, base, few[0]["from"], F.element_at(few, -1)["upto"]), lambda x: glued(x, few[0]["from"], few, sizes[1:]))
        return F.array_join(F.transform(blocks(pieces, sizes[0]), inner), "")

    def built(ordered: Column) -> Column:
        ends = F.transform(ordered, lambda s: s["end"])
        pieces = F.zip_with(ordered, before_each(ends, lambda a, b: F.greatest(a, b), zero), lambda s, done: F.struct(done.alias("from"), s["start"].alias("upto")))
        tail = F.array_max(ends)
        return F.concat(let(F.filter(pieces, lambda p: p["upto"] >= p["from"]), lambda fresh: glued(text, zero, fresh, (BLOCK * BLOCK, BLOCK))), F.substring(text, (tail + 1).cast("int"), F.length(text)))

    return F.when(F.size(found) == 0, text).otherwise(let(F.array_sort(F.transform(found, lambda s: F.struct(s["start"], s["end"]))), built))


def no_spans() -> Column:
    return F.array().cast(SPAN)


def joined(found: Column, order: list[str]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined. found: array of struct(kind, start, end)."""
    rank = F.array(*(F.lit(k) for k in order))
    keyed = F.transform(found, lambda x: F.struct(x["start"], F.array_position(rank, x["kind"]).alias("rank"), x["end"], x["kind"]))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def of_kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
