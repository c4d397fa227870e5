"""Vector expressions in double precision, summed in index order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in vector))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0.0 if either norm is 0. Norms may come from stored columns."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (na * nb))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def euclidean_score(a: Column, b: Column) -> Column:
    return 1 / (1 + squared_distance(a, b))


def index_score(cos: Column) -> Column:
    return (1 + cos) / 2


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once; an expression used inside a lambda is computed for every element otherwise."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize(a: Column, zero_to_zeros: bool = True) -> Column:
    """Unit length; a vector of length 0 becomes zeros, or stays as it is."""
    zeros = lambda v: F.transform(v, lambda x: F.lit(0.0) if zero_to_zeros else x.cast("double"))
    return once(a, lambda v: once(norm(v), lambda n: F.when(n < 1e-12, zeros(v)).otherwise(F.transform(v, lambda x: x.cast("double") / n))))


def weighted(a: Column, weights: list[float]) -> Column:
    return F.zip_with(a, literal(weights), lambda x, w: x.cast("double") * w)


def combined(code: Column, doc: Column, share: float = 0.7) -> Column:
    """One unit vector of a weighted code vector followed by a weighted text vector."""
    return normalize(F.concat(F.transform(code, lambda x: x.cast("double") * share), F.transform(doc, lambda x: x.cast("double") * (1 - share))))


def md5_embedding(text: Column, dims: int = 16) -> Column:
    """Deterministic test vector: the bytes of the text's md5 from the last to the first, over 255; further places are 0."""
    h = F.md5(text.cast("binary"))
    byte = lambda i: F.conv(F.substring(h, 31 - 2 * i, F.lit(2)), 16, 10).cast("double") / 255
    head = F.transform(F.sequence(F.lit(0), F.lit(min(dims, 16) - 1)), byte)
    return head if dims <= 16 else F.concat(head, F.array_repeat(F.lit(0.0), dims - 16))


def valid_dims(a: Column, dims: int) -> Column:
    return F.coalesce(F.size(a) == dims, F.lit(False))


def as_floats(a: Column) -> Column:
    return a.cast("array<float>")


def checked(a: Column, dims: int) -> Column:
    """The vector; the query fails on one of another length."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {dims} dimensions, not "), F.size(a).cast("string"))).cast("array<double>")
    return F.when(F.size(a) == dims, a.cast("array<double>")).otherwise(wrong)


def cosine_float(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """Cosine in single precision; 0 where a norm is below eps."""
    one = lambda x: x.cast("float")
    sums = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: one(one(p) * one(q))), F.lit(0.0).cast("float"), lambda s, v: one(s + v))
    norms = one(F.sqrt(sums(a, a))) * one(F.sqrt(sums(b, b)))
    return F.when(norms < eps, F.lit(0.0).cast("float")).otherwise(one(sums(a, b) / norms))
