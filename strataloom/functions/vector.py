"""Vector and weight functions on arrays of floats; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(doubles(a), 1, n), F.slice(doubles(b), 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def _each(v: Column, other: Column, op) -> Column:
    """op(element, other) with ``other`` computed once: inside a lambda it would be computed for every element."""
    return F.zip_with(doubles(v), F.array_repeat(other, F.size(v)), op)


def unit(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, _each(v, n, lambda x, y: x / y)).otherwise(doubles(v))


def once(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def softmax(v: Column) -> Column:
    powers = once(doubles(v), lambda x: _each(x, F.array_max(x), lambda a, y: F.exp(a - y)))
    return once(powers, lambda p: _each(p, F.aggregate(p, F.lit(0.0), lambda s, y: s + y), lambda x, y: x / y))


def idf(documents: Column, frequency: Column) -> Column:
    return F.least(F.lit(5.0), F.greatest(F.lit(0.1), F.ln((documents + 1) / (frequency + 1))))


def npmi(p_ab: Column, p_a: Column, p_b: Column) -> Column:
    return F.ln(p_ab / (p_a * p_b)) / -F.ln(p_ab)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def jaccard_distance(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) > 0, 1 - jaccard(a, b)).otherwise(F.lit(0.0))


def cache_key(v: Column) -> Column:
    head = F.transform(F.slice(doubles(v), 1, 32), lambda x: F.format_string("%.4f", x))
    return F.substring(F.sha2(F.array_join(head, ","), 256), 1, 16)


def point_id(chunk_id: Column) -> Column:
    return F.conv(F.substring(F.sha2(chunk_id.cast("string"), 256), 1, 15), 16, 10).cast("long")
