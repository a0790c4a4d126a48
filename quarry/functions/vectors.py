"""Vector expressions over arrays; elements are widened to double first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = F.when(norm(a) > 0, norm(a)).otherwise(1.0)
    return F.transform(doubles(a), lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def dcg(labels: Column, k: int) -> Column:
    """Sum of label / log2(rank + 1) over the first k."""
    gains = F.transform(F.slice(labels, 1, k), lambda r, i: F.when(r > 0, r / F.log2(i + F.lit(2.0))).otherwise(0.0))
    return F.aggregate(gains, F.lit(0.0), lambda s, x: s + x)


def ndcg(labels: Column, k: int) -> Column:
    """dcg over that of all labels in falling order; 0 where that is 0."""
    ideal = dcg(F.reverse(F.array_sort(labels)), k)
    return F.round(F.when(ideal > 0, dcg(labels, k) / ideal).otherwise(0.0), 6)


def precision(labels: Column, k: int) -> Column:
    """Share of relevant among the first k that there are; 0 for none."""
    top = F.slice(labels, 1, k)
    return F.round(F.when(F.size(top) > 0, F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.size(top)).otherwise(0.0), 6)


def entropy(values: Column) -> Column:
    """Shannon entropy, in bits, of the values of an array; 0 for none."""
    n = F.size(values)
    share = lambda v: F.size(F.filter(values, lambda x: x == v)) / n
    parts = F.transform(F.array_distinct(values), lambda v: -share(v) * F.log2(share(v)))
    return F.round(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) + 0.0, 6)
