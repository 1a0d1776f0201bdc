"""Vector expressions; all stay inside the JVM and compute in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(c: str | Column) -> Column:
    return col(c).cast("array<double>")


def let(value: Column, f) -> Column:
    """f(value) with value computed once per row; inside a lambda over elements it would be computed for each."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(c: str | Column) -> Column:
    return F.sqrt(F.aggregate(doubles(c), F.lit(0.0), lambda s, x: s + x * x))


def unit(c: str | Column, floor: float = 1e-12) -> Column:
    """Divided by its length, at least floor."""
    return let(F.greatest(norm(c), F.lit(floor)), lambda n: F.transform(doubles(c), lambda x: x / n))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Null where a length is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def parse_vector(c: str | Column) -> Column:
    """'[1,2]' or '(1,2)' to an array; null, '' and 'none' give null."""
    text = F.trim(col(c))
    parts = F.split(F.regexp_replace(text, r"^[\[(]|[\])]$", ""), ",")
    return F.when(text.isNull() | (text == "") | (F.lower(text) == "none"), None).otherwise(F.transform(parts, lambda x: F.trim(x).cast("double")))


def format_vector(c: str | Column, digits: int = 6) -> Column:
    """'[0.100000,...]'; null stays null."""
    return F.when(col(c).isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(doubles(c), lambda x: F.format_string(f"%.{digits}f", x)), ","), F.lit("]")))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def valid(c: str | Column) -> Column:
    """Not null, not empty, every element finite."""
    v = doubles(c)
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, is_finite), F.lit(False))


def rejection(c: str | Column, dim: int, least_norm: float = 1e-8) -> Column:
    """Why a vector is unusable: null, length, not finite, norm; else valid."""
    v = doubles(c)
    return (
        F.when(v.isNull(), "null").when(F.size(v) != dim, "length").when(~F.coalesce(F.forall(v, is_finite), F.lit(False)), "not finite")
        .when(norm(v) < least_norm, "norm").otherwise("valid")
    )


def add(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def ensemble(a: str | Column, b: str | Column) -> Column:
    """Sum of two vectors at unit length; where one is invalid, the other."""
    va, vb = valid(a), valid(b)
    return F.when(va & vb, unit(add(a, b))).when(va, unit(a)).when(vb, unit(b))


def weighted_concat(parts: list[tuple[str | Column, float]]) -> Column:
    """Branches times the root of their renormalised weight, one after the other, at unit length."""
    total = sum(w for _, w in parts)
    scaled = lambda c, by: F.transform(doubles(c), lambda x: x * F.lit(by))
    return unit(F.concat(*[scaled(c, (w / total) ** 0.5) for c, w in parts]))


def fuse(scores: list[tuple[str | Column, float]]) -> Column:
    """Weighted mean of the finite scores, weights renormalised; null without any."""
    ok = [(F.when(is_finite(col(c)), col(c)), w) for c, w in scores]
    num = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in ok), F.lit(0.0))
    den = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in ok), F.lit(0.0))
    return F.when(den > 0, num / den)


def root_sift(c: str | Column) -> Column:
    """L1 at 1, square roots, L2 at 1."""
    v = doubles(c)
    total = F.greatest(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x)), F.lit(1e-12))
    return unit(let(total, lambda n: F.transform(v, lambda x: F.sqrt(F.abs(x) / n))))


def softmax(c: str | Column, temperature: float = 1.0) -> Column:
    v = F.transform(doubles(c), lambda x: x / temperature)
    e = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return let(e, lambda p: let(F.aggregate(p, F.lit(0.0), lambda s, y: s + y), lambda n: F.transform(p, lambda x: x / n)))


def nearest_bucket(c: str | Column, buckets: list[float]) -> Column:
    """The bucket nearest to a value, the first on a tie."""
    value = col(c).cast("double")
    best = F.array_min(F.array(*[F.struct(F.abs(value - b).alias("d"), F.lit(i).alias("i"), F.lit(float(b)).alias("b")) for i, b in enumerate(buckets)]))
    return F.when(value.isNotNull(), best["b"])


def argmax(c: str | Column) -> Column:
    """Index of the largest element, the first on a tie."""
    return F.array_position(col(c), F.array_max(col(c))) - 1
