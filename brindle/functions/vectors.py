"""Vector functions as column expressions over arrays of numbers; all sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a divergence is where the second distribution lacks support.
NO_SUPPORT = 1e20


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    """Infinite when the dimensions differ."""
    d = total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    return F.when(F.size(a) == F.size(b), d).otherwise(F.lit(float("inf")))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def expanded_distance(a: Column, b: Column) -> Column:
    """Squared distance from the norms and the product."""
    return dot(a, a) - F.lit(2.0) * dot(a, b) + dot(b, b)


def l1(v: Column) -> Column:
    return total(F.transform(v, lambda x: F.abs(x.cast("double"))))


def l2(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scaled(v: Column, by: Column) -> Column:
    """v divided by ``by``; unchanged where that is 0."""
    return F.when(by > 0, F.transform(v, lambda x: x.cast("double") / by)).otherwise(F.transform(v, lambda x: x.cast("double")))


def normalise_l2(v: Column) -> Column:
    return scaled(v, l2(v))


def normalise_l1(v: Column) -> Column:
    return scaled(v, l1(v))


def entropy_norm(v: Column) -> Column:
    """Sum of x ln x over the positive entries."""
    return total(F.transform(v, lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)))


def kl(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence in nats."""
    term = lambda x, y: F.when(x > 0, F.when(y > 0, x * F.log(x / y)).otherwise(NO_SUPPORT)).otherwise(0.0)
    return F.least(total(F.zip_with(p, q, term)), F.lit(NO_SUPPORT))


def kl_smoothed(p: Column, q: Column, alpha: float) -> Column:
    """Divergence from q mixed with the uniform distribution: (q + alpha / n) / (1 + alpha)."""
    n = F.size(q)
    return kl(p, F.transform(q, lambda y: (y + F.lit(alpha) / n) / F.lit(1 + alpha)))


def js(p: Column, q: Column, wp: Column, wq: Column) -> Column:
    """Jensen-Shannon divergence in nats with priors wp and wq."""
    a, b = wp / (wp + wq), wq / (wp + wq)
    mean = F.zip_with(p, q, lambda x, y: a * x + b * y)
    return a * kl(p, mean) + b * kl(q, mean)


def exponential_kernel(a: Column, b: Column, sigma: float) -> Column:
    """exp(d^2 / (2 sigma^2)); the exponent is positive."""
    return F.exp(F.lit(0.5) * squared_distance(a, b) / F.lit(sigma * sigma))


def polynomial_kernel(a: Column, b: Column, offset: float, squarings: int) -> Column:
    """(a.b + offset), squared ``squarings`` times."""
    k = dot(a, b) + F.lit(offset)
    for _ in range(squarings):
        k = k * k
    return k


def packed_rgb(r: Column, g: Column, b: Column) -> Column:
    return r * 65_536 + g * 256 + b


def truncated(v: Column) -> Column:
    """Entries as integers, cut toward zero."""
    return F.transform(v, lambda x: x.cast("int"))


def rounded(x: Column, digits: int = 6) -> Column:
    """``x`` as SQL engines on binary doubles round it: the nearest whole number of x * 10^digits, halves away from 0, and -0.0 for small negative numbers."""
    scaled = F.abs(x) * F.lit(10.0**digits)
    return F.when(scaled < 9e18, F.signum(x) * F.floor(scaled + 0.5).cast("double") / F.lit(10.0**digits)).otherwise(x)
