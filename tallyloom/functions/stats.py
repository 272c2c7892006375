"""Column builders for statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b isn't above 0."""
    return F.when(b > 0, F.try_divide(a.cast("double"), b.cast("double"))).otherwise(0.0)


def pct(a: Column, b: Column) -> Column:
    return ratio(a, b) * 100


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the score interval of k out of n; 0 and 0 for n = 0."""
    k, n = k.cast("double"), n.cast("double")
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.greatest(mid - half, F.lit(0.0))).otherwise(0.0), F.when(n > 0, F.least(mid + half, F.lit(1.0))).otherwise(0.0)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def clamp_reason(x: Column, lo: float, hi: float) -> Column:
    return F.when(x < lo, F.lit(f"floor_{lo}")).when(x > hi, F.lit(f"cap_{hi}")).otherwise("p10")


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def kappa(n: Column, agree: Column, expected: Column, on_empty: float | None = 0.0, on_constant: float | None = 1.0) -> Column:
    """From counts: n pairs, how many agree, and the sum over labels of the products of their marginals.

    Without pairs it is on_empty, with one label on both sides throughout on_constant (null, 0, 1 or NaN).
    """
    n, agree, expected = n.cast("double"), agree.cast("double"), expected.cast("double")
    return F.when(n == 0, F.lit(on_empty)).when(expected == n * n, F.lit(on_constant)).otherwise(F.try_divide(n * agree - expected, n * n - expected))


def band(k: Column) -> Column:
    return F.when(k >= 0.8, "almost_perfect").when(k >= 0.6, "substantial").when(k >= 0.4, "moderate").otherwise("low")


def verdict(delta: Column) -> Column:
    return F.when(delta >= -0.02, "good").when(delta >= -0.05, "modest").otherwise("poor")
