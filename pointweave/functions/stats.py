"""Estimators as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def beta_posterior(successes: Column, trials: Column, prior: Column, strength: float) -> dict[str, Column]:
    """Mean and sd of a Beta posterior with half a pseudo-count a side; null outside 0 <= successes <= trials."""
    a = successes + prior * strength + 0.5
    b = trials - successes + (1 - prior) * strength + 0.5
    good = (trials >= 0) & successes.between(0, trials) & prior.between(0, 1)
    return {"mean": F.when(good, a / (a + b)), "sd": F.when(good, F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))}


def dirichlet_posterior(counts: list[Column], priors: list[Column], strength: float) -> list[dict[str, Column]]:
    """Mean and sd of each category with half a pseudo-count each."""
    parts = [c + p * strength + 0.5 for c, p in zip(counts, priors, strict=True)]
    total = sum(parts[1:], parts[0])
    return [{"mean": a / total, "sd": F.sqrt(a * (total - a) / (total * total * (total + 1)))} for a in parts]


def stabilised(count: Column, total: Column, categories: int) -> Column:
    return (count + 0.5) / (total + 0.5 * categories)


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))


def cross_entropy(rates: list[Column], predictions: list[Column]) -> Column:
    parts = [r * F.log(clipped(p)) for r, p in zip(rates, predictions, strict=True)]
    return -sum(parts[1:], parts[0])


def brier(rates: list[Column], predictions: list[Column]) -> Column:
    """One class of two, every class of more."""
    pairs = list(zip(rates, predictions, strict=True))[: 1 if len(rates) == 2 else None]
    parts = [(r - p) * (r - p) for r, p in pairs]
    return sum(parts[1:], parts[0])


def mean_absolute(left: list[Column], right: list[Column]) -> Column:
    parts = [F.abs(a - b) for a, b in zip(left, right, strict=True)]
    return sum(parts[1:], parts[0]) / len(parts)


def total_variation(left: list[Column], right: list[Column], sides: int = 2) -> Column:
    """Mean over the sides of half the absolute differences."""
    parts = [F.abs(a - b) for a, b in zip(left, right, strict=True)]
    return sum(parts[1:], parts[0]) / 2 / sides


def wilson(hits: Column, n: Column) -> dict[str, Column]:
    z2 = Z95 * Z95
    p = hits / n
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return {"low": F.when(n > 0, mid - half), "high": F.when(n > 0, mid + half)}


def required_variance(residual: Column, se_past: Column, se_now: Column) -> Column:
    return F.greatest(F.lit(0.0), F.pow(residual / 1.96, 2) - (se_past * se_past + se_now * se_now))


def nearest_rank(values: Column, p: float) -> Column:
    """The value at round-half-even(p * (n - 1)) of a sorted array."""
    if not 0 <= p <= 1:
        raise ValueError(f"a probability lies from 0 to 1: {p}")
    return F.element_at(F.sort_array(values), (F.bround(F.lit(p) * (F.size(values) - 1)) + 1).cast("int"))


def finite_quantile(values: Column, p: float) -> Column:
    """sorted[min(n, ceil(p (n + 1))) - 1]."""
    if not 0 < p < 1:
        raise ValueError(f"a probability lies between 0 and 1: {p}")
    n = F.size(values)
    return F.element_at(F.sort_array(values), F.least(n, F.ceil(F.lit(p) * (n + 1)).cast("int")))


def bucket_of_ten(p: Column) -> Column:
    return F.least(F.floor(p * 10), F.lit(9)).cast("int")


def hash_index(seed: Column, n: Column) -> Column:
    """A row from 1 to n that depends on nothing but ``seed``: bootstrap draws need neither order nor state."""
    return F.pmod(F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("long"), n) + 1
