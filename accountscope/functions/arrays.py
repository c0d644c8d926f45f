"""Distribution scores on an ``ARRAY<DOUBLE>`` column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Denominators below this are rounding noise around zero.
ZERO = 1e-12


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)


def entries(p: Column, n: int) -> list[Column]:
    """The ``n`` entries as columns: sums over them stay in generated code, unlike array lambdas."""
    return [p[k] for k in range(n)]


def added(terms: list[Column]) -> Column:
    whole = terms[0]
    for term in terms[1:]:
        whole = whole + term
    return whole


def entropy(p: list[Column]) -> Column:
    """Natural-log entropy of the entries normalised to sum 1; NULL when the sum is zero.

    ``-Σ (x/t)·ln(x/t) = ln t − Σ x·ln x / t``.
    """
    t = added(p)
    # ln of zero is NULL in SQL, and 0·ln 0 counts as 0.
    x_ln_x = added([F.coalesce(x * F.ln(x), F.lit(0.0)) for x in p])
    return F.when(t > 0, F.ln(t) - F.try_divide(x_ln_x, t))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``; NULL when the denominator is zero up to rounding."""
    return F.when(denominator >= ZERO, F.try_divide(numerator, denominator))


def row_mean(p: list[Column]) -> Column:
    return added(p) / F.lit(float(len(p)))


def row_spread(p: list[Column], mean: Column) -> Column:
    """sqrt(Σ (x − mean)²)."""
    return F.sqrt(added([(x - mean) * (x - mean) for x in p]))


def global_score(value: Column, mean: float | None, spread: float | None) -> Column:
    """Distance of ``value`` from its topic mean over the topic's spread."""
    if mean is None or spread is None or spread < ZERO:
        return F.lit(None).cast("double")
    return (value - F.lit(mean)) / F.lit(spread)


def squared_distance(a: Column, b: Column) -> Column:
    diffs = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return total(diffs)


def rounded(value: Column, places: int = 6) -> Column:
    """Round for comparison; adding zero folds ``-0.0`` into ``0.0``."""
    return F.round(value, places) + F.lit(0.0)
