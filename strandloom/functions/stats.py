"""Count statistics: normalised counts, zero-truncated Poisson percentiles, k-mer match probabilities."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def with_ncpm(counts: DataFrame, n: str = "n") -> DataFrame:
    """Add counts per million of the total and their log1p. The total is one row, broadcast back."""
    total = counts.agg(F.sum(n).alias("__total"))
    ncpm = F.col(n) * 1e6 / F.col("__total")
    return counts.join(F.broadcast(total)).withColumn("ncpm", ncpm).withColumn("log1p_ncpm", F.log1p(ncpm)).drop("__total")


def upper_gamma_share(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x): a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    log = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * math.exp(log))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return math.exp(log) * h


def ztp_percentile(k: int, rate: float) -> float:
    """100 times P(X <= k | X >= 1) of a Poisson count; 0 for k below 1 or no rate."""
    if k is None or k < 1 or not rate > 0:
        return 0.0
    above = 1 - upper_gamma_share(k + 1, rate)
    return max(0.0, min(100.0, 100 * (1 - above / -math.expm1(-rate))))


def zero_truncated_percentile(k: str, rate: str) -> Column:
    @pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[tuple, float] = {}
        for ks, rates in parts:
            out = []
            for key in zip(ks.tolist(), rates.tolist()):
                if key not in known:
                    known[key] = ztp_percentile(*key)
                out.append(known[key])
            yield pd.Series(out, dtype=float)

    return run(F.col(k), F.col(rate))


def mean_deviation(c: Column) -> tuple[Column, Column]:
    """Mean and sample deviation, 0 for a single value, as aggregates."""
    return F.avg(c), F.coalesce(F.stddev_samp(c), F.lit(0.0))


def kmer_match_probability(n1: int, n2: int, k: int) -> float:
    """Chance that two random sequences share a k-mer."""
    if k <= 0 or k > min(n1, n2):
        return 0.0
    return -math.expm1(-(n1 - k + 1) * (n2 - k + 1) / 4**k)


def least_match_length(n1: int, n2: int, most: float) -> int:
    """Shortest match that random sequences share with a chance below ``most``; -1 for an empty one."""
    if min(n1, n2) <= 0:
        return -1
    return next((k for k in range(1, min(n1, n2) + 1) if kmer_match_probability(n1, n2, k) < most), min(n1, n2))
