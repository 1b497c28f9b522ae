"""Statistics of evaluations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """``struct(low, high)``: the Wilson interval of k successes in n trials, within 0 and 1; zeros where n is 0."""
    p = k / n
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    none = n == 0
    return F.struct(
        F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)).alias("low"),
        F.when(none, 0.0).otherwise(F.least(F.lit(1.0), mid + half)).alias("high")
    )


def mcnemar_ln_p(b: Column, c: Column) -> Column:
    """The natural logarithm of the exact two-sided McNemar p-value of b and c discordant pairs.

    The binomial tail is summed in logarithms, so that it doesn't underflow where p itself would. 0 without discordance.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("int")
    ln_half = F.log(F.lit(0.5))
    start = F.named_struct(F.lit("t"), n * ln_half, F.lit("m"), n * ln_half, F.lit("s"), F.lit(1.0))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1) / i)
        m = F.greatest(acc["m"], t)
        return F.named_struct(F.lit("t"), t, F.lit("m"), m, F.lit("s"), acc["s"] * F.exp(acc["m"] - m) + F.exp(t - m))

    steps = F.when(k >= 1, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(steps, start, step, lambda a: F.log(F.lit(2.0)) + a["m"] + F.log(a["s"]))
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(0.0), tail))
