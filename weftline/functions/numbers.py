"""Column functions on times, shares and probabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959963984540054


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def overlap_hours(open_a: Column, close_a: Column, open_b: Column, close_b: Column) -> Column:
    return F.greatest(F.lit(0), micros(F.least(close_a, close_b)) - micros(F.greatest(open_a, open_b))) / F.lit(3_600_000_000)


def midpoint(open_a: Column, close_a: Column, open_b: Column, close_b: Column) -> Column:
    """Middle of the overlap, in whole microseconds."""
    lo, hi = micros(F.greatest(open_a, open_b)), micros(F.least(close_a, close_b))
    return F.floor((lo + hi) / 2).cast("long")


def gap_hours(close_a: Column, close_b: Column) -> Column:
    return F.abs(micros(close_a) - micros(close_b)) / F.lit(3_600_000_000)


def binned(x: Column, edges: list[float], labels: list[str], right: bool = False) -> Column:
    """Label of the bin; each takes its left edge, or with `right` its right one; outside: null."""
    out = F.when(F.lit(False), F.lit(""))
    for lo, hi, label in zip(edges[:-1], edges[1:], labels, strict=True):
        out = out.when((x > lo) & (x <= hi) if right else (x >= lo) & (x < hi), label)
    return out


INF = float("inf")
DURATION = ([0, 1, 6, 24, 168, INF], ["<1h", "1-6h", "6-24h", "1-7d", ">7d"])
CONCURRENCY = ([2, 3, 6, 11, 21, 51, INF], ["2", "3-5", "6-10", "11-20", "21-50", ">50"])
STARS = ([-1, 10, 100, 1000, INF], ["0-10", "11-100", "101-1k", ">1k"])


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column, Column]:
    """(share, low, high); nulls if n is not positive."""
    n1 = F.when(n > 0, n.cast("double"))
    p = k / n1
    centre, spread = (p + z * z / (2 * n1)) / (1 + z * z / n1), z * F.sqrt(p * (1 - p) / n1 + z * z / (4 * n1 * n1)) / (1 + z * z / n1)
    return p, F.greatest(F.lit(0.0), centre - spread), F.least(F.lit(1.0), centre + spread)


def sigmoid(x: Column, clip: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(clip)), F.lit(-clip))))


def linear(terms: dict[str, float], bias: float) -> Column:
    return reduce(lambda a, t: a + F.col(t[0]) * F.lit(t[1]), sorted(terms.items()), F.lit(bias))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
