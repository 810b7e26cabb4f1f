"""Robust statistics as aggregate, window and array expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Makes the median absolute deviation a standard deviation for normal noise.
MAD_SCALE = 1.4826


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; 0 for constant or too few values instead of an error."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n = F.count(a)
    sx, sy, sxx, syy, sxy = F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b), F.sum(a * b)
    cov, vx, vy = n * sxy - sx * sy, n * sxx - sx * sx, n * syy - sy * sy
    ok = (vx > 1e-12) & (vy > 1e-12)
    return F.coalesce(F.when(ok, cov / F.sqrt(F.when(ok, vx * vy))), F.lit(0.0))


def mad_over(value: Column, median: Column, w: WindowSpec) -> Column:
    """Median absolute deviation over a window, from a median column made before."""
    return F.median(F.abs(value - median)).over(w)


def _mid(a: Column) -> Column:
    """Median of a sorted array of doubles."""
    n = F.size(a)
    lo, hi = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return (F.get(a, lo) + F.get(a, hi)) / 2.0


def _mean(a: Column) -> Column:
    """Mean of an array of doubles, null if it is empty."""
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def sigma_clipped_mean(sorted_values: Column, k: float = 3.0, rounds: int = 5) -> Column:
    """Mean of an array after repeated rejection outside median ± k·sigma.

    sigma is the root mean square about the median of the survivors. Survivors of
    a sorted array stay sorted, so that its median is a lookup. If nothing is left
    the median of all values is returned; null for an empty array.
    """
    cur = _rounds(sorted_values, k, False, rounds)
    mean = F.get(F.transform(F.array(cur), _mean), F.lit(0))
    return F.when(F.size(sorted_values) > 0, F.coalesce(mean, _mid(sorted_values)))


def winsorized_mean(sorted_values: Column, k: float = 2.0, rounds: int = 5) -> Column:
    """Mean of an array after clamping to median ± k·sigma, `rounds` times."""
    cur = _rounds(sorted_values, k, True, rounds)
    return F.get(F.transform(F.array(cur), _mean), F.lit(0))


def _rounds(a: Column, k: float, clamp: bool, rounds: int) -> Column:
    # A fold over the rounds: the expression is written once, however many there are.
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), a, lambda acc, _: _clip_once(acc, k, clamp))


def _clip_once(a: Column, k: float, clamp: bool) -> Column:
    # The statistics go through one-element arrays, so that they are evaluated once
    # per array and not once per element.
    def with_median(m: Column) -> Column:
        var = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a)
        return F.struct((m - k * F.sqrt(var)).alias("lo"), (m + k * F.sqrt(var)).alias("hi"))

    bounds = F.transform(F.array(_mid(a)), with_median)

    def cut(b: Column) -> Column:
        if clamp:
            return F.transform(a, lambda x: F.greatest(F.least(x, b["hi"]), b["lo"]))
        return F.filter(a, lambda x: (x >= b["lo"]) & (x <= b["hi"]))

    return F.when(F.size(a) > 0, F.get(F.transform(bounds, cut), F.lit(0))).otherwise(a)


def trimmed_median(value: Column, lo: Column, hi: Column) -> Column:
    """Median of the values within [lo, hi] (aggregate)."""
    return F.median(F.when(value.between(lo, hi), value))


def group_window(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)
