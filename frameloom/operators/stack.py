"""Stacking along the frame axis, calibration masters and the merge of group results.

Images are in pixel form: one row per frame, channel and position. A group of
pixels (group, c, y, x) has one value per frame, so that the partitions of a
stack grow with the picture and not with the number of groups. Iterative
aggregates collect the values of one pixel, at most one per frame of the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import robust

METHODS = ("average", "median", "winsorized", "sigma_clip", "weighted", "weighted_literal")


def to_pixels(tensors: DataFrame, keep: list[str], data: str = "data", width: str | int = "w", channels: str | int = 1) -> DataFrame:
    """Pixel form of row-major tensors: keep, y, x, c, value (double)."""
    w = F.col(width) if isinstance(width, str) else F.lit(width)
    c = F.col(channels) if isinstance(channels, str) else F.lit(channels)
    px = tensors.select(*keep, w.alias("__w"), c.alias("__c"), F.posexplode(data).alias("__i", "__v"))
    cell = F.floor(F.col("__i") / F.col("__c"))
    return px.select(
        *keep,
        F.floor(cell / F.col("__w")).cast("int").alias("y"),
        (cell % F.col("__w")).cast("int").alias("x"),
        (F.col("__i") % F.col("__c")).cast("int").alias("c"),
        F.col("__v").cast("double").alias("value"),
    )


def to_tensors(pixels: DataFrame, keep: list[str]) -> DataFrame:
    """Tensor form of pixels: keep, h, w, ch, data (row-major, channels last)."""
    cell = F.struct("y", "x", "c", "value")
    return pixels.groupBy(*keep).agg(
        (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), (F.max("c") + 1).alias("ch"),
        F.transform(F.array_sort(F.collect_list(cell)), lambda p: p["value"].cast("float")).alias("data"),
    )


def usable_frames(pixels: DataFrame, frame: str, value: str = "value", drop_zero_median: bool = True) -> DataFrame:
    """Pixels of the frames without a null, NaN or infinite pixel and with a median other than 0."""
    v = robust.finite(F.col(value))
    ok = pixels.groupBy(frame).agg((F.count(v) == F.count("*")).alias("whole"), F.median(v).alias("m"))
    ok = ok.where(F.col("whole") & ((F.col("m") != 0) | F.lit(not drop_zero_median)))
    return pixels.join(ok.select(frame), frame, "left_semi")


def normalise(pixels: DataFrame, frame: list[str], method: str = "mul", value: str = "value") -> DataFrame:
    """mul: divide by the frame's median; add: subtract it; anything else: as it is."""
    if method not in ("mul", "add"):
        return pixels
    m = F.median(value).over(Window.partitionBy(*frame))
    # A median of 0 can't be divided by; such pixels become null.
    v = F.try_divide(F.col(value), m) if method == "mul" else F.col(value) - m
    return pixels.withColumn(value, v)


def stack(pixels: DataFrame, by: list[str], method: str = "average", value: str = "value", column: list[str] | None = None) -> DataFrame:
    """One value per `by` (group and position): by, n, `stacked`.

    average, median; winsorized (clamped to median ± 2 sigma, 5 rounds),
    sigma_clip (rejected outside median ± 3 sigma, 5 rounds), weighted (each
    pixel's mean; its weight 1 / variance stands in `weight`), weighted_literal
    (the product of sum and weight over the weights of `column`, kept because
    results made with it exist). An unknown method is the average.
    """
    v = F.col(value)
    if method == "median":
        return pixels.groupBy(*by).agg(F.count(v).alias("n"), F.median(v).alias("stacked"))
    if method in ("winsorized", "sigma_clip"):
        got = pixels.groupBy(*by).agg(F.count(v).alias("n"), F.array_sort(F.collect_list(v.cast("double"))).alias("__a"))
        f = robust.winsorized_mean if method == "winsorized" else robust.sigma_clipped_mean
        return got.select(*by, "n", f(F.col("__a")).alias("stacked"))
    if method in ("weighted", "weighted_literal"):
        one = pixels.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("__s"), F.avg(v).alias("__m"), F.var_pop(v).alias("__var"))
        one = one.withColumn("weight", 1.0 / (F.col("__var") + 1e-10))
        if method == "weighted":
            return one.select(*by, "n", F.col("__m").alias("stacked"), "weight")
        total = F.sum("weight").over(Window.partitionBy(*(column or by)))
        return one.select(*by, "n", (F.col("__s") * F.col("weight") / total).alias("stacked"), "weight")
    return pixels.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("stacked"))


def percentile_clamped_mean(pixels: DataFrame, by: list[str], value: str = "value", lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Mean after clamping to the group's percentiles: by, n, stacked."""
    v = F.col(value).cast("double")
    w = Window.partitionBy(*by)
    p = pixels.select(*by, v.alias("v"), F.percentile(v, lo).over(w).alias("lo"), F.percentile(v, hi).over(w).alias("hi"))
    return p.groupBy(*by).agg(F.count("v").alias("n"), F.avg(F.greatest(F.least("v", "hi"), "lo")).alias("stacked"))


def merge(stacks: DataFrame, at: list[str], value: str, weight: str | None = None, method: str = "weighted_average") -> DataFrame:
    """Merged image of the group stacks: at, groups, merged (never below 0).

    weighted_average falls back to equal weights where they sum to 0 or less.
    """
    v = F.col(value).cast("double")
    if method == "median":
        m = F.median(v)
    elif method == "average" or weight is None:
        m = F.avg(v)
    else:
        w = F.when(v.isNotNull(), F.coalesce(F.col(weight).cast("double"), F.lit(1.0)))
        total = F.sum(w)
        m = F.when(total > 0, F.sum(v * w) / F.when(total > 0, total)).otherwise(F.avg(v))
    return stacks.groupBy(*at).agg(F.count(v).alias("groups"), F.greatest(m, F.lit(0.0)).alias("merged"))
