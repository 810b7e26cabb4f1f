"""Frame quality: outlier flags, thresholds, scores and the selection of frames per group.

All statistics are windows or aggregates over the group key, so that consecutive
steps share one exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.robust import MAD_SCALE, finite

#: Metrics of the score and their direction: 1 more is better, -1 less is better.
DIRECTIONS = {"snr": 1, "star_count": 1, "fwhm_median": -1, "elongation_ratio": 1, "noise_sigma": -1}
DEFAULT_METRICS = ("snr", "star_count", "fwhm_median", "elongation_ratio")
#: Order of the reasons of a threshold rejection: reason -> column.
THRESHOLD_ORDER = {"star_count": "star_count", "fwhm": "fwhm_median", "snr": "snr", "correlation": "correlation", "double_rate": "double_rate"}


def mad_outliers(df: DataFrame, group: str, metrics: list[str], k: float = 3.0) -> DataFrame:
    """df with `outlier` and `outlier_reason`: |v - median| > k sigma within the group.

    A metric with fewer than two values, or constant, flags nothing.
    """
    w = Window.partitionBy(group)
    out = df.select("*", *[finite(F.col(m)).alias(f"__v_{m}") for m in metrics])
    out = out.select("*", *[F.median(f"__v_{m}").over(w).alias(f"__m_{m}") for m in metrics])
    out = out.select(
        "*",
        *[(F.median(F.abs(F.col(f"__v_{m}") - F.col(f"__m_{m}"))).over(w) * MAD_SCALE).alias(f"__s_{m}") for m in metrics],
        *[F.count(f"__v_{m}").over(w).alias(f"__n_{m}") for m in metrics],
    )
    hits = [
        F.when(
            (F.col(f"__n_{m}") >= 2) & (F.col(f"__s_{m}") > 1e-12) & (F.abs(F.col(f"__v_{m}") - F.col(f"__m_{m}")) > k * F.col(f"__s_{m}")), F.lit(m)
        )
        for m in metrics
    ]
    reason = F.nullif(F.concat_ws(",", *hits), F.lit(""))
    return out.select(*[F.col(c) for c in df.columns], reason.isNotNull().alias("outlier"), reason.alias("outlier_reason"))


def threshold_reasons(bounds: dict[str, tuple[float | None, float | None]], elongation: bool = True) -> Column:
    """Comma-joined reasons for which a row is rejected, null if none. Null and NaN metrics pass."""
    parts = [F.when(F.coalesce(F.col("elongation_unusable"), F.lit(False)), "elongation")] if elongation else []
    for reason, column in THRESHOLD_ORDER.items():
        if reason in bounds:
            lo, hi = bounds[reason]
            v = finite(F.col(column))
            bad = (F.lit(False) if lo is None else v < lo) | (F.lit(False) if hi is None else v > hi)
            parts.append(F.when(bad, reason))
    return F.nullif(F.concat_ws(",", *parts), F.lit(""))


def composite_score(df: DataFrame, group: str, weights: dict[str, float] | None = None) -> DataFrame:
    """df with `score` in [0, 1]: weighted mean of clip(0.5 ± z/6, 0, 1) over the active metrics.

    A metric is active with weight over 0 and one valid value in the group; a row
    that lacks an active metric scores 0. Unknown metrics are ignored, negative
    weights count as 0.
    """
    given = {m: 1.0 for m in DEFAULT_METRICS} if weights is None else weights
    use = {m: float(w) for m, w in given.items() if m in DIRECTIONS and w > 0}
    w = Window.partitionBy(group)
    out = df.select("*", *[finite(F.col(m)).alias(f"__v_{m}") for m in use])
    out = out.select("*", *[F.median(f"__v_{m}").over(w).alias(f"__m_{m}") for m in use], *[F.count(f"__v_{m}").over(w).alias(f"__n_{m}") for m in use])
    out = out.select("*", *[(F.median(F.abs(F.col(f"__v_{m}") - F.col(f"__m_{m}"))).over(w) * MAD_SCALE).alias(f"__s_{m}") for m in use])
    terms, total, missing = [], [], []
    for m, weight in use.items():
        active = F.col(f"__n_{m}") > 0
        sigma = F.when((F.col(f"__n_{m}") < 2) | (F.col(f"__s_{m}") <= 1e-12), 1.0).otherwise(F.col(f"__s_{m}"))
        z = (F.col(f"__v_{m}") - F.col(f"__m_{m}")) / sigma * DIRECTIONS[m]
        clipped = F.greatest(F.least(0.5 + z / 6.0, F.lit(1.0)), F.lit(0.0))
        terms.append(F.when(active, F.coalesce(clipped, F.lit(0.0)) * weight).otherwise(0.0))
        total.append(F.when(active, F.lit(weight)).otherwise(0.0))
        missing.append(active & F.col(f"__v_{m}").isNull())
    if not use:
        return df.withColumn("score", F.lit(0.0))
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    any_missing = reduce(lambda a, b: a | b, missing)
    score = F.when(any_missing | (add(total) <= 0), 0.0).otherwise(add(terms) / F.when(add(total) > 0, add(total)))
    return out.select(*[F.col(c) for c in df.columns], score.alias("score"))


def percentile_keep(df: DataFrame, group: str, score: str, order: str, percent: float = 92.0, min_frames: int = 3) -> DataFrame:
    """df with `rank`, `keep` and `cutoff`: the best n - floor(n (100 - percent) / 100) rows of a group.

    Ties keep the input order; a null score counts as 0. Nothing is discarded
    where fewer than min_frames rows would stay. cutoff is the lowest score kept.
    """
    w = Window.partitionBy(group)
    s = F.coalesce(finite(F.col(score)), F.lit(0.0))
    n = F.count("*").over(w)
    keep = n - F.floor(n * (100.0 - percent) / 100.0)
    keep = F.when(keep < min_frames, n).otherwise(keep)
    ranked = df.select("*", F.row_number().over(w.orderBy(s.desc(), order)).cast("long").alias("rank"), keep.alias("__k"))
    ranked = ranked.withColumn("keep", F.col("rank") <= F.col("__k"))
    return ranked.withColumn("cutoff", F.min(F.when(F.col("keep"), s)).over(w)).drop("__k")


def correlation_gate(df: DataFrame, group: str, minimum: float = 0.05, column: str = "correlation", undo_if_empty: bool = True) -> DataFrame:
    """df with `gate`: correlation is null or at least the minimum.

    The gate of a group that it would empty is undone.
    """
    ok = F.col(column).isNull() | (F.col(column) >= minimum)
    if not undo_if_empty:
        return df.withColumn("gate", ok)
    left = F.sum(F.when(ok, 1).otherwise(0)).over(Window.partitionBy(group))
    return df.withColumn("gate", ok | (left == 0))


def funnel(
    df: DataFrame,
    group: str,
    order: str,
    bounds: dict[str, tuple[float | None, float | None]],
    percent: float = 92.0,
    min_frames: int = 3,
    min_correlation: float = 0.05,
) -> DataFrame:
    """df with `decision` (kept, discarded) and `reason`: percentile, then thresholds, then the gate.

    The gate is undone for a group of which it would leave nothing.
    """
    scored = percentile_keep(composite_score(df, group), group, "score", order, percent, min_frames)
    left = scored.withColumn("__why", threshold_reasons(bounds)).withColumn("__in", F.col("keep") & F.col("__why").isNull())
    ok = F.col("correlation").isNull() | (F.col("correlation") >= min_correlation)
    stay = F.sum(F.when(F.col("__in") & ok, 1).otherwise(0)).over(Window.partitionBy(group))
    gated = left.withColumn("__gate", ok | (stay == 0))
    reason = F.when(~F.col("keep"), "percentile").when(F.col("__why").isNotNull(), F.concat(F.lit("threshold:"), "__why")).when(~F.col("__gate"), "low_correlation")
    return gated.select(*[F.col(c) for c in df.columns], "score", "rank", "cutoff", F.when(reason.isNull(), "kept").otherwise("discarded").alias("decision"), reason.alias("reason"))


def quality_summary(df: DataFrame, group: str, decimals: int = 4) -> DataFrame:
    """Per group: frames, rounded medians over the valid values, outlier rate."""
    med = lambda c: F.round(F.median(finite(F.col(c))), decimals).alias(f"{c}_median")
    return df.groupBy(group).agg(
        F.count("*").alias("frames"), med("snr"), med("star_count"), med("correlation"), F.sum(F.col("outlier").cast("int")).alias("outliers"),
        F.round(F.avg(F.col("outlier").cast("double")), 6).alias("outlier_rate"),
    )
