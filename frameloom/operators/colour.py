"""Colour calibration against a star catalogue, with ordered sources and a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import groups, spatial


def pixel_scale(pixel_um: Column, binning: Column, focal_mm: Column) -> Column:
    """Arc seconds a pixel; 0 where an input is missing or not positive."""
    ok = (pixel_um > 0) & (binning > 0) & (focal_mm > 0)
    return F.coalesce(F.when(ok, 206.265 * pixel_um * binning / F.when(ok, focal_mm)), F.lit(0.0))


def pixel_to_sky(x: Column, y: Column, width: Column, height: Column, ra0: Column, dec0: Column, scale: Column) -> list[Column]:
    """Small-angle right ascension and declination (degrees) of a pixel; y runs downwards."""
    dx, dy = (x - (width - 1) / 2) * scale / 3600.0, ((height - 1) / 2 - y) * scale / 3600.0
    ra = ra0 + dx / F.greatest(F.cos(F.radians(dec0)), F.lit(1e-6))
    return [ra - 360.0 * F.floor(ra / 360.0), dec0 + dy]


def flux_of_magnitude(mag: Column) -> Column:
    return F.pow(F.lit(10.0), -mag / 2.5)


def channel_factors(stars: DataFrame, catalog: DataFrame, group: str, radius_deg: float, min_stars: int = 5, lo: float = 0.5, hi: float = 2.0) -> DataFrame:
    """group, matched, r_factor, b_factor, status: factors that bring star colours to the catalogue's.

    stars has group, star, ra, dec, r, g, b (fluxes); catalog entry, ra, dec,
    mag_r, mag_g, mag_b. Each star takes its nearest entry; ratios relative to
    green are trimmed to their 5th to 95th percentile before the median. Status:
    ok, few_stars (no factors), or rejected where a factor is outside [lo, hi].
    """
    near = spatial.nearest_on_sky(stars, catalog, "star", "entry", radius_deg)
    m = near.join(stars.select(group, "star", "r", "g", "b"), "star").join(catalog.select("entry", "mag_r", "mag_g", "mag_b"), "entry")
    good = m.where((F.col("r") > 0) & (F.col("g") > 0) & (F.col("b") > 0) & F.col("mag_r").isNotNull() & F.col("mag_g").isNotNull() & F.col("mag_b").isNotNull())
    want = {c: flux_of_magnitude(F.col(f"mag_{c}")) / flux_of_magnitude(F.col("mag_g")) for c in "rb"}
    q = good.select(group, *[(want[c] / (F.col(c) / F.col("g"))).alias(f"q_{c}") for c in "rb"])
    w = Window.partitionBy(group)
    t = q.select("*", *[F.percentile(f"q_{c}", p).over(w).alias(f"{n}_{c}") for c in "rb" for n, p in (("lo", 0.05), ("hi", 0.95))])
    f = t.groupBy(group).agg(F.count("*").alias("matched"), *[F.coalesce(F.median(F.when(F.col(f"q_{c}").between(F.col(f"lo_{c}"), F.col(f"hi_{c}")), F.col(f"q_{c}"))), F.median(f"q_{c}")).alias(f"{c}_factor") for c in "rb"])
    enough = F.col("matched") >= min_stars
    status = F.when(~enough, "few_stars").when(groups.plausible(F.col("r_factor"), F.col("b_factor"), lo=lo, hi=hi), "ok").otherwise("rejected")
    return f.select(group, "matched", *[F.when(enough, F.col(f"{c}_factor")).alias(f"{c}_factor") for c in "rb"], status.alias("status"))


def gray_world(pixels: DataFrame, group: str, channel: str = "c", value: str = "value", quantile: float = 0.99) -> DataFrame:
    """group, channel, factor: brings the channels' 99th percentiles of positive pixels to their mean."""
    q = pixels.groupBy(group, channel).agg(F.percentile(F.when(F.col(value) > 0, F.col(value)), quantile).alias("__p"))
    return q.select(group, channel, (F.avg("__p").over(Window.partitionBy(group)) / F.col("__p")).alias("factor"))


def header_scale(frames: DataFrame, keep: list[str], width: int) -> DataFrame:
    """keep, scale, cdelt1, unbinned, crpix1 of frames with xpixsz (of binned pixels), xbinning and focallen."""
    ok = (F.col("xpixsz") > 0) & ~F.isnan("xpixsz")
    size, focal = F.when(ok, F.col("xpixsz")), F.when(~F.isnan("focallen"), F.col("focallen"))
    scale = pixel_scale(size, F.lit(1), focal)
    return frames.select(*keep, scale.alias("scale"), (-scale / 3600 + 0.0).alias("cdelt1"), (size / F.col("xbinning")).alias("unbinned"), F.lit((width + 1) / 2).alias("crpix1"))


def first_success(attempts: list[tuple[str, DataFrame]], group: str, every: DataFrame, fallback: str = "gray_world") -> DataFrame:
    """Per group the first source whose factors are ok; a rejection ends the chain, else the fallback.

    every has one row per group. Columns: group, source, r_factor, b_factor, status.
    """
    out = None
    for i, (name, df) in enumerate(attempts):
        part = df.select(group, F.struct(F.lit(i).alias("i"), F.lit(name).alias("source"), "r_factor", "b_factor", "status").alias("a")).where("a.status in ('ok', 'rejected')")
        out = part if out is None else out.unionByName(part)
    best = out.groupBy(group).agg(F.min_by("a", "a.i").alias("a"))
    ok = F.col("a.status") == "ok"
    return every.select(group).distinct().join(best, group, "left").select(
        group,
        F.when(ok, F.col("a.source")).otherwise(fallback).alias("source"),
        F.when(ok, F.col("a.r_factor")).alias("r_factor"),
        F.when(ok, F.col("a.b_factor")).alias("b_factor"),
        F.coalesce("a.status", F.lit("no_match")).alias("status"),
    )
