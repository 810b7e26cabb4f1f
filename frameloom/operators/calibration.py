"""Calibration of light frames in tensor form: matching darks, masters, and their application.

Masters are per-pixel aggregates in pixel form (calibration frames only); lights
stay one row a frame, so applying a master shuffles no pixels of lights.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, spatial, stack

#: Seconds of exposure that a dark may be off, and degrees that the library's nearest may be.
EXPOSURE_BAND, NEAR_DEGREES, FAR_DEGREES = 0.5, 3.0, 10.0


def match_darks(groups: DataFrame, darks: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """group_hash, dark_id, tier: the darks of the first tier that has any for a group; `none` without.

    groups has group_hash, exptime, gain and temp (may be null); darks and the
    library have dark_id, exptime, gain, ccd_temp. A dark fits if its exposure is
    at most 0.5 s off and its gain equal; the filter plays no part. Tiers:
    `local` and `library_exact` (at most 3 degrees off, or either unknown),
    `library_nearest` (10 degrees).
    """
    g = groups.select("group_hash", F.col("exptime").alias("__e"), F.col("gain").alias("gain"), F.col("temp").alias("__t"))

    def fits(df: DataFrame, degrees: float) -> DataFrame:
        k = df.select("dark_id", F.col("exptime").alias("__x"), "gain", F.col("ccd_temp").alias("__c"))
        near = F.coalesce(F.abs(F.col("__t") - F.col("__c")) <= degrees, F.lit(True))
        return spatial.band_join(g, k, ["gain"], "__e", "__x", EXPOSURE_BAND, near).select("group_hash", "dark_id")

    tiers = [("local", fits(darks, NEAR_DEGREES))]
    if library is not None:
        tiers += [("library_exact", fits(library, NEAR_DEGREES)), ("library_nearest", fits(library, FAR_DEGREES))]
    return spatial.tiered_match(groups.select("group_hash"), "group_hash", tiers)


def master(tensors: DataFrame, by: list[str], method: str = "median", normalise: str = "none") -> DataFrame:
    """by, h, w, ch, data: one master per `by` and picture size of tensors (frame_id, by, h, w, ch, data).

    mul normalisation leaves frames with a median of 0 out.
    """
    size = ["h", "w", "ch"]
    px = stack.to_pixels(tensors.select("frame_id", *by, *size, "data"), ["frame_id", *by, *size], channels="ch")
    if normalise == "mul":
        px = stack.normalise(px, ["frame_id"], "mul")
    one = stack.stack(px, [*by, *size, "y", "x", "c"], method).withColumnRenamed("stacked", "value")
    cell = F.struct("y", "x", "c", "value")
    return one.groupBy(*by, *size).agg(F.transform(F.array_sort(F.collect_list(cell)), lambda p: p["value"]).alias("data"))


def apply(lights: DataFrame, keep: list[str]) -> DataFrame:
    """Calibrated lights: keep, data, `dark_mode`, `dark_low`; one task a batch of frames, no shuffle.

    lights has h, w, ch, data and the masters `dark`, `flat` and `bias` (null, or
    of another size: not applied). The bias goes first. Where the dark's median lies more
    than max(5, 4 % of the light's) above the light's median, only its structure
    is subtracted (`offset_rescue`), else all of it (`full`; `none` without). `dark_low` warns of a
    dark under half of the light's level. The flat is divided by its median.
    Results are never below 0.
    """

    def fitting(x, img: np.ndarray) -> np.ndarray | None:
        return None if x is None or len(x) != img.size else np.asarray(x, dtype=float).reshape(img.shape)

    def one(img, dark, flat, bias):
        dark, flat, bias = (fitting(x, img) for x in (dark, flat, bias))
        out, mode, low = img if bias is None else img - bias, "none", None
        if dark is not None:
            level, dark_level = np.median(out), np.median(dark)
            mode = "offset_rescue" if dark_level - level > max(5.0, 0.04 * abs(level)) else "full"
            low = bool(mode == "full" and dark_level < 0.5 * level)
            out = out - (dark - dark_level) if mode == "offset_rescue" else out - dark
        if flat is not None:
            even = flat / np.median(flat) if np.median(flat) else flat
            out = np.divide(out, even, out=out.copy(), where=even != 0)
        return {"data": kernels.flat(np.maximum(out, 0)), "dark_mode": mode, "dark_low": low}

    return kernels.per_frame(lights, keep, "data array<double>, dark_mode string, dark_low boolean", one, ["dark", "flat", "bias"])
