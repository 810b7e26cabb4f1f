"""From scanned cards to typed frames: aliases, normalised values, file-name fallback, rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys

# The spellings of each header field, in the order they are tried.
ALIASES = {
    "object_name": ["OBJECT", "OBJNAME", "TARGET"],
    "exptime": ["EXPTIME", "EXPOSURE", "ELAPSED", "ELAPSEDTIME"],
    "gain": ["GAIN", "EGAIN", "CCDGAIN"],
    "cam_offset": ["OFFSET", "BIAS", "CCDOFFSET", "PEDESTAL"],
    "ccd_temp": ["CCD-TEMP", "TEMPERAT", "TEMP", "CCD_TEMP", "SET-TEMP", "CCDTEMP", "DET-TEMP"],
    "filter_name": ["FILTER", "FILTNAM", "FILTER1", "FILTNAM1"],
    "xbinning": ["XBINNING", "BINX", "XBIN"],
    "ybinning": ["YBINNING", "BINY", "YBIN"],
    "date_obs": ["DATE-OBS", "DATE_OBS", "DATEOBS", "OBSDATE"],
    "telescope": ["TELESCOP", "TELESCOPE"],
    "instrument": ["INSTRUME", "CAMERA", "INSTRUMENT"],
    "focal_length": ["FOCALLEN", "FOCALLENGTH", "FL"],
    "aperture": ["APERTURE", "APTDIA", "DIAMETER"],
    "pixel_size_x": ["XPIXSZ", "PIXSIZE1", "PIXSIZEX"],
    "pixel_size_y": ["YPIXSZ", "PIXSIZE2", "PIXSIZEY"],
    "site_lat": ["SITELAT", "OBSLAT", "LATITUDE"],
    "site_lon": ["SITELONG", "OBSLONG", "LONGITUDE"],
    "site_elev": ["SITEELEV", "OBSELEV", "ELEVATION", "ALTITUDE"],
    "ra": ["RA", "OBJCTRA", "CRVAL1"],
    "dec": ["DEC", "OBJCTDEC", "CRVAL2"],
    "eq_mode": ["EQMODE"],
}
INTS = {"gain", "cam_offset", "xbinning", "ybinning", "eq_mode"}
DOUBLES = {"exptime", "ccd_temp", "focal_length", "aperture", "pixel_size_x", "pixel_size_y", "site_lat", "site_lon", "site_elev"}
CALIBRATION = ("dark", "flat", "bias", "dark_flat")


def typed_frames(scanned: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """path, idx, frame_type and one typed column per field, raw_cards kept.

    The first alias present decides, even if its value can't be used. Calibration
    frames take what their header lacks from the file name, light frames never.
    idx is the order of paths.
    """
    cols = {}
    for name, aliases in ALIASES.items():
        raw = keys.first_present(F.col("raw_cards"), aliases)
        if name in DOUBLES:
            cols[name] = keys.without_unit(raw)
        elif name in INTS:
            n = keys.without_unit(raw)
            cols[name] = F.when(n.isNotNull() & ~F.isnan(n), n).try_cast("int")
        elif name == "date_obs":
            cols[name] = keys.parse_timestamp(F.trim(raw))
        else:
            cols[name] = F.trim(raw)
    typed = scanned.where("raw_cards is not null").withColumns(cols)
    typed = typed.withColumn("frame_type", keys.frame_type(F.col("name"), F.col("object_name")))
    meta = F.when(F.col("frame_type").isin(*CALIBRATION), keys.file_metadata(F.col("name"), patterns))
    filled = typed.withColumn("__m", meta).withColumns(
        {
            "exptime": F.coalesce("exptime", F.col("__m.exptime")),
            "gain": F.coalesce("gain", F.col("__m.gain")),
            "ccd_temp": F.coalesce("ccd_temp", F.col("__m.temp")),
            "xbinning": F.when((F.col("xbinning") == 1) & F.col("__m.binning").isNotNull(), F.col("__m.binning")).otherwise(F.coalesce("xbinning", F.col("__m.binning"))),
        }
    )
    return filled.drop("__m", "data", "content")


def rejects(scanned: DataFrame, typed: DataFrame) -> DataFrame:
    """path, reason of files that can't be used: unreadable, or calibration without exposure or gain."""
    bad = scanned.where("error is not null").select("path", F.col("error").alias("reason"))
    lacking = typed.where(F.col("frame_type").isin(*CALIBRATION) & (F.col("exptime").isNull() | F.col("gain").isNull()))
    return bad.unionByName(lacking.select("path", F.lit("calibration frame without exposure or gain").alias("reason")))


def propagate(target: DataFrame, source: DataFrame, keys_: list[str], cards: str = "raw_cards") -> DataFrame:
    """target with the cards of a one-row source added where they are missing; keys_ limits them."""
    ref = source.select(F.map_filter(cards, lambda k, _: k.isin(keys_)).alias("__ref")).limit(1)
    joined = target.crossJoin(F.broadcast(ref))  # one row
    own = F.coalesce(F.col(cards), F.create_map().cast("map<string,string>"))
    missing = F.map_filter("__ref", lambda k, _: ~F.map_contains_key(own, k))
    return joined.withColumn(cards, F.map_concat(own, missing)).drop("__ref")


def sky_header(width: str, height: str, ra: str, dec: str, scale: str, binning: str = "xbinning") -> dict:
    """Columns of a tangent-plane header: reference pixel in the middle, scale in degrees, binning undone."""
    deg = F.col(scale) / 3600.0
    return {
        "CTYPE1": F.lit("RA---TAN"), "CTYPE2": F.lit("DEC--TAN"), "CRPIX1": (F.col(width) + 1) / 2, "CRPIX2": (F.col(height) + 1) / 2, "CRVAL1": F.col(ra), "CRVAL2": F.col(dec),
        "CDELT1": -deg, "CDELT2": deg, "EQUINOX": F.lit(2000.0), "XBINNING": F.lit(1), "SCALE_BINNED_BY": F.col(binning),
    }


def intended_captures(lines: DataFrame, line: str = "value") -> DataFrame:
    """Distinct (exptime, gain, filter) named in a text list, as in `60s, gain 40, Duo-Band` or `60s40`."""
    t = F.col(line)
    exp, gain = F.regexp_extract(t, r"(\d+(?:\.\d+)?)\s*s", 1), F.regexp_extract(t, r"(?i)(?:gain\s*[:=]?\s*|\d\s*s)(\d+)", 1)
    name = F.nullif(F.regexp_extract(t, r"(?i)(duo-?band|astro|luminance|vis|red|green|blue)", 1), F.lit(""))
    got = lines.select(exp.try_cast("double").alias("exptime"), gain.try_cast("int").alias("gain"), keys.filter_class(name).alias("filter"))
    return got.where("exptime is not null and gain is not null").distinct()
