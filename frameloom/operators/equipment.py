"""Equipment of a session from its headers: mount, registration, scale, and values with their source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spatial

# Telescopes on alt-azimuth mounts, and the words for such a mount, as parts of the card's text.
AZ_TELESCOPES = ["DWARF MINI", "DWARF II", "SEESTAR", "ZWO ASIAIR", "SMARTTELESCOPE"]
AZ_WORDS = ["AZ", "ALTAZ", "ALT-AZ"]


def _any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def mount_type(eq_mode: Column, equat: Column, mount: Column, telescope: Column) -> Column:
    """struct(mount, source): az or eq by mode, then the EQUAT and MOUNT words, then the telescope; eq otherwise.

    source is mode, equat, mount, telescope, default (a telescope that isn't
    known to be alt-azimuth) or unknown (no telescope either).
    """
    e, m, t = (F.upper(F.coalesce(c, F.lit(""))) for c in (equat, mount, telescope))
    az_telescope = _any_of(t, AZ_TELESCOPES) | (t.contains("DWARF") & t.contains("MINI"))
    source = (
        F.when(eq_mode.isin(0, 1), "mode").when(_any_of(e, AZ_WORDS), "equat").when(_any_of(m, AZ_WORDS), "mount").when(az_telescope, "telescope")
        .when(F.trim(t) == "", "unknown").otherwise("default")
    )
    az = F.when(eq_mode == 0, True).when(eq_mode == 1, False).otherwise(source.isin("equat", "mount", "telescope"))
    return F.struct(F.when(az, "az").otherwise("eq").alias("mount"), source.alias("source"))


def eq_flag(eq_mode: Column, exptime: Column) -> Column:
    """struct(eq, source): the header's mode wins, else an exposure up to 60 s tells an alt-azimuth mount, else it is unknown."""
    known = eq_mode.isNotNull()
    return F.struct(
        F.when(known, eq_mode == 1).when(exptime <= 60, False).alias("eq"),
        F.when(known, "header").when(exptime <= 60, "az_fallback").otherwise("unknown").alias("source"),
    )


def preferred_registration(az: Column, exptime: Column) -> Column:
    """Star matching for alt-azimuth mounts and exposures over 120 s, else the transform."""
    return F.when(F.coalesce(az, F.lit(False)) | (exptime > 120), "astroalign").otherwise("fft")


def registration_advice(eq: Column, filter_name: Column) -> Column:
    """struct(advice, max_rotation) by mount (null: unknown) and duo or dual filters."""
    low = F.lower(F.coalesce(filter_name, F.lit("")))
    duo = low.contains("duo") | low.contains("dual")
    az = F.coalesce(~eq, F.lit(False))
    return F.struct(F.when(az | duo, "astroalign").alias("advice"), F.when(az | (eq.isNull() & duo), 30).alias("max_rotation"))


def debayer_factor(method: Column, is_rgb: Column, explicit: Column | None = None, preset: Column | None = None) -> Column:
    """struct(factor, source): explicit, then preset, then 1 for colour input, then by method; 2 for an unknown method."""
    none = F.lit(None).cast("double")
    explicit, preset = (none if c is None else c.cast("double") for c in (explicit, preset))
    data = F.when(is_rgb | method.isin("bilinear", "malvar"), 1.0).when(method == "superpixel", 2.0)
    source = F.when(explicit.isNotNull(), "explicit").when(preset.isNotNull(), "preset").when(data.isNotNull(), "auto_data").otherwise("default")
    return F.struct(F.coalesce(explicit, preset, data, F.lit(2.0)).alias("factor"), source.alias("source"))


def placeholder_null(value: Column) -> Column:
    """A text of a profile; '', unknown (any case) and 0 stand for nothing."""
    t = F.trim(value.cast("string"))
    return F.when(~F.lower(t).isin("", "unknown", "0", "0.0"), t)


def mode_majority(frames: DataFrame, key: str, mode: str = "eq_mode") -> DataFrame:
    """key, eq, az, unknown, majority (1, 0; null on a tie), consistent (not both occur)."""
    n = lambda c: F.count(F.when(c, 1))
    out = frames.groupBy(key).agg(n(F.col(mode) == 1).alias("eq"), n(F.col(mode) == 0).alias("az"), n(F.col(mode).isNull()).alias("unknown"))
    majority = F.when(F.col("eq") > F.col("az"), 1).when(F.col("az") > F.col("eq"), 0)
    return out.withColumns({"majority": majority, "consistent": (F.col("eq") == 0) | (F.col("az") == 0)})


def majority_value(frames: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, value (the most frequent one; a tie goes to the first seen), `different` (values that occur). Nulls don't count.

    Counted per value first, so a hot key reaches no task whole.
    """
    seen = frames.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
    return seen.groupBy(key).agg(F.max_by(value, F.struct("__n", -F.col("__first"))).alias(value), F.count("*").alias("different"))


def first_known(frames: DataFrame, key: str, order: str, columns: dict[str, Column]) -> DataFrame:
    """key and, per name, the value of the first frame by `order` for which the column isn't null."""
    return frames.groupBy(key).agg(*[F.min_by(F.when(c.isNotNull(), c), F.when(c.isNotNull(), F.col(order))).alias(n) for n, c in columns.items()])


def with_source(candidates: dict[str, Column]) -> Column:
    """struct(value, source): the first candidate that isn't null and its name; source `none` without."""
    source = F.coalesce(*[F.when(c.isNotNull(), n) for n, c in candidates.items()], F.lit("none"))
    return F.struct(F.coalesce(*candidates.values()).alias("value"), source.alias("source"))


def detect_profile(items: DataFrame, key: str, telescope: str, profiles: DataFrame, eq_mode: str | None = None) -> DataFrame:
    """key, profile, mount: the profile whose pattern fits the telescope best; the header's mode overrides its mount.

    profiles has name, pattern, ord and mount. Patterns `unknown` and blank ones fit nothing.
    """
    usable = profiles.where(placeholder_null(F.col("pattern")).isNotNull())
    best = spatial.profile_match(items, key, telescope, usable).where("profile <> 'default'")
    mounts = usable.groupBy(F.col("name").alias("profile")).agg(F.min_by("mount", "ord").alias("__m"))
    mode = F.col(eq_mode) if eq_mode else F.lit(None).cast("int")
    own = items.select(key, F.when(mode == 0, "az").when(mode == 1, "eq").alias("__own"))
    return own.join(best.join(mounts, "profile"), key, "left").select(key, "profile", F.when(F.col("profile").isNotNull(), F.coalesce("__own", "__m")).alias("mount"))


def position(frames: DataFrame, key: str, order: list[str]) -> DataFrame:
    """frames with `ordinal`, their place in key from 1: data of a frame, never the way to join it."""
    return frames.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))
