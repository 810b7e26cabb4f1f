"""Group keys, names and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_label(c: Column) -> Column:
    """Whole numbers without decimals, others as they print (15, 0.5)."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def group_hash(exptime: Column, gain: Column, filter_name: Column) -> Column:
    """Key of an acquisition group, as in 15s60 or 60s40_duo-band.

    Null exposure and gain count as 0; a null or empty filter is left out.
    """
    f = F.lower(F.replace(F.trim(filter_name), F.lit(" "), F.lit("_")))
    e, g = F.coalesce(exptime, F.lit(0.0)), F.coalesce(gain, F.lit(0))
    return F.concat(number_label(e), F.lit("s"), g.cast("string"), F.when((f != "") & (f != "none"), F.concat(F.lit("_"), f)).otherwise(F.lit("")))


def filter_class(filter_name: Column) -> Column:
    """astro, duo-band, unknown (null or blank), or the lower-case name with - for blanks and _."""
    f = F.lower(F.trim(filter_name))
    slug = F.regexp_replace(f, r"[\s_]+", "-")
    return (
        F.when(f.isNull() | (f == ""), "unknown")
        .when(slug.isin("astro", "l", "luminance", "clear"), "astro")
        .when(slug.isin("duo-band", "duo", "dual", "duoband"), "duo-band")
        .otherwise(slug)
    )


def safe_name(name: Column) -> Column:
    """File name: blanks become _, parentheses go."""
    return F.translate(F.replace(name, F.lit(" "), F.lit("_")), "()", "")


def short_name(name: Column) -> Column:
    """Leading letters, digits, blanks, dots and hyphens, without separators at the end."""
    return F.regexp_replace(F.regexp_extract(name, r"^([A-Za-z0-9][A-Za-z0-9 ._-]*)", 1), r"[.\-_ ]+$", "")


def name_key(name: Column) -> Column:
    """Lower case with single blanks."""
    return F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))


def compact_key(name: Column) -> Column:
    """name_key without blanks and hyphens."""
    return F.regexp_replace(name_key(name), r"[ -]", "")


def first_present(cards: Column, aliases: list[str]) -> Column:
    """Value of the first alias that is a key of the map, even if that value is unusable."""
    out = None
    for a in aliases:
        here = F.map_contains_key(cards, a)
        out = F.when(here, F.element_at(cards, a)) if out is None else out.when(here, F.element_at(cards, a))
    return out


def raw_card(cards: Column, card: str, aliases: list[str]) -> Column:
    """Value of a card, else of the first of its aliases, else of a card that differs in case only; blank and null values don't count.

    Of several that differ in case the least name is taken.
    """

    def value(c: str) -> Column:
        v = F.element_at(cards, c)
        return F.when(v != "", v)

    same = F.map_filter(cards, lambda k, v: (F.lower(k) == card.lower()) & (v != ""))
    loose = F.element_at(same, F.array_min(F.map_keys(same)))
    return F.coalesce(*[value(c) for c in dict.fromkeys([card, *aliases])], loose)


def without_unit(text: Column) -> Column:
    """Number before a unit (`30s`, `-4.5 C`), null if there is none."""
    return F.regexp_replace(F.trim(text), r"\s*[a-zA-Z/°]+$", "").try_cast("double")


def frame_type(name: Column, object_name: Column) -> Column:
    """Type from the file name, then from the target; light if neither tells."""
    n, o = F.lower(name), F.lower(F.coalesce(object_name, F.lit("")))
    return (
        F.when(n.contains("dark") & n.contains("flat"), "dark_flat")
        .when(n.contains("dark"), "dark")
        .when(n.contains("flat"), "flat")
        .when(n.contains("bias") | n.contains("offset"), "bias")
        .when(n.contains("light") | n.contains("obj") | n.contains("image"), "light")
        .when(o.contains("dark"), "dark")
        .when(o.contains("flat"), "flat")
        .when(o.contains("bias") | o.contains("offset"), "bias")
        .otherwise("light")
    )


# The preset of a class of objects.
PRESETS = {
    "galaxy": "galaxy_standard", "nebula": "nebula_standard", "planetary": "nebula_standard", "snr": "nebula_standard",
    "dark_nebula": "nebula_standard", "globular": "star_standard", "open_cluster": "star_standard", "star": "star_standard",
}


def object_class(text: Column) -> Column:
    """Class of an object from its type text: slugs first, then words, else unknown."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    has = t.contains
    return (
        F.when(t.isin(*PRESETS), t)
        .when(has("galax"), "galaxy")
        .when(has("planetar"), "planetary")
        .when(has("emission") & has("reflect"), "nebula")
        .when(has("supernova") | has("snr"), "snr")
        .when(has("emission"), "nebula")
        .when(has("dunkelnebel") | has("dark nebula"), "dark_nebula")
        .when(has("globular") | has("kugelsternhaufen"), "globular")
        .when(has("open cluster") | has("offener sternhaufen"), "open_cluster")
        .when(has("stern") | has("star"), "star")
        .otherwise("unknown")
    )


# File names of calibration frames whose headers are empty, in the
# order they are tried; groups: exposure, gain, binning, temperature (Java syntax).
FILE_PATTERNS = [
    ("light", r"(?i)(.+?)[_-]([\d.]+)s[_-]?(\d+)[_-](Astro|Duo-Band)[_-](\d{8})[-_]?(\d{6,})?[_-](-?\d+)C", (2, 3, None, 7)),
    ("dark", r"(?i)(?:dark|bias|flat|offset)(?:_exp)?_?([\d.]+)(?:s|sec)?_gain[_-]?(\d+)_bin[_-]?(\d+)(?:_(-?\d+)C)?_stack[_-]?(\d+)", (1, 2, 3, 4)),
    ("dark_short", r"(?i)(?:dark|bias|flat|offset)(?:_exp)?_?([\d.]+)(?:s|sec)?[_-](\d+)g[_-](-?\d+)C(?:_(\d+))?", (1, 2, None, 3)),
    ("dark_compact", r"(?i)(?:dark|bias|flat|offset)(?:_exp)?_?([\d.]+)s(\d+)", (1, 2, None, None)),
    ("generic", r"(?i)[_-]([\d.]+)s?[_-](\d+)[_-](\d+)[_-](-?\d+)C", (1, 2, 3, 4)),
]


def file_metadata(name: Column, overrides: dict[str, str] | None = None) -> Column:
    """struct(pattern, exptime, gain, binning, temp) of a file name; null if no pattern fits.

    overrides replaces the expression of a pattern by its label; case doesn't count. Its groups keep their meaning.
    """
    unknown = set(overrides or {}) - {p[0] for p in FILE_PATTERNS}
    if unknown:
        raise ValueError(f"unknown patterns: {', '.join(sorted(unknown))}")
    out = None
    for label, default, groups in FILE_PATTERNS:
        pattern = f"(?i){overrides[label]}" if overrides and label in overrides else default
        vals = [F.regexp_extract(name, pattern, g).try_cast(t) if g else F.lit(None).cast(t) for g, t in zip(groups, ("double", "int", "int", "double"))]
        row = F.struct(F.lit(label).alias("pattern"), *[v.alias(n) for v, n in zip(vals, ("exptime", "gain", "binning", "temp"))])
        out = F.when(name.rlike(pattern), row) if out is None else out.when(name.rlike(pattern), row)
    return out


def parse_timestamp(text: Column) -> Column:
    """Reading of the five plain header formats, without a zone; null for any other."""
    # The formats of a header date, in the order they are tried.
    formats = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss"]
    # A fraction of one to six digits is padded to microseconds.
    head, frac = (F.regexp_extract(text, r"^(.*)\.(\d{1,6})$", k) for k in (1, 2))
    padded = F.when(frac != "", F.concat(head, F.lit("."), F.rpad(frac, 6, "0"))).otherwise(text)
    return F.coalesce(*[F.try_to_timestamp(padded, F.lit(f)).cast("timestamp_ntz") for f in formats])
