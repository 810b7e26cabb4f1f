"""Joins by tolerance, tier, distance and pattern, as bucketed equi-joins.

A range condition alone would make a cartesian product. One side is put into
buckets as wide as the tolerance, the other into its bucket and both neighbours,
and the exact condition is checked within. Dense buckets are ordinary join keys,
which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _neighbours(c: Column, width: float) -> Column:
    b = F.floor(c / width)
    return F.explode(F.array(b - 1, b, b + 1))


def band_join(left: DataFrame, right: DataFrame, equal: list[str], left_value: str, right_value: str, tolerance: float, condition: Column | None = None, how: str = "inner") -> DataFrame:
    """left ⨝ right on equal keys and |left_value - right_value| <= tolerance.

    Null keys or values match nothing. The sides' other columns must not clash.
    """
    width = max(tolerance, 1e-12)
    r = right.withColumn("__b", F.floor(F.col(right_value) / width))
    lid = left.withColumn("__b", _neighbours(F.col(left_value), width))
    hit = F.abs(F.col(left_value) - F.col(right_value)) <= tolerance
    out = lid.join(r, [*equal, "__b"]).where(hit if condition is None else hit & condition).drop("__b")
    if how == "inner":
        return out
    if how == "left_semi":
        return out.select(*left.columns).distinct()
    raise ValueError(how)


def tiered_match(groups: DataFrame, key: str, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of the first tier that matches a group; groups without any get tier `none`.

    Each tier has key and the same further columns.
    """
    found = None
    for i, (name, df) in enumerate(tiers):
        part = df.withColumns({"tier": F.lit(name), "__t": F.lit(i)})
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy(key)
    first = found.withColumn("__m", F.min("__t").over(best)).where("__t = __m").drop("__t", "__m")
    return groups.join(first, key, "left").withColumn("tier", F.coalesce("tier", F.lit("none")))


def unit_vector(ra: Column, dec: Column) -> list[Column]:
    """x, y, z of a direction in degrees."""
    r, d = F.radians(ra), F.radians(dec)
    return [F.cos(d) * F.cos(r), F.cos(d) * F.sin(r), F.sin(d)]


def nearest_on_sky(stars: DataFrame, catalog: DataFrame, star: str, entry: str, radius_deg: float) -> DataFrame:
    """star, entry, chord: the nearest catalogue entry within a radius (chord on the unit sphere).

    Both sides have `ra` and `dec` in degrees. Zones of declination as high as
    the radius are cut into cells of right ascension at least as wide as the radius is in that zone,
    which are joined with their neighbours across the wrap-around; zones that reach a pole
    are one cell. So candidates grow with the density on the sky and not with a
    whole ring. Ties go to the lesser entry. Stars without an entry near are left
    out; null positions match nothing.
    """
    far = 2.0 * F.sin(F.radians(F.lit(radius_deg)) / 2.0)
    height = max(radius_deg * 1.001, 1e-9)

    def cells(zone: Column) -> Column:
        """Number of cells around a zone: the widest difference in right ascension of a circle about its narrowest parallel."""
        top = F.least(F.greatest(F.abs(zone * height), F.abs((zone + 1) * height)), F.lit(90.0))
        part = F.sin(F.radians(F.lit(min(height, 90.0)))) / F.greatest(F.cos(F.radians(top)), F.lit(1e-12))
        wide = F.degrees(F.asin(F.least(part, F.lit(1.0)))) * 1.001
        return F.when(part >= 1.0, 1).otherwise(F.greatest(F.floor(360.0 / wide), F.lit(1))).cast("long")

    def cell(ra: Column, n: Column) -> Column:
        turn = ra / 360.0
        return F.least(F.floor((turn - F.floor(turn)) * n), n - 1).cast("long")

    s = stars.select(star, "ra", *[v.alias(f"__s{i}") for i, v in enumerate(unit_vector(F.col("ra"), F.col("dec")))], _neighbours(F.col("dec"), height).alias("__z"))
    s = s.withColumn("__n", cells(F.col("__z")))
    at = cell(F.col("ra"), F.col("__n"))
    around = F.array_distinct(F.transform(F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)]), lambda k: F.pmod(at + k, F.col("__n"))))
    s = s.withColumn("__a", F.explode(around)).drop("ra", "__n")
    c = catalog.select(entry, "ra", *[v.alias(f"__c{i}") for i, v in enumerate(unit_vector(F.col("ra"), F.col("dec")))], F.floor(F.col("dec") / height).alias("__z"))
    c = c.withColumn("__a", cell(F.col("ra"), cells(F.col("__z")))).drop("ra")
    chord = F.sqrt(sum((F.pow(F.col(f"__s{i}") - F.col(f"__c{i}"), F.lit(2.0)) for i in range(3)), F.lit(0.0)))
    near = s.join(c, ["__z", "__a"]).select(star, entry, chord.alias("chord")).where(F.col("chord") <= far)
    return near.groupBy(star).agg(F.min(F.struct("chord", entry)).alias("__n")).select(star, F.col(f"__n.{entry}").alias(entry), F.col("__n.chord").alias("chord"))


def pairs_within(a: DataFrame, b: DataFrame, frame: str, radius: float) -> DataFrame:
    """Pairs of points of one frame at most `radius` apart: frame, a_id, b_id, dist.

    a and b have frame, id, x, y; cells of the grid are as wide as the radius.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    pa = a.select(frame, F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), _neighbours(F.col("x"), radius).alias("cx"))
    pa = pa.withColumn("cy", _neighbours(F.col("ay"), radius))
    pb = b.select(frame, F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy"))
    dist = F.sqrt(F.pow(F.col("ax") - F.col("bx"), F.lit(2.0)) + F.pow(F.col("ay") - F.col("by"), F.lit(2.0)))
    return pa.join(pb, [frame, "cx", "cy"]).select(frame, "a_id", "b_id", dist.alias("dist")).where(F.col("dist") <= radius)


def double_rate(stars: DataFrame, frame: str, radius: float = 5.0, min_stars: int = 5, lo: float = 0.5, hi: float = 2.0) -> DataFrame:
    """frame, stars, doubles, double_rate: share of stars with a later neighbour of similar flux.

    A star counts once; rate is null with fewer than min_stars stars. stars has
    frame, id, x, y, flux; ids order the stars of a frame.
    """
    lit = stars.select(frame, "id", "x", "y", "flux")
    flux = lit.select(frame, F.col("id").alias("a_id"), F.col("flux").alias("fa"))
    near = pairs_within(lit, lit, frame, radius).where("a_id < b_id")
    pair = near.join(flux, [frame, "a_id"]).join(flux.select(frame, F.col("a_id").alias("b_id"), F.col("fa").alias("fb")), [frame, "b_id"])
    ratio = F.when((F.col("fa") > 0) & (F.col("fb") > 0), F.least("fa", "fb") / F.greatest("fa", "fb"))
    doubles = pair.where(ratio.between(lo, hi)).select(frame, "a_id").distinct().groupBy(frame).agg(F.count("*").alias("d"))
    n = stars.groupBy(frame).agg(F.count("*").alias("stars"))
    d = F.coalesce("d", F.lit(0))
    return n.join(doubles, frame, "left").select(frame, "stars", d.alias("doubles"), F.when(F.col("stars") >= min_stars, d / F.col("stars")).alias("double_rate"))


def profile_match(items: DataFrame, key: str, text: str, profiles: DataFrame) -> DataFrame:
    """key, profile: exact beats substring, longer beats shorter, first beats later; else `default`.

    profiles has name, pattern and ord. The distinct texts are matched against
    it, not the items: every part of a text that is as long as some pattern is
    an equi-join key, so neither side is multiplied by the other.
    """
    texts = items.select(F.lower(text).alias("__t")).where("__t is not null").distinct()
    p = profiles.select("name", F.lower("pattern").alias("pattern"), "ord").where("pattern <> ''")
    # Lengths of patterns: few, whatever the number of profiles.
    lengths = p.agg(F.array_sort(F.collect_set(F.length("pattern"))).alias("__l"))
    parts = texts.crossJoin(lengths).select("__t", F.explode(F.coalesce("__l", F.array().cast("array<int>"))).alias("__k")).where(F.length("__t") >= F.col("__k"))  # one row
    parts = parts.select("__t", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("__t") - F.col("__k") + 1), lambda i: F.substring(F.col("__t"), i, F.col("__k"))))).alias("pattern"))
    rank = F.struct((F.col("__t") == F.col("pattern")).alias("exact"), F.length("pattern").alias("len"), (-F.col("ord")).alias("o"))
    best = parts.join(p, "pattern").groupBy("__t").agg(F.max_by("name", rank).alias("profile"))
    return items.select(key, F.lower(text).alias("__t")).join(best, "__t", "left").select(key, F.coalesce("profile", F.lit("default")).alias("profile"))


def in_cone(catalog: DataFrame, ra0: float, dec0: float, radius_deg: float) -> DataFrame:
    """Rows of a catalogue (ra, dec in degrees) within a cone, with `sep_deg`.

    A band of declinations goes first, so that the scan is pruned by it.
    """
    d = F.radians("dec")
    hav = F.pow(F.sin((d - F.radians(F.lit(dec0))) / 2), F.lit(2.0)) + F.cos(d) * F.cos(F.radians(F.lit(dec0))) * F.pow(F.sin(F.radians(F.col("ra") - ra0) / 2), F.lit(2.0))
    sep = F.degrees(2 * F.asin(F.sqrt(F.least(hav, F.lit(1.0)))))
    band = F.col("dec").between(dec0 - radius_deg, dec0 + radius_deg)
    return catalog.where(band).withColumn("sep_deg", sep).where(F.col("sep_deg") <= radius_deg)
