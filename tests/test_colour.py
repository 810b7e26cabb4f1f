import numpy as np
from pyspark.sql import functions as F

from frameloom.operators import colour, spatial
from tests.conftest import rows


def test_pixels_on_the_sky(spark):
    df = spark.createDataFrame([(0.0, 0.0), (99.0, 49.0)], "x double, y double")
    lit = [F.lit(float(v)) for v in (100, 50, 359.999, 60.0, 3.6)]
    got = df.select(*colour.pixel_to_sky(F.col("x"), F.col("y"), *lit)).collect()
    assert abs(got[0][0] - (359.999 - 0.0495 / 0.5)) < 1e-6 and abs(got[0][1] - 60.0245) < 1e-6
    assert abs(got[1][0] - (0.098)) < 1e-3
    assert df.select(colour.pixel_scale(F.lit(3.76), F.lit(1), F.lit(0.0)), colour.pixel_scale(F.lit(2.0), F.lit(2), F.lit(206.265))).first() == (0.0, 4.0)


def test_nearest_entry_across_the_zero_meridian_and_at_the_pole(spark):
    s = spark.createDataFrame([(1, 359.9999, 10.0), (2, 10.0, 89.9999), (3, 50.0, 0.0), (4, None, 0.0)], "star int, ra double, dec double")
    c = spark.createDataFrame([(10, 0.0001, 10.0), (11, 190.0, 89.9999), (12, 60.0, 0.0), (13, 0.0001, 10.0)], "entry int, ra double, dec double")
    assert [r[:2] for r in rows(spatial.nearest_on_sky(s, c, "star", "entry", 0.01))] == [(1, 10), (2, 11)]
    assert spatial.nearest_on_sky(s.limit(0), c, "star", "entry", 0.01).count() == 0


def test_band_join_equals_a_cross_join(spark):
    rnd = np.random.default_rng(1)
    a = spark.createDataFrame([(int(g), float(v)) for g, v in zip(rnd.integers(0, 3, 200), rnd.uniform(-9, 9, 200))] + [(None, 1.0), (1, None)], "k int, va double").withColumn("ia", F.monotonically_increasing_id())
    b = spark.createDataFrame([(int(g), float(v)) for g, v in zip(rnd.integers(0, 3, 200), rnd.uniform(-9, 9, 200))] + [(None, 1.0), (1, None)], "k int, vb double").withColumn("ib", F.monotonically_increasing_id())
    want = a.alias("a").crossJoin(b.alias("b")).where("a.k = b.k and abs(va - vb) <= 0.5").select("ia", "ib")
    assert rows(spatial.band_join(a, b, ["k"], "va", "vb", 0.5).select("ia", "ib")) == rows(want)


def test_chain_of_sources(spark):
    t = "g string, matched int, r_factor double, b_factor double, status string"
    first = spark.createDataFrame([("a", 9, 1.1, 0.9, "ok"), ("b", 2, None, None, "few_stars"), ("c", 9, 5.0, 1.0, "rejected")], t)
    second = spark.createDataFrame([("a", 9, 9.9, 9.9, "ok"), ("b", 9, 1.2, 1.0, "ok"), ("c", 9, 1.0, 1.0, "ok")], t)
    every = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "g string")
    got = {r.g: (r.source, r.r_factor, r.status) for r in colour.first_success([("one", first), ("two", second)], "g", every).collect()}
    assert got == {"a": ("one", 1.1, "ok"), "b": ("two", 1.2, "ok"), "c": ("gray_world", None, "rejected"), "d": ("gray_world", None, "no_match")}


def test_nearest_on_sky_equals_all_pairs(spark):
    """Over the whole sky, the wrap-around and the poles, for radii small and large."""
    import numpy as np

    rnd = np.random.default_rng(8)
    for radius in (0.5, 3.0, 25.0):
        ra = np.r_[rnd.uniform(0, 360, 150), [0.0, 359.99, 0.01, 180.0, 10.0, 200.0]]
        dec = np.r_[np.degrees(np.arcsin(rnd.uniform(-1, 1, 150))), [0.0, 0.1, -0.1, 89.9, -90.0, 90.0]]
        rb, db = (ra + rnd.normal(0, radius / 2, len(ra))) % 360, np.clip(dec + rnd.normal(0, radius / 2, len(ra)), -90, 90)
        s = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(ra, dec))], "star int, ra double, dec double")
        c = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rb, db))], "entry int, ra double, dec double")

        def unit(a, b):
            a, b = np.radians(a), np.radians(b)
            return np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], axis=1)

        chord = np.linalg.norm(unit(ra, dec)[:, None] - unit(rb, db)[None], axis=2)
        want = {i: int(chord[i].argmin()) for i in range(len(ra)) if chord[i].min() <= 2 * np.sin(np.radians(radius) / 2)}
        assert {r.star: r.entry for r in spatial.nearest_on_sky(s, c, "star", "entry", radius).collect()} == want
