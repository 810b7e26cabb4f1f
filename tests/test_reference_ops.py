"""Image-stack operators against numpy, and on nulls, ties and empty tables."""

import numpy as np
from pyspark.sql import functions as F

from frameloom.functions import keys, robust
from frameloom.operators import groups, image, selection, stack
from tests.conftest import rows


def clip(values, k=3.0, rounds=5):
    a = np.array(values, float)
    mask = np.ones(len(a), bool)
    for _ in range(rounds):
        m = np.median(a[mask])
        s = np.sqrt(np.mean((a[mask] - m) ** 2))
        mask &= (a >= m - k * s) & (a <= m + k * s)
    return a[mask].mean() if mask.any() else np.median(a)


def winsor(values, k=2.0, rounds=5):
    a = np.array(values, float)
    for _ in range(rounds):
        m = np.median(a)
        s = np.sqrt(np.mean((a - m) ** 2))
        a = np.clip(a, m - k * s, m + k * s)
    return a.mean()


def test_iterative_clips_against_numpy(spark):
    rnd = np.random.default_rng(1)
    sets = [rnd.normal(0, 1, n).tolist() + ([50.0] if n > 10 else []) for n in (1, 2, 5, 11, 40)] + [[3.0] * 4, []]
    df = spark.createDataFrame([(i, sorted(v)) for i, v in enumerate(sets)], "i int, a array<double>")
    out = {r.i: (r.c, r.w) for r in df.select("i", robust.sigma_clipped_mean(F.col("a")).alias("c"), robust.winsorized_mean(F.col("a")).alias("w")).collect()}
    for i, v in enumerate(sets):
        if v:
            assert abs(out[i][0] - clip(v)) < 1e-9 and abs(out[i][1] - winsor(v)) < 1e-9
        else:
            assert out[i] == (None, None)


def test_safe_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 1.0, None)], "g string, x double, y double")
    got = {r.g: r.c for r in df.groupBy("g").agg(robust.safe_corr(F.col("x"), F.col("y")).alias("c")).collect()}
    assert abs(got["a"] - 1) < 1e-9 and got["b"] == 0.0 and got["c"] == 0.0


def pixels(spark, values):
    return spark.createDataFrame([(f, "g", 0, i, v) for f, vs in values.items() for i, v in enumerate(vs)], "f string, g string, y int, x int, value double")


def test_frames_with_defects_and_normalisation(spark):
    px = pixels(spark, {"a": [1.0, 2.0, 3.0], "b": [1.0, None, 3.0], "c": [1.0, float("nan"), 3.0], "d": [0.0, 0.0, 5.0]})
    assert {r.f for r in stack.usable_frames(px, "f").collect()} == {"a"}
    norm = stack.normalise(px.where("f in ('a', 'd')"), ["f"], "mul")
    assert sorted((r.f, r.value) for r in norm.collect() if r.f == "a") == [("a", 0.5), ("a", 1.0), ("a", 1.5)]
    assert all(r.value is None for r in norm.collect() if r.f == "d")
    for m in stack.METHODS:
        assert stack.stack(px.limit(0), ["g", "y", "x"], m).count() == 0
        assert stack.stack(px.where("f = 'a'"), ["g", "y", "x"], m).count() == 3


def test_tensor_and_pixel_forms_agree(spark):
    t = spark.createDataFrame([("a", 2, 3, 2, [float(i) for i in range(12)])], "f string, h int, w int, ch int, data array<double>")
    back = stack.to_tensors(stack.to_pixels(t, ["f"], channels="ch"), ["f"]).first()
    assert (back.h, back.w, back.ch, list(back.data)) == (2, 3, 2, [float(i) for i in range(12)])


def quality(spark, data):
    return spark.createDataFrame(data, "f string, g string, snr double, star_count int, fwhm_median double, elongation_ratio double, correlation double, double_rate double, elongation_unusable boolean, idx int")


def test_selection_on_nulls_ties_and_small_groups(spark):
    q = quality(spark, [(f"f{i}", "g", 5.0, 10, 2.0, 1.0, 0.9, 0.1, False, i) for i in range(25)] + [("nan", "g", float("nan"), 10, 2.0, 1.0, None, None, None, 30), ("one", "h", 1.0, 1, None, None, 0.0, None, True, 0)])
    s = {r.f: r.score for r in selection.composite_score(q, "g").collect()}
    assert s["f0"] == 0.5 and s["nan"] == 0.0 and s["one"] == 0.5
    kept = selection.percentile_keep(selection.composite_score(q, "g"), "g", "score", "idx")
    assert {r.f for r in kept.where("not keep").collect()} == {"nan", "f24"}
    f = {r.f: (r.decision, r.reason) for r in selection.funnel(q, "g", "idx", {"snr": (2.0, None)}).collect()}
    assert f["nan"] == ("discarded", "percentile") and f["one"] == ("discarded", "threshold:elongation,snr") and f["f0"] == ("kept", None)
    # A gate that would empty its group is undone.
    g = {r.f: r.gate for r in selection.correlation_gate(q, "g", 0.05).collect()}
    assert g["one"] and g["nan"]
    assert selection.funnel(q.limit(0), "g", "idx", {}).count() == 0
    assert selection.mad_outliers(q, "g", ["snr", "star_count"]).where("outlier").count() == 0


def test_status_and_names(spark):
    df = spark.createDataFrame([("a", "PASS"), ("a", "FAIL"), ("b", "SKIPPED"), ("c", "PASS"), ("c", "SKIPPED")], "k string, status string")
    assert rows(groups.overall_status(df, ["k"])) == [("a", "FAIL", 2), ("b", "SKIPPED", 1), ("c", "PASS", 0)]
    n = spark.createDataFrame([(15.0, 60, None), (0.5, 0, "Duo Band"), (None, None, "none")], "e double, g int, f string")
    assert sorted(r[0] for r in n.select(keys.group_hash(F.col("e"), F.col("g"), F.col("f"))).collect()) == ["0.5s0_duo_band", "0s0", "15s60"]


def test_flips_are_found(spark):
    rnd = np.random.default_rng(2)
    ref = rnd.normal(0, 1, (6, 6))
    shots = {"same": ref, "vertical": ref[::-1], "horizontal": ref[:, ::-1], "rotate_180": ref[::-1, ::-1], "transpose": ref.T, "flat": np.ones((6, 6))}
    px = spark.createDataFrame([(n, "g", y, x, float(a[y, x])) for n, a in shots.items() for y in range(6) for x in range(6)], "f string, g string, y int, x int, value double")
    r = spark.createDataFrame([("g", y, x, float(ref[y, x])) for y in range(6) for x in range(6)], "g string, y int, x int, ref double")
    got = {x.f: x.flip for x in image.best_flip(px, r, "f", "g", 6, 6).collect()}
    assert got == {"same": "none", "vertical": "vertical", "horizontal": "horizontal", "rotate_180": "rotate_180", "transpose": "transpose", "flat": "none"}


def test_shifts_repeat_edges(spark):
    a = np.arange(12.0).reshape(3, 4)
    px = spark.createDataFrame([("f", y, x, float(a[y, x])) for y in range(3) for x in range(4)], "f string, y int, x int, value double")
    for dy in (-4, -1, 0, 2, 5):
        for dx in (-2, 0, 3):
            got = np.full((3, 4), np.nan)
            for r in image.shift_pixels(px, ["f"], dy, dx, 3, 4).collect():
                assert np.isnan(got[r.y, r.x])
                got[r.y, r.x] = r.value
            ys, xs = np.clip(np.arange(3) - dy, 0, 2), np.clip(np.arange(4) - dx, 0, 3)
            assert np.array_equal(got, a[np.ix_(ys, xs)]), (dy, dx)
