"""Tensor-form statistics against numpy, with gaps, several sizes and nothing at all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import tensors as T

SCHEMA = "f string, g string, h int, w int, ch int, data array<double>, median string, n int"


def frames(spark, data):
    return spark.createDataFrame([(k, "g", *np.shape(a), [None if v is None else float(v) for v in np.ravel(a)], "x", 1) if a is not None else (k, "g", 2, 2, 1, None, "x", 1) for k, a in data.items()], SCHEMA)


@pytest.fixture
def pictures():
    rnd = np.random.default_rng(3)
    out = {str(i): rnd.normal(10, 3, (4, 6, 1) if i % 2 else (5, 5, 1)) for i in range(12)}
    out["gap"] = np.array([1.0, np.nan, 3.0, np.inf]).reshape(2, 2, 1)
    out["flat"], out["zero"] = np.full((2, 2, 1), 4.0), np.zeros((2, 2, 1))
    return out


def test_stats(spark, pictures):
    got = {r.f: r for r in T.frame_stats(frames(spark, pictures | {"null": None}), "f").collect()}
    for k, a in pictures.items():
        v = a[np.isfinite(a)]
        s = 1.4826 * np.median(np.abs(v - np.median(v)))
        assert np.isclose(got[k]["median"], np.median(v)) and np.isclose(got[k].sigma, s) and np.isclose(got[k].signal, np.percentile(v, 95) - np.median(v))
    assert got["null"]["median"] is None and got["flat"].snr == 0 and len(got) == len(pictures) + 1
    assert T.frame_stats(frames(spark, pictures).limit(0), "f").count() == 0


def test_normalise(spark, pictures):
    got = {r.f: r for r in T.normalise(frames(spark, pictures), ["f"], "mul").collect()}
    assert np.allclose(got["1"].data, (pictures["1"] / np.median(pictures["1"])).ravel()) and got["1"].whole
    assert got["gap"].data == [0.5, None, 1.5, None] and not got["gap"].whole
    assert got["zero"].data == [None] * 4 and got["zero"]["median"] == 0
    none = {r.f: r.data for r in T.normalise(frames(spark, pictures), ["f"], "none").collect()}
    assert np.allclose(none["2"], pictures["2"].ravel())


def test_stretches_and_background(spark, pictures):
    for how in ("asinh", "linear", "auto"):
        got = {r.f: np.array([np.nan if v is None else v for v in r.data]) for r in T.stretch(frames(spark, pictures), ["f"], how).collect()}
        assert all(np.nanmin(v) >= 0 for v in got.values()) and np.nanmax(got["zero"]) == 0
        assert np.isclose(got["1"].max(), pictures["1"].max() if how == "asinh" else 1.0)
    colour = np.arange(24, dtype=float).reshape(2, 4, 3)
    out = T.neutralise(frames(spark, {"a": colour}), ["f"]).first()
    assert np.allclose(np.array(out.data).reshape(2, 4, 3), np.maximum(colour - np.median(colour.reshape(-1, 3), axis=0), 0))


def test_flips_and_centroids(spark):
    img = np.arange(36, dtype=float).reshape(6, 6, 1) ** 1.3
    turned = {"none": img, "vertical": img[::-1], "horizontal": img[:, ::-1], "rotate_180": img[::-1, ::-1], "transpose": img.transpose(1, 0, 2)}
    wide = np.arange(8, dtype=float).reshape(2, 4, 1)
    ref = spark.createDataFrame([("g", img.ravel().tolist())], "g string, ref array<double>")
    got = {r.f: r for r in T.best_flip(T.with_reference(frames(spark, turned), ref, "g", "f"), "f").collect()}
    assert {k: r.flip for k, r in got.items()} == {k: k for k in turned} and all(r.gap > 0 for r in got.values())
    own = frames(spark, {"w": wide}).withColumn("ref", F.col("data"))
    assert T.best_flip(own, "f").first().flip == "none"
    spot = np.zeros((9, 9, 1))
    spot[3, 5] = 8.0
    c = T.bright_centroid(frames(spark, {"a": spot}), "f", 0.999).first()
    assert (c.n, c.cy, c.cx) == (1, 3.0, 5.0)


def test_no_pixel_is_shuffled(spark, pictures):
    df = frames(spark, pictures)
    for out in (T.frame_stats(df, "f"), T.normalise(df, ["f"]), T.stretch(df, ["f"]), T.neutralise(df, ["f"]), T.bright_centroid(df, "f", 0.9)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
