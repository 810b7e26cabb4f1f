"""Queries on kernels with synthetic frames whose answer is known, so that SQL can state it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kernels
from ..session import read_table
from .catalog import query


def _made(spark: SparkSession, d: str, table: str, key: str, schema: str, fn) -> DataFrame:
    """fn(key) for each row of a table, through the same path as images: the frame is the key itself."""
    rows = read_table(spark, d, table).select(key).select(key, F.lit(1).alias("h"), F.lit(1).alias("w"), F.lit(1).alias("ch"), F.array(F.col(key).cast("double")).alias("data"))
    return kernels.per_frame(rows, [key], schema, lambda img: fn(int(img[0, 0])))


def _texture(seed: int, n: int) -> np.ndarray:
    """A frame of smooth noise that wraps around."""
    return np.random.default_rng(seed).normal(0, 1, (n, n))


@query("SELECT p_partkey, p_partkey % 7 - 3 AS dy, p_partkey % 5 - 2 AS dx FROM part")
def known_shift(spark: SparkSession, d: str) -> DataFrame:
    """Shift found by phase correlation between a frame and itself moved."""

    def one(k):
        a = _texture(k, 32)
        dy, dx = kernels.phase_shift(a, np.roll(a, (-(k % 7 - 3), -(k % 5 - 2)), (0, 1)))
        return {"dy": round(dy), "dx": round(dx)}

    return _made(spark, d, "part", "p_partkey", "dy bigint, dx bigint", one)


@query("SELECT p_partkey, (p_partkey % 7 - 3)::DOUBLE AS dy, (p_partkey % 5 - 2)::DOUBLE AS dx FROM part")
def known_upsampled(spark: SparkSession, d: str) -> DataFrame:
    """The same by the upsampled transform, to a tenth."""

    def one(k):
        a = _texture(k, 32)
        dy, dx = kernels.upsampled_shift(a, np.roll(a, (-(k % 7 - 3), -(k % 5 - 2)), (0, 1)))
        return {"dy": round(dy, 1) + 0.0, "dx": round(dx, 1) + 0.0}

    return _made(spark, d, "part", "p_partkey", "dy double, dx double", one)


@query("SELECT n_nationkey, n_nationkey % 9 - 4 AS dy, n_nationkey % 6 - 3 AS dx FROM nation")
def known_grid(spark: SparkSession, d: str) -> DataFrame:
    """The same by the grid search."""

    def one(k):
        a = _texture(k, 40)
        dy, dx, _ = kernels.grid_shift(a, kernels.shift_integer(a, -(k % 9 - 4), -(k % 6 - 3)), 8)
        return {"dy": int(dy), "dx": int(dx)}

    return _made(spark, d, "nation", "n_nationkey", "dy bigint, dx bigint", one)


@query("""WITH k AS (SELECT unnest(range(-6, 7)) AS o), g AS (SELECT o, exp(-0.5 * pow(o / 1.5, 2)) AS w FROM k), n AS (SELECT o, w / (SELECT sum(w) FROM g) AS w FROM g)
SELECT a.o AS y, b.o AS x, round(a.w * b.w, 9) AS value FROM n a, n b""")
def known_blur(spark: SparkSession, d: str) -> DataFrame:
    """A single bright pixel blurred: the kernel itself."""

    def one(_):
        img = np.zeros((13, 13))
        img[6, 6] = 1.0
        return {"data": kernels.flat(kernels.gaussian_blur(img, 1.5))}

    out = _made(spark, d, "region", "r_regionkey", "data array<double>", one).where("r_regionkey = 0").select(F.posexplode("data").alias("i", "v"))
    return out.select((F.floor(F.col("i") / 13) - 6).alias("y"), (F.col("i") % 13 - 6).cast("long").alias("x"), F.round("v", 9).alias("value"))


@query("SELECT s_suppkey, (s_suppkey % 11 + 1)::DOUBLE AS r, (s_suppkey % 7 + 2)::DOUBLE AS g, (s_suppkey % 5 + 3)::DOUBLE AS b FROM supplier")
def known_malvar(spark: SparkSession, d: str) -> DataFrame:
    """Grey-free constant colours through a mosaic and back; the planes stay constant inside."""

    def one(k):
        rgb = (k % 11 + 1, k % 7 + 2, k % 5 + 3)
        img = np.zeros((12, 12))
        for (_, mask), v in zip(kernels.bayer_masks(img.shape).items(), rgb):
            img[mask] = v
        out = kernels.bilinear(img)
        fine = kernels.malvar(np.full((12, 12), float(rgb[1])))
        return {"r": float(np.median(out[2:-2, 2:-2, 0])), "g": float(np.median(fine[2:-2, 2:-2, 1])), "b": float(np.median(out[2:-2, 2:-2, 2]))}

    return _made(spark, d, "supplier", "s_suppkey", "r double, g double, b double", one)


@query("SELECT s_suppkey, s_suppkey % 6 + 1 AS stars, (3 + 8 * ((s_suppkey % 6) // 3))::DOUBLE AS last_y, (5 + 9 * ((s_suppkey % 6) % 3))::DOUBLE AS last_x FROM supplier")
def known_stars(spark: SparkSession, d: str) -> DataFrame:
    """Number and faintest position of stars put on a noisy frame."""

    def one(k):
        n = k % 6 + 1
        y, x = np.indices((18, 30))
        img = np.random.default_rng(k).normal(10, 0.1, y.shape)
        for i in range(n):
            img += (200 - 20 * i) * np.exp(-((y - 3 - 8 * (i // 3)) ** 2 + (x - 5 - 9 * (i % 3)) ** 2) / 1.5)
        s = kernels.detect_stars(img, 30.0, 8.0, 3)
        return {"stars": len(s), "last_y": float(round(s[-1]["y"])), "last_x": float(round(s[-1]["x"]))}

    return _made(spark, d, "supplier", "s_suppkey", "stars bigint, last_y double, last_x double", one)


@query("SELECT s_suppkey, 100.0::DOUBLE AS c0, (s_suppkey % 9)::DOUBLE AS cx, (s_suppkey % 4 - 2)::DOUBLE AS cy FROM supplier")
def known_gradient(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of a plane recovered from its cells."""

    def one(k):
        y, x = np.mgrid[0:24, 0:24] / 23.0
        c = kernels.gradient_fit(100.0 + (k % 9) * x + (k % 4 - 2) * y, 1, 6)["coefficients"]
        return {n: round(v, 6) + 0.0 for n, v in zip(("c0", "cx", "cy"), c)}

    return _made(spark, d, "supplier", "s_suppkey", "c0 double, cx double, cy double", one)


@query("SELECT n_nationkey, (n_nationkey % 9 - 4) * 0.5 AS rotation FROM nation")
def known_rotation(spark: SparkSession, d: str) -> DataFrame:
    """Rotation found between a scene and itself turned, in steps of a quarter degree."""

    def one(k):
        rnd = np.random.default_rng(k)
        y, x = np.indices((96, 96))
        img = sum(rnd.uniform(50, 200) * np.exp(-((y - a) ** 2 + (x - b) ** 2) / 8.0) for a, b in rnd.uniform(12, 84, (25, 2)))
        turn = (k % 9 - 4) * 0.5
        found, _ = kernels.rotation_between(img, kernels.transform(img, rotation_deg=-turn), 5.0)
        return {"rotation": found + 0.0}

    return _made(spark, d, "nation", "n_nationkey", "rotation double", one)
