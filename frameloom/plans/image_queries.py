"""Queries on pixels: stacking, calibration, stencils, display, registration.

The 64 values of an embedding stand for an 8 × 8 frame, its label for the group.
Doubles are rounded to six decimals, since sums may run in another order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import robust
from ..operators import calibration, image, kernels, stack
from ..operators import tensors as T
from ..session import read_table
from .catalog import query

PX = """px AS (SELECT vec_id, label, (i // 8)::INT AS y, (i % 8)::INT AS x, v FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"""
AT = ["label", "y", "x"]
R6 = lambda c: F.round(c, 6)


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, y, x, c, value."""
    return stack.to_pixels(read_table(spark, d, "embeddings"), ["vec_id", "label"], "embedding", 8)


def tensors(spark: SparkSession, d: str) -> DataFrame:
    return kernels.tensors_of_vectors(read_table(spark, d, "embeddings"), ["vec_id", "label"], "embedding", 8, 8)


@query(f"""WITH {PX}, m AS (SELECT *, median(v) OVER (PARTITION BY vec_id) m FROM px), s AS (SELECT vec_id, max(m) AS median, 1.4826 * median(abs(v - m)) AS sigma, quantile_cont(v, 0.95) - max(m) AS signal FROM m GROUP BY vec_id)
SELECT vec_id, round(median, 6) AS median, round(sigma, 6) AS sigma, round(signal, 6) AS signal, round(CASE WHEN sigma > 1e-12 THEN greatest(signal / sigma, 0) ELSE 0 END, 6) AS snr FROM s""")
def frame_stats(spark: SparkSession, d: str) -> DataFrame:
    """Median, noise, signal and signal-to-noise of each frame."""
    s = T.frame_stats(tensors(spark, d), "vec_id")
    return s.select("vec_id", *[R6(c).alias(c) for c in ("median", "sigma", "signal", "snr")])


def _stacked(spark: SparkSession, d: str, method: str) -> DataFrame:
    out = stack.stack(pixels(spark, d), AT, method, column=["label", "x"])
    return out.select(*AT, "n", R6("stacked").alias("stacked"))


@query(f"WITH {PX} SELECT label, y, x, count(v) AS n, round(avg(v), 6) AS stacked FROM px GROUP BY ALL")
def stack_average(spark: SparkSession, d: str) -> DataFrame:
    return _stacked(spark, d, "average")


@query(f"WITH {PX} SELECT label, y, x, count(v) AS n, round(median(v), 6) AS stacked FROM px GROUP BY ALL")
def stack_median(spark: SparkSession, d: str) -> DataFrame:
    return _stacked(spark, d, "median")


def _rounds(keep: str, clamp: bool) -> str:
    """Five rounds of statistics per pixel as a chain of windows."""
    w = "OVER (PARTITION BY label, y, x)"
    out, src = [], "px"
    for i in range(5):
        out.append(f"m{i} AS (SELECT *, median(v) {w} AS m FROM {src}), s{i} AS (SELECT *, sqrt(avg((v - m) * (v - m)) {w}) AS s FROM m{i})")
        step = "greatest(least(v, m + 2 * s), m - 2 * s) AS v" if clamp else "v"
        cond = "" if clamp else " WHERE v >= m - 3 * s AND v <= m + 3 * s"
        out.append(f"r{i} AS (SELECT vec_id, label, y, x, {step} FROM s{i}{cond})")
        src = f"r{i}"
    return f"WITH {PX}, {', '.join(out)}, n AS (SELECT label, y, x, count(*) AS n FROM px GROUP BY ALL), a AS (SELECT label, y, x, avg(v) AS a FROM r4 GROUP BY ALL) {keep}"


@query(_rounds("SELECT label, y, x, n, round(a, 6) AS stacked FROM n JOIN a USING (label, y, x)", True))
def stack_winsor(spark: SparkSession, d: str) -> DataFrame:
    return _stacked(spark, d, "winsorized")


@query(_rounds("SELECT label, y, x, n, round(a, 6) AS stacked FROM n JOIN a USING (label, y, x)", False))
def stack_sigma_clip(spark: SparkSession, d: str) -> DataFrame:
    return _stacked(spark, d, "sigma_clip")


_W = f"WITH {PX}, o AS (SELECT label, y, x, count(v) AS n, sum(v) s, avg(v) a, 1 / (var_pop(v) + 1e-10) AS w FROM px GROUP BY ALL)"


@query(_W + " SELECT label, y, x, n, round(a, 6) AS stacked, round(w, 6) AS weight FROM o")
def stack_weighted(spark: SparkSession, d: str) -> DataFrame:
    out = stack.stack(pixels(spark, d), AT, "weighted")
    return out.select(*AT, "n", R6("stacked").alias("stacked"), R6("weight").alias("weight"))


@query(_W + " SELECT label, y, x, n, round(s * w / sum(w) OVER (PARTITION BY label, x), 6) AS stacked FROM o")
def stack_weighted_literal(spark: SparkSession, d: str) -> DataFrame:
    return _stacked(spark, d, "weighted_literal")


@query(f"WITH {PX}, k AS (SELECT *, v - median(v) OVER (PARTITION BY vec_id) AS u FROM px) SELECT label, y, x, count(u) AS n, round(avg(u), 6) AS stacked FROM k GROUP BY ALL")
def stack_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Average of frames whose median was subtracted."""
    even = T.normalise(tensors(spark, d), ["vec_id", "label"], "add")
    out = stack.stack(stack.to_pixels(even, ["label"]), AT)
    return out.select(*AT, "n", R6("stacked").alias("stacked"))


@query("""WITH p AS (SELECT l_suppkey, l_extendedprice / median(l_extendedprice) OVER (PARTITION BY l_suppkey) AS v, l_linenumber FROM lineitem)
SELECT l_linenumber, count(v) AS n, round(avg(v), 6) AS stacked FROM p GROUP BY l_linenumber""")
def stack_multiplied(spark: SparkSession, d: str) -> DataFrame:
    """Average per line number of prices divided by their supplier's median."""
    rows = read_table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", F.col("l_extendedprice").alias("value"))
    out = stack.stack(stack.normalise(rows, ["l_suppkey"], "mul"), ["l_linenumber"])
    return out.select("l_linenumber", "n", R6("stacked").alias("stacked"))


@query("""WITH p AS (SELECT l_returnflag, l_linestatus, l_extendedprice v, quantile_cont(l_extendedprice, 0.05) OVER w AS lo, quantile_cont(l_extendedprice, 0.95) OVER w AS hi FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linestatus))
SELECT l_returnflag, l_linestatus, count(v) AS n, round(avg(greatest(least(v, hi), lo)), 4) AS stacked FROM p GROUP BY ALL""")
def master_percentile_clamp(spark: SparkSession, d: str) -> DataFrame:
    """Mean price after clamping to the 5th and 95th percentile."""
    out = stack.percentile_clamped_mean(read_table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.select("l_returnflag", "l_linestatus", "n", F.round("stacked", 4).alias("stacked"))


@query(f"""WITH {PX}, g AS (SELECT label, count(DISTINCT vec_id) AS frames FROM px GROUP BY label HAVING count(DISTINCT vec_id) >= 2), k AS (SELECT *, v / nullif(median(v) OVER (PARTITION BY vec_id), 0) AS u FROM px)
SELECT label, y, x, count(u) AS n, round(avg(u), 4) AS flat FROM k JOIN g USING (label) GROUP BY ALL""")
def master_flat(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the frames divided by their median, per group of at least two frames."""
    px = pixels(spark, d)
    enough = px.groupBy("label").agg(F.count_distinct("vec_id").alias("f")).where("f >= 2").select("label")
    out = stack.stack(stack.normalise(px.join(enough, "label", "left_semi"), ["vec_id"], "mul"), AT)
    return out.select(*AT, "n", F.round("stacked", 4).alias("flat"))


_MEDSTACK = f"{PX}, st AS (SELECT label, y, x, median(v) AS s FROM px GROUP BY ALL), fc AS (SELECT label, count(*) AS frames FROM embeddings GROUP BY label)"


@query(f"WITH {_MEDSTACK} SELECT y, x, count(s) AS groups, round(greatest(sum(s * frames) / sum(frames), 0), 6) AS merged FROM st JOIN fc USING (label) GROUP BY y, x")
def merge_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Group stacks merged with their frame counts as weights."""
    counts = read_table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("frames"))
    st = stack.stack(pixels(spark, d), AT, "median").join(counts, "label")
    return stack.merge(st, ["y", "x"], "stacked", "frames").select("y", "x", "groups", R6("merged").alias("merged"))


@query(f"WITH {_MEDSTACK} SELECT y, x, count(s) AS groups, round(greatest(median(s), 0), 6) AS merged FROM st GROUP BY y, x")
def merge_median(spark: SparkSession, d: str) -> DataFrame:
    st = stack.stack(pixels(spark, d), AT, "median")
    return stack.merge(st, ["y", "x"], "stacked", method="median").select("y", "x", "groups", R6("merged").alias("merged"))


@query(f"""WITH {PX}, u AS (SELECT vec_id, label, y, x, v * 100 + CASE WHEN label % 2 = 0 THEN 0 ELSE -40 END AS v FROM px), d AS (SELECT label, y, x, median(v) * 50 + 3 AS dark FROM px WHERE label <> 3 GROUP BY ALL),
 dm AS (SELECT *, median(dark) OVER (PARTITION BY label) dm FROM d), l AS (SELECT *, median(v) OVER (PARTITION BY vec_id) lm FROM u)
SELECT vec_id, l.label, l.y, l.x, round(greatest(CASE WHEN dark IS NULL THEN v WHEN dm - lm > greatest(5.0, 0.04 * abs(lm)) THEN v - (dark - dm) ELSE v - dark END, 0), 5) AS value,
 CASE WHEN dark IS NULL THEN 'none' WHEN dm - lm > greatest(5.0, 0.04 * abs(lm)) THEN 'offset_rescue' ELSE 'full' END AS dark_mode FROM l LEFT JOIN dm ON l.label = dm.label AND l.y = dm.y AND l.x = dm.x""")
def calibrate_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Frames less their group's master dark; only its structure where the dark is too bright."""
    offset = F.when(F.col("label") % 2 == 0, 0.0).otherwise(-40.0)
    lights = tensors(spark, d).withColumn("data", F.transform("data", lambda v: v.cast("double") * 100 + offset))
    darks = stack.stack(pixels(spark, d).where("label <> 3"), AT, "median").withColumn("value", F.col("stacked") * 50 + 3).withColumn("c", F.lit(0))
    cell = F.struct("y", "x", "value")
    master = darks.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(cell)), lambda p: p["value"]).alias("dark"))
    none = F.lit(None).cast("array<double>")
    rows = lights.join(master, "label", "left").withColumns({"flat": none, "bias": none})
    out = calibration.apply(rows, ["vec_id", "label", "h", "w", "ch"])
    px = stack.to_pixels(out, ["vec_id", "label", "dark_mode"])
    return px.select("vec_id", *AT, F.round("value", 5).alias("value"), "dark_mode")


# The planes of a colour image: px % 3 as channel.
RGB = """rgb AS (SELECT vec_id, label, i // 3 AS p, max(CASE WHEN i % 3 = 0 THEN v END) AS r, max(CASE WHEN i % 3 = 1 THEN v END) AS g, max(CASE WHEN i % 3 = 2 THEN v END) AS b
 FROM (SELECT vec_id, label, abs(unnest(embedding)::DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL)"""


def colours(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, p, r, g, b of absolute values."""
    e = read_table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    v = F.abs(F.col("v").cast("double"))
    c = F.col("i") % 3
    return e.groupBy("vec_id", "label", F.floor(F.col("i") / 3).alias("p")).agg(*[F.max(F.when(c == k, v)).alias(n) for k, n in enumerate("rgb")])


@query(f"""WITH {PX}, m AS (SELECT *, max(abs(v)) OVER (PARTITION BY vec_id) mx FROM px)
SELECT vec_id, y, x, round(greatest(CASE WHEN mx > 0 THEN asinh(abs(v) * 0.01) / asinh(mx * 0.01) * mx ELSE 0 END, 0), 6) AS asinh_value, round(CASE WHEN mx > 0 THEN abs(v) / mx ELSE 0 END, 6) AS linear_value FROM m""")
def asinh_display(spark: SparkSession, d: str) -> DataFrame:
    """Display stretch with the frame's maximum kept, and linear."""
    shown = tensors(spark, d).withColumn("data", F.transform("data", lambda v: F.abs(v.cast("double"))))
    asinh = T.stretch(shown, ["vec_id"], "asinh", 0.01)
    both = T.stretch(shown, ["vec_id"], "linear").withColumnRenamed("data", "linear").join(asinh.select("vec_id", F.col("data").alias("asinh")), "vec_id")
    cells = both.select("vec_id", "w", F.posexplode(F.arrays_zip("asinh", "linear")).alias("i", "v"))
    return cells.select("vec_id", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"), R6("v.asinh").alias("asinh_value"), R6("v.linear").alias("linear_value"))


@query(f"""WITH {PX}, m AS (SELECT *, median(v) OVER w AS m FROM px WINDOW w AS (PARTITION BY vec_id)), s AS (SELECT *, 1.4826 * median(abs(v - m)) OVER (PARTITION BY vec_id) AS mad FROM m),
 a AS (SELECT *, asinh(greatest(v - m, 0) / greatest(CASE WHEN mad > 0 THEN mad ELSE 1 END * 3.0, 1e-10)) AS a FROM s)
SELECT vec_id, y, x, round(CASE WHEN max(a) OVER (PARTITION BY vec_id) > 0 THEN a / max(a) OVER (PARTITION BY vec_id) ELSE a END, 6) AS value FROM a""")
def asinh_auto(spark: SparkSession, d: str) -> DataFrame:
    """Display stretch scaled by the frame's own noise."""
    out = stack.to_pixels(T.stretch(tensors(spark, d), ["vec_id"], "auto", k=3.0), ["vec_id"])
    return out.select("vec_id", "y", "x", R6("value").alias("value"))


@query(f"""WITH {RGB}, m AS (SELECT *, median(r) OVER w mr, median(g) OVER w mg, median(b) OVER w mb FROM rgb WINDOW w AS (PARTITION BY vec_id))
SELECT vec_id, p, round(greatest(r - mr, 0), 6) AS r, round(greatest(g - mg, 0), 6) AS g, round(greatest(b - mb, 0), 6) AS b FROM m""")
def background_neutral(spark: SparkSession, d: str) -> DataFrame:
    """Channels less their median."""
    # A row of 22 colour pixels, the last with one channel.
    none = F.array(*[F.lit(None).cast("double")] * 2)
    rgb = read_table(spark, d, "embeddings").select("vec_id", F.lit(1).alias("h"), F.lit(22).alias("w"), F.lit(3).alias("ch"), F.concat(F.transform("embedding", lambda v: F.abs(v.cast("double"))), none).alias("data"))
    px = stack.to_pixels(T.neutralise(rgb, ["vec_id"]), ["vec_id"], channels="ch")
    out = px.groupBy("vec_id", F.col("x").alias("p")).agg(*[F.max(F.when(F.col("c") == i, F.col("value"))).alias(n) for i, n in enumerate("rgb")])
    # A channel that is missing is shown as 0.
    return out.select("vec_id", "p", *[F.coalesce(R6(c), F.lit(0.0)).alias(c) for c in "rgb"])


@query(f"WITH {RGB} SELECT vec_id, p, round(r, 6) AS r, round(g - 0.5 * greatest(0, g - greatest(r, b)), 6) AS g, round(b, 6) AS b FROM rgb")
def scnr(spark: SparkSession, d: str) -> DataFrame:
    """Green reduced towards the greater of red and blue."""
    return colours(spark, d).select("vec_id", "p", R6("r").alias("r"), R6(image.scnr_green(F.col("r"), F.col("g"), F.col("b"), 0.5)).alias("g"), R6("b").alias("b"))


@query(f"""WITH {RGB}, h AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM rgb), f AS (SELECT *, CASE WHEN mx > mn THEN least(1.4 * (mx - mn) / mx, 1.0) / ((mx - mn) / mx) ELSE 1 END AS k FROM h)
SELECT vec_id, p, abs(round(mx - (mx - r) * k, 6)) AS r, abs(round(mx - (mx - g) * k, 6)) AS g, abs(round(mx - (mx - b) * k, 6)) AS b FROM f""")
def saturation(spark: SparkSession, d: str) -> DataFrame:
    """Saturation times 1.4, hue and value kept."""
    out = image.saturate(F.col("r"), F.col("g"), F.col("b"), 1.4)
    return colours(spark, d).select("vec_id", "p", out.alias("o")).select("vec_id", "p", *[F.abs(R6(f"o.{c}")).alias(c) for c in "rgb"])


@query(f"""WITH {PX} SELECT vec_id, y // 2 AS y, x // 2 AS x, round(max(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN v END), 6) AS r, round(avg(CASE WHEN (y + x) % 2 = 1 THEN v END), 6) AS g, round(max(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN v END), 6) AS b FROM px GROUP BY ALL""")
def superpixel(spark: SparkSession, d: str) -> DataFrame:
    """RGGB mosaic to half-size colour."""
    return image.superpixel(pixels(spark, d), ["vec_id"]).select("vec_id", "y", "x", *[R6(c).alias(c) for c in "rgb"])


def _reflect(c: str, o: int) -> str:
    e = f"({c} + {o})"
    return f"(CASE WHEN {e} < 0 THEN -{e} WHEN {e} > 7 THEN 14 - {e} ELSE {e} END)"


_OFF = [(a, b) for a in (-2, 0, 2) for b in (-2, 0, 2) if (a, b) != (0, 0)]
_NB = f"""{PX}, o AS (SELECT unnest([{', '.join(f'{{dy: {a}, dx: {b}}}' for a, b in _OFF)}]) AS o), s AS (SELECT vec_id, label, y, x, v, y + o.dy AS a, x + o.dx AS b FROM px, o),
 r AS (SELECT *, CASE WHEN a < 0 THEN -a WHEN a > 7 THEN 14 - a ELSE a END AS sy, CASE WHEN b < 0 THEN -b WHEN b > 7 THEN 14 - b ELSE b END AS sx FROM s),
 nb AS (SELECT r.vec_id, r.label, r.y, r.x, r.v, median(q.v) AS nm FROM r JOIN px q ON q.vec_id = r.vec_id AND q.y = r.sy AND q.x = r.sx GROUP BY ALL)"""


@query(f"WITH {_NB} SELECT vec_id, y, x, round(nm, 6) AS value FROM nb")
def neighbour_median(spark: SparkSession, d: str) -> DataFrame:
    """Median of the eight neighbours of the same colour."""
    out = kernels.per_frame(tensors(spark, d), ["vec_id"], "data array<double>", lambda i: {"data": kernels.flat(kernels.neighbour_median(i))})
    px = stack.to_pixels(out, ["vec_id"], "data", 8)
    return px.select("vec_id", "y", "x", R6("value").alias("value"))


_BAD = "bad AS (SELECT label, y, x, sum((v - nm > 0.3)::INT)::BIGINT AS hits FROM nb GROUP BY ALL HAVING sum((v - nm > 0.3)::INT) >= 3)"


@query(f"WITH {_NB}, {_BAD} SELECT * FROM bad")
def bad_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Positions that stand out of their neighbours in at least three frames of a group."""
    return image.bad_pixels(tensors(spark, d), "label", "vec_id", 8, 0.3, 3)


@query(f"""WITH {_NB}, {_BAD}, j AS (SELECT nb.*, bad.hits IS NOT NULL AS is_bad FROM nb LEFT JOIN bad ON nb.label = bad.label AND nb.y = bad.y AND nb.x = bad.x),
 s2 AS (SELECT j.vec_id, j.label, j.y, j.x, j.y + o.dy AS a, j.x + o.dx AS b FROM j, o WHERE is_bad),
 r2 AS (SELECT *, CASE WHEN a < 0 THEN -a WHEN a > 7 THEN 14 - a ELSE a END AS sy, CASE WHEN b < 0 THEN -b WHEN b > 7 THEN 14 - b ELSE b END AS sx FROM s2),
 f AS (SELECT r2.vec_id, r2.y, r2.x, count(CASE WHEN NOT q.is_bad THEN 1 END) AS good, median(CASE WHEN NOT q.is_bad THEN q.v END) AS gm, median(q.v) AS am FROM r2 JOIN j q ON q.vec_id = r2.vec_id AND q.y = r2.sy AND q.x = r2.sx GROUP BY ALL)
SELECT vec_id, y, x, good, round(CASE WHEN good >= 2 THEN gm ELSE am END, 6) AS value FROM f""")
def bad_pixel_fill(spark: SparkSession, d: str) -> DataFrame:
    """Bad pixels replaced by the median of their good neighbours of the same colour."""
    bad = image.bad_pixels(tensors(spark, d), "label", "vec_id", 8, 0.3, 3)
    out = image.fill_bad_pixels(tensors(spark, d), bad, "label", "vec_id")
    return out.select("vec_id", "y", "x", "good", R6("value").alias("value"))


@query(f"""WITH {PX}, m AS (SELECT *, median(v) OVER (PARTITION BY vec_id) AS m FROM px), s AS (SELECT *, 1.4826 * median(abs(v - m)) OVER (PARTITION BY vec_id) AS s FROM m),
 c AS (SELECT *, (s > 0 AND abs(v - m) > 2.5 * s) AS cand FROM s), o AS (SELECT unnest([-1, 0, 1]) AS dy), o2 AS (SELECT unnest([-1, 0, 1]) AS dx),
 n AS (SELECT c.vec_id, c.y, c.x, sum(q.cand::INT) AS near FROM c, o, o2 JOIN c q ON q.vec_id = c.vec_id AND q.y = (c.y + dy + 8) % 8 AND q.x = (c.x + dx + 8) % 8 GROUP BY ALL)
SELECT c.vec_id, c.y, c.x, round(CASE WHEN cand AND near <= 3 THEN m ELSE v END, 6) AS value FROM c JOIN n USING (vec_id, y, x)""")
def hot_pixel_clip(spark: SparkSession, d: str) -> DataFrame:
    """Isolated outliers set to the frame's median."""
    out = kernels.per_frame(tensors(spark, d), ["vec_id"], "data array<double>", lambda i: {"data": kernels.flat(kernels.hot_pixel_clip(i, 2.5))})
    return stack.to_pixels(out, ["vec_id"], "data", 8).select("vec_id", "y", "x", R6("value").alias("value"))


@query(f"""WITH {PX} SELECT a.vec_id, a.y, a.x, round(b.v, 6) AS value FROM px a JOIN px b ON a.vec_id = b.vec_id AND b.y = greatest(least(a.y - 2, 7), 0) AND b.x = greatest(least(a.x + 1, 7), 0)""")
def integer_shift(spark: SparkSession, d: str) -> DataFrame:
    """Frames moved by (2, -1); edges repeat."""
    return image.shift_pixels(pixels(spark, d), ["vec_id"], 2, -1, 8, 8).select("vec_id", "y", "x", R6("value").alias("value"))


_FLIPS = {
    "none": ("px.y", "px.x"), "vertical": ("7 - px.y", "px.x"), "horizontal": ("px.y", "7 - px.x"),
    "rotate_180": ("7 - px.y", "7 - px.x"), "transpose": ("px.x", "px.y"),
}


def _flip_sql() -> str:
    """Correlation of each frame with its group's mean under five flips."""
    parts = []
    for k, (name, (y, x)) in enumerate(_FLIPS.items()):
        parts.append(f"SELECT px.vec_id, {k} AS k, '{name}' AS flip, px.v AS a, r.v AS b FROM px JOIN r ON r.label = px.label AND r.y = {y} AND r.x = {x}")
    u = " UNION ALL ".join(parts)
    return f"""WITH {PX}, r AS (SELECT label, y, x, avg(v) AS v FROM px GROUP BY ALL), u AS ({u}),
 c AS (SELECT vec_id, k, flip, count(*) AS n, sum(a) sa, sum(b) sb, sum(a * a) saa, sum(b * b) sbb, sum(a * b) sab FROM u GROUP BY ALL),
 s AS (SELECT vec_id, k, flip, CASE WHEN n * saa - sa * sa > 1e-12 AND n * sbb - sb * sb > 1e-12 THEN (n * sab - sa * sb) / sqrt((n * saa - sa * sa) * (n * sbb - sb * sb)) ELSE 0 END AS ncc FROM c),
 t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(ncc, 9) DESC, k) AS rn, lead(ncc) OVER (PARTITION BY vec_id ORDER BY round(ncc, 9) DESC, k) AS nx FROM s)
 SELECT vec_id, flip, round(ncc, 6) AS ncc, round(ncc - nx, 6) AS gap FROM t WHERE rn = 1"""


@query(_flip_sql())
def flip_ncc(spark: SparkSession, d: str) -> DataFrame:
    """The flip under which a frame fits its group's mean best, and how clearly."""
    mean = pixels(spark, d).groupBy(*AT).agg(F.avg("value").alias("value"))
    ref = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "value"))), lambda p: p["value"]).alias("ref"))
    out = T.best_flip(T.with_reference(tensors(spark, d), ref, "label", "vec_id"), "vec_id")
    return out.select("vec_id", "flip", R6("ncc").alias("ncc"), R6("gap").alias("gap"))


@query(f"""WITH {PX}, q AS (SELECT vec_id, quantile_cont(v, 0.9) AS q FROM px GROUP BY vec_id) SELECT vec_id, count(*) AS n, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx FROM px JOIN q USING (vec_id) WHERE v >= q GROUP BY vec_id""")
def centroid(spark: SparkSession, d: str) -> DataFrame:
    """Centre of the brightest tenth of the pixels."""
    out = T.bright_centroid(tensors(spark, d), "vec_id", 0.9)
    return out.select("vec_id", "n", R6("cy").alias("cy"), R6("cx").alias("cx"))


@query(f"WITH {PX} SELECT vec_id, y // 2 AS cell_y, x // 2 AS cell_x, count(v) AS n, round(median(v), 6) AS value FROM px GROUP BY ALL")
def gradient_cells(spark: SparkSession, d: str) -> DataFrame:
    """Medians of 4 × 4 cells of a frame."""
    return image.cell_medians(pixels(spark, d), ["vec_id"], 2, 2).select("vec_id", "cell_y", "cell_x", "n", R6("value").alias("value"))


@query(f"""WITH {PX}, w AS (SELECT label, v, (y * 2 + (vec_id % 3) * 0.5) AS ty, (x * 2 + (vec_id % 2) * 0.5) AS tx FROM px), o AS (SELECT unnest([0, 1]) AS d), o2 AS (SELECT unnest([0, 1]) AS e),
 c AS (SELECT label, floor(ty)::INT + d AS oy, floor(tx)::INT + e AS ox, v, (CASE WHEN d = 0 THEN 1 - (ty - floor(ty)) ELSE ty - floor(ty) END) * (CASE WHEN e = 0 THEN 1 - (tx - floor(tx)) ELSE tx - floor(tx) END) AS w FROM w, o, o2)
SELECT label, oy, ox, round(sum(v * w) / sum(w), 6) AS value, round(sum(w), 6)::DOUBLE AS weight FROM c WHERE w > 1e-6 GROUP BY ALL""")
def drizzle_scatter(spark: SparkSession, d: str) -> DataFrame:
    """Pixels scattered onto a grid of twice the scale with sub-pixel shifts."""
    px = pixels(spark, d)
    out = image.drizzle(px, ["label"], 2.0, (F.col("vec_id") % 3) * 0.5, (F.col("vec_id") % 2) * 0.5)
    return out.select("label", "oy", "ox", R6("value").alias("value"), R6("weight").alias("weight"))


@query(f"""WITH {PX}, s AS (SELECT label, y, x, v, CASE WHEN y % 2 = 0 THEN CASE WHEN x % 2 = 0 THEN 'r' ELSE 'g' END ELSE CASE WHEN x % 2 = 0 THEN 'g' ELSE 'b' END END AS c FROM px), m AS (SELECT label, c, median(abs(v)) AS m FROM s GROUP BY ALL),
 p AS (SELECT label, max(CASE WHEN c = 'r' THEN m END) r, max(CASE WHEN c = 'g' THEN m END) g, max(CASE WHEN c = 'b' THEN m END) b FROM m GROUP BY label), e AS (SELECT label, CASE WHEN (r + b) / 2 < 1e-6 THEN 0 ELSE (g / ((r + b) / 2) - 1) * 100 END AS e FROM p)
SELECT label, round(e, 6) AS excess_percent, CASE WHEN e > 15 THEN 'FAIL' ELSE 'PASS' END AS status FROM e""")
def colour_excess(spark: SparkSession, d: str) -> DataFrame:
    """Green over the mean of red and blue, in per cent."""
    px = pixels(spark, d).withColumn("value", F.abs("value"))
    out = image.colour_excess(px, ["label"])
    return out.select("label", R6("excess_percent").alias("excess_percent"), "status")


@query(f"""WITH {RGB} SELECT vec_id, p, round(0.299 * r + 0.587 * g + 0.114 * b, 6) AS luma, round((r + g + b) / 3, 6) AS mono FROM rgb""")
def luminance_mono(spark: SparkSession, d: str) -> DataFrame:
    """Luminance and channel mean of every pixel; null where a channel is missing."""
    r, g, b = (F.col(c) for c in "rgb")
    return colours(spark, d).select("vec_id", "p", R6(image.luminance(r, g, b)).alias("luma"), R6((r + g + b) / 3).alias("mono"))


@query(f"WITH {PX} SELECT vec_id, y // 4 AS y, x // 4 AS x, round(v, 6) AS value FROM px WHERE y % 4 = 0 AND x % 4 = 0")
def downsample(spark: SparkSession, d: str) -> DataFrame:
    """Frames of at most two pixels a side by a stride, as checks on large products use them (the stride is the feature)."""
    out = image.downsample(pixels(spark, d), ["vec_id"], 8, 8, 2)
    return out.select("vec_id", "y", "x", R6("value").alias("value"))


@query(f"""WITH {PX}, b AS (SELECT vec_id, label, y, x, CASE WHEN vec_id % 7 = 0 AND y = 3 AND x = 3 THEN 'nan'::DOUBLE WHEN vec_id % 11 = 0 AND y = 0 AND x = 0 THEN NULL ELSE v END AS v FROM px),
 f AS (SELECT vec_id, label, count(CASE WHEN isfinite(v) THEN 1 END) = count(*) AS whole, median(CASE WHEN isfinite(v) THEN v END) AS m FROM b GROUP BY ALL), k AS (SELECT label, count(*) AS frames FROM f WHERE whole AND m <> 0 GROUP BY label HAVING count(*) >= 2)
SELECT label, frames FROM k""")
def non_finite_guard(spark: SparkSession, d: str) -> DataFrame:
    """Usable frames per group after dropping those with a missing or NaN pixel."""
    y, x, i = F.col("y"), F.col("x"), F.col("vec_id")
    v = F.when((i % 7 == 0) & (y == 3) & (x == 3), float("nan")).when((i % 11 == 0) & (y == 0) & (x == 0), F.lit(None)).otherwise(F.col("value"))
    ok = stack.usable_frames(pixels(spark, d).withColumn("value", v), "vec_id")
    return ok.groupBy("label").agg(F.count_distinct("vec_id").alias("frames")).where("frames >= 2")


@query(f"""WITH {PX}, g AS (SELECT label, v FROM px WHERE (y + x) % 2 = 1) SELECT label, round(quantile_cont(v, 0.95) - median(v), 6) AS signal FROM g GROUP BY label""")
def signal_score(spark: SparkSession, d: str) -> DataFrame:
    """Signal of the green samples of a group."""
    g = pixels(spark, d).where((F.col("y") + F.col("x")) % 2 == 1)
    v = robust.finite(F.col("value"))
    return g.groupBy("label").agg(R6(F.coalesce(F.percentile(v, 0.95) - F.median(v), F.lit(0.0))).alias("signal"))


@query(f"""WITH {PX}, k AS (SELECT unnest([{{dy: 0, dx: 0, w: 1.0}}, {{dy: -1, dx: 0, w: 0.25}}, {{dy: 1, dx: 0, w: 0.25}}, {{dy: 0, dx: -1, w: 0.25}}, {{dy: 0, dx: 1, w: 0.25}}]) AS k),
 j AS (SELECT a.vec_id, a.y, a.x, a.v AS own, b.v, k.w AS w, b.y AS by2, b.x AS bx FROM px a, k JOIN px b ON b.vec_id = a.vec_id AND b.y = a.y + k.dy AND b.x = a.x + k.dx)
SELECT vec_id, y, x, round(CASE WHEN (y + x) % 2 = 1 THEN max(own) ELSE sum(CASE WHEN (by2 + bx) % 2 = 1 THEN v * w END) / sum(CASE WHEN (by2 + bx) % 2 = 1 THEN w END) END, 6) AS green FROM j GROUP BY vec_id, y, x""")
def bilinear(spark: SparkSession, d: str) -> DataFrame:
    """Green plane of a bilinear demosaicing."""
    out = kernels.per_frame(tensors(spark, d), ["vec_id"], "data array<double>", lambda i: {"data": kernels.flat(kernels.bilinear(i)[:, :, 1])})
    return stack.to_pixels(out, ["vec_id"], "data", 8).select("vec_id", "y", "x", R6("value").alias("green"))


@query(f"""WITH {PX}, m AS (SELECT *, median(v) OVER (PARTITION BY vec_id) m FROM px), s AS (SELECT vec_id, label, 1.4826 * median(abs(v - m)) AS sigma, quantile_cont(v, 0.95) - max(m) AS signal FROM m GROUP BY ALL),
 r AS (SELECT vec_id, label, round(CASE WHEN sigma > 1e-12 THEN greatest(signal / sigma, 0) ELSE 0 END, 9) AS snr FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY snr DESC, vec_id) AS n, count(*) OVER (PARTITION BY label) AS c FROM r),
 kept AS (SELECT vec_id FROM k WHERE n <= CASE WHEN c - floor(c * 8.0 / 100.0) < 3 THEN c ELSE c - floor(c * 8.0 / 100.0) END) SELECT label, y, x, count(v) AS n, round(median(v), 6) AS stacked FROM px JOIN kept USING (vec_id) GROUP BY ALL""")
def select_and_stack(spark: SparkSession, d: str) -> DataFrame:
    """Median stack of the best 92 % of the frames of each group by signal-to-noise."""
    from ..operators import selection

    px = pixels(spark, d)
    stats = T.frame_stats(tensors(spark, d), "vec_id").join(read_table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    scored = stats.withColumn("score", F.round("snr", 9))
    kept = selection.percentile_keep(scored, "label", "score", "vec_id").where("keep").select("vec_id")
    out = stack.stack(px.join(kept, "vec_id", "left_semi"), AT, "median")
    return out.select(*AT, "n", R6("stacked").alias("stacked"))


# Kernels without a SQL form: tests hold them against known inputs.


def _kernel(name: str, doc: str, schema: str, fn) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return kernels.per_frame(tensors(spark, d), ["vec_id"], schema, fn)

    run.__name__, run.__doc__ = name, doc
    query()(run)


_kernel("gaussian_blur", "Frames blurred by sigma 1.5.", "data array<double>", lambda i: {"data": kernels.flat(kernels.gaussian_blur(i, 1.5))})
_kernel("malvar", "Gradient-corrected demosaicing.", "data array<double>", lambda i: {"data": kernels.flat(kernels.malvar(i))})
_kernel(
    "stars",
    "Stars of each frame.",
    "stars array<struct<x:double,y:double,flux:double,peak:double,fwhm_est:double>>",
    lambda i: {"stars": kernels.detect_stars(i, 2.0, 1.0, 1)},
)
_kernel(
    "gradient_fit",
    "Background polynomial of each frame.",
    "coefficients array<double>, cells_used int, rms double",
    lambda i: kernels.gradient_fit(i, 1, 4),
)
_kernel("structure_enhancement", "Unsharp mask between background and highlights.", "data array<double>", lambda i: {"data": kernels.flat(kernels.structure_enhancement(i))})


def _against_mean(spark: SparkSession, d: str, schema: str, fn) -> DataFrame:
    """Each frame against the mean frame of its group; means travel with the rows of a join."""
    mean = stack.to_tensors(pixels(spark, d).groupBy("label", "y", "x", "c").agg(F.avg("value").alias("value")), ["label"])
    both = tensors(spark, d).join(mean.select("label", F.col("data").alias("ref")), "label")
    return kernels.per_frame(both, ["vec_id"], schema, fn, ["ref"])


def _ref(ref, img):
    import numpy as np

    return np.asarray(ref, dtype=float).reshape(img.shape)


@query()
def phase_shift(spark: SparkSession, d: str) -> DataFrame:
    """Shift of each frame against its group's mean, by phase correlation."""
    return _against_mean(spark, d, "dy double, dx double", lambda i, r: dict(zip(("dy", "dx"), kernels.phase_shift(_ref(r, i), i))))


@query()
def upsampled_dft(spark: SparkSession, d: str) -> DataFrame:
    """The same to a tenth of a pixel."""
    return _against_mean(spark, d, "dy double, dx double", lambda i, r: dict(zip(("dy", "dx"), kernels.upsampled_shift(_ref(r, i), i))))


@query()
def grid_shift(spark: SparkSession, d: str) -> DataFrame:
    """Whole-pixel shift with the best correlation."""
    return _against_mean(spark, d, "dy int, dx int, r double", lambda i, r: dict(zip(("dy", "dx", "r"), kernels.grid_shift(_ref(r, i), i, 3))))


@query()
def rotation_fft(spark: SparkSession, d: str) -> DataFrame:
    """Rotation of each frame against its group's mean."""
    return _against_mean(spark, d, "rotation_deg double, r double", lambda i, r: dict(zip(("rotation_deg", "r"), kernels.rotation_between(_ref(r, i), i))))


