"""Pixel-wise and relational image operators in pixel form (frame keys, y, x, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import robust
from . import kernels


def scnr_green(r: Column, g: Column, b: Column, amount: float = 0.5) -> Column:
    return g - amount * F.greatest(F.lit(0.0), g - F.greatest(r, b))


def saturate(r: Column, g: Column, b: Column, factor: float) -> Column:
    """struct(r, g, b) with the HSV saturation times factor, at most 1; hue and value stay."""
    mx, mn = F.greatest(r, g, b), F.least(r, g, b)
    s = (mx - mn) / mx
    k = F.when(mx > mn, F.least(s * factor, F.lit(1.0)) / s).otherwise(1.0)
    return F.struct(*[(mx - (mx - c) * k).alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))])


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def superpixel(px: DataFrame, frame: list[str], value: str = "value") -> DataFrame:
    """RGGB mosaic to half size: frame, y, x, r, g, b."""
    py, qx = F.col("y") % 2, F.col("x") % 2
    v = F.col(value)
    return px.groupBy(*frame, F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(
        F.max(F.when((py == 0) & (qx == 0), v)).alias("r"), F.avg(F.when((py + qx) == 1, v)).alias("g"), F.max(F.when((py == 1) & (qx == 1), v)).alias("b")
    )


def bad_pixels(tensors: DataFrame, group: str | list[str], frame: str, width: int | str, threshold: float, n_frames: int) -> DataFrame:
    """group, y, x, hits: positions over their same-colour neighbours by more than threshold in n_frames frames.

    width: that of all frames, or a column among those of group. Only the
    exceeding positions leave a frame, so what is aggregated is sparse.
    """
    by = [group] if isinstance(group, str) else group
    w = F.col(width) if isinstance(width, str) else F.lit(width)

    def over(img):
        import numpy as np

        y, x = np.nonzero(img - kernels.neighbour_median(img) > threshold)
        return {"at": (y * img.shape[1] + x).tolist()}

    hot = kernels.per_frame(tensors, [frame, *by], "at array<int>", over).select(*by, F.explode("at").alias("__i"))
    hits = hot.groupBy(*by, "__i").agg(F.count("*").alias("hits")).where(F.col("hits") >= n_frames)
    return hits.select(*by, F.floor(F.col("__i") / w).cast("int").alias("y"), (F.col("__i") % w).alias("x"), "hits")


def fill_bad_pixels(tensors: DataFrame, bad: DataFrame, group: str, frame: str) -> DataFrame:
    """frame, y, x, good, value: bad pixels by the median of good same-colour neighbours, of all if fewer than two are good.

    bad has group, y, x; the bad positions of a group travel as one array.
    """
    where = bad.groupBy(group).agg(F.collect_list(F.struct("y", "x")).alias("__bad"))
    both = tensors.join(where, group)

    def fill(img, positions):
        import numpy as np

        mask = np.zeros(img.shape, bool)
        for p in positions:
            mask[p["y"], p["x"]] = True
        _, values, good = kernels.fill_bad(img, mask)
        y, x = np.nonzero(mask)
        return {"px": [{"y": int(a), "x": int(b), "good": int(g), "value": float(v)} for a, b, g, v in zip(y, x, good, values)]}

    got = kernels.per_frame(both, [frame], "px array<struct<y:int,x:int,good:bigint,value:double>>", fill, ["__bad"])
    return got.select(frame, F.explode("px").alias("p")).select(frame, "p.y", "p.x", "p.good", "p.value")


def shift_pixels(px: DataFrame, frame: list[str], dy: int, dx: int, h: int, w: int, value: str = "value") -> DataFrame:
    """Moved by whole pixels with repeated edges: a coordinate rewrite, no join.

    A pixel goes to its new place, those on the edge also to the places left empty.
    """

    def targets(c: str, d: int, n: int) -> Column:
        lo = F.when(F.col(c) == 0, F.lit(0)).otherwise(F.greatest(F.col(c) + d, F.lit(0)))
        hi = F.when(F.col(c) == n - 1, F.lit(n - 1)).otherwise(F.least(F.col(c) + d, F.lit(n - 1)))
        ok = (hi >= lo) & (F.col(c) + d <= n - 1 + F.when(F.col(c) == 0, F.lit(n)).otherwise(F.lit(0))) & (F.col(c) + d >= -F.when(F.col(c) == n - 1, F.lit(n)).otherwise(F.lit(0)))
        return F.when(ok, F.sequence(lo, hi))

    rows = px.select(*frame, value, targets("y", dy, h).alias("__y"), targets("x", dx, w).alias("__x"))
    return rows.select(*frame, value, F.explode("__y").alias("y"), "__x").select(*frame, value, "y", F.explode("__x").alias("x"))


def best_flip(px: DataFrame, ref: DataFrame, frame: str, group: str, h: int, w: int, value: str = "value") -> DataFrame:
    """frame, flip, ncc, gap: the flip of the frame that correlates best with the reference (group, y, x, ref).

    gap is the lead over the second best. For frames that exist as pixels only;
    tensors.best_flip needs no shuffle of pixels. All flips are tried in one join, as
    five places per pixel.
    """
    y, x = F.col("y"), F.col("x")
    flips = [("none", y, x), ("vertical", h - 1 - y, x), ("horizontal", y, w - 1 - x), ("rotate_180", h - 1 - y, w - 1 - x), ("transpose", x, y)]
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(n).alias("flip"), a.alias("y"), b.alias("x")) for i, (n, a, b) in enumerate(flips)]))
    rows = px.select(frame, group, F.col(value).alias("__v"), place.alias("p")).select(frame, group, "__v", "p.k", "p.flip", "p.y", "p.x")
    r = rows.join(ref, [group, "y", "x"]).groupBy(frame, "k", "flip").agg(robust.safe_corr(F.col("__v"), F.col("ref")).alias("ncc"))
    order = Window.partitionBy(frame).orderBy(F.round("ncc", 9).desc(), "k")
    top = r.select(frame, "flip", "ncc", F.row_number().over(order).alias("__n"), (F.col("ncc") - F.lead("ncc").over(order)).alias("gap"))
    return top.where("__n = 1").select(frame, "flip", "ncc", "gap")


def cell_medians(px: DataFrame, frame: list[str], cell_h: int, cell_w: int, value: str = "value") -> DataFrame:
    """frame, cell_y, cell_x, n, value."""
    cell = lambda c, n: F.floor(F.col(c) / n).cast("int")
    return px.groupBy(*frame, cell("y", cell_h).alias("cell_y"), cell("x", cell_w).alias("cell_x")).agg(F.count(value).alias("n"), F.median(value).alias(value))


def drizzle(px: DataFrame, group: list[str], scale: float, dy: Column, dx: Column, value: str = "value", least: float = 1e-6) -> DataFrame:
    """group, oy, ox, value, weight: pixels scattered onto a finer grid by their overlap.

    A pixel lands at scale·position + shift and is shared among the four cells
    around; map-side partial sums keep what is shuffled near the output's size.
    """
    ty, tx = F.col("y") * scale + dy, F.col("x") * scale + dx
    rows = px.select(*group, F.col(value).alias("__v"), ty.alias("ty"), tx.alias("tx"))
    cells = []
    for d in (0, 1):
        for e in (0, 1):
            fy, fx = F.col("ty") - F.floor("ty"), F.col("tx") - F.floor("tx")
            w = (fy if d else 1 - fy) * (fx if e else 1 - fx)
            cells.append(F.struct((F.floor("ty") + d).cast("int").alias("oy"), (F.floor("tx") + e).cast("int").alias("ox"), w.alias("w")))
    hit = rows.select(*group, "__v", F.explode(F.array(*cells)).alias("__cell"))
    hit = hit.select(*group, "__v", "__cell.oy", "__cell.ox", F.col("__cell.w").alias("__w")).where(F.col("__w") > least)
    return hit.groupBy(*group, "oy", "ox").agg((F.sum(F.col("__v") * F.col("__w")) / F.sum("__w")).alias("value"), F.sum("__w").alias("weight"))


def dither(frames: DataFrame, group: str, dy: str, dx: str, step: float = 0.5) -> DataFrame:
    """group, frames, phases, pixfrac: distinct shifts in half pixels, and the drop size they allow.

    Under four phases or ten frames drops are whole pixels, under 30 frames 0.7, else 0.5.
    """
    phase = [F.bround(F.col(c) / step) for c in (dy, dx)]
    out = frames.groupBy(group).agg(F.count("*").alias("frames"), F.count_distinct(F.struct(*phase)).alias("phases"))
    return out.withColumn("pixfrac", pixfrac_for(F.col("phases"), F.col("frames")))


def pixfrac_for(phases: Column, frames: Column) -> Column:
    return F.when((phases < 4) | (frames < 10), 1.0).when(frames < 30, 0.7).otherwise(0.5)


def expected_phases(frames: Column, exptime: Column) -> Column:
    """Phases that so many frames should show: one in ten frames from 60 s or of unknown exposure, else one in six; 0 without frames."""
    cadence = F.when(exptime < 60, 6).otherwise(10)
    return F.when(frames <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(frames / cadence))).cast("long")


def kernel_weight(d: Column, kind: str, reach: Column) -> Column:
    """Weight at a distance d: lanczos3 (of d), gaussian (of half the reach) or tophat (up to the reach)."""
    if kind == "lanczos3":
        x = F.lit(3.141592653589793) * d
        return F.when(F.abs(d) < 1e-9, 1.0).when(F.abs(d) < 3, 3 * F.sin(x) * F.sin(x / 3) / (x * x)).otherwise(0.0)
    if kind == "gaussian":
        return F.exp(-0.5 * F.pow(d / F.greatest(reach / 2, F.lit(1e-9)), F.lit(2.0)))
    if kind == "tophat":
        return F.when(F.abs(d) <= reach, 1.0).otherwise(0.0)
    raise ValueError(f"kernel {kind!r} is none of lanczos3, gaussian, tophat")


def drizzle_footprint(px: DataFrame, group: list[str], scale: float, dy: Column, dx: Column, pixfrac: Column, kernel: str = "tophat", value: str = "value", least: float = 1e-6) -> DataFrame:
    """group, oy, ox, value, weight: pixels scattered as drops of pixfrac times their size by a kernel.

    A pixel's centre lands at scale * position + shift; every cell whose centre is within
    half the drop (pixfrac * scale / 2, at least half a cell) of it in y and x gets the kernel's
    weight of both distances. Weights at or under `least`, negative lobes
    included, are dropped. Map-side partial sums keep what is shuffled near the output's size.
    """
    reach = F.greatest(pixfrac * scale / 2, F.lit(0.5))
    rows = px.select(*group, F.col(value).alias("__v"), (F.col("y") * scale + dy).alias("__ty"), (F.col("x") * scale + dx).alias("__tx"), reach.alias("__r"))

    def cells(t: str) -> Column:
        return F.sequence(F.ceil(F.col(t) - F.col("__r")).cast("int"), F.floor(F.col(t) + F.col("__r")).cast("int"))

    hit = rows.select("*", F.explode(cells("__ty")).alias("oy")).select("*", F.explode(cells("__tx")).alias("ox"))
    w = kernel_weight(F.col("oy") - F.col("__ty"), kernel, F.col("__r")) * kernel_weight(F.col("ox") - F.col("__tx"), kernel, F.col("__r"))
    hit = hit.select(*group, "oy", "ox", "__v", w.alias("__w")).where(F.col("__w") > least)
    return hit.groupBy(*group, "oy", "ox").agg((F.sum(F.col("__v") * F.col("__w")) / F.sum("__w")).alias("value"), F.sum("__w").alias("weight"))


def weight_stats(drizzled: DataFrame, group: str, channel: str) -> DataFrame:
    """group, weight_min, weight_median, hole_percent: holes are cells of the covered rectangle that no drop reached."""
    one = drizzled.groupBy(group, channel).agg(
        F.count("*").alias("__n"), ((F.max("oy") - F.min("oy") + 1).cast("long") * (F.max("ox") - F.min("ox") + 1)).alias("__all")
    )
    holes = one.groupBy(group).agg((100.0 * (1 - F.sum("__n") / F.sum("__all"))).alias("hole_percent"))
    return drizzled.groupBy(group).agg(F.min("weight").alias("weight_min"), F.median("weight").alias("weight_median")).join(holes, group)


def downsample(px: DataFrame, frame: list[str], h: int, w: int, most: int, value: str = "value") -> DataFrame:
    """frame, y, x, value of every k-th pixel, with the least k that leaves at most `most` a side; no shuffle."""
    k = max(1, -(-max(h, w) // most))
    at = px.where((F.col("y") % k == 0) & (F.col("x") % k == 0))
    return at.select(*frame, F.floor(F.col("y") / k).cast("int").alias("y"), F.floor(F.col("x") / k).cast("int").alias("x"), value)


def colour_excess(px: DataFrame, group: list[str], value: str = "value", fail_over: float = 15.0) -> DataFrame:
    """group, excess_percent, status: green of an RGGB mosaic over the mean of red and blue."""
    py, qx, v = F.col("y") % 2, F.col("x") % 2, F.col(value)
    m = px.groupBy(*group).agg(
        F.median(F.when((py == 0) & (qx == 0), v)).alias("r"), F.median(F.when(py != qx, v)).alias("g"), F.median(F.when((py == 1) & (qx == 1), v)).alias("b")
    )
    base = (F.col("r") + F.col("b")) / 2
    e = F.when(base < 1e-6, 0.0).otherwise((F.col("g") / F.when(base >= 1e-6, base) - 1) * 100)
    return m.select(*group, e.alias("excess_percent"), F.when(e > fail_over, "FAIL").otherwise("PASS").alias("status"))
