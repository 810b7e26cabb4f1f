"""The stages of image-stack processing as one lazy plan of DataFrames.

Tables: `frames` (frame_id, idx, group_hash, frame_type, filter_name, ...) and
`tensors` (frame_id, h, w, ch, data). Nothing runs until a result is used; each
stage adds its tables to the context, with decisions as columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import calibration, colour, groups, image, kernels, selection, stack, tensors
from .config import Params, resolve
from .steps import Context, FunctionStep, Registry, Result, run_steps


def discover(frames: DataFrame) -> DataFrame:
    """frames with group_hash; light frames that lack a mandatory column carry `missing`."""
    parts = [F.when(F.col(c).isNull(), c) for c in ("exptime", "gain", "object_name", "ccd_temp")]
    light = F.col("frame_type") == "light"
    return frames.withColumns(
        {
            "group_hash": keys.group_hash(F.col("exptime"), F.col("gain"), F.col("filter_name")),
            "missing": F.when(light, F.nullif(F.concat_ws(",", *parts), F.lit(""))),
        }
    )


def _images(c: Context) -> DataFrame:
    return c.tables["images"] if "images" in c.tables else c.tables["tensors"]


def _unregistered(c: Context, done: DataFrame) -> dict[str, DataFrame]:
    """done as the images and, before registration, as what drizzle scatters."""
    return {"images": done} if "registrations" in c.tables else {"images": done, "unregistered": done}


def _lights(c: Context) -> DataFrame:
    return c.tables["frames"].where("frame_type = 'light'").select("frame_id", "idx", "group_hash", "filter_name", "exptime")


#: Parts that the images of a group are split into where they meet one reference image, which is repeated for each.
SALTS = 32


def dark_tiers(c: Context) -> DataFrame:
    """group_hash, dark_id, tier of each light group: darks by exposure, gain and temperature, whatever the filter.

    Darks of the table `library` (frame_id, exptime, gain, ccd_temp) come after
    the frames' own. A group's temperature is the median of its lights'.
    """
    lights = c.tables["frames"].where("frame_type = 'light'")
    of_group = lights.groupBy("group_hash").agg(F.min("exptime").alias("exptime"), F.min("gain").alias("gain"), F.median("ccd_temp").alias("temp"))

    def darks(df: DataFrame) -> DataFrame:
        return df.select(F.col("frame_id").alias("dark_id"), "exptime", "gain", "ccd_temp")

    library = darks(c.tables["library"]) if "library" in c.tables else None
    return calibration.match_darks(of_group, darks(c.tables["frames"].where("frame_type = 'dark'")), library)


def calibrate(c: Context) -> dict[str, DataFrame]:
    """Lights less the master dark of their group, and bias and flat where the parameters ask for them.

    `dark_mode` tells how the dark was applied, `tier` of `dark_tiers` where it came from. A
    group without a dark gets none of another group. The bias is the mean of all bias
    frames, flats are averaged per filter and applied to lights of that filter.
    """
    p, frames, images = c.params.calibration, c.tables["frames"], c.tables["tensors"]
    size = ["h", "w", "ch"]
    rows = images.join(frames.where("frame_type = 'light'").select("frame_id", "group_hash", F.coalesce("filter_name", F.lit("")).alias("__f")), "frame_id")
    out = {}
    none = F.lit(None).cast("array<double>")
    if p.use_darks:
        tiers = dark_tiers(c)
        of = images.join(tiers.where("dark_id is not null").select(F.col("dark_id").alias("frame_id"), "group_hash"), "frame_id")
        rows = rows.join(calibration.master(of, ["group_hash"]).withColumnRenamed("data", "dark"), ["group_hash", *size], "left")
        out["dark_tiers"] = tiers.groupBy("group_hash", "tier").agg(F.count("dark_id").alias("darks"))
    else:
        rows = rows.withColumn("dark", none)
    if p.use_bias:
        of = images.join(frames.where("frame_type = 'bias'").select("frame_id"), "frame_id")
        rows = rows.join(calibration.master(of, [], "average").withColumnRenamed("data", "bias"), size, "left")
    else:
        rows = rows.withColumn("bias", none)
    if p.use_flats:
        flats = frames.where("frame_type = 'flat'").select("frame_id", F.coalesce("filter_name", F.lit("")).alias("__f"))
        enough = flats.groupBy("__f").agg(F.count("*").alias("n")).where("n >= 2").select("__f")
        of = images.join(flats.join(enough, "__f"), "frame_id")
        rows = rows.join(calibration.master(of, ["__f"], "average", "mul").withColumnRenamed("data", "flat"), ["__f", *size], "left")
    else:
        rows = rows.withColumn("flat", none)
    done = calibration.apply(rows, ["frame_id", *size])
    return _unregistered(c, done) | out


def cosmetic(c: Context) -> dict[str, DataFrame]:
    """Bad pixels of a group's one-channel lights interpolated from good neighbours; other lights stay.

    A position is bad if it exceeds its neighbours in n_frames frames of the group and one size while the
    group's master dark is normal there: under its median plus dark_tolerance. Fewer than n_frames such frames stay as they are.
    """
    p = c.params.cosmetic
    if not p.enabled:
        return {}
    rows = _images(c).join(_lights(c).select("frame_id", "group_hash"), "frame_id")
    like = ["group_hash", "h", "w"]
    bad = image.bad_pixels(rows.where("ch = 1"), like, "frame_id", "w", p.threshold, p.n_frames)
    if "dark_tiers" in c.tables:
        of = c.tables["tensors"].where("ch = 1").join(dark_tiers(c).where("dark_id is not null").select(F.col("dark_id").alias("frame_id"), "group_hash"), "frame_id")
        dark = calibration.master(of, ["group_hash"])

        def bright(img):
            y, x = np.nonzero(img >= np.median(img) + p.dark_tolerance)
            return {"at": [{"y": int(a), "x": int(b)} for a, b in zip(y, x)]}

        known = kernels.per_frame(dark, like, "at array<struct<y:int,x:int>>", bright).select(*like, F.explode("at").alias("p"))
        bad = bad.join(known.select(*like, "p.y", "p.x"), [*like, "y", "x"], "left_anti")
    where = bad.groupBy(*like).agg(F.collect_list(F.struct("y", "x")).alias("bad"))

    def fix(img, positions):
        if positions is None or img.ndim == 3:
            return {"data": kernels.flat(img), "fixed": 0}
        mask = np.zeros(img.shape, dtype=bool)
        for q in positions:
            mask[q["y"], q["x"]] = True
        return {"data": kernels.flat(kernels.fill_bad(img, mask)[0]), "fixed": len(positions)}

    done = kernels.per_frame(rows.join(where, like, "left"), ["frame_id", "h", "w", "ch"], "data array<double>, fixed int", fix, ["bad"])
    return {**_unregistered(c, done.drop("fixed")), "bad_pixels": bad, "interpolated": done.select("frame_id", "fixed")}


#: Demosaicing by debayer.method: superpixel halves the sides, the others keep them.
DEBAYER = {"superpixel": lambda img, pattern: kernels.superpixel(img), "bilinear": kernels.bilinear, "malvar": kernels.malvar}


def debayer(c: Context) -> dict[str, DataFrame]:
    """Mosaics of one channel to colour; other images, and odd sides under superpixel, stay."""
    p = c.params.debayer
    if p.method not in DEBAYER:
        raise ValueError(f"debayer.method {p.method!r} is none of {', '.join(DEBAYER)}")
    rows = _images(c)

    def one(img):
        if img.ndim == 3 or (p.method == "superpixel" and (img.shape[0] % 2 or img.shape[1] % 2)):
            a = img if img.ndim == 3 else img[:, :, None]
        else:
            a = DEBAYER[p.method](img, p.pattern)
        return {"nh": a.shape[0], "nw": a.shape[1], "nch": a.shape[2], "data": kernels.flat(a)}

    out = kernels.per_frame(rows, ["frame_id"], "nh int, nw int, nch int, data array<double>", one)
    return {"images": out.select("frame_id", F.col("nh").alias("h"), F.col("nw").alias("w"), F.col("nch").alias("ch"), "data")}


def _grid(ref: np.ndarray, img: np.ndarray) -> tuple[float, float]:
    return tuple(map(float, kernels.grid_shift(ref, img)[:2]))


SHIFTS = {"fft": kernels.phase_shift, "rotation_fft": kernels.phase_shift, "upsampled_fft": kernels.upsampled_shift, "grid": _grid, "stars": _grid}


def _shift(method: str):
    """The function that measures a shift by registration.method."""
    if method not in SHIFTS:
        raise ValueError(f"registration.method {method!r} is none of {', '.join(SHIFTS)}")
    return SHIFTS[method]


def align(ref: np.ndarray, img: np.ndarray, p) -> dict:
    """dy, dx, rotation_deg, scale, corr_hp, points and the way (`shift` or `stars`) that img goes onto ref.

    Correlations are those of the high-passed images. The method's shift is
    always measured. `rotation_fft` adds a rotation. `stars` matches star
    triangles too and takes them if they correlate at most 0.05 worse and stay
    within the rotation and scale allowed.
    """
    ha, hb = (x - kernels.gaussian_blur(x, p.high_pass) for x in (ref, img))
    dy, dx = SHIFTS[p.method](ha, hb)
    rot = kernels.rotation_between(ha, hb, p.max_rotation_deg)[0] if p.method == "rotation_fft" else 0.0
    if rot:
        dy, dx = SHIFTS[p.method](ha, kernels.transform(hb, rotation_deg=rot))
    best = {"dy": dy, "dx": dx, "rotation_deg": rot, "scale": 1.0, "corr_hp": kernels.pearson(ha, kernels.transform(hb, dy, dx, rot)), "points": None, "way": "shift"}
    if p.method == "stars" and (m := kernels.match_triangles(kernels.detect_stars(img), kernels.detect_stars(ref))):
        # The similarity turns about the origin, transform about the centre.
        c = complex((img.shape[1] - 1) / 2, (img.shape[0] - 1) / 2)
        turn = m["scale"] * np.exp(1j * np.radians(m["rotation_deg"]))
        off = turn * c + complex(m["dx"], m["dy"]) - c
        corr = kernels.pearson(ha, kernels.transform(hb, off.imag, off.real, m["rotation_deg"], m["scale"]))
        if abs(m["rotation_deg"]) <= p.max_rotation_deg and abs(m["scale"] - 1) <= p.max_scale_dev and corr >= best["corr_hp"] - 0.05:
            best = {"dy": off.imag, "dx": off.real, "rotation_deg": m["rotation_deg"], "scale": m["scale"], "corr_hp": corr, "points": m["points"], "way": "stars"}
    return best | {"plain": kernels.pearson(ha, hb)}


def _moved(img: np.ndarray, m: dict) -> np.ndarray:
    planes = img[:, :, None] if img.ndim == 2 else img
    return np.dstack([kernels.transform(planes[:, :, k], m["dy"], m["dx"], m["rotation_deg"], m["scale"]) for k in range(planes.shape[2])])


def _mono(x: np.ndarray) -> np.ndarray:
    return x.mean(axis=2) if x.ndim == 3 else x


def register(c: Context) -> dict[str, DataFrame]:
    """Each light aligned to its group's first frame; weak correlations give no shift.

    A group's images are split by salt, and its reference is repeated for each
    part, so that a large group spans many tasks. Only ids are aggregated to find
    the references.
    """
    p = c.params.registration
    _shift(p.method)
    rows = _images(c).join(_lights(c).select("frame_id", "idx", "group_hash"), "frame_id")
    ids = rows.groupBy("group_hash").agg(F.min_by("frame_id", F.struct("idx", "frame_id")).alias("frame_id"))
    first = _images(c).join(ids, "frame_id").select("group_hash", F.col("data").alias("ref"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("frame_id"), F.lit(SALTS)).cast("int"))

    def one(img, ref):
        r = np.asarray(ref, dtype=float)
        none = {"dy": 0.0, "dx": 0.0, "rotation_deg": 0.0, "scale": 1.0, "points": None}
        if r.size != img.size:
            return {"data": kernels.flat(img), "dy": None, "dx": None, "rotation_deg": None, "scale": None, "corr_hp": None, "points": None, "status": "rejected"}
        m = align(_mono(r.reshape(img.shape)), _mono(img), p)
        if m["corr_hp"] < p.zero_shift_below or abs(m["rotation_deg"]) > p.max_rotation_deg:
            return none | {"data": kernels.flat(img), "corr_hp": m["plain"], "status": "zero_shift"}
        return {k: m[k] for k in ("dy", "dx", "rotation_deg", "scale", "corr_hp", "points")} | {"data": kernels.flat(_moved(img, m)), "status": "ok"}

    schema = "data array<double>, dy double, dx double, rotation_deg double, scale double, corr_hp double, points int, status string"
    done = kernels.per_frame(rows.join(first, ["group_hash", "salt"]), ["frame_id", "group_hash", "idx", "h", "w", "ch"], schema, one, ["ref"])
    return {"images": done.select("frame_id", "h", "w", "ch", "data"), "registrations": done.drop("data")}


def measure(c: Context) -> DataFrame:
    """Quality of each registered light: snr, stars, fwhm, elongation, noise."""
    reg = c.tables["registrations"].select("frame_id", "group_hash", "idx", F.col("corr_hp").alias("correlation"))

    def one(img):
        a = img.mean(axis=2) if img.ndim == 3 else img
        if not np.isfinite(a).all():
            return {"snr": 0.0, "star_count": 0, "fwhm_median": None, "elongation_ratio": None, "noise_sigma": None}
        stars = kernels.detect_stars(a)
        med = np.median(a)
        s = kernels.MAD_SCALE * np.median(np.abs(a - med))
        snr = max((np.percentile(a, 95) - med) / s, 0.0) if s > 1e-12 else 0.0
        fwhm = float(np.median([x["fwhm_est"] for x in stars])) if len(stars) >= 3 else None
        return {"snr": float(snr), "star_count": len(stars), "fwhm_median": fwhm, "elongation_ratio": kernels.elongation(a, stars), "noise_sigma": float(s)}

    schema = "snr double, star_count int, fwhm_median double, elongation_ratio double, noise_sigma double"
    q = kernels.per_frame(c.tables["images"], ["frame_id"], schema, one)
    extra = {"double_rate": F.lit(None).cast("double"), "elongation_unusable": F.coalesce(F.col("elongation_ratio") < 0.6, F.lit(False))}
    return q.join(reg, "frame_id").withColumns(extra)


def select(c: Context) -> dict[str, DataFrame]:
    p = c.params.selection
    q = measure(c)
    if not p.enabled:
        return {"quality": q, "selected": q.select("frame_id", "group_hash")}
    out = selection.funnel(q, "group_hash", "idx", p.bounds, p.keep_percent, p.min_frames, p.min_correlation or -1.0)
    return {"quality": out, "selected": out.where("decision = 'kept'").select("frame_id", "group_hash")}


def stack_groups(c: Context) -> dict[str, DataFrame]:
    """One image per group of at least two usable frames."""
    p = c.params.stacking
    chosen = c.tables.get("selected", _lights(c).select("frame_id", "group_hash"))
    even = tensors.normalise(_images(c).join(chosen, "frame_id"), ["frame_id", "group_hash"], p.normalise)
    good = even.where("whole" if p.normalise != "mul" else "whole and median <> 0")
    norm = stack.to_pixels(good, ["frame_id", "group_hash"], channels="ch")
    enough = good.select("frame_id", "group_hash").distinct().groupBy("group_hash").agg(F.count("*").alias("frame_count")).where("frame_count >= 2")
    chosen_lights = chosen.join(_lights(c).select("frame_id", "exptime", "filter_name"), "frame_id")
    exposure = chosen_lights.groupBy("group_hash").agg(F.sum("exptime").alias("total_exposure"), F.min("filter_name").alias("filter"))
    enough = enough.join(exposure, "group_hash", "left")
    out = stack.stack(norm.join(enough.select("group_hash"), "group_hash", "left_semi"), ["group_hash", "y", "x", "c"], p.method)
    return {"stacks": out.select("group_hash", "y", "x", "c", "n", F.col("stacked").alias("value")), "groups": enough}


def gradient(c: Context) -> dict[str, DataFrame]:
    """Stacks less their background polynomial; a fit that fails leaves the stack as it is."""
    p = c.params.gradient
    if not p.enabled:
        return {}
    t = stack.to_tensors(c.tables["stacks"], ["group_hash"])

    def one(img):
        mono = img.mean(axis=2) if img.ndim == 3 else img
        fit = kernels.gradient_fit(mono, p.degree, min(p.cells, *mono.shape), p.sigma)
        if fit["coefficients"] is None:
            return {"data": kernels.flat(img), "status": "skipped"}
        model = kernels.gradient_model(mono.shape, fit["coefficients"], p.degree)
        base = np.median(mono)
        planes = img[:, :, None] if img.ndim == 2 else img
        out = [np.maximum(planes[:, :, k] - (model - model.mean()) * (np.median(planes[:, :, k]) / base if abs(base) > 1e-12 else 1.0), 0) for k in range(planes.shape[2])]
        return {"data": kernels.flat(np.dstack(out)), "status": "ok"}

    done = kernels.per_frame(t, ["group_hash", "w", "ch"], "data array<double>, status string", one)
    return {"stacks": stack.to_pixels(done, ["group_hash"], channels="ch"), "gradients": done.select("group_hash", "status")}


def colour_step(c: Context) -> dict[str, DataFrame]:
    """Colour stacks calibrated against catalogues: stars measured, placed on the sky, matched, and the factors applied.

    The tables named in colour.sources (entry, ra, dec, mag_r, mag_g, mag_b) are tried in order; the first whose
    factors are plausible counts, an implausible one ends the search. `wcs` has
    group_hash, ra0, dec0 (degrees of the centre) and scale (arc seconds a pixel). Groups
    without factors take the fallback: gray_world, skip (left as they are) or fail.
    `colour` has source, factors and status per group.
    """
    p = c.params.colour
    if not p.enabled:
        return {}
    if p.fallback not in ("gray_world", "skip", "fail"):
        raise ValueError(f"colour.fallback {p.fallback!r} is none of gray_world, skip, fail")
    t = stack.to_tensors(c.tables["stacks"], ["group_hash"]).where("ch = 3")
    every = t.select("group_hash")
    attempts = []
    sources = [s for s in p.sources if s in c.tables]
    if "wcs" in c.tables and sources:
        found = kernels.per_frame(t, ["group_hash", "h", "w"], "stars array<struct<x:double,y:double,r:double,g:double,b:double>>", lambda img: {"stars": kernels.photometry(img, min_stars=p.min_stars)})
        each = found.select("group_hash", "h", "w", F.posexplode("stars").alias("i", "s")).join(c.tables["wcs"], "group_hash")
        ra, dec = colour.pixel_to_sky(F.col("s.x"), F.col("s.y"), F.col("w"), F.col("h"), F.col("ra0"), F.col("dec0"), F.col("scale"))
        stars = each.select("group_hash", F.concat_ws(" ", "group_hash", "i").alias("star"), ra.alias("ra"), dec.alias("dec"), "s.r", "s.g", "s.b")
        attempts = [(s, colour.channel_factors(stars, c.tables[s], "group_hash", p.radius_arcsec / 3600, p.min_stars, p.low, p.high)) for s in sources]
    if attempts:
        chosen = colour.first_success(attempts, "group_hash", every, p.fallback)
    else:
        none = F.lit(None).cast("double")
        chosen = every.select("group_hash", F.lit(p.fallback).alias("source"), none.alias("r_factor"), none.alias("b_factor"), F.lit("no_catalogue").alias("status"))
    if p.fallback == "fail":
        chosen = chosen.withColumn("status", F.when(F.col("source") == "fail", F.raise_error(F.concat(F.lit("no colour factors for "), "group_hash"))).otherwise(F.col("status")))
    gray = colour.gray_world(c.tables["stacks"], "group_hash").withColumnRenamed("factor", "__gray")
    rows = c.tables["stacks"].join(chosen, "group_hash", "left").join(gray, ["group_hash", "c"], "left")
    own = F.when(F.col("c") == 0, F.col("r_factor")).when(F.col("c") == 2, F.col("b_factor"))
    factor = F.coalesce(own, F.when((F.col("source") == "gray_world") & F.col("r_factor").isNull(), F.col("__gray")), F.lit(1.0))
    return {"stacks": rows.select(*c.tables["stacks"].columns[:-1], (F.col("value") * factor).alias("value")), "colour": chosen}


def drizzle_groups(c: Context) -> dict[str, DataFrame]:
    """Stacks by scattering each registered frame onto a finer grid; groups under min_frames are left to the other path.

    The frames are those selected, as they were before debayering and
    registration; shifts measured on another size are scaled to theirs. Pixels
    of a mosaic that was registered in colour go to their own colour's channel.
    Where quality was measured and the gate is on, frames with fewer than
    min_stars stars are left out, unless no frame of the group has so many: stars say nothing there.
    The kernel `point` shares a pixel among the four cells around its place; lanczos3, gaussian and
    tophat spread drops of the pixfrac, which follows from the phases and frames of a group where none is given.
    `drizzle_groups` has it, and why a group was left out.
    """
    p = c.params.drizzle
    if not p.enabled:
        return {}
    reg = c.tables["registrations"].where("status = 'ok'")
    if "selected" in c.tables:
        reg = reg.join(c.tables["selected"].select("frame_id"), "frame_id", "left_semi")
    if p.gate and "quality" in c.tables:
        enough_stars = F.max("star_count").over(Window.partitionBy("group_hash")) >= p.min_stars
        starless = c.tables["quality"].select("frame_id", "star_count", enough_stars.alias("judged")).where(F.col("judged") & (F.col("star_count") < p.min_stars))
        reg = reg.join(starless.select("frame_id"), "frame_id", "left_anti")
    reg = reg.select("frame_id", "group_hash", F.col("h").alias("rh"), F.col("w").alias("rw"), F.col("ch").alias("rch"), "dy", "dx")
    source = c.tables.get("unregistered", c.tables["tensors"]).join(reg, "frame_id")
    source = source.withColumns({"dy": F.col("dy") * F.col("h") / F.col("rh"), "dx": F.col("dx") * F.col("w") / F.col("rw"), "mosaic": (F.col("ch") == 1) & (F.col("rch") == 3)})
    facts = image.dither(source, "group_hash", "dy", "dx")
    given = F.lit(p.pixfrac).cast("double") if p.pixfrac is not None else F.col("pixfrac")
    facts = facts.withColumns({"pixfrac": given, "reason": F.when(F.col("frames") < p.min_frames, "too_few_frames")})
    source = source.join(facts.where("reason is null").select("group_hash", "pixfrac"), "group_hash")
    px = stack.to_pixels(source, ["group_hash", "dy", "dx", "mosaic", "pixfrac"], channels="ch")
    # RGGB: red where both coordinates are even, blue where both are odd.
    px = px.withColumn("c", F.when(F.col("mosaic"), F.col("y") % 2 + F.col("x") % 2).otherwise(F.col("c")))
    if p.kernel == "point":
        out = image.drizzle(px, ["group_hash", "c"], p.scale, F.col("dy") * p.scale, F.col("dx") * p.scale)
    else:
        out = image.drizzle_footprint(px, ["group_hash", "c"], p.scale, F.col("dy") * p.scale, F.col("dx") * p.scale, F.col("pixfrac"), p.kernel)
    stats = image.weight_stats(out, "group_hash", "c")
    return {
        "drizzled": out.select("group_hash", F.col("oy").alias("y"), F.col("ox").alias("x"), "c", "value", "weight"),
        "drizzle_stats": stats.join(facts.select("group_hash", "phases"), "group_hash"),
        "drizzle_groups": facts,
    }


def _groups(c: Context) -> DataFrame:
    """The groups with what the choice of a reference and the gate look at; unknown facts are null."""
    g = c.tables["groups"]
    if "registrations" in c.tables:
        reg = c.tables["registrations"].groupBy("group_hash").agg(
            F.count("*").alias("frames_registered"), F.count(F.when(F.col("status") == "zero_shift", 1)).alias("zero_shift_count"), F.median("corr_hp").alias("corr_hp_median"),
            *([F.median("points").cast("double").alias("n_cp_median")] if "points" in c.tables["registrations"].columns else []),
        )
        g = g.join(reg, "group_hash", "left")
    for name, kind in (("frames_registered", "long"), ("zero_shift_count", "long"), ("corr_hp_median", "double"), ("n_cp_median", "double"), ("filter", "string"), ("total_exposure", "double")):
        if name not in g.columns:
            g = g.withColumn(name, F.lit(None).cast(kind))
    return g


def reference(c: Context) -> DataFrame:
    """group_hash, method of the reference group by merge.reference: quality, signal, largest or a group's own hash.

    What can't be decided by quality or isn't a group falls back to the largest; ties go to the lesser hash.
    """
    if "reference" in c.tables:
        return c.tables["reference"]
    how, g = c.params.merge.reference, _groups(c)
    largest = g.agg(F.max_by("group_hash", F.struct("frame_count", F.expr("transform(split(group_hash, ''), x -> -ascii(x))"))).alias("group_hash"), F.lit("largest").alias("method"))
    if how == "quality":
        best = groups.reference_by_quality(g, "group_hash")
    elif how == "signal":
        top = c.tables["stacks"].groupBy("group_hash").agg((F.percentile("value", 0.95) - F.median("value")).alias("score"))
        rated = g.join(top, "group_hash")
        best = rated.where("frame_count >= 3 and score > 0").agg(F.max_by("group_hash", F.struct("score", "group_hash")).alias("group_hash"), F.lit("signal").alias("method"))
    else:
        best = g.where(F.col("group_hash") == how).agg(F.max("group_hash").alias("group_hash"), F.lit("explicit").alias("method"))
    # One row each.
    both = best.select(F.struct(F.col("group_hash").isNotNull().alias("ok"), F.col("group_hash"), F.col("method")).alias("r")).unionByName(
        largest.select(F.struct(F.lit(False).alias("ok"), F.col("group_hash"), F.col("method")).alias("r"))
    )
    rank = F.struct(F.col("r.ok"), F.col("r.group_hash").isNotNull())
    return both.agg(F.max_by("r", rank).alias("r")).select("r.group_hash", "r.method")


def cross_register(c: Context) -> dict[str, DataFrame]:
    """Group stacks aligned to the reference group's; a shift over a quarter of the picture counts as none.

    A rotation is applied only where it beats the plain shift by 0.02 in correlation.
    """
    p = c.params.registration
    _shift(p.method)
    ref = reference(c)
    t = stack.to_tensors(c.tables["stacks"], ["group_hash"])
    base = t.join(F.broadcast(ref.select("group_hash")), "group_hash", "left_semi").select(F.col("data").alias("ref"), F.col("h").alias("rh"), F.col("w").alias("rw"))
    rows = t.crossJoin(base)  # one row: the reference picture travels to each group

    def one(img, r, rh, rw):
        a = np.asarray(r, dtype=float)
        if a.size != img.size:
            return {"data": kernels.flat(img), "dy": None, "dx": None, "rotation_deg": None, "corr_hp": None, "n_control_points": None, "ok": False}
        x, y = _mono(a.reshape(img.shape)), _mono(img)
        m = align(x, y, p)
        if m["way"] == "shift":
            hx, hy = (v - kernels.gaussian_blur(v, p.high_pass) for v in (x, y))
            if max(abs(m["dy"]), abs(m["dx"])) > max(x.shape) / 4:
                m |= {"dy": 0.0, "dx": 0.0}
            straight = kernels.pearson(hx, kernels.transform(hy, m["dy"], m["dx"]))
            turned = kernels.pearson(hx, kernels.transform(hy, m["dy"], m["dx"], m["rotation_deg"])) if m["rotation_deg"] else straight
            m |= {"corr_hp": turned} if turned > straight + 0.02 else {"corr_hp": straight, "rotation_deg": 0.0}
        out = {k: m[k] for k in ("dy", "dx", "rotation_deg", "corr_hp")}
        return out | {"data": kernels.flat(_moved(img, m)), "n_control_points": m["points"], "ok": bool(m["corr_hp"] >= 0.3)}

    schema = "data array<double>, dy double, dx double, rotation_deg double, corr_hp double, n_control_points int, ok boolean"
    done = kernels.per_frame(rows, ["group_hash", "w", "ch"], schema, one, ["ref", "rh", "rw"])
    return {"stacks": stack.to_pixels(done, ["group_hash"], channels="ch"), "cross_group": done.drop("data", "w", "ch"), "reference": ref}


def merge(c: Context) -> dict[str, DataFrame]:
    """The weighted merge of the groups that pass the gate against the reference; the others are in `merge_skipped`.

    merge.weight: frame_count, or total_exposure (frame_count where it is unknown). `merge_stats` has one row:
    groups merged and skipped, the part of the integration that is lost with the
    skipped ones, and the merged image's minimum, maximum, mean and median.
    """
    p, g, ref = c.params.merge, _groups(c), reference(c)
    if p.weight not in ("frame_count", "total_exposure"):
        raise ValueError(f"merge.weight {p.weight!r} is neither frame_count nor total_exposure")
    out = {"reference": ref}
    if "cross_group" in c.tables:
        cross = c.tables["cross_group"]
        known = {"corr_hp": "double", "corr_roh": "double", "n_control_points": "int", "eqmode_majority": "int", "rotation_deg": "double", "ok": "boolean"}
        facts = [F.col(n) if n in cross.columns else F.lit(None).cast(t).alias(n) for n, t in known.items()]
        gated = groups.cross_group_gate(g.join(cross.select("group_hash", *facts), "group_hash", "left"), "group_hash", ref, p.min_correlation)
        lost = F.when(F.col("corr_hp").isNull(), "other_size").when(~F.coalesce("ok", F.lit(False)), "low_corr_hp")
        own = F.col("group_hash") == F.col("__ref")
        judged = gated.crossJoin(F.broadcast(ref.select(F.col("group_hash").alias("__ref"))))  # one row
        reason = F.when(F.col("skip"), F.col("reasons")).when(~own, lost)
        skipped = judged.select("group_hash", reason.alias("reason")).where("reason is not null")
    else:
        skipped = g.select("group_hash", F.lit(None).cast("string").alias("reason")).where("reason is not null")
    out["merge_skipped"] = skipped
    weight = F.coalesce("total_exposure", "frame_count", F.lit(1)) if p.weight == "total_exposure" else F.coalesce("frame_count", F.lit(1))
    use = g.join(skipped, "group_hash", "left_anti").select("group_hash", weight.cast("double").alias("__w"))
    merged = stack.merge(c.tables["stacks"].join(use, "group_hash"), ["y", "x", "c"], "value", "__w", p.method)
    amount = F.coalesce("total_exposure", F.lit(0.0)).alias("e"), F.coalesce("frame_count", F.lit(0)).cast("double").alias("n")
    parts = g.join(skipped, "group_hash", "left").select(*amount, F.col("reason").isNull().alias("kept"))
    total = F.when(F.sum("e") > 0, F.sum("e")).otherwise(F.sum("n"))
    kept = F.when(F.sum("e") > 0, F.sum(F.when(F.col("kept"), F.col("e")))).otherwise(F.sum(F.when(F.col("kept"), F.col("n"))))
    integration = parts.agg(
        F.count_if("kept").alias("groups_merged"), F.count_if(~F.col("kept")).alias("groups_skipped"),
        F.when(total > 0, F.round((1 - F.coalesce(kept, F.lit(0.0)) / total) * 100, 1)).alias("integration_lost_percent"),
    )
    figures = merged.agg(*[f("merged").alias(n) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("median", F.median))])
    return out | {"merged": merged, "merge_stats": integration.crossJoin(figures)}  # one row each


def display(c: Context) -> dict[str, DataFrame]:
    """The merged image as shown: y, x and r, g, b in 0..1; one channel is shown as grey.

    Background neutralised, stretched (asinh, linear or none), green noise
    suppressed and saturated by the parameters, in this order.
    """
    p = c.params.display
    if p.stretch not in ("asinh", "linear", "none"):
        raise ValueError(f"display.stretch {p.stretch!r} is none of asinh, linear, none")
    if "merged" not in c.tables:
        return {}
    v = F.col("merged")
    rgb = c.tables["merged"].groupBy("y", "x").agg(*[F.coalesce(F.max(F.when(F.col("c") == i, v)), F.max(F.when(F.col("c") == 0, v))).alias(n) for i, n in enumerate("rgb")])
    if p.neutralise:
        levels = rgb.agg(*[F.median(n).alias(f"__{n}") for n in "rgb"])
        rgb = rgb.crossJoin(levels).select("y", "x", *[F.greatest(F.col(n) - F.col(f"__{n}"), F.lit(0.0)).alias(n) for n in "rgb"])  # one row
    top = rgb.agg(*[F.max(n).alias(f"__{n}") for n in "rgb"])
    rgb = rgb.crossJoin(top)  # one row
    m = F.greatest(*[F.col(f"__{n}") for n in "rgb"])
    if p.stretch != "none":
        shown = {n: F.when(m > 0, F.asinh(F.col(n) * p.a) / F.asinh(m * p.a) if p.stretch == "asinh" else F.col(n) / m).otherwise(0.0) for n in "rgb"}
        rgb = rgb.select("y", "x", *[F.greatest(e, F.lit(0.0)).alias(n) for n, e in shown.items()])
    rgb = rgb.withColumn("g", image.scnr_green(F.col("r"), F.col("g"), F.col("b"), p.scnr))
    s = image.saturate(F.col("r"), F.col("g"), F.col("b"), p.saturation)
    return {"display": rgb.select("y", "x", s.alias("s")).select("y", "x", *[F.greatest(F.col(f"s.{n}"), F.lit(0.0)).alias(n) for n in "rgb"])}


def default_registry() -> Registry:
    r = Registry()
    for name, f in (("calibrate", calibrate), ("cosmetic", cosmetic), ("debayer", debayer), ("register", register), ("select", select), ("stack", stack_groups), ("gradient", gradient), ("colour", colour_step), ("drizzle", drizzle_groups), ("cross_register", cross_register), ("merge", merge), ("display", display)):
        r.add(FunctionStep(name, f))
    return r


def process(frames: DataFrame, images: DataFrame, params: Params | dict | None = None, registry: Registry | None = None) -> tuple[Context, list[Result]]:
    """All stages over frames and their images (tensor rows); the context has every table, still lazy."""
    p = params if isinstance(params, Params) else resolve(params)
    c = Context({"frames": discover(frames), "tensors": images}, p)
    return c, run_steps(p.steps, registry or default_registry(), c)


def inspect(frames: DataFrame) -> DataFrame:
    """Groups of the light frames with counts, exposure and what is missing."""
    d = discover(frames).where("frame_type = 'light'")
    return d.groupBy("group_hash").agg(F.count("*").alias("frames"), F.sum(F.coalesce("exptime", F.lit(0.0))).alias("exposure"), F.count("missing").alias("incomplete"), F.sort_array(F.collect_set("missing")).alias("missing"))


def darks_coverage(frames: DataFrame) -> DataFrame:
    """group_hash, lights, darks, status (ok, few, none) of each light group."""
    d = discover(frames)
    light = d.where("frame_type = 'light'").groupBy("group_hash", "exptime", "gain").agg(F.count("*").alias("lights"))
    dark = d.where("frame_type = 'dark'").groupBy("exptime", "gain").agg(F.count("*").alias("darks"))
    n = F.coalesce("darks", F.lit(0))
    return light.join(dark, ["exptime", "gain"], "left").select("group_hash", "lights", n.alias("darks"), F.when(n == 0, "none").when(n < 5, "few").otherwise("ok").alias("status"))


def qc(stacks: DataFrame) -> DataFrame:
    """Colour status of each stacked group with an overall code per group."""
    rgb = stacks.groupBy("group_hash").agg(*[F.median(F.when(F.col("c") == i, F.col("value"))).alias(n) for i, n in enumerate("rgb")])
    base = (F.col("r") + F.col("b")) / 2
    excess = F.when(base.isNull() | (base < 1e-6), 0.0).otherwise((F.col("g") / F.when(base >= 1e-6, base) - 1) * 100)
    checks = rgb.select("group_hash", excess.alias("excess_percent"), F.when(F.col("g").isNull() | F.col("r").isNull(), "SKIPPED").when(excess > 15, "FAIL").otherwise("PASS").alias("status"))
    return checks.join(groups.overall_status(checks, ["group_hash"]), "group_hash")
