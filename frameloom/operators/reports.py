"""Summaries, checks and reports of sessions, groups and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.robust import MAD_SCALE
from . import equipment, groups


def session_summary(lights: DataFrame, key: str, order: str = "idx") -> DataFrame:
    """key, lights, seconds, target, eq_mode, filters: totals, the first known target and mode, filters as first seen."""
    totals = lights.groupBy(key).agg(F.count("*").alias("lights"), F.round(F.sum(F.when(F.col("exptime") > 0, F.col("exptime"))), 3).alias("seconds"))
    first = equipment.first_known(lights, key, order, {"target": F.col("object_name"), "eq_mode": F.col("eq_mode")})
    seen = lights.where("filter_name is not null").groupBy(key, "filter_name").agg(F.min(order).alias("__i"))
    listed = F.array_sort(F.collect_list(F.struct("__i", "filter_name")))
    filters = seen.groupBy(key).agg(F.array_join(F.transform(listed, lambda s: s["filter_name"]), "|").alias("filters"))
    return totals.join(first, key).join(filters, key, "left")


def mandatory(frames: DataFrame, columns: dict[str, str], warn: str | None = None) -> DataFrame:
    """missing, frames, `without`, aborts: frames by the mandatory columns (column -> name) they lack; `warn` is only counted."""
    parts = [F.when(F.col(c).isNull(), n) for c, n in columns.items()]
    lost = F.col(warn).isNull().cast("long") if warn else F.lit(0).cast("long")
    out = frames.groupBy(F.concat_ws(",", *parts).alias("missing")).agg(F.count("*").alias("frames"), F.sum(lost).alias("without"))
    return out.withColumn("aborts", F.col("missing") != "")


def _plain(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def of_filters(frames: DataFrame, column: str, asked: list[str] | None) -> DataFrame:
    """Frames of the filters asked for, whatever case and blanks; all for None, none for an empty list. Blank entries don't count."""
    if asked is None:
        return frames
    return frames.where(_plain(F.col(column)).isin(sorted({f.strip().lower() for f in asked if f.strip()})))


def unknown_filters(frames: DataFrame, column: str, asked: list[str]) -> DataFrame:
    """asked, position: filters asked for that no frame has, once each, with the place where they were first asked for."""
    names = [(i, f.strip().lower()) for i, f in enumerate(asked) if f.strip()]
    rows = frames.sparkSession.createDataFrame(names, "i int, asked string")
    have = frames.select(F.lower(F.trim(column)).alias("asked")).distinct()
    return rows.groupBy("asked").agg(F.min("i").alias("position")).join(have, "asked", "left_anti")


def first_of_each(frames: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n frames of each combination of `by`, with `ordinal` (1 the first); nulls are a value."""
    w = Window.partitionBy(*by).orderBy(*order)
    return frames.withColumn("ordinal", F.row_number().over(w).cast("long")).where(F.col("ordinal") <= n)


def sound_registrations(frames: DataFrame, key: str, scale: Column, rotation: Column, max_scale: float = 0.02, max_rotation: float = 2.0, least: int = 3) -> DataFrame:
    """key, n, registered (scale and rotation within bounds), branch: candidate from `least`, skip under two frames, else fallback."""
    ok = (F.abs(scale - 1) <= max_scale) & (F.abs(rotation) <= max_rotation)
    r = F.count(F.when(ok, 1))
    branch = F.when(r >= least, "candidate").when(F.count("*") < 2, "skip").otherwise("fallback")
    return frames.groupBy(key).agg(F.count("*").alias("n"), r.alias("registered"), branch.alias("branch"))


def header_gaps(frames: DataFrame, keep: list[str], cards: str, needed: list[str], pixel_sizes: tuple[float, ...] = (5.8, 2.9, 1.45), within: float = 0.05, drizzled: Column | None = None, drizzle_cards: list[str] | None = None) -> DataFrame:
    """keep, missing, status: needed cards that a header (a map) lacks, and XPIXSZ where it is none of the sizes.

    Products that are `drizzled` need drizzle_cards as well. FAIL with anything missing, SKIPPED without a header, else PASS.
    """
    x = F.element_at(cards, "XPIXSZ").try_cast("double")
    fits = F.lit(False)
    for s in pixel_sizes:
        fits = fits | (F.abs(x - s) <= within)
    parts = [F.when(~F.map_contains_key(cards, c), c) for c in needed] + [F.when(~F.coalesce(fits, F.lit(False)), "XPIXSZ")]
    if drizzled is not None:
        parts += [F.when(F.coalesce(drizzled, F.lit(False)) & ~F.map_contains_key(cards, c), c) for c in drizzle_cards or []]
    missing = F.when(F.col(cards).isNull(), "").otherwise(F.concat_ws(",", *parts))
    status = F.when(F.col(cards).isNull(), "SKIPPED").when(missing != "", "FAIL").otherwise("PASS")
    return frames.select(*keep, missing.alias("missing"), status.alias("status"))


def hot_counts(values: DataFrame, group: str, value: str, k: float = 20.0, recommend_over: int = 200) -> DataFrame:
    """group, hot, recommend: values over the group's median + k sigma, and whether a correction is advised."""
    w = Window.partitionBy(group)
    v = F.col(value)
    m = values.select(group, v, F.median(v).over(w).alias("__m"))
    s = m.withColumn("__s", F.median(F.abs(v - F.col("__m"))).over(w) * MAD_SCALE)
    hot = F.count(F.when(v > F.col("__m") + k * F.col("__s"), 1))
    return s.groupBy(group).agg(hot.alias("hot"), (hot > recommend_over).alias("recommend"))


def temperature_gap(frames: DataFrame, key: str, low: float = -60.0, high: float = 60.0, over: float = 5.0) -> DataFrame:
    """key, frames, lights, gap, mismatch: the lights' mean temperature less the darks', and whether it is over 5 degrees.

    Temperatures of lights outside the range are none. A side without any gives a null gap and no mismatch.
    """
    light, t = F.col("frame_type") == "light", F.col("ccd_temp")
    gap = F.avg(F.when(light & t.between(low, high), t)) - F.avg(F.when(F.col("frame_type") == "dark", t))
    out = frames.groupBy(key).agg(F.count("*").alias("frames"), F.count(F.when(light, 1)).alias("lights"), F.round(gap, 6).alias("gap"))
    return out.withColumn("mismatch", F.coalesce(F.abs("gap") > over, F.lit(False)))


def worst_runs(checks: DataFrame, run: str, target: str) -> DataFrame:
    """target, worst, runs: the greatest code over the runs of a target, each the overall status of its checks."""
    overall = groups.overall_status(checks, [target, run])
    return overall.groupBy(target).agg(F.max("code").alias("worst"), F.count("*").alias("runs"))


def busiest(lights: DataFrame, target: str, n: int = 5) -> DataFrame:
    """target, lights, place: the n targets with most light frames; ties by name. The report is the top n."""
    counts = lights.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("lights"))
    top = counts.orderBy(F.desc("lights"), target).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("lights"), target)))  # at most n rows


def object_scan(lights: DataFrame, key: str, group: str, order: str, value: str = "object_name") -> DataFrame:
    """key, object, objects, mixed: the targets named by the first frame of each group, in the order of groups.

    `object` is the most frequent of them, the first on ties; `mixed` tells that they differ.
    Blank names don't count.
    """
    named = lights.where(F.col(group).isNotNull()).groupBy(key, group).agg(F.min_by(value, order).alias("__o"))
    named = named.select(key, group, F.trim("__o").alias("__o")).where("__o <> ''")
    each = named.groupBy(key, "__o").agg(F.count("*").alias("__n"), F.min(group).alias("__g"))
    rank = F.array_sort(F.collect_list(F.struct((-F.col("__n")).alias("n"), F.col("__g").alias("g"), F.col("__o").alias("o"))))
    listed = F.array_sort(F.collect_list(F.struct(F.col("__g").alias("g"), F.col("__o").alias("o"))))
    return each.groupBy(key).agg(rank[0]["o"].alias("object"), F.array_join(F.transform(listed, lambda s: s["o"]), "|").alias("objects"), (F.count("*") > 1).alias("mixed"))


def target_lookup(values: DataFrame, value: str, names: DataFrame) -> DataFrame:
    """value, entry_id: the entry that has a name equal in compact form; of several the least entry.

    names has entry_id and name (catalogue numbers, official names, aliases).
    """
    cache = names.where("name is not null").groupBy(keys.compact_key(F.col("name")).alias("__k")).agg(F.min("entry_id").alias("entry_id")).where("__k <> ''")
    asked = values.select(value).where(F.col(value).isNotNull()).distinct().withColumn("__k", keys.compact_key(F.col(value)))
    return asked.join(cache, "__k").select(value, "entry_id")


def suggest(headers: DataFrame, key: str, names: DataFrame, types: DataFrame, presets: DataFrame) -> DataFrame:
    """What to process a session with: key, target, target_source, target_type, preset, mount, registration, options, missing, warnings.

    headers has one row per key: object_name, filter_name, exptime, telescope,
    eq_mode, equat, mount, mixed (of object_scan); names as in target_lookup;
    types entry_id, target_type; presets target_type, preset. The header's target
    comes before the cache's. An unknown mount offers both registrations. Missing
    cards and mixed targets are warnings, never errors.
    """
    found = target_lookup(headers, "object_name", names).join(types.groupBy("entry_id").agg(F.min("target_type").alias("target_type")), "entry_id", "left")
    found = found.join(presets.groupBy("target_type").agg(F.min("preset").alias("preset")), "target_type", "left").withColumnRenamed("object_name", "__name")
    h = headers.join(found, F.col("object_name") == F.col("__name"), "left")
    m = equipment.mount_type(F.col("eq_mode"), F.col("equat"), F.col("mount"), F.col("telescope"))
    told = F.trim(F.coalesce("telescope", F.lit(""))) != ""
    kind = F.when(told | F.col("eq_mode").isin(0, 1), m["mount"]).otherwise("unknown")
    method = equipment.preferred_registration(kind == "az", F.col("exptime"))
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    cards = {"object_name": "OBJECT", "filter_name": "FILTER", "exptime": "EXPTIME", "telescope": "TELESCOP"}
    missing = F.concat_ws(",", *[F.when(blank(c), n) for c, n in cards.items()])
    warnings = F.concat_ws(",", F.when(F.col("mixed"), "mixed_targets"), F.when(missing != "", "header_incomplete"), F.when(kind == "unknown", "mount_unknown"))
    source = F.when(F.col("entry_id").isNotNull(), "cache").when(~blank("object_name"), "header").otherwise("none")
    return h.select(
        key, F.col("object_name").alias("target"), source.alias("target_source"), "target_type", "preset", kind.alias("mount"), method.alias("registration"),
        F.when(kind == "unknown", "astroalign|fft").otherwise(method).alias("options"), missing.alias("missing"), warnings.alias("warnings"),
        (F.coalesce("preset", F.lit("")) == "galaxy").alias("colour_calibration"),
    )


def selection_report(groups_df: DataFrame, key: str, reference: DataFrame, asked: str) -> DataFrame:
    """One row: asked, method, reference, scores (JSON of key -> score), fallback (why the asked method wasn't used).

    groups_df has key and score; reference one row of key and method. Scores are sorted by key; their number is that of the groups of one run.
    """
    scores = groups_df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), "score"))))).alias("scores"))
    ref = reference.select(F.col(key).alias("reference"), "method")
    fallback = F.when(F.col("method") != asked, F.concat(F.lit(asked), F.lit(" gave no single group")))
    return ref.crossJoin(scores).select(F.lit(asked).alias("asked"), "method", "reference", "scores", fallback.alias("fallback"))  # one row each


def run_report(tables: dict[str, DataFrame], key: str = "group_hash") -> DataFrame:
    """One row of `report`: the nested JSON of a finished plan; parts that the plan doesn't have are left out.

    Groups with frames and exposure, registrations by status and the frames
    registered, dark tiers, what the merge left out and its figures, the reference.
    """
    one: DataFrame | None = None

    def add(df: DataFrame) -> None:
        nonlocal one
        one = df if one is None else one.crossJoin(df)  # one row each

    def listed(df: DataFrame, columns: list[str], name: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    if "groups" in tables:
        have = [c for c in (key, "frame_count", "total_exposure", "filter") if c in tables["groups"].columns]
        add(listed(tables["groups"], have, "groups"))
    if "registrations" in tables:
        by = tables["registrations"].groupBy("status").agg(F.count("*").alias("frames"))
        add(by.agg(F.array_sort(F.collect_list(F.struct("status", "frames"))).alias("registrations"), F.coalesce(F.sum(F.when(F.col("status") != "rejected", F.col("frames"))), F.lit(0)).alias("frames_registered")))
    if "dark_tiers" in tables:
        add(listed(tables["dark_tiers"], [key, "tier", "darks"], "darks"))
    if "reference" in tables:
        add(tables["reference"].agg(F.max(F.struct(key, "method")).alias("reference")))
    if "merge_skipped" in tables:
        add(listed(tables["merge_skipped"], [key, "reason"], "skipped"))
    if "merge_stats" in tables:
        add(tables["merge_stats"].agg(F.max(F.struct(*tables["merge_stats"].columns)).alias("merge")))
    if one is None:
        raise ValueError("no table of a plan to report on")
    return one.select(F.to_json(F.struct(*one.columns)).alias("report"))


def read_report(reports: DataFrame, report: str, paths: dict[str, list[str]]) -> DataFrame:
    """reports with a text column per name: the first of its JSON paths that holds a value."""
    return reports.withColumns({n: F.coalesce(*[F.get_json_object(report, p) for p in ps]) for n, ps in paths.items()})


def final_products(products: DataFrame, run: str, path: str) -> DataFrame:
    """run, path: the merged product, else a stretched or stacked one, else any; the least path of the best kind."""
    low = F.lower(path)
    rank = F.when(low.contains("_merged."), 0).when(low.contains("_final."), 1).when(low.contains("stack"), 2).otherwise(3)
    return products.where(F.col(path).isNotNull()).groupBy(run).agg(F.min_by(path, F.struct(rank, path)).alias(path))
