"""Decisions on groups: reference choice, gates, plausibility, status roll-ups, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reference_by_quality(groups: DataFrame, key: str) -> DataFrame:
    """One row: the group with fewest zero shifts, then most control points, best correlation, most frames, greatest key.

    groups has frames_registered, zero_shift_count, n_cp_median, corr_hp_median,
    frame_count. Groups with fewer than three registered frames are no candidates.
    """
    low = F.lit(float("-inf"))
    ratio = F.col("zero_shift_count") / F.col("frames_registered")
    rank = F.struct((-ratio).alias("z"), F.coalesce("n_cp_median", low).alias("cp"), F.coalesce("corr_hp_median", low).alias("c"), F.col("frame_count").alias("n"), F.col(key).alias("k"))
    return groups.where("frames_registered >= 3").agg(F.max_by(key, rank).alias(key), F.lit("quality").alias("method"))


def reference_by_signal(groups: DataFrame, key: str) -> DataFrame:
    """One row: the group with the highest score, at least three frames and a score over 0.

    A tie for the highest score (within 1e-12), or no candidate, falls back to
    the largest group, the first by `ord` on ties.
    """
    ok = (F.col("frame_count") >= 3) & (F.col("score") > 0)
    best = groups.agg(F.max(F.when(ok, F.col("score"))).alias("__b"))
    tops = F.sum(F.when(ok & (F.abs(F.col("score") - F.col("__b")) <= 1e-12), 1).otherwise(0))
    g = groups.crossJoin(F.broadcast(best))  # one row
    return g.agg(
        tops.alias("__n"),
        F.max_by(key, F.when(ok, F.col("score"))).alias("__s"),
        F.max_by(key, F.struct("frame_count", -F.col("ord"))).alias("__l"),
    ).select(F.when(F.col("__n") == 1, F.col("__s")).otherwise(F.col("__l")).alias(key), F.when(F.col("__n") == 1, "signal").otherwise("largest").alias("method"))


def reference_largest(groups: DataFrame, key: str) -> DataFrame:
    return groups.agg(F.max_by(key, F.struct("frame_count", -F.col("ord"))).alias(key), F.lit("largest").alias("method"))


def cross_group_gate(groups: DataFrame, key: str, reference: DataFrame, min_corr: float = 0.1, duo_corr: float = 0.05) -> DataFrame:
    """groups with `skip` and `reasons` against the reference group (one row with `key`).

    The reference and groups with fewer than three frames are never skipped. A
    correlation under the minimum (a lower one for duo filters) skips; so do low
    corr_roh (not for duo), fewer than 30 control points, a mix of mounts and a
    rotation over 1° off the median on equatorial mounts.
    """
    ref = reference.select(F.col(key).alias("__ref"))
    mode = groups.select(F.col(key).alias("__ref"), F.col("eqmode_majority").alias("__mode"))
    middle = groups.agg(F.median("rotation_deg").alias("__rot"))
    # One row: the reference, its mount and the median rotation.
    facts = ref.join(mode, "__ref", "left").crossJoin(F.broadcast(middle))
    g = groups.crossJoin(F.broadcast(facts))
    duo = F.lower(F.coalesce("filter", F.lit(""))).contains("duo")
    least = F.when(duo, duo_corr).otherwise(min_corr)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("corr_hp") < least, "low_corr_hp"),
            F.when((F.col("corr_hp") >= least) & ~duo & (F.col("corr_roh") < 0.05), "low_corr_roh"),
            F.when((F.col("corr_hp") >= least) & (F.col("n_control_points") < 30), "few_control_points"),
            F.when((F.col("corr_hp") >= least) & (F.col("eqmode_majority") != F.col("__mode")), "eq_mix_az_eq"),
            F.when((F.col("corr_hp") >= least) & (F.col("eqmode_majority") == 1) & (F.abs(F.col("rotation_deg") - F.col("__rot")) > 1.0), "unexpected_rotation"),
        )
    )
    exempt = (F.col(key) == F.col("__ref")) | (F.col("frame_count") < 3)
    return g.select(*groups.columns, F.when(exempt, F.lit("")).otherwise(F.array_join(reasons, ",")).alias("reasons")).withColumn("skip", F.col("reasons") != "")


def plausible(*factors: Column, lo: float = 0.5, hi: float = 2.0) -> Column:
    """Every factor is a finite number within [lo, hi]."""
    ok = F.lit(True)
    for f in factors:
        ok = ok & F.coalesce(~F.isnan(f) & f.between(lo, hi), F.lit(False))
    return ok


def overall_status(df: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """by, overall, code: FAIL if one fails, SKIPPED if all are skipped, else PASS; code 2, 1, 0."""
    s = F.col(status)
    overall = F.when(F.bool_or(s == "FAIL"), "FAIL").when(F.bool_and(s == "SKIPPED"), "SKIPPED").otherwise("PASS")
    out = df.groupBy(*by).agg(overall.alias("overall"))
    return out.withColumn("code", F.when(F.col("overall") == "FAIL", 2).when(F.col("overall") == "PASS", 0).otherwise(1))


def last_runs(df: DataFrame, key: str, order: list[str], n: int = 2) -> DataFrame:
    """The last n rows of each key, with `back` (1 the latest)."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("back", F.row_number().over(w).cast("long")).where(F.col("back") <= n)


def organise(frames: DataFrame) -> DataFrame:
    """Groups by exposure, gain, filter and mount: label, frames, status.

    The mount is part of the label only where one triple was taken with both.
    Under a second is `moon`, fewer than three frames `skipped`, else `ok`.
    """
    g = frames.groupBy("exptime", "gain", "filter", "eq_mode").agg(F.count("*").alias("frames"))
    modes = F.count("*").over(Window.partitionBy("exptime", "gain", "filter"))
    g = g.withColumn("__n", modes)
    exp = F.when(F.col("exptime") == F.floor("exptime"), F.floor("exptime").cast("string")).otherwise(F.col("exptime").cast("string"))
    suffix = F.when(F.col("__n") > 1, F.when(F.col("eq_mode") == 1, "_EQ").when(F.col("eq_mode") == 0, "_AZ").otherwise("_NA")).otherwise("")
    label = F.concat_ws("_", F.concat(exp, F.lit("s"), F.col("gain").cast("string")), F.col("filter"))
    status = F.when(F.col("exptime") < 1, "moon").when(F.col("frames") < 3, "skipped").otherwise("ok")
    return g.select(F.concat(label, suffix).alias("label"), "exptime", "gain", "filter", "eq_mode", "frames", status.alias("status"))


def resolve_name(names: DataFrame, name: str, asked: DataFrame, most: int = 3) -> DataFrame:
    """asked, match, candidates: exact name, else the only one with that prefix (case doesn't count), else null.

    candidates lists up to `most` close names by edit distance where there is no
    match. Prefixes of names are join keys. Only for the names asked in vain
    is every name compared, by the asked names sent along with each batch; the best
    few are kept while aggregating, so no list of all names of an asked one is ever held.
    """
    n = names.select(F.col(name).alias("n")).where("n is not null").distinct()
    q = asked.select("asked").where("asked is not null").distinct()
    lengths = q.agg(F.array_sort(F.collect_set(F.length("asked"))).alias("__l"))
    starts = n.crossJoin(lengths).select("n", F.explode(F.coalesce("__l", F.array().cast("array<int>"))).alias("__k")).where(F.length("n") >= F.col("__k"))  # one row
    starts = starts.select("n", F.lower(F.substring(F.col("n"), F.lit(1), F.col("__k"))).alias("__p"))
    pairs = q.select("asked", F.lower("asked").alias("__p")).join(starts, "__p")
    hit = pairs.groupBy("asked").agg(F.count("n").alias("k"), F.max("n").alias("only"), F.max(F.when(F.lower("n") == F.lower("asked"), F.col("n"))).alias("exact"))
    match = F.coalesce("exact", F.when(F.col("k") == 1, F.col("only")))
    found = q.join(hit, "asked", "left").select("asked", match.alias("match"))
    lost = found.where("match is null").select("asked")
    # A stated query set against all names, in blocks.
    blocks = lost.select("asked", F.pmod(F.xxhash64("asked"), F.lit(ASKED_BLOCKS)).alias("__b")).groupBy("__b").agg(F.collect_list("asked").alias("__q"))
    spread = n.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(ASKED_BLOCKS - 1)))).withColumn("__salt", F.pmod(F.xxhash64("n"), F.lit(64)))
    salted = blocks.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    near = spread.join(salted, ["__b", "__salt"]).select("__salt", "n", F.explode("__q").alias("asked"))
    scored = near.select("asked", "__salt", F.struct(F.levenshtein(F.lower("n"), F.lower("asked")).alias("d"), F.col("n").alias("n")).alias("c"))
    best = F.slice(F.array_sort(F.collect_list("c")), 1, most)
    part = scored.groupBy("asked", "__salt", F.pmod(F.xxhash64("c.n"), F.lit(4096)).alias("__p")).agg(best.alias("c")).groupBy("asked", "__salt").agg(F.slice(F.array_sort(F.flatten(F.collect_list("c"))), 1, most).alias("c"))
    listed = part.groupBy("asked").agg(F.array_join(F.transform(F.slice(F.array_sort(F.flatten(F.collect_list("c"))), 1, most), lambda s: s["n"]), ",").alias("candidates"))
    return found.join(listed, "asked", "left")


#: Parts that the names asked in vain are split into.
ASKED_BLOCKS = 4
