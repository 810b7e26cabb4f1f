"""Queries on joins, group decisions and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import colour, equipment, groups, image, reports, spatial
from ..session import read_table
from .catalog import query
from .meta_queries import FRAMES_SQL, frames

R6 = lambda c: F.round(c, 6)


@query("""SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 50""")
def band_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers of a nation with balances at most 50 apart."""
    c = read_table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), "c_acctbal")
    s = read_table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), "s_acctbal")
    return spatial.band_join(c, s, ["n"], "c_acctbal", "s_acctbal", 50.0).select("c_custkey", "s_suppkey")


@query(f"""WITH {FRAMES_SQL}, g AS (SELECT session_id, device_id, exptime, gain, median(CASE WHEN ccd_temp BETWEEN -60 AND 60 THEN ccd_temp END) AS temp FROM fr
  WHERE frame_type = 'light' AND exptime IS NOT NULL AND gain IS NOT NULL GROUP BY ALL),
 k AS (SELECT session_id, device_id, exptime, gain, ccd_temp FROM fr WHERE frame_type = 'dark' AND exptime IS NOT NULL AND gain IS NOT NULL),
 lib AS (SELECT device_id, exptime, gain, min(ccd_temp) lo, max(ccd_temp) hi, count(*) n FROM k GROUP BY ALL),
 l AS (SELECT g.session_id, g.exptime, g.gain, count(*) AS darks FROM g JOIN k ON k.session_id = g.session_id AND k.gain = g.gain AND abs(k.exptime - g.exptime) <= 0.5 AND (g.temp IS NULL OR k.ccd_temp IS NULL OR abs(g.temp - k.ccd_temp) <= 3) GROUP BY ALL),
 m AS (SELECT g.session_id, g.exptime, g.gain, lib.n AS darks, CASE WHEN g.temp IS NOT NULL AND lib.lo <= g.temp + 3 AND lib.hi >= g.temp - 3 THEN 1 WHEN g.temp IS NOT NULL AND lib.lo <= g.temp + 10 AND lib.hi >= g.temp - 10 THEN 2 END AS t
  FROM g JOIN lib ON lib.device_id = g.device_id AND lib.gain = g.gain AND lib.exptime = floor(g.exptime))
SELECT g.session_id, g.exptime, g.gain, CASE WHEN l.darks IS NOT NULL THEN 'local' WHEN m.t = 1 THEN 'library' WHEN m.t = 2 THEN 'library_wide' ELSE 'none' END AS tier,
 coalesce(l.darks, CASE WHEN m.t IS NOT NULL THEN m.darks END, 0) AS darks FROM g LEFT JOIN l USING (session_id, exptime, gain) LEFT JOIN m USING (session_id, exptime, gain)""")
def tiered_match(spark: SparkSession, d: str) -> DataFrame:
    """Darks for each light group: of the session, else of the device's library within 3°, within 10°, else none."""
    f = frames(spark, d, "session_id", "device_id", "frame_type", "exptime", "gain", "ccd_temp").where("exptime is not null and gain is not null")
    key = ["session_id", "exptime", "gain"]
    g = f.where("frame_type = 'light'").groupBy(*key, "device_id").agg(F.median(F.when(F.col("ccd_temp").between(-60, 60), F.col("ccd_temp"))).alias("temp"))
    g = g.withColumn("gid", F.struct(*key))
    k = f.where("frame_type = 'dark'")
    kd = k.select(F.col("session_id"), F.col("gain"), F.col("exptime").alias("dark_exp"), F.col("ccd_temp").alias("dark_temp"))
    near = F.col("temp").isNull() | F.col("dark_temp").isNull() | (F.abs(F.col("temp") - F.col("dark_temp")) <= 3)
    local = spatial.band_join(g, kd, ["session_id", "gain"], "exptime", "dark_exp", 0.5, near).groupBy("gid").agg(F.count("*").alias("darks"))
    lib = k.groupBy("device_id", "exptime", "gain").agg(F.min("ccd_temp").alias("lo"), F.max("ccd_temp").alias("hi"), F.count("*").alias("darks"))
    m = g.withColumn("whole", F.floor("exptime").cast("double")).join(lib.withColumnRenamed("exptime", "whole"), ["device_id", "gain", "whole"])
    within = lambda t: (F.col("lo") <= F.col("temp") + t) & (F.col("hi") >= F.col("temp") - t)
    tiers = [("local", local), ("library", m.where(within(3)).select("gid", "darks")), ("library_wide", m.where(within(10)).select("gid", "darks"))]
    out = spatial.tiered_match(g.select("gid"), "gid", tiers)
    return out.select("gid.session_id", "gid.exptime", "gid.gain", "tier", F.coalesce("darks", F.lit(0)).alias("darks"))


_RADEC = "{k} AS id, ({a} * 37.0 / 360.0 - floor({a} * 37.0 / 360.0)) * 360.0 AS ra, (({a} * 17.0 / 180.0) - floor({a} * 17.0 / 180.0)) * 180.0 - 90.0 AS dec"


def _vec(p: str) -> list[str]:
    return [f"cos(radians({p}.dec)) * cos(radians({p}.ra))", f"cos(radians({p}.dec)) * sin(radians({p}.ra))", f"sin(radians({p}.dec))"]


_CHORD = "sqrt(" + " + ".join(f"pow({a} - {b}, 2)" for a, b in zip(_vec("s"), _vec("c"))) + ")"


@query(f"""WITH s AS (SELECT {_RADEC.format(k='c_custkey', a='c_acctbal')} FROM customer), c AS (SELECT {_RADEC.format(k='s_suppkey', a='s_acctbal')} FROM supplier),
 j AS (SELECT s.id AS star, c.id AS entry, {_CHORD} AS chord FROM s JOIN c ON abs(s.dec - c.dec) <= 2.001)
SELECT star, entry, round(chord, 6) AS chord FROM j WHERE chord <= 2 * sin(radians(2.0) / 2) QUALIFY row_number() OVER (PARTITION BY star ORDER BY chord, entry) = 1""")
def nearest_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Nearest supplier within 2° of each customer on a made-up sky."""

    def sky(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
        a, b = F.col(value) * 37.0 / 360.0, F.col(value) * 17.0 / 180.0
        return df.select(F.col(key).alias(name), ((a - F.floor(a)) * 360.0).alias("ra"), ((b - F.floor(b)) * 180.0 - 90.0).alias("dec"))

    stars, cat = sky(read_table(spark, d, "customer"), "c_custkey", "c_acctbal", "star"), sky(read_table(spark, d, "supplier"), "s_suppkey", "s_acctbal", "entry")
    return spatial.nearest_on_sky(stars, cat, "star", "entry", 2.0).select("star", "entry", R6("chord").alias("chord"))


# Events as stars: the user is the frame, value and the minute of the hour the position.
_STARS = "st AS (SELECT user_id AS frame, event_id AS id, value AS x, (event_id % 97)::DOUBLE AS y, value + 1 AS flux, event_type FROM events WHERE value IS NOT NULL)"


def _stars(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").where("value is not null")
    return e.select(F.col("user_id").alias("frame"), F.col("event_id").alias("id"), F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"), (F.col("value") + 1).alias("flux"), "event_type")


@query(f"""WITH {_STARS}, p AS (SELECT DISTINCT a.frame, a.id FROM st a JOIN st b ON a.frame = b.frame AND a.id < b.id AND abs(a.x - b.x) <= 20 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 20
  WHERE a.flux > 0 AND b.flux > 0 AND least(a.flux, b.flux) / greatest(a.flux, b.flux) BETWEEN 0.5 AND 2.0), d AS (SELECT frame, count(*) AS doubles FROM p GROUP BY frame), n AS (SELECT frame, count(*) AS stars FROM st GROUP BY frame)
SELECT frame, stars, coalesce(doubles, 0) AS doubles, CASE WHEN stars >= 5 THEN round(coalesce(doubles, 0) / stars, 6) END AS double_rate FROM n LEFT JOIN d USING (frame)""")
def double_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of stars with a close neighbour of similar flux."""
    out = spatial.double_rate(_stars(spark, d), "frame", 20.0)
    return out.select("frame", "stars", "doubles", R6("double_rate").alias("double_rate"))


@query(f"""WITH {_STARS}, r AS (SELECT *, row_number() OVER (PARTITION BY frame, event_type = 'click' ORDER BY flux DESC, id) AS n FROM st), t AS (SELECT * FROM r WHERE n <= 10)
SELECT a.frame, count(*) AS pairs, round(min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS nearest FROM t a JOIN t b ON a.frame = b.frame AND a.event_type = 'click' AND b.event_type <> 'click' AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 25 GROUP BY a.frame""")
def star_match_2d(spark: SparkSession, d: str) -> DataFrame:
    """Matches between the ten brightest stars of two lists per frame."""
    s = _stars(spark, d).withColumn("own", F.col("event_type") == "click")
    top = s.withColumn("n", F.row_number().over(Window.partitionBy("frame", "own").orderBy(F.desc("flux"), "id"))).where("n <= 10")
    pairs = spatial.pairs_within(top.where("own"), top.where("not own"), "frame", 25.0)
    return pairs.groupBy("frame").agg(F.count("*").alias("pairs"), R6(F.min("dist")).alias("nearest"))


PROFILES = [("petrel", "Petrel", 0), ("petrel_50", "Petrel 50", 1), ("skua", "skua c3", 2), ("small", "mini", 3), ("kestrel", "Kestrel", 4)]
_PROF = "(VALUES " + ", ".join(f"('{n}', '{p.lower()}', {o})" for n, p, o in PROFILES) + ") p(name, pattern, ord)"


@query(f"""SELECT device_id, coalesce(max_by(name, (CASE WHEN lower(instrument) = pattern THEN 1000 ELSE 0 END) + length(pattern) - ord / 100.0), 'default') AS profile
FROM devices LEFT JOIN {_PROF} ON contains(lower(instrument), pattern) GROUP BY device_id""")
def profile_match(spark: SparkSession, d: str) -> DataFrame:
    """Equipment profile of each device by its instrument."""
    profiles = spark.createDataFrame(PROFILES, "name string, pattern string, ord int")
    return spatial.profile_match(read_table(spark, d, "devices"), "device_id", "instrument", profiles)


_GROUPS = """gm AS (SELECT group_hash, count(*) AS frame_count, count(correlation) AS frames_registered, sum((correlation < 0.6)::INT)::BIGINT AS zero_shift_count, median(star_count)::DOUBLE AS n_cp_median, median(correlation) AS corr_hp_median,
 round(median(CASE WHEN isfinite(snr) THEN snr END), 6) AS score FROM (SELECT DISTINCT * FROM quality) GROUP BY group_hash), go AS (SELECT *, row_number() OVER (ORDER BY group_hash) AS ord FROM gm)"""


def _groups(spark: SparkSession, d: str) -> DataFrame:
    q = read_table(spark, d, "quality").distinct()
    snr = F.when(~F.isnan("snr"), F.col("snr"))
    g = q.groupBy("group_hash").agg(
        F.count("*").alias("frame_count"), F.count("correlation").alias("frames_registered"), F.count(F.when(F.col("correlation") < 0.6, 1)).alias("zero_shift_count"),
        F.median("star_count").alias("n_cp_median"), F.median("correlation").alias("corr_hp_median"), F.round(F.median(snr), 6).alias("score"),
    )
    # One row per group hash, of which there are a few hundred: exposures times gains times filters.
    return g.withColumn("ord", F.row_number().over(Window.orderBy("group_hash")))


@query(f"""WITH {_GROUPS}, q AS (SELECT group_hash, 'quality' AS method FROM go WHERE frames_registered >= 3 ORDER BY coalesce(zero_shift_count, 0) / frames_registered, n_cp_median DESC NULLS LAST, corr_hp_median DESC NULLS LAST, frame_count DESC, group_hash DESC LIMIT 1),
 b AS (SELECT max(score) AS b FROM go WHERE frame_count >= 3 AND score > 0), t AS (SELECT group_hash, count(*) OVER () n FROM go, b WHERE frame_count >= 3 AND score > 0 AND abs(score - b) <= 1e-12),
 l AS (SELECT group_hash FROM go ORDER BY frame_count DESC, ord LIMIT 1)
SELECT 'quality' AS asked, group_hash, method FROM q UNION ALL SELECT 'signal', CASE WHEN (SELECT count(*) FROM t) = 1 THEN (SELECT min(group_hash) FROM t) ELSE l.group_hash END, CASE WHEN (SELECT count(*) FROM t) = 1 THEN 'signal' ELSE 'largest' END FROM l
UNION ALL SELECT 'largest', group_hash, 'largest' FROM l""")
def reference_choice(spark: SparkSession, d: str) -> DataFrame:
    """The reference group by quality, by signal and by size."""
    g = _groups(spark, d)
    parts = [("quality", groups.reference_by_quality), ("signal", groups.reference_by_signal), ("largest", groups.reference_largest)]
    out = [f(g, "group_hash").select(F.lit(n).alias("asked"), "group_hash", "method") for n, f in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


_CG = f"""{_GROUPS}, cg AS (SELECT group_hash, frame_count, round(score / 20 - 0.4, 6) AS corr_hp, round(corr_hp_median - 0.75, 6) AS corr_roh, (n_cp_median / 2)::INT AS n_control_points, round((ord % 40) / 10.0 - 2, 3) AS rotation_deg, (ord % 3 > 0)::INT AS eqmode_majority,
 split_part(group_hash, '_', 2) AS filter FROM go), rf AS (SELECT group_hash AS ref FROM go ORDER BY frame_count DESC, ord LIMIT 1), rr AS (SELECT cg.*, median(rotation_deg) OVER () AS rot, ref, max(CASE WHEN group_hash = ref THEN eqmode_majority END) OVER () AS rmode, CASE WHEN contains(filter, 'duo') THEN 0.05 ELSE 0.1 END AS least, contains(filter, 'duo') AS duo FROM cg, rf)"""


@query(f"""WITH {_CG}, x AS (SELECT group_hash, CASE WHEN group_hash = ref OR frame_count < 3 THEN '' ELSE concat_ws(',', CASE WHEN corr_hp < least THEN 'low_corr_hp' END, CASE WHEN corr_hp >= least AND NOT duo AND corr_roh < 0.05 THEN 'low_corr_roh' END,
 CASE WHEN corr_hp >= least AND n_control_points < 30 THEN 'few_control_points' END, CASE WHEN corr_hp >= least AND eqmode_majority <> rmode THEN 'eq_mix_az_eq' END, CASE WHEN corr_hp >= least AND eqmode_majority = 1 AND abs(rotation_deg - rot) > 1 THEN 'unexpected_rotation' END) END AS reasons FROM rr)
SELECT group_hash, reasons, reasons <> '' AS skip FROM x""")
def cross_group_gate(spark: SparkSession, d: str) -> DataFrame:
    """Groups that are left out of the merge, and why."""
    g = _groups(spark, d)
    o = F.col("ord")
    cg = g.select(
        "group_hash", "frame_count", F.round(F.col("score") / 20 - 0.4, 6).alias("corr_hp"), F.round(F.col("corr_hp_median") - 0.75, 6).alias("corr_roh"),
        F.round(F.col("n_cp_median") / 2).cast("int").alias("n_control_points"), F.round((o % 40) / 10.0 - 2, 3).alias("rotation_deg"),
        (o % 3 > 0).cast("int").alias("eqmode_majority"), F.split_part("group_hash", F.lit("_"), F.lit(2)).alias("filter"),
    )
    out = groups.cross_group_gate(cg, "group_hash", groups.reference_largest(g, "group_hash"))
    return out.select("group_hash", "reasons", "skip")


@query("""WITH f AS (SELECT l_suppkey, l_linenumber % 3 AS c, l_extendedprice / l_quantity / 1000 AS v FROM lineitem), p AS (SELECT *, quantile_cont(v, 0.05) OVER w AS lo, quantile_cont(v, 0.95) OVER w AS hi FROM f WINDOW w AS (PARTITION BY l_suppkey, c)),
 m AS (SELECT l_suppkey, c, median(CASE WHEN v BETWEEN lo AND hi THEN v END) AS m FROM p GROUP BY ALL), w AS (SELECT l_suppkey, max(CASE WHEN c = 0 THEN m END) r, max(CASE WHEN c = 1 THEN m END) g, max(CASE WHEN c = 2 THEN m END) b FROM m GROUP BY l_suppkey)
SELECT l_suppkey, round(g / r, 6) AS r_factor, round(g / b, 6) AS b_factor, g / r BETWEEN 0.98 AND 1.02 AND g / b BETWEEN 0.98 AND 1.02 AS plausible FROM w""")
def plausible_factors(spark: SparkSession, d: str) -> DataFrame:
    """Channel factors from trimmed medians and whether they are plausible."""
    f = read_table(spark, d, "lineitem").select("l_suppkey", (F.col("l_linenumber") % 3).alias("c"), (F.col("l_extendedprice") / F.col("l_quantity") / 1000).alias("v"))
    w = Window.partitionBy("l_suppkey", "c")
    p = f.select("*", F.percentile("v", 0.05).over(w).alias("lo"), F.percentile("v", 0.95).over(w).alias("hi"))
    from ..functions.robust import trimmed_median

    m = p.groupBy("l_suppkey", "c").agg(trimmed_median(F.col("v"), F.col("lo"), F.col("hi")).alias("m"))
    x = m.groupBy("l_suppkey").agg(*[F.max(F.when(F.col("c") == i, F.col("m"))).alias(n) for i, n in enumerate("rgb")])
    r, b = F.col("g") / F.col("r"), F.col("g") / F.col("b")
    return x.select("l_suppkey", R6(r).alias("r_factor"), R6(b).alias("b_factor"), groups.plausible(r, b, lo=0.98, hi=1.02).alias("plausible"))


@query("""WITH p AS (SELECT l_suppkey, l_linenumber % 3 AS c, l_extendedprice v FROM lineitem), q AS (SELECT l_suppkey, c, quantile_cont(CASE WHEN v > 0 THEN v END, 0.99) AS p99 FROM p GROUP BY ALL), m AS (SELECT l_suppkey, avg(p99) AS t FROM q GROUP BY l_suppkey)
SELECT l_suppkey, c, round(t / p99, 6) AS factor FROM q JOIN m USING (l_suppkey)""")
def gray_world(spark: SparkSession, d: str) -> DataFrame:
    """Factors that bring the channels' 99th percentiles to their mean."""
    p = read_table(spark, d, "lineitem").select("l_suppkey", (F.col("l_linenumber") % 3).alias("c"), F.col("l_extendedprice").alias("value"))
    return colour.gray_world(p, "l_suppkey").withColumn("factor", R6("factor"))


@query("""WITH s AS (SELECT p_partkey, p_size, ((p_partkey % 41) - 20) / 4.0 AS sy, ((p_partkey % 29) - 14) / 4.0 AS sx FROM part), r AS (SELECT p_size, count(*) AS n, count(DISTINCT (round_even(sy / 0.5, 0), round_even(sx / 0.5, 0))) AS phases FROM s GROUP BY p_size)
SELECT p_size, n, phases, CASE WHEN n <= 0 THEN 0 ELSE greatest(1, ceil(n / CASE WHEN p_size >= 25 THEN 10 ELSE 6 END)::BIGINT) END AS expected, CASE WHEN phases < 4 OR n < 10 THEN 1.0 WHEN n < 30 THEN 0.7 ELSE 0.5 END::DOUBLE AS pixfrac FROM r""")
def phases(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sub-pixel phases of a group, the number expected and the drop size that follows."""
    p = read_table(spark, d, "part")
    sy, sx = (F.col("p_partkey") % 41 - 20) / 4.0, (F.col("p_partkey") % 29 - 14) / 4.0
    r = image.dither(p.select("p_size", sy.alias("sy"), sx.alias("sx")), "p_size", "sy", "sx")
    return r.select("p_size", F.col("frames").alias("n"), "phases", image.expected_phases(F.col("frames"), F.when(F.col("p_size") >= 25, 60.0).otherwise(10.0)).alias("expected"), "pixfrac")


_ST = "s AS (SELECT session_id, CASE WHEN snr < 8 THEN 'FAIL' WHEN fwhm_median IS NULL THEN 'SKIPPED' ELSE 'PASS' END AS status FROM (SELECT DISTINCT * FROM quality) q JOIN (SELECT DISTINCT frame_id, session_id FROM frames) f USING (frame_id))"


def _checks(spark: SparkSession, d: str) -> DataFrame:
    f = read_table(spark, d, "frames").select("frame_id", "session_id").distinct()
    s = F.when((F.col("snr") < 8) & ~F.isnan("snr"), "FAIL").when(F.col("fwhm_median").isNull(), "SKIPPED").otherwise("PASS")
    return read_table(spark, d, "quality").distinct().join(f, "frame_id").select("session_id", s.alias("status"))


@query(f"""WITH {_ST} SELECT session_id, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_and(status = 'SKIPPED') THEN 'SKIPPED' ELSE 'PASS' END AS overall,
 CASE WHEN bool_or(status = 'FAIL') THEN 2 WHEN bool_and(status = 'SKIPPED') THEN 1 ELSE 0 END AS code FROM s GROUP BY session_id""")
def gate_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Overall status of each session's checks."""
    return groups.overall_status(_checks(spark, d), ["session_id"])


@query(f"""WITH {_ST}, o AS (SELECT session_id, CASE WHEN bool_or(status = 'FAIL') THEN 2 WHEN bool_and(status = 'SKIPPED') THEN 1 ELSE 0 END AS code FROM s GROUP BY session_id)
SELECT device_id, max(code) AS worst, count(*) AS runs FROM o JOIN sessions USING (session_id) GROUP BY device_id""")
def runs_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Worst status over the sessions of a device."""
    c = _checks(spark, d).join(read_table(spark, d, "sessions").select("session_id", "device_id"), "session_id")
    return reports.worst_runs(c, "session_id", "device_id")


@query(f"""WITH {FRAMES_SQL} SELECT frame_id, concat_ws(',', CASE WHEN NOT list_contains(map_keys(raw_cards), 'OBJECT') THEN 'OBJECT' END, CASE WHEN NOT list_contains(map_keys(raw_cards), 'EXPTIME') THEN 'EXPTIME' END, CASE WHEN NOT list_contains(map_keys(raw_cards), 'FOCALLEN') THEN 'FOCALLEN' END,
 CASE WHEN NOT coalesce(abs(try_cast(raw_cards['XPIXSZ'] AS DOUBLE) - 3.84) <= 0.05 OR abs(try_cast(raw_cards['XPIXSZ'] AS DOUBLE) - 2.31) <= 0.05, false) THEN 'XPIXSZ' END) AS missing FROM fr""")
def header_check(spark: SparkSession, d: str) -> DataFrame:
    """Mandatory cards that a header lacks, and a pixel size off the expected ones."""
    return reports.header_gaps(frames(spark, d, "raw_cards"), ["frame_id"], "raw_cards", ["OBJECT", "EXPTIME", "FOCALLEN"], (3.84, 2.31)).select("frame_id", "missing")


@query("""WITH m AS (SELECT *, median(l_extendedprice) OVER (PARTITION BY l_suppkey) m FROM lineitem), s AS (SELECT *, 1.4826 * median(abs(l_extendedprice - m)) OVER (PARTITION BY l_suppkey) s FROM m)
SELECT l_suppkey, sum((l_extendedprice > m + 1.5 * s)::INT)::BIGINT AS hot, sum((l_extendedprice > m + 1.5 * s)::INT) > 60 AS recommend FROM s GROUP BY l_suppkey""")
def preflight_hot(spark: SparkSession, d: str) -> DataFrame:
    """Values far over the median, and whether a correction is advised."""
    return reports.hot_counts(read_table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", 1.5, 60)


@query(f"""WITH {FRAMES_SQL}, g AS (SELECT exptime, gain, filter_name AS filter, eq_mode, count(*) AS frames FROM fr WHERE frame_type = 'light' AND exptime IS NOT NULL AND gain IS NOT NULL GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY exptime, gain, filter) AS n FROM g)
SELECT concat_ws('_', CASE WHEN exptime = floor(exptime) THEN (floor(exptime)::BIGINT)::VARCHAR ELSE exptime::VARCHAR END || 's' || gain::VARCHAR, filter) || CASE WHEN n > 1 THEN CASE WHEN eq_mode = 1 THEN '_EQ' WHEN eq_mode = 0 THEN '_AZ' ELSE '_NA' END ELSE '' END AS label,
 exptime, gain, filter, eq_mode, frames, CASE WHEN exptime < 1 THEN 'moon' WHEN frames < 3 THEN 'skipped' ELSE 'ok' END AS status FROM n""")
def organise(spark: SparkSession, d: str) -> DataFrame:
    """Capture groups with their labels and status."""
    f = frames(spark, d, "frame_type", "exptime", "gain", "filter_name", "eq_mode").where("frame_type = 'light' and exptime is not null and gain is not null")
    return groups.organise(f.withColumnRenamed("filter_name", "filter"))


@query(f"""WITH {FRAMES_SQL}, l AS (SELECT * FROM fr WHERE frame_type = 'light'), a AS (SELECT session_id, count(*) AS lights, round(sum(CASE WHEN exptime > 0 THEN exptime END), 3) AS seconds, arg_min(object_name, idx) FILTER (object_name IS NOT NULL) AS target,
 arg_min(eq_mode, idx) FILTER (eq_mode IS NOT NULL) AS eq_mode FROM l GROUP BY session_id), f AS (SELECT session_id, filter_name, min(idx) i FROM l WHERE filter_name IS NOT NULL GROUP BY ALL), g AS (SELECT session_id, string_agg(filter_name, '|' ORDER BY i, filter_name) AS filters FROM f GROUP BY session_id)
SELECT a.session_id, lights, seconds, target, eq_mode, filters FROM a LEFT JOIN g USING (session_id)""")
def context_summary(spark: SparkSession, d: str) -> DataFrame:
    """First target and mount by order of capture, filters as first seen, totals."""
    light = frames(spark, d, "session_id", "idx", "frame_type", "exptime", "object_name", "eq_mode", "filter_name").where("frame_type = 'light'")
    return reports.session_summary(light, "session_id")


@query(f"""WITH c AS (SELECT {_RADEC.format(k='c_custkey', a='c_acctbal')}, 5 + abs(c_acctbal) / 800 AS mag FROM customer), h AS (SELECT *, degrees(2 * asin(sqrt(least(pow(sin((radians(dec) - radians(10.0)) / 2), 2) + cos(radians(dec)) * cos(radians(10.0)) * pow(sin(radians(ra - 180.0) / 2), 2), 1.0)))) AS sep FROM c)
SELECT id, round(sep, 6) AS sep_deg, round(pow(10, -mag / 2.5), 9) AS flux FROM h WHERE sep <= 40 AND mag > 6 AND mag < 16""")
def catalog_cone(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue entries within 40° of a direction, between magnitudes 6 and 16, with their flux."""
    c = read_table(spark, d, "customer")
    a, b = F.col("c_acctbal") * 37.0 / 360.0, F.col("c_acctbal") * 17.0 / 180.0
    cat = c.select(F.col("c_custkey").alias("id"), ((a - F.floor(a)) * 360.0).alias("ra"), ((b - F.floor(b)) * 180.0 - 90.0).alias("dec"), (5 + F.abs("c_acctbal") / 800).alias("mag"))
    cone = spatial.in_cone(cat.where("mag > 6 and mag < 16"), 180.0, 10.0, 40.0)
    return cone.select("id", R6("sep_deg").alias("sep_deg"), F.round(F.pow(F.lit(10.0), -F.col("mag") / 2.5), 9).alias("flux"))


ASKED_NAMES = ["ind", "INDIA", "united", "fra", "germny", "xx"]
_AN = "(VALUES " + ", ".join(f"('{a}')" for a in ASKED_NAMES) + ") a(asked)"


@query(f"""WITH j AS (SELECT asked, n_name FROM {_AN} LEFT JOIN nation ON starts_with(lower(n_name), lower(asked))), h AS (SELECT asked, count(n_name) k, max(n_name) o, max(CASE WHEN lower(n_name) = lower(asked) THEN n_name END) e FROM j GROUP BY asked),
 f AS (SELECT asked, coalesce(e, CASE WHEN k = 1 THEN o END) AS match FROM h), c AS (SELECT asked, n_name, row_number() OVER (PARTITION BY asked ORDER BY levenshtein(lower(n_name), lower(asked)), n_name) AS r FROM f, (SELECT DISTINCT n_name FROM nation) WHERE match IS NULL)
SELECT f.asked, match, string_agg(c.n_name, ',' ORDER BY r) AS candidates FROM f LEFT JOIN c ON c.asked = f.asked AND r <= 3 GROUP BY f.asked, match""")
def prefix_select(spark: SparkSession, d: str) -> DataFrame:
    """Names by prefix; close ones where nothing or more than one fits."""
    asked = spark.createDataFrame([(a,) for a in ASKED_NAMES], "asked string")
    return groups.resolve_name(read_table(spark, d, "nation"), "n_name", asked)


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, 1 + (l_discount - 0.05) AS scale, (l_tax - 0.04) * 60 AS rotation FROM lineitem), g AS (SELECT *, abs(scale - 1) <= 0.02 AND abs(rotation) <= 2 AS ok FROM m)
SELECT l_orderkey, count(*) AS n, sum(ok::INT)::BIGINT AS registered, CASE WHEN sum(ok::INT) >= 3 THEN 'candidate' WHEN count(*) < 2 THEN 'skip' ELSE 'fallback' END AS branch FROM g GROUP BY l_orderkey""")
def sanity_guard(spark: SparkSession, d: str) -> DataFrame:
    """Registrations within bounds per group, and what follows from their number."""
    scale, rot = 1 + (F.col("l_discount") - 0.05), (F.col("l_tax") - 0.04) * 60
    return reports.sound_registrations(read_table(spark, d, "lineitem"), "l_orderkey", scale, rot)


@query("""SELECT entry_id, translate(replace(catalog_number, ' ', '_'), '()', '') AS safe, regexp_replace(regexp_extract(catalog_number, '^([A-Za-z0-9][A-Za-z0-9 ._-]*)', 1), '[.\\-_ ]+$', '') AS short,
 lower(regexp_replace(trim(coalesce(simbad_name, ''), ' '), '\\s+', ' ', 'g')) AS key FROM cache_entries""")
def name_strings(spark: SparkSession, d: str) -> DataFrame:
    """File names, short names and keys of cache entries."""
    c = read_table(spark, d, "cache_entries")
    return c.select("entry_id", keys.safe_name(F.col("catalog_number")).alias("safe"), keys.short_name(F.col("catalog_number")).alias("short"), keys.name_key(F.coalesce("simbad_name", F.lit(""))).alias("key"))


@query(f"""WITH {FRAMES_SQL} SELECT frame_id, round(CASE WHEN xpixsz > 0 AND focallen > 0 AND NOT isnan(xpixsz) AND NOT isnan(focallen) THEN 206.265 * xpixsz / focallen ELSE 0 END, 6) AS scale,
 round(CASE WHEN xpixsz > 0 AND focallen > 0 AND NOT isnan(xpixsz) AND NOT isnan(focallen) THEN -206.265 * xpixsz / focallen / 3600 ELSE 0 END, 9) AS cdelt1, round(CASE WHEN xpixsz > 0 AND NOT isnan(xpixsz) THEN xpixsz / xbinning END, 6) AS unbinned, 540.5::DOUBLE AS crpix1 FROM fr WHERE frame_type = 'light'""")
def pixel_scale_header(spark: SparkSession, d: str) -> DataFrame:
    """Pixel scale in arc seconds and the header values that follow from it."""
    f = frames(spark, d, "frame_type", "xpixsz", "focallen", "xbinning").where("frame_type = 'light'")
    out = colour.header_scale(f, ["frame_id"], 1080)
    return out.select("frame_id", R6("scale").alias("scale"), F.round("cdelt1", 9).alias("cdelt1"), R6("unbinned").alias("unbinned"), "crpix1")


@query("""WITH k AS (SELECT DISTINCT p_size, p_size / 10.0 AS d FROM part) SELECT p_size, round(CASE WHEN d < 3 THEN sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) ELSE 0 END, 6) + 0.0 AS lanczos3, round(exp(-0.5 * pow(d / 1.0, 2)), 6) AS gaussian,
 (d <= 2)::INT::DOUBLE AS tophat, greatest(least(p_size, 30), 5) AS clamped FROM k""")
def kernel_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the drizzle kernels by distance."""
    sizes = read_table(spark, d, "part").select("p_size").distinct().withColumn("d", F.col("p_size") / 10.0)
    w = {k: image.kernel_weight(F.col("d"), k, F.lit(2.0)) for k in ("lanczos3", "gaussian", "tophat")}
    return sizes.select("p_size", *[R6(c).alias(k) for k, c in w.items()], F.greatest(F.least("p_size", F.lit(30)), F.lit(5)).alias("clamped"))


@query(f"""WITH {FRAMES_SQL}, e AS (SELECT frame_id, CASE WHEN eq_mode IS NOT NULL THEN eq_mode = 1 WHEN exptime <= 60 THEN false END AS eq, CASE WHEN eq_mode IS NOT NULL THEN 'header' WHEN exptime <= 60 THEN 'az_fallback' ELSE 'unknown' END AS source, exptime, contains(lower(coalesce(filter_name, '')), 'duo') OR contains(lower(coalesce(filter_name, '')), 'dual') AS duo FROM fr WHERE frame_type = 'light')
SELECT frame_id, eq, source, CASE WHEN NOT eq THEN 'astroalign' WHEN exptime > 120 THEN 'astroalign' ELSE 'fft' END AS preferred, CASE WHEN eq IS NULL AND NOT duo OR eq AND NOT duo THEN NULL ELSE 'astroalign' END AS advice, CASE WHEN NOT eq OR eq IS NULL AND duo THEN 30 END AS max_rotation FROM e""")
def ladders(spark: SparkSession, d: str) -> DataFrame:
    """Mount, preferred registration and advice for each light frame."""
    f = frames(spark, d, "frame_type", "eq_mode", "exptime", "filter_name").where("frame_type = 'light'")
    e = f.select("*", equipment.eq_flag(F.col("eq_mode"), F.col("exptime")).alias("e")).select("*", "e.eq", "e.source")
    a = equipment.registration_advice(F.col("eq"), F.col("filter_name"))
    return e.select("frame_id", "eq", "source", equipment.preferred_registration(~F.col("eq"), F.col("exptime")).alias("preferred"), a.alias("a")).select("frame_id", "eq", "source", "preferred", "a.*")


@query(f"""WITH {FRAMES_SQL}, l AS (SELECT session_id, device_id, idx, focallen, xpixsz FROM fr WHERE frame_type = 'light'), h AS (SELECT session_id, min(device_id) device_id, arg_min(focallen, idx) FILTER (focallen > 0 AND NOT isnan(focallen)) AS fl FROM l GROUP BY session_id),
 p AS (SELECT device_id, median(focallen) FILTER (focallen > 0 AND NOT isnan(focallen)) AS pf FROM l GROUP BY device_id) SELECT session_id, coalesce(fl, pf) AS focal_length, CASE WHEN fl IS NOT NULL THEN 'header' WHEN pf IS NOT NULL THEN 'profile' ELSE 'none' END AS source FROM h JOIN p USING (device_id)""")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    """Focal length of a session from its headers, else from the device, with its source."""
    light = frames(spark, d, "session_id", "device_id", "idx", "frame_type", "focallen").where("frame_type = 'light'")
    known = F.when((F.col("focallen") > 0) & ~F.isnan("focallen"), F.col("focallen"))
    h = equipment.first_known(light, "session_id", "idx", {"fl": known}).join(light.groupBy("session_id").agg(F.min("device_id").alias("device_id")), "session_id")
    p = light.groupBy("device_id").agg(F.median(known).alias("pf"))
    both = equipment.with_source({"header": F.col("fl"), "profile": F.col("pf")})
    return h.join(p, "device_id").select("session_id", both["value"].alias("focal_length"), both["source"].alias("source"))


@query(f"""WITH {FRAMES_SQL}, c AS (SELECT session_id, count(*) AS frames, sum((frame_type = 'light')::INT)::BIGINT AS lights, round(avg(CASE WHEN frame_type = 'light' AND ccd_temp BETWEEN -60 AND 60 THEN ccd_temp END) - avg(CASE WHEN frame_type = 'dark' THEN ccd_temp END), 6) AS gap FROM fr GROUP BY session_id)
SELECT device_id, s.session_id, back, frames, lights, coalesce(abs(gap) > 5, false) AS temp_mismatch FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY night DESC, session_id DESC) AS back FROM sessions) s LEFT JOIN c USING (session_id) WHERE back <= 2""")
def inventory(spark: SparkSession, d: str) -> DataFrame:
    """The last two sessions of each device with counts and a check of dark temperatures."""
    c = reports.temperature_gap(frames(spark, d, "session_id", "frame_type", "ccd_temp"), "session_id")
    last = groups.last_runs(read_table(spark, d, "sessions").select("session_id", "device_id", "night"), "device_id", ["night", "session_id"])
    return last.join(c, "session_id", "left").select("device_id", "session_id", "back", "frames", "lights", F.coalesce("mismatch", F.lit(False)).alias("temp_mismatch"))


@query(f"""WITH {FRAMES_SQL}, n AS (SELECT frame_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY idx, frame_id) AS k FROM fr) SELECT a.frame_id, q.frame_id IS NOT NULL AS has_quality, a.k AS ordinal FROM n a LEFT JOIN (SELECT DISTINCT frame_id FROM quality) q USING (frame_id)""")
def positional_vs_key(spark: SparkSession, d: str) -> DataFrame:
    """Frames with their quality by key; their ordinal is data, never the join."""
    n = equipment.position(frames(spark, d, "session_id", "idx"), "session_id", ["idx", "frame_id"])
    q = read_table(spark, d, "quality").select("frame_id", F.lit(True).alias("q")).distinct()
    return n.join(q, "frame_id", "left").select("frame_id", F.coalesce("q", F.lit(False)).alias("has_quality"), "ordinal")


@query(f"""WITH {FRAMES_SQL} SELECT session_id, lpad(k::VARCHAR, 5, '0') || ' ' || frame_id AS line, frame_id AS name, k::INTEGER AS ordinal FROM (SELECT session_id, frame_id, row_number() OVER (PARTITION BY session_id ORDER BY idx, frame_id) AS k FROM fr WHERE frame_type = 'light')""")
def ordinal_list(spark: SparkSession, d: str) -> DataFrame:
    """Sequence lines with a padded ordinal, read back into their parts."""
    from ..sources.listing import parse_lines, sequence_lines

    light = frames(spark, d, "session_id", "idx", "frame_type").where("frame_type = 'light'")
    return parse_lines(sequence_lines(light, "session_id", ["idx", "frame_id"], "frame_id", 5))


@query(f"""WITH {FRAMES_SQL}, g AS (SELECT session_id, count(*) AS frames, count(gain) AS with_gain, max(filter_name) AS f FROM fr GROUP BY session_id) SELECT session_id, frames, with_gain, f AS last_filter, f IS NOT NULL AS has_filter FROM g""")
def report_json(spark: SparkSession, d: str) -> DataFrame:
    """A nested report per session as JSON (null keys left out), and its values read back."""
    g = frames(spark, d, "session_id", "gain", "filter_name").groupBy("session_id").agg(F.count("*").alias("frames"), F.count("gain").alias("with_gain"), F.max("filter_name").alias("f"))
    doc = F.to_json(F.struct(F.struct(F.col("frames"), F.struct(F.col("with_gain").alias("gain")).alias("with")).alias("counts"), F.col("f").alias("filter")))
    r = g.select("session_id", doc.alias("doc"))
    get = lambda p: F.get_json_object("doc", p)
    return r.select("session_id", get("$.counts.frames").cast("long").alias("frames"), F.coalesce(get("$.with_gain"), get("$.counts.with.gain")).cast("long").alias("with_gain"), get("$.filter").alias("last_filter"), F.col("doc").contains('"filter"').alias("has_filter"))




@query(f"""WITH s AS (SELECT c_nationkey, c_mktsegment, {_RADEC.format(k='c_custkey', a='c_acctbal')}, 100.0 + c_custkey % 7 AS r, 110.0 + c_custkey % 5 AS g, 95.0 + c_custkey % 11 AS b FROM customer), c AS (SELECT {_RADEC.format(k='s_suppkey', a='s_acctbal')}, 10 + s_suppkey % 3 / 10.0 AS mr, 10.0 AS mg, 10 + s_suppkey % 4 / 10.0 AS mb FROM supplier),
 j AS (SELECT s.*, mr, mg, mb, c.id AS entry, {_CHORD} AS chord FROM s JOIN c ON abs(s.dec - c.dec) <= 6.01), n AS (SELECT * FROM j WHERE chord <= 2 * sin(radians(6.0) / 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY chord, entry) = 1),
 q AS (SELECT c_mktsegment, pow(10, -mr / 2.5) / pow(10, -mg / 2.5) / (r / g) AS qr, pow(10, -mb / 2.5) / pow(10, -mg / 2.5) / (b / g) AS qb FROM n), t AS (SELECT *, quantile_cont(qr, 0.05) OVER w lr, quantile_cont(qr, 0.95) OVER w hr, quantile_cont(qb, 0.05) OVER w lb, quantile_cont(qb, 0.95) OVER w hb FROM q WINDOW w AS (PARTITION BY c_mktsegment)),
 f AS (SELECT c_mktsegment, count(*) AS matched, median(CASE WHEN qr BETWEEN lr AND hr THEN qr END) AS r, median(CASE WHEN qb BETWEEN lb AND hb THEN qb END) AS b FROM t GROUP BY c_mktsegment)
SELECT c_mktsegment, matched, CASE WHEN matched >= 5 THEN round(r, 6) END AS r_factor, CASE WHEN matched >= 5 THEN round(b, 6) END AS b_factor, CASE WHEN matched < 5 THEN 'few_stars' WHEN r BETWEEN 0.5 AND 2 AND b BETWEEN 0.5 AND 2 THEN 'ok' ELSE 'rejected' END AS status FROM f""")
def colour_factors(spark: SparkSession, d: str) -> DataFrame:
    """Channel factors per segment from stars matched with a catalogue."""

    def sky(df: DataFrame, key: str, value: str, name: str, *more) -> DataFrame:
        a, b = F.col(value) * 37.0 / 360.0, F.col(value) * 17.0 / 180.0
        return df.select(F.col(key).alias(name), ((a - F.floor(a)) * 360.0).alias("ra"), ((b - F.floor(b)) * 180.0 - 90.0).alias("dec"), *more)

    k, s = F.col("c_custkey"), F.col("s_suppkey")
    stars = sky(read_table(spark, d, "customer"), "c_custkey", "c_acctbal", "star", "c_mktsegment", (100.0 + k % 7).alias("r"), (110.0 + k % 5).alias("g"), (95.0 + k % 11).alias("b"))
    cat = sky(read_table(spark, d, "supplier"), "s_suppkey", "s_acctbal", "entry", (10 + s % 3 / 10.0).alias("mag_r"), F.lit(10.0).alias("mag_g"), (10 + s % 4 / 10.0).alias("mag_b"))
    out = colour.channel_factors(stars, cat, "c_mktsegment", 6.0)
    return out.select("c_mktsegment", "matched", R6("r_factor").alias("r_factor"), R6("b_factor").alias("b_factor"), "status")


@query(f"""WITH {FRAMES_SQL}, c AS (SELECT frame_id, eq_mode, upper(coalesce(raw_cards['EQUAT'], '')) AS e, upper(coalesce(raw_cards['MOUNT'], '')) AS m, upper(coalesce(raw_cards['TELESCOP'], '')) AS t FROM fr WHERE frame_type = 'light'),
 s AS (SELECT *, CASE WHEN eq_mode IN (0, 1) THEN 'mode' WHEN contains(e, 'AZ') THEN 'equat' WHEN contains(m, 'AZ') THEN 'mount' WHEN contains(t, 'SEESTAR') OR contains(t, 'DWARF II') OR contains(t, 'ZWO ASIAIR') OR contains(t, 'SMARTTELESCOPE') OR contains(t, 'DWARF') AND contains(t, 'MINI') THEN 'telescope' WHEN trim(t) = '' THEN 'unknown' ELSE 'default' END AS source FROM c)
SELECT frame_id, CASE WHEN eq_mode = 0 OR (eq_mode IS NULL OR eq_mode NOT IN (0, 1)) AND (source IN ('equat', 'mount', 'telescope')) THEN 'az' ELSE 'eq' END AS mount, source FROM s""")
def mount_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Mount of each light frame by mode, words and telescope, with its source."""
    f = frames(spark, d, "frame_type", "eq_mode", "raw_cards").where("frame_type = 'light'")
    card = lambda c: F.element_at("raw_cards", c)
    m = equipment.mount_type(F.col("eq_mode"), card("EQUAT"), card("MOUNT"), card("TELESCOP"))
    return f.select("frame_id", m["mount"].alias("mount"), m["source"].alias("source"))


@query("""SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN p_size / 10.0 WHEN p_size % 7 = 0 THEN 1.5 WHEN p_size % 3 = 0 OR p_partkey % 4 IN (1, 2) THEN 1.0 ELSE 2.0 END::DOUBLE AS factor,
 CASE WHEN p_size % 10 = 0 THEN 'explicit' WHEN p_size % 7 = 0 THEN 'preset' WHEN p_size % 3 = 0 OR p_partkey % 4 < 3 THEN 'auto_data' ELSE 'default' END AS source FROM part""")
def debayer_scale(spark: SparkSession, d: str) -> DataFrame:
    """Scale factor by precedence: explicit, preset, colour input, method."""
    p = read_table(spark, d, "part")
    method = F.element_at(F.array(*map(F.lit, ("superpixel", "bilinear", "malvar", "other"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    size = F.col("p_size")
    f = equipment.debayer_factor(method, size % 3 == 0, F.when(size % 10 == 0, size / 10.0), F.when(size % 7 == 0, 1.5))
    return p.select("p_partkey", f["factor"].alias("factor"), f["source"].alias("source"))


@query(f"""WITH {FRAMES_SQL}, l AS (SELECT * FROM fr WHERE frame_type = 'light' AND exptime IS NOT NULL), g AS (SELECT session_id, exptime, trim(arg_min_null(object_name, idx), ' ') AS o FROM l GROUP BY ALL),
 e AS (SELECT session_id, o, count(*) AS n, min(exptime) AS g FROM g WHERE o <> '' GROUP BY ALL)
SELECT session_id, arg_min(o, (-n, g, o)) AS object, string_agg(o, '|' ORDER BY g, o) AS objects, count(*) > 1 AS mixed FROM e GROUP BY session_id""")
def object_scan(spark: SparkSession, d: str) -> DataFrame:
    """Targets named by the first frame of each exposure group of a session."""
    light = frames(spark, d, "session_id", "idx", "frame_type", "exptime", "object_name").where("frame_type = 'light'")
    return reports.object_scan(light, "session_id", "exptime", "idx")


@query(f"""WITH {FRAMES_SQL}, c AS (SELECT object_name, count(*) AS lights FROM fr WHERE frame_type = 'light' AND object_name IS NOT NULL GROUP BY 1 ORDER BY lights DESC, object_name LIMIT 5)
SELECT object_name, lights, row_number() OVER (ORDER BY lights DESC, object_name)::INTEGER AS place FROM c""")
def busiest_targets(spark: SparkSession, d: str) -> DataFrame:
    """The five targets with most light frames."""
    return reports.busiest(frames(spark, d, "frame_type", "object_name").where("frame_type = 'light'"), "object_name")


@query(f"""WITH {_GROUPS}, b AS (SELECT max(score) AS b FROM go WHERE frame_count >= 3 AND score > 0), t AS (SELECT group_hash, count(*) OVER () AS n FROM go, b WHERE frame_count >= 3 AND score > 0 AND abs(score - b) <= 1e-12),
 l AS (SELECT group_hash FROM go ORDER BY frame_count DESC, ord LIMIT 1), m AS (SELECT coalesce((SELECT max(n) FROM t), 0) = 1 AS single)
SELECT 'signal' AS asked, CASE WHEN single THEN 'signal' ELSE 'largest' END AS method, CASE WHEN single THEN (SELECT min(group_hash) FROM t) ELSE l.group_hash END AS reference, (SELECT count(score) FROM go)::BIGINT AS scored, CASE WHEN NOT single THEN 'signal gave no single group' END AS fallback FROM l, m""")
def score_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """The report on the choice of a reference by signal."""
    g = _groups(spark, d)
    out = reports.selection_report(g, "group_hash", groups.reference_by_signal(g, "group_hash"), "signal")
    scored = F.size(F.map_keys(F.map_filter(F.from_json("scores", "map<string,double>"), lambda k, v: v.isNotNull()))).cast("long")
    return out.select("asked", "method", "reference", scored.alias("scored"), "fallback")
