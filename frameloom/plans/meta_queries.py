"""Queries on frame metadata: grouping, parsing, filters, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import equipment, reports, selection
from ..session import read_table
from .catalog import query

# One row per frame: repeated deliveries are equal but for received_at.
FRAMES_SQL = """fr AS (SELECT * FROM frames QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY received_at) = 1)"""
HASH_SQL = """(CASE WHEN e = floor(e) THEN (floor(e)::BIGINT)::VARCHAR ELSE e::VARCHAR END || 's' || g::VARCHAR ||
  CASE WHEN lower(replace(trim(f, ' '), ' ', '_')) NOT IN ('', 'none') THEN '_' || lower(replace(trim(f, ' '), ' ', '_')) ELSE '' END)"""


def frames(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return read_table(spark, d, "frames").select("frame_id", *[c for c in cols if c != "frame_id"]).dropDuplicates(["frame_id"])


def quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality rows, repeated ones once."""
    return read_table(spark, d, "quality").distinct()


@query(f"""WITH {FRAMES_SQL}, k AS (SELECT coalesce(exptime, 0.0) e, coalesce(gain, 0) g, coalesce(filter_name, 'none') f FROM fr WHERE frame_type = 'light')
SELECT {HASH_SQL} AS group_hash, e AS exptime, g AS gain, f AS filter_name, count(*) AS frame_count, round(sum(e), 3) AS total_exposure FROM k GROUP BY e, g, f""")
def group_overview(spark: SparkSession, d: str) -> DataFrame:
    """Acquisition groups of the light frames with count and exposure."""
    light = frames(spark, d, "frame_type", "exptime", "gain", "filter_name").where("frame_type = 'light'")
    e, g, f = F.coalesce("exptime", F.lit(0.0)), F.coalesce("gain", F.lit(0)), F.coalesce("filter_name", F.lit("none"))
    groups = light.groupBy(e.alias("exptime"), g.alias("gain"), f.alias("filter_name")).agg(
        F.count("*").alias("frame_count"), F.round(F.sum(e), 3).alias("total_exposure")
    )
    return groups.select(keys.group_hash(F.col("exptime"), F.col("gain"), F.col("filter_name")).alias("group_hash"), "exptime", "gain", "filter_name", "frame_count", "total_exposure")


@query(f"""WITH {FRAMES_SQL}, k AS (SELECT frame_type, lower(trim(filter_name, ' ')) f, exptime FROM fr),
c AS (SELECT frame_type, CASE WHEN f IS NULL OR f = '' THEN 'unknown'
  WHEN regexp_replace(f, '[\\s_]+', '-', 'g') IN ('astro', 'l', 'luminance', 'clear') THEN 'astro'
  WHEN regexp_replace(f, '[\\s_]+', '-', 'g') IN ('duo-band', 'duo', 'dual', 'duoband') THEN 'duo-band'
  ELSE regexp_replace(f, '[\\s_]+', '-', 'g') END AS filter_class, exptime FROM k)
SELECT frame_type, filter_class, count(*) AS frame_count, count(exptime) AS with_exptime, count(DISTINCT exptime) AS exptimes FROM c GROUP BY ALL""")
def group_null_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Frames by type and normalised filter; null and blank filters are `unknown`."""
    rows = frames(spark, d, "frame_type", "filter_name", "exptime")
    return rows.groupBy("frame_type", keys.filter_class(F.col("filter_name")).alias("filter_class")).agg(
        F.count("*").alias("frame_count"), F.count("exptime").alias("with_exptime"), F.count_distinct("exptime").alias("exptimes")
    )


@query(f"""WITH {FRAMES_SQL} SELECT session_id, count(*) AS lights, round(coalesce(sum(CASE WHEN exptime > 0 THEN exptime END), 0), 3) AS integration
FROM fr WHERE frame_type = 'light' GROUP BY session_id""")
def total_integration(spark: SparkSession, d: str) -> DataFrame:
    """Light frames and seconds per session; exposures of 0 don't count."""
    light = frames(spark, d, "session_id", "frame_type", "exptime").where("frame_type = 'light'")
    return light.groupBy("session_id").agg(F.count("*").alias("lights"), F.round(F.coalesce(F.sum(F.when(F.col("exptime") > 0, F.col("exptime"))), F.lit(0.0)), 3).alias("integration"))


@query(f"""WITH {FRAMES_SQL} SELECT frame_id, session_id, n AS ordinal FROM (SELECT frame_id, session_id,
  row_number() OVER (PARTITION BY session_id, exptime, gain, filter_name ORDER BY idx, frame_id) n FROM fr WHERE frame_type = 'light') WHERE n <= 5""")
def limit_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The first five light frames of each acquisition group of a session."""
    light = frames(spark, d, "session_id", "idx", "frame_type", "exptime", "gain", "filter_name").where("frame_type = 'light'")
    first = reports.first_of_each(light, ["session_id", "exptime", "gain", "filter_name"], ["idx", "frame_id"], 5)
    return first.select("frame_id", "session_id", "ordinal")


# Spellings of the sensor temperature, in the order they are tried.
TEMP_ALIASES = ["CCD-TEMP", "TEMPERAT", "TEMP", "CCD_TEMP", "SET-TEMP", "CCDTEMP", "DET-TEMP"]
_FIRST = " ".join(f"WHEN list_contains(map_keys(raw_cards), '{a}') THEN raw_cards['{a}']" for a in TEMP_ALIASES)


@query(f"""WITH {FRAMES_SQL}, t AS (SELECT frame_id, CASE {_FIRST} END AS card FROM fr)
SELECT frame_id, card, try_cast(regexp_replace(trim(card, ' '), '\\s*[a-zA-Z/°]+$', '') AS DOUBLE) AS temp,
  try_cast(trunc(try_cast(regexp_replace(trim(card, ' '), '\\s*[a-zA-Z/°]+$', '') AS DOUBLE)) AS INTEGER) AS temp_int FROM t WHERE card IS NOT NULL""")
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Sensor temperature by the first alias present, unit removed, also truncated to whole degrees."""
    cards = frames(spark, d, "raw_cards")
    card = cards.select("frame_id", keys.first_present(F.col("raw_cards"), TEMP_ALIASES).alias("card")).where("card is not null")
    n = keys.without_unit(F.col("card"))
    return card.select("frame_id", "card", n.alias("temp"), n.try_cast("int").alias("temp_int"))


@query(f"""WITH {FRAMES_SQL}, v AS (SELECT frame_id, raw_cards AS m, coalesce(nullif(raw_cards['DET-TEMP'], ''), {', '.join(f"nullif(raw_cards['{a}'], '')" for a in TEMP_ALIASES)}) AS v,
 list_sort(list_filter(map_keys(raw_cards), lambda k: lower(k) = 'det-temp' AND raw_cards[k] <> ''))[1] AS loose FROM fr)
SELECT frame_id, coalesce(v, m[loose]) AS card FROM v""")
def alias_scan(spark: SparkSession, d: str) -> DataFrame:
    """The sensor temperature as written, under any alias, or its card's name in another case."""
    return frames(spark, d, "raw_cards").select("frame_id", keys.raw_card(F.col("raw_cards"), "DET-TEMP", TEMP_ALIASES).alias("card"))


@query("""SELECT l_orderkey, l_linenumber, try_cast(regexp_replace(t, '\\s*[a-zA-Z/]+$', '') AS DOUBLE) AS value,
  try_cast(trunc(try_cast(regexp_replace(t, '\\s*[a-zA-Z/]+$', '') AS DOUBLE)) AS INTEGER) AS whole
FROM (SELECT l_orderkey, l_linenumber, (l_quantity::BIGINT)::VARCHAR || CASE l_linenumber % 4 WHEN 0 THEN 's' WHEN 1 THEN ' mm/s' WHEN 2 THEN '' ELSE 'x9' END AS t FROM lineitem)""")
def unit_stripping(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with and without units; text that isn't a number gives null."""
    rows = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    k = F.col("l_linenumber") % 4
    text = F.concat(F.col("l_quantity").cast("long").cast("string"), F.when(k == 0, "s").when(k == 1, " mm/s").when(k == 2, "").otherwise("x9"))
    number = F.regexp_replace(F.trim(text), r"\s*[a-zA-Z/]+$", "").try_cast("double")
    return rows.select("l_orderkey", "l_linenumber", number.alias("value"), number.try_cast("int").alias("whole"))


_NAME_SQL = """CASE frame_type WHEN 'dark' THEN 'dark_exp_' || coalesce(exptime, 0.0)::VARCHAR || '_gain_' || coalesce(gain, 0)::VARCHAR || '_bin_' || xbinning::VARCHAR || '_21C_stack_1.fits'
  WHEN 'flat' THEN 'flat_' || coalesce(exptime, 0.0)::VARCHAR || 's_' || coalesce(gain, 0)::VARCHAR || 'g_-5C_2.fits'
  WHEN 'bias' THEN 'Bias_' || coalesce(exptime, 0.0)::VARCHAR || 's' || coalesce(gain, 0)::VARCHAR || '.fits'
  ELSE 'T ' || session_id::VARCHAR || '_' || coalesce(exptime, 0.0)::VARCHAR || 's' || coalesce(gain, 0)::VARCHAR || '_Astro_20260717-231509939_33C.fits' END"""


@query(f"""WITH {FRAMES_SQL}, n AS (SELECT frame_id, {_NAME_SQL} AS name FROM fr),
p AS (SELECT frame_id, name,
 regexp_extract(name, '(?i)(.+?)[_-]([\\d.]+)s[_-]?(\\d+)[_-](Astro|Duo-Band)[_-](\\d{{8}})[-_]?(\\d{{6,}})?[_-](-?\\d+)C', ['t','e','g','f','d','c','k']) l,
 regexp_extract(name, '(?i)(?:dark|bias|flat|offset)(?:_exp)?_?([\\d.]+)(?:s|sec)?_gain[_-]?(\\d+)_bin[_-]?(\\d+)(?:_(-?\\d+)C)?_stack[_-]?(\\d+)', ['e','g','b','k','s']) a,
 regexp_extract(name, '(?i)(?:dark|bias|flat|offset)(?:_exp)?_?([\\d.]+)(?:s|sec)?[_-](\\d+)g[_-](-?\\d+)C(?:_(\\d+))?', ['e','g','k','s']) w,
 regexp_extract(name, '(?i)(?:dark|bias|flat|offset)(?:_exp)?_?([\\d.]+)s(\\d+)', ['e','g']) c FROM n)
SELECT frame_id, CASE WHEN l.g <> '' THEN 'light' WHEN a.g <> '' THEN 'dark' WHEN w.g <> '' THEN 'dark_short' WHEN c.g <> '' THEN 'dark_compact' END AS pattern,
 try_cast(CASE WHEN l.g <> '' THEN l.e WHEN a.g <> '' THEN a.e WHEN w.g <> '' THEN w.e ELSE c.e END AS DOUBLE) AS exptime,
 try_cast(CASE WHEN l.g <> '' THEN l.g WHEN a.g <> '' THEN a.g WHEN w.g <> '' THEN w.g ELSE c.g END AS INTEGER) AS gain,
 try_cast(CASE WHEN l.g <> '' THEN l.k WHEN a.g <> '' THEN a.k WHEN w.g <> '' THEN w.k END AS DOUBLE) AS temp FROM p""")
def filename_parse(spark: SparkSession, d: str) -> DataFrame:
    """Exposure, gain and temperature read back from file names made of the headers."""
    f = frames(spark, d, "session_id", "frame_type", "exptime", "gain", "xbinning")
    e, g = F.coalesce("exptime", F.lit(0.0)).cast("string"), F.coalesce("gain", F.lit(0)).cast("string")
    name = (
        F.when(F.col("frame_type") == "dark", F.concat(F.lit("dark_exp_"), e, F.lit("_gain_"), g, F.lit("_bin_"), F.col("xbinning").cast("string"), F.lit("_21C_stack_1.fits")))
        .when(F.col("frame_type") == "flat", F.concat(F.lit("flat_"), e, F.lit("s_"), g, F.lit("g_-5C_2.fits")))
        .when(F.col("frame_type") == "bias", F.concat(F.lit("Bias_"), e, F.lit("s"), g, F.lit(".fits")))
        .otherwise(F.concat(F.lit("T "), F.col("session_id").cast("string"), F.lit("_"), e, F.lit("s"), g, F.lit("_Astro_20260717-231509939_33C.fits")))
    )
    named = f.select("frame_id", name.alias("name")).select("frame_id", keys.file_metadata(F.col("name")).alias("m"))
    return named.select("frame_id", "m.pattern", "m.exptime", "m.gain", "m.temp")


@query(f"""WITH {FRAMES_SQL}, n AS (SELECT frame_id, lower(CASE idx % 5 WHEN 0 THEN 'img' ELSE frame_type END || '_' || idx::VARCHAR) n, lower(coalesce(object_name, '')) o, frame_type FROM fr)
SELECT frame_id, CASE WHEN contains(n, 'dark') AND contains(n, 'flat') THEN 'dark_flat' WHEN contains(n, 'dark') THEN 'dark' WHEN contains(n, 'flat') THEN 'flat'
 WHEN contains(n, 'bias') OR contains(n, 'offset') THEN 'bias' WHEN contains(n, 'light') OR contains(n, 'obj') OR contains(n, 'image') THEN 'light'
 WHEN contains(o, 'dark') THEN 'dark' WHEN contains(o, 'flat') THEN 'flat' WHEN contains(o, 'bias') OR contains(o, 'offset') THEN 'bias' ELSE 'light' END AS detected FROM n""")
def frame_type(spark: SparkSession, d: str) -> DataFrame:
    """Frame type from a file name, else from the target."""
    f = frames(spark, d, "idx", "frame_type", "object_name")
    name = F.concat(F.when(F.col("idx") % 5 == 0, "img").otherwise(F.col("frame_type")), F.lit("_"), F.col("idx").cast("string"))
    return f.select("frame_id", keys.frame_type(name, F.col("object_name")).alias("detected"))


@query(f"""WITH {FRAMES_SQL} SELECT frame_id, try_strptime(date_obs_card, ['%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%d %H:%M:%S', '%Y/%m/%d %H:%M:%S']) AS ts
FROM fr WHERE regexp_matches(date_obs_card, '^\\d{{4}}.\\d{{2}}.\\d{{2}}.\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d{{1,6}})?$')""")
def timestamp_formats(spark: SparkSession, d: str) -> DataFrame:
    """Header dates in the five plain formats."""
    f = frames(spark, d, "date_obs_card").where(F.col("date_obs_card").rlike(r"^\d{4}.\d{2}.\d{2}.\d{2}:\d{2}:\d{2}(\.\d{1,6})?$"))
    return f.select("frame_id", keys.parse_timestamp(F.col("date_obs_card")).alias("ts"))


@query(f"""WITH {FRAMES_SQL}, m AS (SELECT concat_ws(',', CASE WHEN exptime IS NULL THEN 'exptime' END, CASE WHEN gain IS NULL THEN 'gain' END,
 CASE WHEN object_name IS NULL THEN 'object' END, CASE WHEN ccd_temp IS NULL THEN 'ccd_temp' END) missing, CASE WHEN filter_name IS NULL THEN 1 ELSE 0 END w FROM fr WHERE frame_type = 'light')
SELECT missing, count(*) AS frames, sum(w)::BIGINT AS without_filter, missing <> '' AS aborts FROM m GROUP BY missing""")
def mandatory_check(spark: SparkSession, d: str) -> DataFrame:
    """Light frames by the mandatory columns they lack; missing filters only warn."""
    light = frames(spark, d, "frame_type", "exptime", "gain", "object_name", "ccd_temp", "filter_name").where("frame_type = 'light'")
    out = reports.mandatory(light, {"exptime": "exptime", "gain": "gain", "object_name": "object", "ccd_temp": "ccd_temp"}, "filter_name")
    return out.withColumnRenamed("without", "without_filter")


#: A filter list as a user states it; the second entry is misspelt.
ASKED_FILTERS = [" Duo-Band", "Astroo", "vis", "", "vis"]
_ASKED = "(VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(ASKED_FILTERS)) + ") a(i, f)"


@query(f"""WITH {FRAMES_SQL} SELECT frame_id, filter_name FROM fr WHERE frame_type = 'light'
 AND lower(trim(coalesce(filter_name, ''), ' ')) IN (SELECT lower(trim(f, ' ')) FROM {_ASKED} WHERE trim(f, ' ') <> '')""")
def filter_match(spark: SparkSession, d: str) -> DataFrame:
    """Light frames of the filters asked for, whatever their case and blanks."""
    light = frames(spark, d, "frame_type", "filter_name").where("frame_type = 'light'")
    return reports.of_filters(light, "filter_name", ASKED_FILTERS).select("frame_id", "filter_name")


@query(f"""SELECT lower(trim(f, ' ')) AS asked, min(i)::INTEGER AS position FROM {_ASKED} WHERE trim(f, ' ') <> ''
 AND lower(trim(f, ' ')) NOT IN (SELECT lower(trim(filter_name, ' ')) FROM frames WHERE frame_type = 'light' AND filter_name IS NOT NULL) GROUP BY 1""")
def filter_typos(spark: SparkSession, d: str) -> DataFrame:
    """Filters asked for that no frame has, in the order they were asked for."""
    return reports.unknown_filters(read_table(spark, d, "frames").where("frame_type = 'light'"), "filter_name", ASKED_FILTERS)


@query("""SELECT s.session_id, s.device_id FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM frames f WHERE f.session_id = s.session_id AND f.frame_type = 'light' AND f.exptime > 200)""")
def group_empty(spark: SparkSession, d: str) -> DataFrame:
    """Sessions without a single usable frame (here: a light frame over 200 s)."""
    good = read_table(spark, d, "frames").where("frame_type = 'light' and exptime > 200").select("session_id").distinct()
    return read_table(spark, d, "sessions").select("session_id", "device_id").join(good, "session_id", "left_anti")


@query(f"""WITH {FRAMES_SQL}, k AS (SELECT entry_id, unnest([catalog_number, simbad_name]) n FROM target_cache),
c AS (SELECT min(entry_id) entry_id, regexp_replace(lower(regexp_replace(trim(n, ' '), '\\s+', ' ', 'g')), '[ -]', '', 'g') AS key FROM k WHERE n IS NOT NULL GROUP BY 2)
SELECT frame_id, entry_id FROM fr JOIN c ON regexp_replace(lower(regexp_replace(trim(object_name, ' '), '\\s+', ' ', 'g')), '[ -]', '', 'g') = c.key WHERE frame_type = 'light'""")
def target_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Targets found in the cache by compact name; the first entry of a key wins."""
    names = read_table(spark, d, "target_cache").select("entry_id", F.explode(F.array("catalog_number", "simbad_name")).alias("name"))
    light = frames(spark, d, "frame_type", "object_name").where("frame_type = 'light'")
    return light.join(reports.target_lookup(light, "object_name", names), "object_name").select("frame_id", "entry_id")


_CLASS_SQL = """CASE WHEN t IN ('galaxy','nebula','planetary','snr','dark_nebula','globular','open_cluster','star') THEN t WHEN contains(t, 'galax') THEN 'galaxy' WHEN contains(t, 'planetar') THEN 'planetary'
 WHEN contains(t, 'emission') AND contains(t, 'reflect') THEN 'nebula' WHEN contains(t, 'supernova') OR contains(t, 'snr') THEN 'snr' WHEN contains(t, 'emission') THEN 'nebula'
 WHEN contains(t, 'dunkelnebel') OR contains(t, 'dark nebula') THEN 'dark_nebula' WHEN contains(t, 'globular') OR contains(t, 'kugelsternhaufen') THEN 'globular'
 WHEN contains(t, 'open cluster') OR contains(t, 'offener sternhaufen') THEN 'open_cluster' WHEN contains(t, 'stern') OR contains(t, 'star') THEN 'star' ELSE 'unknown' END"""


@query(f"""WITH a AS (SELECT entry_id, target_type t0 FROM cache_entries UNION ALL SELECT entry_id, simbad_name FROM target_cache),
c AS (SELECT entry_id, lower(trim(coalesce(t0, ''), ' ')) t FROM a), d AS (SELECT entry_id, {_CLASS_SQL} AS object_class FROM c)
SELECT entry_id, object_class, CASE WHEN object_class = 'galaxy' THEN 'galaxy_standard' WHEN object_class IN ('nebula','planetary','snr','dark_nebula') THEN 'nebula_standard'
 WHEN object_class IN ('globular','open_cluster','star') THEN 'star_standard' END AS preset FROM d""")
def classify_type(spark: SparkSession, d: str) -> DataFrame:
    """Object class and preset of cache entries (type text) and targets (name)."""
    texts = read_table(spark, d, "cache_entries").select("entry_id", F.col("target_type").alias("t")).unionByName(
        read_table(spark, d, "target_cache").select("entry_id", F.col("simbad_name").alias("t"))
    )
    presets = F.create_map(*[F.lit(x) for kv in keys.PRESETS.items() for x in kv])
    return texts.select("entry_id", keys.object_class(F.col("t")).alias("object_class")).withColumn("preset", F.element_at(presets, F.col("object_class")))


_Q = "q AS (SELECT DISTINCT * FROM quality)"
_FIN = lambda c: f"(CASE WHEN isfinite({c}::DOUBLE) THEN {c}::DOUBLE END)"


def _mad_sql(metrics: list[str]) -> str:
    v = ", ".join(f"{_FIN(m)} AS v_{m}" for m in metrics)
    med = ", ".join(f"median(v_{m}) OVER (PARTITION BY group_hash) AS m_{m}" for m in metrics)
    sig = ", ".join(f"1.4826 * median(abs(v_{m} - m_{m})) OVER (PARTITION BY group_hash) AS s_{m}, count(v_{m}) OVER (PARTITION BY group_hash) AS n_{m}" for m in metrics)
    return f"{_Q}, a AS (SELECT *, {v} FROM q), b AS (SELECT *, {med} FROM a), c AS (SELECT *, {sig} FROM b)"


_OUT = "concat_ws(',', " + ", ".join(f"CASE WHEN n_{m} >= 2 AND s_{m} > 1e-12 AND abs(v_{m} - m_{m}) > 3 * s_{m} THEN '{m}' END" for m in ("snr", "fwhm_median", "star_count")) + ")"


@query(f"WITH {_mad_sql(['snr', 'fwhm_median', 'star_count'])} SELECT frame_id, group_hash, {_OUT} <> '' AS outlier, nullif({_OUT}, '') AS outlier_reason FROM c")
def mad_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Frames off their group's median in snr, fwhm or star count."""
    out = selection.mad_outliers(quality(spark, d), "group_hash", ["snr", "fwhm_median", "star_count"])
    return out.select("frame_id", "group_hash", "outlier", "outlier_reason")


BOUNDS = {"star_count": (40.0, None), "fwhm": (None, 3.6), "snr": (8.0, None), "correlation": (0.6, None), "double_rate": (None, 0.2)}
_THR = f"""concat_ws(',', CASE WHEN elongation_unusable THEN 'elongation' END, CASE WHEN {_FIN('star_count')} < 40 THEN 'star_count' END, CASE WHEN {_FIN('fwhm_median')} > 3.6 THEN 'fwhm' END,
 CASE WHEN {_FIN('snr')} < 8 THEN 'snr' END, CASE WHEN {_FIN('correlation')} < 0.6 THEN 'correlation' END, CASE WHEN {_FIN('double_rate')} > 0.2 THEN 'double_rate' END)"""


@query(f"WITH {_Q} SELECT frame_id, nullif({_THR}, '') AS reasons FROM q")
def threshold_reject(spark: SparkSession, d: str) -> DataFrame:
    """Reasons for which a frame misses the bounds."""
    return quality(spark, d).select("frame_id", selection.threshold_reasons(BOUNDS).alias("reasons"))


@query(f"""WITH {_Q} SELECT frame_id, group_hash, (correlation IS NULL OR correlation >= 0.8) OR sum(CASE WHEN correlation IS NULL OR correlation >= 0.8 THEN 1 ELSE 0 END) OVER (PARTITION BY group_hash) = 0 AS gate,
 (correlation IS NULL OR correlation >= 0.8) AS strict_gate FROM q""")
def low_corr_gate(spark: SparkSession, d: str) -> DataFrame:
    """Frames that correlate with their group; a group isn't emptied."""
    gated = selection.correlation_gate(quality(spark, d), "group_hash", 0.8)
    return gated.select("frame_id", "group_hash", "gate", (F.col("correlation").isNull() | (F.col("correlation") >= 0.8)).alias("strict_gate"))


def _score_sql() -> str:
    ms = {"snr": 1, "star_count": 1, "fwhm_median": -1, "elongation_ratio": 1}
    t = " + ".join(
        f"CASE WHEN n_{m} > 0 THEN coalesce(greatest(least(0.5 + ({s} * (v_{m} - m_{m}) / CASE WHEN n_{m} < 2 OR s_{m} <= 1e-12 THEN 1.0 ELSE s_{m} END) / 6.0, 1.0), 0.0), 0.0) ELSE 0.0 END" for m, s in ms.items()
    )
    n = " + ".join(f"CASE WHEN n_{m} > 0 THEN 1.0 ELSE 0.0 END" for m in ms)
    miss = " OR ".join(f"(n_{m} > 0 AND v_{m} IS NULL)" for m in ms)
    return f"{_mad_sql(list(ms))}, sc AS (SELECT *, CASE WHEN ({miss}) OR ({n}) <= 0 THEN 0.0 ELSE ({t}) / ({n}) END AS score FROM c)"


@query(f"WITH {_score_sql()} SELECT frame_id, group_hash, round(score, 6) AS score FROM sc")
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    """Score of each frame within its group."""
    return selection.composite_score(quality(spark, d), "group_hash").select("frame_id", "group_hash", F.round("score", 6).alias("score"))


_KEEP = """kp AS (SELECT *, row_number() OVER (PARTITION BY group_hash ORDER BY rs DESC, frame_id, ROWKEY) AS rank, count(*) OVER (PARTITION BY group_hash) n FROM (SELECT *, round(score, 9) rs FROM sc)),
 k2 AS (SELECT *, CASE WHEN n - floor(n * 8.0 / 100.0) < 3 THEN n ELSE n - floor(n * 8.0 / 100.0) END AS k FROM kp)""".replace(", ROWKEY", "")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    # Scores are rounded before ranking, so that sums in another order rank alike.
    q = quality(spark, d).dropDuplicates(["frame_id"])
    return selection.composite_score(q, "group_hash").withColumn("rs", F.round("score", 9))


@query(f"WITH {_score_sql()}, {_KEEP} SELECT frame_id, group_hash, rank, rank <= k AS keep, round(min(CASE WHEN rank <= k THEN rs END) OVER (PARTITION BY group_hash), 6) AS cutoff FROM k2")
def percentile_keep(spark: SparkSession, d: str) -> DataFrame:
    """The best 92 % of each group."""
    kept = selection.percentile_keep(_scored(spark, d), "group_hash", "rs", "frame_id")
    return kept.select("frame_id", "group_hash", "rank", "keep", F.round("cutoff", 6).alias("cutoff"))


@query(f"""WITH {_score_sql()}, {_KEEP}, f AS (SELECT *, rank <= k AS keep, nullif({_THR}, '') AS why FROM k2),
 g AS (SELECT *, keep AND why IS NULL AS inn, (correlation IS NULL OR correlation >= 0.7) AS ok FROM f),
 h AS (SELECT *, ok OR sum(CASE WHEN inn AND ok THEN 1 ELSE 0 END) OVER (PARTITION BY group_hash) = 0 AS gate FROM g),
 r AS (SELECT *, CASE WHEN NOT keep THEN 'percentile' WHEN why IS NOT NULL THEN 'threshold:' || why WHEN NOT gate THEN 'low_correlation' END AS reason FROM h)
 SELECT frame_id, group_hash, CASE WHEN reason IS NULL THEN 'kept' ELSE 'discarded' END AS decision, reason FROM r""")
def selection_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Decision and reason of each frame: percentile, thresholds, correlation."""
    q = quality(spark, d).dropDuplicates(["frame_id"])
    out = selection.funnel(q, "group_hash", "frame_id", BOUNDS, min_correlation=0.7)
    return out.select("frame_id", "group_hash", "decision", "reason")


@query(f"""WITH {_mad_sql(['snr', 'fwhm_median', 'star_count'])}, o AS (SELECT *, {_OUT} <> '' AS outlier FROM c)
 SELECT group_hash, count(*) AS frames, round(median({_FIN('snr')}), 6) AS snr_median, round(median({_FIN('star_count')}), 6) AS star_count_median, round(median({_FIN('correlation')}), 6) AS correlation_median,
 sum(outlier::INT)::BIGINT AS outliers, round(avg(outlier::INT), 6) AS outlier_rate FROM o GROUP BY group_hash""")
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    """Medians and outlier rate per group."""
    return selection.quality_summary(selection.mad_outliers(quality(spark, d), "group_hash", ["snr", "fwhm_median", "star_count"]), "group_hash", 6)


@query(f"""WITH {FRAMES_SQL}, g AS (SELECT session_id, sum((eq_mode = 1)::INT)::BIGINT eq, sum((eq_mode = 0)::INT)::BIGINT az, sum((eq_mode IS NULL)::INT)::BIGINT unknown FROM fr WHERE frame_type = 'light' GROUP BY session_id),
 v AS (SELECT session_id, gain, count(*) n, min(idx) first FROM fr WHERE frame_type = 'light' AND gain IS NOT NULL GROUP BY ALL),
 m AS (SELECT session_id, gain AS main_gain, count(*) OVER (PARTITION BY session_id) AS gains FROM v QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first) = 1)
 SELECT g.session_id, coalesce(eq, 0) AS eq, coalesce(az, 0) AS az, unknown, CASE WHEN coalesce(eq, 0) > coalesce(az, 0) THEN 1 WHEN coalesce(az, 0) > coalesce(eq, 0) THEN 0 END AS majority,
 coalesce(eq, 0) = 0 OR coalesce(az, 0) = 0 AS consistent, main_gain, gains FROM g LEFT JOIN m USING (session_id)""")
def majority_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Mount mode by majority (tie: null) and the most frequent gain (tie: first seen) of a session."""
    light = frames(spark, d, "session_id", "frame_type", "eq_mode", "gain", "idx").where("frame_type = 'light'")
    main = equipment.majority_value(light, "session_id", "gain", "idx").select("session_id", F.col("gain").alias("main_gain"), F.col("different").alias("gains"))
    return equipment.mode_majority(light, "session_id").join(main, "session_id", "left")