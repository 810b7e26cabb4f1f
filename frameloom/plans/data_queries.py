"""Queries p1 and p3 to p6: the data-preparation operators applied to their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, fill, spikes, timestamps, unpack
from ..session import read_table


def _lights(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return read_table(spark, d, "frames").where("frame_type = 'light'").select(*cols)


def _headers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, d, "raw_headers"), read_table(spark, d, "card_aliases")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.field_changes(*_headers(spark, d))


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    """Every header dump in one typed table, with its version, its schema fingerprint and the rules applied."""
    headers, aliases = _headers(spark, d)
    out = drift.unify(headers, aliases, versions=drift.schema_versions(headers, aliases))
    return out.withColumn("steps", F.array_join("steps", "; "))


def p1_migrations(spark: SparkSession, d: str) -> DataFrame:
    """The versions of each device's schema with the steps that lead to them."""
    out = drift.migrations(drift.schema_versions(*_headers(spark, d)))
    told = F.transform("steps", lambda s: F.concat_ws(" ", s["change_kind"], s["field_name"], F.concat(F.coalesce(s["card_was"], F.lit("-")), F.lit(" -> "), F.coalesce(s["card_now"], F.lit("-"))), F.concat(F.coalesce(s["kind_was"], F.lit("-")), F.lit(" -> "), F.coalesce(s["kind_now"], F.lit("-")))))
    return out.withColumn("steps", F.array_join(told, "; "))


def p1_versions(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprints of single dumps seen, with their number of dumps and dates."""
    headers, aliases = _headers(spark, d)
    return drift.versions(headers, drift.unify(headers, aliases))


#: Physically possible readings. Sensors in use stay far inside; exposures are over 0 s.
CCD_RANGE = (-100.0, 80.0)
EXPTIME_RANGE = (1e-6, 86_400.0)


def p3_flags(spark: SparkSession, d: str) -> DataFrame:
    """frame_id, field_name, reason, score of every implausible reading."""
    lights = _lights(spark, d, "frame_id", "device_id", "session_id", "idx", "ccd_temp", "exptime")
    fields = [spikes.Field("ccd_temp", *CCD_RANGE), spikes.Field("exptime", *EXPTIME_RANGE, levels=True, frozen=False)]
    return spikes.flag_fields(lights, "device_id", "session_id", "idx", "frame_id", fields)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_flags(spark, d).select("frame_id", "field_name")


def p3_limits(spark: SparkSession, d: str) -> DataFrame:
    """The impossible readings among the flags, which SQL can find as well."""
    return p3_flags(spark, d).where("reason = 'limit'").select("frame_id", "field_name")


def p4_fills(spark: SparkSession, d: str) -> DataFrame:
    """frame_id, field_name, value, fill_method, fill_distance, fill_level of every filled value."""
    lights = _lights(spark, d, "frame_id", "session_id", "device_id", "idx", "exptime", "gain", "xbinning", "xpixsz", "focallen", "received_at")
    nights = read_table(spark, d, "sessions").groupBy("session_id").agg(F.min(F.datediff("night", F.lit("1970-01-01").cast("date"))).alias("day"))

    def real(name: str):
        return ~F.isnan(name) & (F.col(name) > 0)

    fields = [
        fill.Fill("gain", F.col("gain") >= 0, numeric=False, within=["exptime"]),
        fill.Fill("xpixsz", real("xpixsz"), beyond=["device_id", "xbinning"]),
        fill.Fill("focallen", real("focallen"), beyond=["device_id"]),
    ]
    return fill.fill_fields(lights, "session_id", "idx", "frame_id", fields, nights, "received_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_fills(spark, d).select("frame_id", "field_name", F.round(F.col("value") * 1000).cast("long").alias("value_milli"))


def p5_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every frame: frame_id, utc_second, the format read, its posterior, and a status.

    status: resolved, ambiguous_format, ambiguous_zone (an instant was chosen but
    another is as likely), or unread; `reason` tells why a card denotes no instant.
    """
    frames = read_table(spark, d, "frames")
    sessions = read_table(spark, d, "sessions").dropDuplicates(["session_id"])
    devices = read_table(spark, d, "devices").select("device_id", "clock_mode", F.col("station_id").alias("home"))
    zones = read_table(spark, d, "stations").select("station_id", "tz_name")
    home = zones.select(F.col("station_id").alias("home"), F.col("tz_name").alias("home_tz"))
    clock = (
        sessions.join(zones, "station_id", "left")
        .select("session_id", "tz_name", F.datediff("night", F.lit("1970-01-01").cast("date")).alias("day"))
        .withColumn("fold", timestamps.may_fold(F.col("day"), F.col("tz_name")) | F.col("tz_name").isNull() | F.col("day").isNull())
    )
    device = devices.join(home, "home", "left").select("device_id", "clock_mode", "home_tz")
    time_text = F.coalesce(*[F.element_at("raw_cards", k) for k in ("TIME-OBS", "TIME_OBS", "UTSTART", "TIME")])
    rows = (
        frames.select("frame_id", "device_id", "session_id", "idx", "date_obs_card", time_text.alias("time_text"))
        .join(clock, "session_id", "left")
        .join(device, "device_id", "left")
    )
    keep = ["frame_id", "session_id", "idx", "clock_mode", "tz_name", "home_tz", "fold"]
    chosen = timestamps.choose_readings(rows, "device_id", keep, F.col("date_obs_card"), F.col("day"), F.col("time_text"))
    zone = F.coalesce("tz_name", "home_tz")
    instants = timestamps.to_instants(chosen, ["frame_id", "session_id", "idx", "fold", "why"], F.col("clock_mode") == "utc", zone, F.col("fold"))
    settled = timestamps.settle_folds(instants, "session_id", "idx", ["frame_id", "why"], "fold")
    names = F.array(*map(F.lit, timestamps.FORMATS))
    read = F.col("utc_second").isNotNull()
    status = F.when(~read, "unread").when(F.col("ambiguous_format"), "ambiguous_format").when(F.col("ambiguous_zone"), "ambiguous_zone").otherwise("resolved")
    return settled.select(
        "frame_id", "utc_second", F.get(names, F.col("fmt")).alias("format"), F.round("posterior", 6).alias("posterior"), status.alias("status"),
        F.when(~read, F.coalesce("why", F.lit("no_zone"))).alias("reason"),
    ).dropDuplicates(["frame_id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_instants(spark, d).where("utc_second is not null").select("frame_id", "utc_second")


def p5_unread(spark: SparkSession, d: str) -> DataFrame:
    """The frames whose card denotes no instant, with the reason."""
    return p5_instants(spark, d).where("utc_second is null").select("frame_id", "reason")


def p5_explicit(spark: SparkSession, d: str) -> DataFrame:
    """frame_id, utc_second of the cards that SQL can read as well: ISO with Z and counts of seconds."""
    plain = read_table(spark, d, "frames").where(F.col("date_obs_card").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$|^\d{10}$|^\d{13}$"))
    return p5_found(spark, d).join(plain.select("frame_id"), "frame_id", "left_semi")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """entry_id, pos, alias_text, flag of every packed name."""
    both = read_table(spark, d, "target_cache").select("entry_id", "aliases").unionByName(
        read_table(spark, d, "cache_entries").select("entry_id", "aliases")
    )
    return unpack.unpack(both, "entry_id", "aliases", "alias_text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_items(spark, d).select("entry_id", "pos", "alias_text").distinct()


def p6_simple(spark: SparkSession, d: str) -> DataFrame:
    """The names of entries packed by semicolons alone, which SQL can split as well."""
    both = read_table(spark, d, "target_cache").select("entry_id", "aliases").unionByName(read_table(spark, d, "cache_entries").select("entry_id", "aliases"))
    plain = both.where(F.col("aliases").rlike(r"^[A-Za-z0-9 ]*[A-Za-z0-9](?: ?; ?[A-Za-z0-9 ]*[A-Za-z0-9])+$")).select("entry_id").distinct()
    return p6_found(spark, d).join(plain, "entry_id", "left_semi")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_table, p1_migrations, p1_versions, p3_found, p3_flags, p3_limits, p4_found, p4_fills, p5_found, p5_instants, p5_unread, p5_explicit, p6_found, p6_items, p6_simple)
}
