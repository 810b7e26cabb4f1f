"""Runs of a data folder and the capture session of a target, from file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files that make a folder a run, and the one that tells how it was started.
MARKS = ("run-info.json", "agent-log.yaml")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (below root) and url of every file; the content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("url"))
    tail = F.regexp_replace("url", "^file:(//)?", "")
    return files.select(F.substring(tail, len(root.rstrip("/")) + 2, 1 << 20).alias("path"), "url")


def discover_runs(files: DataFrame) -> DataFrame:
    """target, run, info (url of its run-info.json, null without): folders target/generated/run that hold a mark or a FITS file.

    Targets beginning with _ or . are none.
    """
    parts = F.split("path", "/")
    deep = files.select(parts.alias("p"), "url").where((F.size("p") >= 4) & (F.get("p", F.lit(1)) == "generated") & ~F.get("p", F.lit(0)).rlike("^[_.]"))
    name = F.get("p", F.lit(3))
    sign = (F.size("p") == 4) & (name.isin(*MARKS) | F.lower(name).endswith(".fits"))
    return deep.where(sign).groupBy(F.get("p", F.lit(0)).alias("target"), F.get("p", F.lit(2)).alias("run")).agg(F.max(F.when(name == MARKS[0], F.col("url"))).alias("info"))


def without_smoke(runs: DataFrame) -> DataFrame:
    """The runs that were no trial: their run-info has no smoke_mode, smoke or limit. Unreadable infos keep a run."""
    spark = runs.sparkSession
    told = [r.info for r in runs.where("info is not null").select("info").collect()]  # one small file per run of a data folder
    if not told:
        return runs
    texts = spark.read.text(told, wholetext=True).select(F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("__i"), "value")
    v = F.try_parse_json("value")
    flag = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "boolean"), F.lit(False))
    smoke = texts.where(flag("smoke_mode") | flag("smoke") | F.try_variant_get(v, "$.limit", "string").isNotNull()).select("__i")
    return runs.withColumn("__i", F.regexp_replace("info", "^file:/+", "/")).join(smoke, "__i", "left_anti").drop("__i")


def capture_session(spark: SparkSession, root: str, name: str = "shotsInfo.json") -> DataFrame:
    """path, eq, exp, gain, shots_taken, shots_to_take, target, error of the capture session of a folder; no row without the file.

    The file directly in the folder comes before the first of its subfolders, in the order of paths.
    """
    files = listing(spark, root).where((F.col("path") == name) | F.col("path").endswith("/" + name))
    best = files.agg(F.min_by("url", F.struct(F.col("path") != name, "path")).alias("url")).where("url is not null").first()  # one row
    fields = {"eq": "boolean", "exp": "string", "gain": "int", "shots_taken": "int", "shots_to_take": "int", "target": "string"}
    camel = {"shots_taken": "shotsTaken", "shots_to_take": "shotsToTake"}
    if best is None:
        return spark.createDataFrame([], "path string, " + ", ".join(f"{k} {t}" for k, t in fields.items()) + ", error string")
    text = spark.read.text(best.url, wholetext=True)
    v = F.try_parse_json("value")
    got = [F.coalesce(*[F.try_variant_get(v, f"$.{n}", t) for n in dict.fromkeys((k, camel.get(k, k)))]).alias(k) for k, t in fields.items()]
    return text.select(F.lit(best.url).alias("path"), *got, F.when(v.isNull(), "parse_failed").alias("error"))
