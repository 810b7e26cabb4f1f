"""Sequence files: lines of a padded ordinal and a name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sequence_lines(df: DataFrame, group: str, order: list[str], name: str, width: int = 5) -> DataFrame:
    """group, line: ordinals from 1 in the given order within the group."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("string")
    # Longer ordinals aren't cut.
    padded = F.lpad(n, F.greatest(F.length(n), F.lit(width)), F.lit("0"))
    return df.select(group, F.concat_ws(" ", padded, F.col(name)).alias("line"))


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with name and ordinal; null where a line has no ordinal."""
    parts = F.split(line, " ", 2)
    return lines.withColumns({"name": F.get(parts, F.lit(1)), "ordinal": F.get(parts, F.lit(0)).try_cast("int")})


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """line, name, ordinal of a sequence file; blank lines are left out."""
    text = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("line"))
    return parse_lines(text)


def write_sequence(lines: DataFrame, path: str) -> None:
    """Writes `line` as text, one file per partition of the group's output."""
    lines.select("line").write.mode("overwrite").text(path)
