"""Target caches: a JSON array of flat records, or headings with key/value tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

COLUMNS = ["catalog_number", "simbad_name", "type", "ra", "dec", "aliases"]


def parse_markdown(text: str) -> list[dict[str, str]]:
    """One record per level-3 heading; rows of its table give the fields."""
    out: list[dict[str, str]] = []
    for line in text.splitlines():
        if line.startswith("### "):
            out.append({"catalog_number": line[4:].strip()})
        elif out and (m := re.match(r"\|\s*([^|]+?)\s*\|\s*([^|]*?)\s*\|\s*$", line)) and not set(m[1]) <= set("-: "):
            out[-1][re.sub(r"\W+", "_", m[1].strip("* ").lower())] = m[2].strip()
    return out


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """ord and the six text columns of a cache file (a short list kept by a person)."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    rows = json.loads(text) if path.endswith(".json") else parse_markdown(text)
    data = [(i, *[None if r.get(c) is None else str(r[c]) for c in COLUMNS]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "ord int, " + ", ".join(f"{c} string" for c in COLUMNS))
