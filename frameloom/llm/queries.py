"""Queries p2 and p7 to p9: the operators of this subpackage applied to their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import unpack
from ..session import read_table
from . import canonical, packing, splitting, tokens

# Other words for the filters of the reference list, the table of further spellings of p2.
FILTER_SPELLINGS = {
    "VIS": ["visible", "visual", "v i s", "visible light"],
    "Luminance": ["l", "lum", "lumi"],
    "Red": ["r", "rot", "rouge", "rojo", "rosso"],
    "Green": ["g", "grn", "gruen", "vert", "verde"],
    "Blue": ["b", "blu", "blau", "bleu", "azul"],
    "H-alpha": ["ha", "h a", "hydrogen alpha", "hydrogen"],
    "O-III": ["o3", "oxygen iii", "oxygen", "oxygen 3"],
    "S-II": ["s2", "sulphur ii", "sulfur ii", "sulphur", "sulfur"],
    "Duo-Band": ["dual band", "dual", "duo", "dual narrowband"],
}


def filter_spellings(spark: SparkSession) -> DataFrame:
    """name, spelling: the words for filters as a table; another list can be given to the operator."""
    return spark.createDataFrame([(n, w) for n, words in FILTER_SPELLINGS.items() for w in words], "name string, spelling string")


def target_names(cache: DataFrame) -> DataFrame:
    """ref_id, name: every name of the reference targets, aliases unpacked."""
    own = cache.select(F.col("entry_id").alias("ref_id"), F.explode(F.array("catalog_number", "simbad_name")).alias("name"))
    more = unpack.unpack(cache, "entry_id", "aliases", "name").select(F.col("entry_id").alias("ref_id"), "name")
    return own.where("name is not null").unionByName(more)


def _fields(spark: SparkSession, d: str) -> list:
    """Field, names that need no mapping, and the mapping of its values, for both fields of p2."""
    cache, filters = read_table(spark, d, "target_cache"), read_table(spark, d, "filter_list")
    official = cache.select(F.explode(F.array("catalog_number", "simbad_name")).alias("v")).where("v is not null").distinct()
    listed = filters.select(F.col("filter_name").alias("v")).where("v is not null").distinct()
    return [
        ("object_name", official, lambda v: canonical.canonicalise(v, target_names(cache), "v")),
        ("filter_name", listed, lambda v: canonical.canonical_filters(v, filters, filter_spellings(spark), "v")),
    ]


def _typed(spark: SparkSession, d: str, field: str) -> DataFrame:
    lights = read_table(spark, d, "frames").where("frame_type = 'light'")
    return lights.select("frame_id", F.col(field).alias("v")).where(F.trim("v") != "")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for field, known, match in _fields(spark, d):
        cases = _typed(spark, d, field).join(known, "v", "left_anti")
        # The mapping has one row per distinct value; whether it is small enough to be
        # broadcast is left to the runtime size check of adaptive execution.
        mapped = cases.join(match(cases.select("v").distinct()), "v", "left")
        parts.append(mapped.select("frame_id", F.lit(field).alias("field_name"), F.coalesce("ref_id", F.lit(0)).cast("long").alias("ref_id")))
    return parts[0].unionByName(parts[1]).dropDuplicates(["frame_id", "field_name"])


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that mean no entry, with the number of deliveries and the reason."""
    out = []
    for field, _, match in _fields(spark, d):
        counts = _typed(spark, d, field).groupBy("v").agg(F.count("*").alias("deliveries"))
        missed = match(counts.select("v")).where("ref_id is null").join(counts, "v")
        out.append(missed.select(F.lit(field).alias("field_name"), F.col("v").alias("typed"), "how", "deliveries"))
    return out[0].unionByName(out[1])


def p2_exact(spark: SparkSession, d: str) -> DataFrame:
    """typed, ref_id: what the operator gives for the targets typed as an official name up to case and separators.

    The values that SQL can map as well; all values go through the operator.
    """
    cache = read_table(spark, d, "target_cache")

    def compact(c: str):
        return F.regexp_replace(F.lower(c), r"[\s_./-]+", "")

    official = cache.select(F.explode(F.array("catalog_number", "simbad_name")).alias("name")).where("name is not null")
    keys = official.select(compact("name").alias("k")).distinct()
    mapped = canonical.canonicalise(_typed(spark, d, "object_name").select("v"), target_names(cache), "v")
    return mapped.withColumn("k", compact("v")).join(keys, "k", "left_semi").select(F.col("v").alias("typed"), "ref_id")


def limits(spark: SparkSession, d: str, name: str) -> tuple[int, int]:
    """max_tokens and overlap_tokens of a limit; the table has one row per limit."""
    row = read_table(spark, d, "token_limits").where(F.col("limit_name") == name).select("max_tokens", "overlap_tokens").first()
    return int(row[0]), int(row[1])


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_ids(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def p7_offsets(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, starts, ends: the characters that each token touches."""
    return tokens.encode_spans(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").drop("ids")


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, n_tokens, same: whether decoding the ids gives the text again."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    back = tokens.decode_ids(tokens.encode_ids(docs, "doc_id", "text"), "doc_id", "ids").withColumnRenamed("text", "back")
    sizes = tokens.count_tokens(docs, "doc_id", "text")
    joined = docs.join(back, "doc_id").join(sizes, "doc_id")
    return joined.select("doc_id", "n_tokens", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, part_no, n_tokens, container_id, place, start, certified."""
    capacity, _ = limits(spark, d, "container")
    sizes = tokens.count_tokens(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", capacity)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers used against the lower bound over all documents."""
    capacity, _ = limits(spark, d, "container")
    return packing.report(p8_containers(spark, d), "n_tokens", capacity)


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, piece_no, start_char, n_tokens, overlap_tokens, boundary, piece."""
    most, overlap = limits(spark, d, "piece")
    return splitting.split_texts(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", most, overlap)


QUERIES = {f.__name__: f for f in (p2_found, p2_unmatched, p2_exact, p7_ids, p7_offsets, p7_roundtrip, p8_containers, p8_report, p9_pieces)}

_COMPACT = "regexp_replace(lower(X), '[\\s_./-]+', '', 'g')"
#: Typing errors and tokens can't be expressed in SQL; tests hold these queries against brute force.
SQL: dict[str, str] = {
    "p2_exact": f"""WITH o AS (SELECT entry_id, catalog_number AS name FROM target_cache UNION SELECT entry_id, simbad_name FROM target_cache),
 k AS (SELECT {_COMPACT.replace('X', 'name')} AS k, min(entry_id) AS ref_id, count(DISTINCT entry_id) AS n FROM o WHERE name IS NOT NULL GROUP BY 1)
 SELECT DISTINCT object_name AS typed, CASE WHEN n = 1 THEN ref_id END AS ref_id FROM frames JOIN k ON k.k = {_COMPACT.replace('X', 'object_name')} WHERE frame_type = 'light' AND trim(object_name) <> ''""",
}
