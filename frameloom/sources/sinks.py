"""Sinks: JSON reports, quantised previews, products with metadata columns."""

from __future__ import annotations

import os
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import tensors
from .fits import write_frames


def quantise(value: Column, bits: int = 16) -> Column:
    """[0, 1] to whole numbers, cut off, values outside clamped; null and NaN give 0."""
    v = F.when(~F.isnan(value), value)
    return (F.least(F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * (2**bits - 1)).cast("int")


def preview(px: DataFrame, frame: list[str], height: int, bits: int = 8) -> DataFrame:
    """Quantised pixels with the first row at the bottom."""
    return px.select(*frame, (height - 1 - F.col("y")).alias("y"), "x", "c", quantise(F.col("value"), bits).alias("value"))


def report(df: DataFrame, key: str, sections: dict[str, list[str]]) -> DataFrame:
    """key, document: nested JSON of the columns by section; nulls are left out."""
    parts = [F.struct(*cols).alias(name) for name, cols in sections.items()]
    return df.select(key, F.to_json(F.struct(key, *parts)).alias("document"))


def write_report(documents: DataFrame, path: str) -> None:
    """One JSON document a line, replacing what was there."""
    documents.select("document").write.mode("overwrite").text(path)


def write_products(px: DataFrame, path: str, by: str = "group_hash") -> None:
    """Pixels as Parquet, one directory per group, so that readers of a group skip the others."""
    px.repartition(by, F.floor(F.col("y") / 256)).write.mode("overwrite").partitionBy(by).parquet(path)


def tiff16(img: np.ndarray) -> bytes:
    """A TIFF of 16-bit grey or RGB from values in 0..1, one strip, flipped so that the first row is at the bottom."""
    a = img[:, :, None] if img.ndim == 2 else img
    h, w, ch = a.shape
    pixels = (np.clip(np.nan_to_num(a[::-1]), 0, 1) * 65535).astype("<u2").tobytes()
    tags = [
        (256, 4, 1, w), (257, 4, 1, h), (258, 3, ch, 16), (259, 3, 1, 1), (262, 3, 1, 2 if ch == 3 else 1), (273, 4, 1, 8), (277, 3, 1, ch), (278, 4, 1, h), (279, 4, 1, len(pixels)), (284, 3, 1, 1),
    ]
    at = 8 + len(pixels)
    extra = at + 2 + 12 * len(tags) + 4
    body = b"".join(struct.pack("<HHII", t, k, n, extra if n > 2 else v) for t, k, n, v in tags)
    more = struct.pack(f"<{ch}H", *[16] * ch) if ch > 2 else b""
    return struct.pack("<2sHI", b"II", 42, at) + pixels + struct.pack("<H", len(tags)) + body + struct.pack("<I", 0) + more


def export(images: DataFrame, key: str, folder: str, stretched: bool = False, a: float = 0.01) -> DataFrame:
    """Writes each tensor (key, h, w, ch, data, optional raw_cards) as FITS, a stretched FITS if asked, and a TIFF preview: key, kind, path.

    The preview shows the asinh stretch scaled to 1. The folder is shared by the executors; as in write_frames a repeated task replaces its own files.
    """
    shown = tensors.stretch(images, [key], "asinh", a)
    out = write_frames(images, key, folder).withColumn("kind", F.lit("fits"))
    if stretched:
        named = shown.withColumn(key, F.concat(F.col(key).cast("string"), F.lit("_stretched")))
        out = out.withColumn(key, F.col(key).cast("string")).unionByName(write_frames(named, key, folder).withColumn("kind", F.lit("stretched")))

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            paths = []
            for k, h, w, ch, data in zip(pdf[key], pdf["h"], pdf["w"], pdf["ch"], pdf["data"]):
                img = np.asarray(data, dtype=float).reshape(int(h), int(w), int(ch))
                top = np.nanmax(img) if img.size else 0
                path = os.path.join(folder, f"{k}.tiff")
                with open(part := f"{path}.{os.getpid()}.part", "wb") as f:
                    f.write(tiff16(img / top if top > 0 else img))
                os.replace(part, path)
                paths.append(path)
            yield pd.DataFrame({key: pdf[key].astype(str), "path": paths})

    previews = shown.mapInPandas(run, f"{key} string, path string").withColumn("kind", F.lit("preview"))
    return out.withColumn(key, F.col(key).cast("string")).unionByName(previews).select(key, "kind", "path")
