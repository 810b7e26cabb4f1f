"""FITS files: a decoder and encoder in numpy, a scan and a Spark data source.

The scan lists files with the `binaryFile` reader and decodes them where they
are; only headers are decoded unless pixels are asked for, and an unreadable
file gives a row with an error instead of ending the job.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 2880
# BITPIX and the type of its samples.
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
# Directories whose products are never input again.
OUTPUT_DIRS = [
    "masters", "00_masters", "master", "calibrated", "01_calibrated", "debayered", "02_debayered",
    "registered", "03_registered", "stacked", "04_stacked", "generated", "00_input", "_siril",
]
SUFFIXES = ("fit", "fits", "fts")


def parse_card(card: str) -> tuple[str, str | None] | None:
    """Name and text of a value of an 80-character card; None for comments and blanks."""
    if card.startswith("HIERARCH ") and "=" in card:
        name, rest = card[9:].split("=", 1)
        name = "HIERARCH " + name.strip()
    elif card[8:10] == "= ":
        name, rest = card[:8].strip(), card[10:]
    else:
        return None
    rest = rest.strip()
    if rest.startswith("'"):
        m = re.match(r"'((?:[^']|'')*)'", rest)
        return name, (m.group(1).replace("''", "'").rstrip() if m else rest[1:].rstrip())
    value = rest.split("/", 1)[0].strip()
    return name, value or None


def read_header(data: bytes) -> tuple[dict[str, str], int]:
    """Cards of the primary header as text (nulls left out) and the position of its data."""
    if not data.startswith(b"SIMPLE"):
        raise ValueError("no FITS file")
    cards: dict[str, str] = {}
    for at in range(0, len(data), 80):
        card = data[at : at + 80].decode("ascii", errors="replace")
        if card.startswith("END") and not card[3:].strip():
            return cards, -(-(at + 80) // BLOCK) * BLOCK
        got = parse_card(card)
        if got and got[1] is not None and got[0] not in cards:
            cards[got[0]] = got[1]
    raise ValueError("header has no END")


def read_image(data: bytes) -> tuple[dict[str, str], np.ndarray]:
    """Cards and the image as (h, w, c), scaled by BSCALE and BZERO."""
    cards, at = read_header(data)
    n = int(cards.get("NAXIS", 0))
    shape = [int(cards[f"NAXIS{i}"]) for i in range(n, 0, -1)]
    if n not in (2, 3):
        raise ValueError(f"NAXIS is {n}")
    kind = np.dtype(TYPES[int(cards["BITPIX"])])
    raw = np.frombuffer(data, dtype=kind, count=int(np.prod(shape)), offset=at).reshape(shape)
    img = raw.astype(np.float32) * float(cards.get("BSCALE", 1)) + float(cards.get("BZERO", 0))
    img = img[:, :, None] if n == 2 else np.moveaxis(img, 0, -1)
    return cards, np.ascontiguousarray(img, dtype=np.float32)


def write_image(img: np.ndarray, cards: dict[str, object] | None = None) -> bytes:
    """A FITS file of a float image (h, w) or (h, w, c); channels become the slowest axis."""
    a = np.asarray(img, dtype=np.float32)
    a = a[:, :, 0] if a.ndim == 3 and a.shape[2] == 1 else a
    a = np.moveaxis(a, -1, 0) if a.ndim == 3 else a
    head: dict[str, object] = {"SIMPLE": True, "BITPIX": -32, "NAXIS": a.ndim} | {f"NAXIS{i + 1}": s for i, s in enumerate(reversed(a.shape))}
    if a.ndim == 3:
        head |= {"CTYPE3": "RGB", "CUNIT3": "channel"}
    lines = []
    for k, v in (head | {k: v for k, v in (cards or {}).items() if k not in head}).items():
        if isinstance(v, bool):
            text = f"{'T' if v else 'F':>20}"
        elif isinstance(v, (int, float)):
            text = f"{v!r:>20}"
        else:
            text = "'" + str(v).replace("'", "''").ljust(8) + "'"
        lines.append((f"HIERARCH {k} = {text}" if len(k) > 8 else f"{k:<8}= {text}")[:80].ljust(80))
    text = "".join([*lines, "END".ljust(80)])
    header = text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("ascii", errors="replace")
    body = a.astype(">f4").tobytes()
    return header + body + b"\0" * (-len(body) % BLOCK)


def is_input(path: str) -> bool:
    """Whether a path is a frame to be scanned: its suffix, no output directory, no final product."""
    parts = path.lower().split("/")
    name = parts[-1]
    return (
        name.rsplit(".", 1)[-1] in SUFFIXES
        and not set(parts[:-1]) & set(OUTPUT_DIRS)
        and "_final." not in name
        and "_stretched." not in name
    )


def scan(spark: SparkSession, root: str, pixels: bool = False) -> DataFrame:
    """One row per frame file below root, in no order: path, name, size_bytes, raw_cards, h, w, ch, data, error.

    data is null unless pixels are asked for; then one row holds one image.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = F.regexp_replace("path", "^file:(//)?", "")
    below = F.substring(tail, len(root.rstrip("/")) + 1, 1 << 20)
    low = F.lower(below)
    dirs = "|".join(re.escape(d) for d in OUTPUT_DIRS)
    keep = low.rlike(rf"\.({'|'.join(SUFFIXES)})$") & ~low.rlike(rf"/({dirs})/") & ~low.rlike(r"_(final|stretched)\.[^/]*$")
    picked = files.where(keep).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, name, size, content in zip(pdf["path"], pdf["name"], pdf["size_bytes"], pdf["content"]):
                rec = {"path": path, "name": name, "size_bytes": size, "raw_cards": None, "h": None, "w": None, "ch": None, "data": None, "error": None}
                try:
                    if pixels:
                        cards, img = read_image(content)
                        rec |= {"h": img.shape[0], "w": img.shape[1], "ch": img.shape[2], "data": img.ravel()}
                    else:
                        cards, _ = read_header(content)
                        rec |= {"h": int(cards["NAXIS2"]) if "NAXIS2" in cards else None, "w": int(cards["NAXIS1"]) if "NAXIS1" in cards else None, "ch": int(cards.get("NAXIS3", 1))}
                    rec["raw_cards"] = cards
                except Exception as e:  # noqa: BLE001 - an unreadable file is a row, not the end of the job
                    rec["error"] = f"{type(e).__name__}: {e}"
                out.append(rec)
            frame = pd.DataFrame(out)
            for c in ("h", "w", "ch"):
                frame[c] = frame[c].astype("Int32")
            yield frame

    return picked.mapInPandas(run, "path string, name string, size_bytes bigint, raw_cards map<string,string>, h int, w int, ch int, data array<float>, error string")


class FitsSource(DataSource):
    """spark.read.format("fits").option("path", folder): path, raw_cards, h, w, ch, data.

    Files are spread over partitions of about `files_per_task` (default 16).
    """

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return "path string, raw_cards map<string,string>, h int, w int, ch int, data array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _FitsReader(self.options)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _FitsReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.per_task = options["path"], int(options.get("files_per_task", 16))

    def partitions(self):
        found = sorted(
            os.path.join(base, n) for base, _, names in os.walk(self.root) for n in names if is_input(os.path.relpath(os.path.join(base, n), self.root))
        )
        return [_Files(found[i : i + self.per_task]) for i in range(0, len(found), self.per_task)] or [_Files([])]

    def read(self, partition):
        for path in partition.paths:
            with open(path, "rb") as f:
                cards, img = read_image(f.read())
            yield path, cards, img.shape[0], img.shape[1], img.shape[2], img.ravel().tolist()


def write_frames(tensors: DataFrame, key: str, folder: str) -> DataFrame:
    """Writes each tensor (h, w, ch, data, optional raw_cards) as folder/<key>.fits; gives key and path.

    The folder is shared by the executors. A repeated task writes the same bytes
    under a temporary name and renames it, so a lost executor leaves no half file.
    """
    cols = [key, "h", "w", "ch", "data", *(["raw_cards"] if "raw_cards" in tensors.columns else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            paths = []
            for row in pdf.to_dict("records"):
                path = os.path.join(folder, f"{row[key]}.fits")
                img = np.asarray(row["data"], dtype=np.float32).reshape(int(row["h"]), int(row["w"]), int(row["ch"]))
                part = f"{path}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(write_image(img, dict(row.get("raw_cards") or {})))
                os.replace(part, path)
                paths.append(path)
            yield pd.DataFrame({key: pdf[key], "path": paths})

    return tensors.select(*cols).mapInPandas(run, f"{key} {dict(tensors.dtypes)[key]}, path string")
