"""Per-frame statistics and stretches in tensor form: one row a frame, no pixel is shuffled.

Arrow batches are cut by picture size and every size is worked on at once, as an
array of frames. The runtime bounds a batch by bytes
(spark.sql.execution.arrow.maxBytesPerBatch), so large pictures don't pile up.
Pixels that are null, NaN or infinite are missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.robust import MAD_SCALE

_ARROW = {"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}


def _lists(a: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists; NaN is null."""
    flat = np.ascontiguousarray(a, dtype=np.float64).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * (a.size // max(len(a), 1))), pa.array(flat, from_pandas=True))


def per_shape(df: DataFrame, keep: list[str], schema: dict[str, str], fn: Callable[..., dict], extra: list[str] | None = None) -> DataFrame:
    """Apply fn(frames, *extra) to all frames of a batch that have one size; keep and the columns of `schema`.

    df has keep, h, w, ch, data and extra. frames is (n, h, w, ch) in double
    precision with NaN for missing pixels; fn gives arrays of n values, or of n rows
    for arrays. Arrays among extra come as (n, values), NaN where null or of another size. Rows
    whose data is null or doesn't fill h·w·ch give null columns.
    """
    types = dict(df.dtypes)
    more = extra or []
    names = [*keep, *schema]

    def matrix(column: pa.Array, size: int) -> np.ndarray:
        out = np.full((len(column), size), np.nan)
        for i, v in enumerate(column):
            if v.is_valid and len(v) == size:
                out[i] = v.values.to_numpy(zero_copy_only=False)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("data")
            length = pc.fill_null(pc.list_value_length(data), -1).to_numpy()
            shape = np.stack([pc.fill_null(batch.column(c).cast(pa.int64()), -1).to_numpy() for c in ("h", "w", "ch")], axis=1) if batch.num_rows else np.zeros((0, 3), int)
            good = (length == shape.prod(axis=1)) & (shape > 0).all(axis=1)
            if (~good).any():
                bad = batch.filter(pa.array(~good))
                yield pa.RecordBatch.from_arrays([*[bad.column(c) for c in keep], *[pa.nulls(bad.num_rows, _ARROW[t]) for t in schema.values()]], names=names)
            for size in np.unique(shape[good], axis=0):
                part = batch.filter(pa.array(good & (shape == size).all(axis=1)))
                flat = part.column("data").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                frames = flat.reshape(part.num_rows, *size.tolist())
                others = [matrix(part.column(m), int(size.prod())) if pa.types.is_list(part.column(m).type) else part.column(m).to_numpy(zero_copy_only=False) for m in more]
                got = fn(np.where(np.isfinite(frames), frames, np.nan), *others)
                cols = [_lists(np.asarray(got[n]).reshape(part.num_rows, -1)) if t.startswith("array") else pa.array(got[n], _ARROW[t], from_pandas=True) for n, t in schema.items()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *cols], names=names)

    full = ", ".join([f"{k} {types[k]}" for k in keep] + [f"{n} {t}" for n, t in schema.items()])
    rows = df.withColumn("data", F.col("data").cast("array<double>"))
    return rows.select(*dict.fromkeys([*keep, "h", "w", "ch", "data", *more])).mapInArrow(run, full)


def _rows(frames: np.ndarray) -> np.ndarray:
    return frames.reshape(len(frames), -1)


def _quiet(f: Callable, *args, **kw):
    """Without warnings of rows that have no value at all."""
    import warnings

    with warnings.catch_warnings(), np.errstate(all="ignore"):
        warnings.simplefilter("ignore", RuntimeWarning)
        return f(*args, **kw)


def frame_stats(tensors: DataFrame, frame: str) -> DataFrame:
    """frame, median, sigma (scaled MAD), signal (p95 - median), snr (0 without noise or signal)."""

    def one(frames):
        v = _rows(frames)
        m = _quiet(np.nanmedian, v, axis=1)
        sigma = _quiet(np.nanmedian, np.abs(v - m[:, None]), axis=1) * MAD_SCALE
        signal = _quiet(np.nanpercentile, v, 95, axis=1) - m
        snr = np.where(sigma > 1e-12, np.maximum(signal / np.where(sigma > 1e-12, sigma, 1.0), 0.0), 0.0)
        return {"median": m, "sigma": sigma, "signal": signal, "snr": snr}

    return per_shape(tensors, [frame], dict.fromkeys(("median", "sigma", "signal", "snr"), "double"), one)


def normalise(tensors: DataFrame, keep: list[str], method: str = "mul") -> DataFrame:
    """keep, h, w, ch, data, `whole` (no pixel is missing) and `median`: mul divides by the frame's median, add subtracts it.

    A median of 0 can't be divided by; such a frame's pixels become null.
    """

    def one(frames):
        v = _rows(frames)
        m = _quiet(np.nanmedian, v, axis=1)
        if method == "mul":
            out = v / np.where(m == 0, np.nan, m)[:, None]
        else:
            out = v - m[:, None] if method == "add" else v
        return {"data": out, "whole": ~np.isnan(v).any(axis=1), "median": m}

    return per_shape(tensors, [*keep, "h", "w", "ch"], {"data": "array<double>", "whole": "boolean", "median": "double"}, one)


def stretch(tensors: DataFrame, keep: list[str], method: str = "asinh", a: float = 0.01, k: float = 3.0) -> DataFrame:
    """keep, h, w, ch, data for display.

    asinh keeps the frame's maximum, linear makes it 1; both give 0 for a frame
    without signal. auto takes the median off, divides by k sigma, and makes the
    maximum of asinh 1. Values are never below 0.
    """

    def one(frames):
        v = _rows(frames)
        if method == "auto":
            m = _quiet(np.nanmedian, v, axis=1)[:, None]
            s = _quiet(np.nanmedian, np.abs(v - m), axis=1)[:, None] * MAD_SCALE
            up = np.arcsinh(np.maximum(v - m, 0) / np.maximum(np.where(s > 0, s, 1.0) * k, 1e-10))
            top = _quiet(np.nanmax, up, axis=1)[:, None]
            return {"data": up / np.where(top > 0, top, 1.0)}
        top = _quiet(np.nanmax, v, axis=1)[:, None]
        safe = np.where(top > 0, top, 1.0)
        out = np.arcsinh(v * a) / np.arcsinh(safe * a) * safe if method == "asinh" else v / safe
        return {"data": np.where(top > 0, np.maximum(out, 0.0), np.where(np.isnan(v), np.nan, 0.0))}

    return per_shape(tensors, [*keep, "h", "w", "ch"], {"data": "array<double>"}, one)


def neutralise(tensors: DataFrame, keep: list[str]) -> DataFrame:
    """keep, h, w, ch, data: each channel less its median, not below 0."""

    def one(frames):
        m = _quiet(np.nanmedian, frames.reshape(len(frames), -1, frames.shape[3]), axis=1)
        return {"data": np.maximum(frames - m[:, None, None, :], 0)}

    return per_shape(tensors, [*keep, "h", "w", "ch"], {"data": "array<double>"}, one)


def bright_centroid(tensors: DataFrame, frame: str, quantile: float) -> DataFrame:
    """frame, n, cy, cx of the pixels (channel mean) at or over the frame's quantile."""

    def one(frames):
        img = frames.mean(axis=3)
        q = _quiet(np.nanquantile, img.reshape(len(img), -1), quantile, axis=1)
        over = img >= q[:, None, None]
        n = over.sum(axis=(1, 2))
        y, x = np.indices(img.shape[1:])
        d = np.where(n > 0, n, np.nan)
        return {"n": n, "cy": (over * y).sum(axis=(1, 2)) / d, "cx": (over * x).sum(axis=(1, 2)) / d}

    return per_shape(tensors, [frame], {"n": "long", "cy": "double", "cx": "double"}, one)


#: Flips of a picture; a transposed one fits only square pictures.
FLIPS = ("none", "vertical", "horizontal", "rotate_180", "transpose")


def with_reference(images: DataFrame, reference: DataFrame, group: str, key: str, name: str = "ref", salts: int = 32) -> DataFrame:
    """images with the array `name` of their group's reference (group, name), which is repeated for each part of a group."""
    ref = reference.select(group, name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    return images.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")).join(ref, [group, "__salt"]).drop("__salt")


def best_flip(images: DataFrame, frame: str, ref: str = "ref") -> DataFrame:
    """frame, flip, ncc, gap, confidence: the flip of the frame that correlates best with its array `ref`, and its lead over the second best.

    Correlations are compared to nine digits; ties go to the first of FLIPS.
    confidence, 0 to 1: a third of 1 + |ncc| + lead, at least 0.9 where ncc is over 0.7 and leads by over 0.2,
    at least 0.7 where it is over 0.5 and leads by over 0.1.
    """

    def one(frames, refs):
        n, h, w, ch = frames.shape
        img, r = frames.mean(axis=3), refs.reshape(n, h, w, ch).mean(axis=3)
        turned = [img, img[:, ::-1], img[:, :, ::-1], img[:, ::-1, ::-1]] + ([img.transpose(0, 2, 1)] if h == w else [])
        b = r.reshape(n, -1) - r.reshape(n, -1).mean(axis=1, keepdims=True)
        found = []
        for t in turned:
            a = t.reshape(n, -1) - t.reshape(n, -1).mean(axis=1, keepdims=True)
            d = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            found.append(np.where(d > 1e-12, (a * b).sum(axis=1) / np.where(d > 1e-12, d, 1.0), 0.0))
        ncc = np.stack(found, axis=1)
        order = np.argsort(-np.round(ncc, 9), axis=1, kind="stable")
        first, second = (np.take_along_axis(ncc, order[:, [k]], axis=1)[:, 0] for k in (0, 1))
        gap = first - second
        least = np.where((first > 0.7) & (gap > 0.2), 0.9, np.where((first > 0.5) & (gap > 0.1), 0.7, 0.0))
        sure = np.clip(np.maximum((1 + np.abs(first) + gap) / 3, least), 0, 1)
        return {"flip": np.array(FLIPS, dtype=object)[order[:, 0]], "ncc": first, "gap": gap, "confidence": sure}

    return per_shape(images, [frame], {"flip": "string", "ncc": "double", "gap": "double", "confidence": "double"}, one, [ref])
