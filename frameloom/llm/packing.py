"""Filling fixed-capacity containers with items of varying length.

Items are spread over partitions of bounded size by a hash of their key, and each
partition is packed by best-fit decreasing. Dual-feasible functions give a lower
bound on the containers a partition needs: a partition that meets its bound is
certified. Containers with notable free space, and the worst-filled ones of
partitions that miss their bound, are released; the released items meet in new
partitions and are packed again. Only bounded groups of sizes
are ever in one task, and a histogram of sizes (at most capacity + 1 rows) is all
that is looked at for the bound over everything.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Items of a partition, on average. Hashing keeps partitions within a few per cent of it.
PART_ITEMS = 50_000


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing of the sizes needs.

    The best bound over two families of dual-feasible functions: items over
    capacity - t count as whole, items under t as nothing (each t up to half the
    capacity); and rounding of sizes to k-ths of the capacity.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    hist = np.bincount(sizes[sizes > 0], minlength=capacity + 1)[: capacity + 1]
    return bound_of_histogram(hist, capacity)


def bound_of_histogram(hist: np.ndarray, capacity: int) -> int:
    """`lower_bound` of a histogram of sizes 0..capacity."""
    hist = np.asarray(hist, dtype=np.int64).copy()
    hist[0] = 0
    x = np.arange(capacity + 1, dtype=np.int64)
    n, s = np.cumsum(hist), np.cumsum(hist * x)
    t = np.arange(0, capacity // 2 + 1)
    above = n[-1] - n[capacity - t]
    below = np.where(t > 0, s[np.maximum(t - 1, 0)], 0)
    best = (above * capacity + s[capacity - t] - below).max()
    bound = -(-int(best) // capacity)
    for k in range(1, 21):
        # u(x) = x where x (k+1) is a multiple of the capacity, else floor(x (k+1) / capacity) / k.
        whole = (x * (k + 1)) % capacity == 0
        u = np.where(whole, x * k, (x * (k + 1) // capacity) * capacity)
        bound = max(bound, -(-int((u * hist).sum()) // (capacity * k)))
    return bound


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number (from 0) of each item. Sizes are 0..capacity; ties keep their order."""
    order = np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable")
    out = np.zeros(len(order), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0
    for i in order.tolist():
        s = int(sizes[i])
        fit = mask >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask &= ~(1 << r)
        else:
            b, r, used = used, capacity, used + 1
        out[i] = b
        r -= s
        free[r].append(b)
        mask |= 1 << r
    return out


def _places(part: pd.DataFrame, label: int) -> pd.DataFrame:
    """Place and start of each item within its container; larger items first, then by key."""
    part = part.sort_values(["bin", "size", "key", "part_no"], ascending=[True, False, True, True], kind="stable")
    by = part.groupby("bin", sort=False)["size"]
    part["place"] = by.cumcount().astype("int32") + 1
    part["start"] = (by.cumsum() - part["size"]).astype("int32")
    part["container"] = (np.int64(label) << np.int64(32)) | part["bin"].to_numpy(dtype=np.int64)
    return part


def _packer(capacity: int, r: int, last: bool):
    """Packs one partition in round r; all but the last round release containers."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label = (r << 24) | int(pdf["slot"].iloc[0])
        pdf = pdf.sort_values(["key", "part_no"], kind="stable")
        sizes = pdf["size"].to_numpy()
        pdf["bin"] = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(pdf["bin"], weights=sizes)
        gap = len(fill) - lower_bound(sizes, capacity)
        release = np.zeros(len(fill), dtype=bool)
        if not last:
            # Containers with notable free space always go on, since items elsewhere may
            # fit that this partition hasn't got; behind a gap also the worst others.
            free = capacity - fill
            worst = np.argsort(-free, kind="stable")[: 1 + 8 * gap]
            release[worst] = free[worst] > 0
            release |= free > capacity // 64
        out = _places(pdf, label)
        out["certified"] = gap <= 0
        out["released"] = release[out["bin"].to_numpy()]
        return out[["key", "part_no", "size", "container", "place", "start", "certified", "released"]]

    return run


def pack(items: DataFrame, key: str, size: str, capacity: int, rounds: int = 3, part_items: int = PART_ITEMS) -> DataFrame:
    """Container and place of every item: key, part_no, size, container_id, place, start, certified.

    An item over the capacity is split into full containers of its own and a rest
    (part_no from 0); no other item is split. Items of size 0 or null take a
    place, not space. `start` is where the item begins within its container.
    `certified` tells that the item's partition met its lower bound. Keys are
    unique and not null; equal sizes are packed in order of keys. An empty table
    gives an empty table.

    Runs actions: the sizes are checkpointed (a few bytes an item), as each round
    reads them again; rows are counted to choose the number of partitions.
    """
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    pieces = items.select(
        F.col(key).alias("key"),
        F.explode(
            F.when(n <= capacity, F.array(F.struct(F.lit(0).alias("part_no"), n.cast("int").alias("size")))).otherwise(
                F.transform(
                    F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / capacity)),
                    lambda k: F.struct(k.cast("int").alias("part_no"), F.least(F.lit(capacity).cast("long"), n - k * capacity).cast("int").alias("size")),
                )
            )
        ).alias("p"),
    ).select("key", "p.part_no", "p.size")
    todo = cut(pieces)
    key_type = dict(items.dtypes)[key]
    schema = f"key {key_type}, part_no int, size int, container bigint, place int, start int, certified boolean, released boolean"
    done = None
    for r in range(rounds):
        parts = max(1, -(-todo.count() // part_items))
        last = r + 1 == rounds

        slotted = todo.withColumn("slot", F.pmod(F.xxhash64("key", "part_no", F.lit(r)), F.lit(parts)).cast("int"))
        packed = slotted.groupBy("slot").applyInPandas(_packer(capacity, r, last), schema)
        if not last:
            packed = cut(packed)
            todo = packed.where("released").select("key", "part_no", "size")
            packed = packed.where("not released")
        done = packed if done is None else done.unionByName(packed)
    return done.select(F.col("key").alias(key), "part_no", F.col("size").alias(size), F.col("container").alias("container_id"), "place", "start", "certified")


def report(packed: DataFrame, size: str, capacity: int) -> DataFrame:
    """One row: items, containers, lower_bound, used, unused.

    The bound holds over all items: the histogram of sizes has at most
    capacity + 1 rows and is evaluated as one group.
    """
    hist = packed.groupBy(F.col(size).alias("size")).agg(F.count("*").alias("n"))
    used = packed.agg(F.count("*").alias("items"), F.count_distinct("container_id").alias("containers"), F.coalesce(F.sum(size), F.lit(0)).alias("used"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(capacity + 1, dtype=np.int64)
        counts[pdf["size"].to_numpy()] = pdf["n"].to_numpy()
        return pd.DataFrame({"lower_bound": [bound_of_histogram(counts, capacity)]})

    bound = hist.groupBy(F.lit(1).alias("g")).applyInPandas(run, "lower_bound bigint")
    total = bound.agg(F.coalesce(F.max("lower_bound"), F.lit(0)).alias("lower_bound"))
    return used.join(total).select("items", "containers", "lower_bound", "used", (F.col("containers") * capacity - F.col("used")).alias("unused"))
