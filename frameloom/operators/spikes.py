"""Implausible readings: impossible values, short excursions, frozen stretches.

Each source is judged by its own behaviour. Readings of a run (a session) go
through a robust exponentially weighted control chart in their order: suspected
values are clipped before they update level and scale, an excursion counts only
if the readings return, and a change that lasts becomes the new level. The level
that the source's neighbouring runs end and begin at is carried in, so that an
excursion at a run's own ends is told from a lasting change. Settings go through
the same kind of chart on the logarithm, where the noise is zero. Counters of
equal readings find frozen stretches, against the tail of the stretch lengths
that the source shows elsewhere.

Runs are cut into blocks of the order column, so that no task holds more than a
block whatever share of the rows a source or a run has. A chart sees an overlap on
both sides of its block; stretches are counted in their own block and those at
the edges are merged over all blocks they cross. All fields of a reading travel
together: one exchange, whatever their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BLOCK, OVERLAP = 4096, 128
#: Readings whose median is the level that a run begins or ends at.
ENDS = 9
#: Runs up to which their levels and scales are broadcast (under 200 bytes each); beyond, they are joined.
BROADCAST_RUNS = 500_000


@dataclass
class Field:
    """A column to judge. low and high: its physically possible range. levels: it is a setting. frozen: report frozen stretches."""

    name: str
    low: float
    high: float
    levels: bool = False
    frozen: bool = True


def chart(
    x: np.ndarray,
    sigma: float,
    resolution: float,
    k: float = 7.0,
    few: int = 4,
    weight: float = 0.3,
    prior: float | None = None,
    after: float | None = None,
) -> np.ndarray:
    """Marks the readings of excursions: at most `few` in a row, after which x returns.

    sigma, resolution: the source's noise and the step of its readings. The
    chart's own scale may rise above sigma, never fall below. A suspected reading
    updates level and scale too, clipped to one scale from the level.
    prior, after: the level at which the run before ended and the next one begins.
    At most `few` readings before x steps at once to prior and stays, or at its end
    while the next run is back at the level, are excursions as well.
    """
    out = np.zeros(len(x), dtype=bool)
    if len(x) == 0:
        return out
    least = max(k * sigma, 2.9 * resolution, 1e-9)
    level, var, base = float(x[0]), sigma * sigma, sigma * sigma
    pending: list[int] = []
    least_off, steady = 0.0, 1
    for i in range(1, len(x)):
        v = float(x[i])
        r = v - level
        limit = max(least, k * math.sqrt(var))
        # Back is also clearly nearer to the level than the excursion was.
        if abs(r) <= limit and (not pending or abs(r) <= 0.5 * least_off):
            if pending:
                out[pending] = True
                pending = []
            steady += 1
            level += weight * r
            var = max(base, 0.9 * var + 0.1 * min(r * r, 9.0 * var))
            continue
        if not pending:
            anchor = level, var
        least_off = min(least_off, abs(r)) if pending else abs(r)
        pending.append(i)
        s = math.sqrt(var)
        level += weight * min(max(r, -s), s)
        var = max(base, 0.9 * var + 0.1 * min(r * r, var))
        if len(pending) > few:
            # It lasts: the latest reading is the new level.
            stays = np.abs(x[pending] - v).max() <= least
            if prior is not None and steady <= few and pending[0] == steady and stays and abs(prior - v) <= least and np.abs(x[:steady] - v).min() > least:
                out[:steady] = True
            level, var, pending, steady = v, base, [], 1
    if pending and after is not None:
        held, spread = anchor
        limit = max(least, k * math.sqrt(spread))
        if abs(after - held) <= limit and np.abs(x[pending] - after).min() > limit:
            out[pending] = True
    return out


def setting_chart(x: np.ndarray, few: int = 4) -> np.ndarray:
    """Marks the readings with which a setting is left for at most `few` frames, after which it returns.

    The chart of a value without noise, on its logarithm: every other value is
    suspected, returned values are the level itself, and more than `few` suspected
    readings make the latest the new level. An excursion counts only if the level
    was held for more than `few` readings before or after it; otherwise the run
    alternates between levels.
    """
    out = np.zeros(len(x), dtype=bool)
    if len(x) == 0:
        return out
    y = np.log(np.maximum(x, 1e-300))
    level, steady = y[0], 1
    pending: list[int] = []
    unsure: list[int] = []
    for i in range(1, len(y)):
        if abs(y[i] - level) <= 1e-9:
            if pending:
                if steady > few:
                    out[pending] = True
                else:
                    unsure = pending
                pending, steady = [], 0
            steady += 1
            if unsure and steady > few:
                out[unsure] = True
                unsure = []
            continue
        if not pending:
            unsure = []
        pending.append(i)
        if len(pending) > few:
            level, steady = y[i], 0
            for j in reversed(pending):
                if abs(y[j] - level) > 1e-9:
                    break
                steady += 1
            pending = []
    return out


def stretches(x: np.ndarray) -> np.ndarray:
    """Length of the stretch of equal readings that each reading belongs to."""
    if len(x) == 0:
        return np.zeros(0, dtype=np.int64)
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    length = np.diff(np.r_[start, len(x)])
    return np.repeat(length, length)


def frozen_limit(lengths: np.ndarray, counts: np.ndarray, chance: float = 0.01, least: int = 8) -> int:
    """Stretch length that a source reaches by chance less than `chance` times.

    A geometric tail is fitted to the lengths over their 90 % quantile; what
    lies beyond the limit is left out and the fit repeated until it holds.
    """
    order = np.argsort(lengths)
    n, c = lengths[order].astype(float), counts[order].astype(float)
    limit = math.inf
    for _ in range(20):
        keep = n < limit
        if not keep.any():
            break
        a, b = n[keep], c[keep]
        u = a[np.searchsorted(np.cumsum(b), 0.9 * b.sum())]
        over = a >= u
        total = b[over].sum()
        excess = ((a[over] - u) * b[over]).sum() / total
        p = min(max(excess / (1 + excess), 0.05), 0.999)
        new = max(least, u + (math.log(total) - math.log(chance)) / -math.log(p))
        if new >= limit:
            break
        limit = new
    return least if math.isinf(limit) else math.ceil(limit)


def _whole_groups(batches: Iterator[pd.DataFrame], by: list[str], least: int = 20_000) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Whole groups of a sorted partition, many at once, with the places where groups begin; repeated keys go.

    Groups are bounded, so a part holds about `least` rows and one group more.
    """

    def begins(pdf: pd.DataFrame) -> np.ndarray:
        new = np.ones(len(pdf), dtype=bool)
        if len(pdf) > 1:
            new[1:] = False
            for c in by:
                v = pdf[c].to_numpy()
                new[1:] |= v[1:] != v[:-1]
        return new

    def once(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        new, key = begins(pdf), pdf["key"].to_numpy()
        again = np.zeros(len(pdf), dtype=bool)
        again[1:] = (key[1:] == key[:-1]) & ~new[1:]
        if again.any():
            pdf = pdf[~again].reset_index(drop=True)
            new = new[~again]
        return pdf, np.flatnonzero(new)

    parts: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        if not len(pdf):
            continue
        parts.append(pdf)
        size += len(pdf)
        if size < least:
            continue
        both = pd.concat(parts, ignore_index=True)
        last = np.flatnonzero(begins(both))[-1]
        if last:
            yield once(both.iloc[:last].reset_index(drop=True))
        parts, size = [both.iloc[last:]], len(both) - last
    if size:
        yield once(pd.concat(parts, ignore_index=True))


def _rounded(d: np.ndarray) -> np.ndarray:
    """To four digits, so that the number of different values is bounded."""
    unit = 10.0 ** (np.floor(np.log10(np.maximum(d, 1e-9))) - 3)
    return np.round(d / unit) * unit


def _table(columns: dict[str, list]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in columns.items()})


def _steps_and_ends(n: int):
    """Pass over the blocks: counts of steps between neighbours, and the levels that blocks begin and end at."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, starts in _whole_groups(batches, ["src", "run", "blk"]):
            own = (g["own"] == g["blk"]).to_numpy()
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(g)]))
            heads = [[None] * n for _ in starts]
            tails = [[None] * n for _ in starts]
            out = []
            for i in range(n):
                v = g[f"v{i}"].to_numpy(dtype=float)
                at = np.flatnonzero(~np.isnan(v))
                x, gr, mine = v[at], group[at], own[at]
                if len(x) > 1:
                    step = (gr[1:] == gr[:-1]) & mine[1:]
                    d = _rounded(np.abs(x[1:] - x[:-1])[step])
                    counted = pd.DataFrame({"src": g["src"].to_numpy()[at][1:][step], "d": d}).groupby(["src", "d"], sort=False).size().reset_index(name="n")
                    out.append(_table({"src": counted["src"].tolist(), "run": [None] * len(counted), "blk": [None] * len(counted), "field": [i] * len(counted), "d": counted["d"].tolist(), "n": counted["n"].tolist(), "head": [None] * len(counted), "tail": [None] * len(counted)}))
                xo, go = x[mine], gr[mine]
                if len(xo):
                    first = np.flatnonzero(np.r_[True, go[1:] != go[:-1]])
                    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(xo)]):
                        heads[go[a]][i] = float(np.median(xo[a : min(b, a + ENDS)]))
                        tails[go[a]][i] = float(np.median(xo[max(a, b - ENDS) : b]))
            have = [j for j in range(len(starts)) if own[starts[j] :][: (np.r_[starts, len(g)][j + 1] - starts[j])].any()]
            at = starts[have]
            out.append(_table({"src": g["src"].to_numpy()[at].tolist(), "run": g["run"].to_numpy()[at].tolist(), "blk": g["blk"].to_numpy()[at].tolist(), "field": [None] * len(at), "d": [None] * len(at), "n": [None] * len(at), "head": [heads[j] for j in have], "tail": [tails[j] for j in have]}))
            yield pd.concat(out, ignore_index=True)

    return run


_FOUND = ("what", "field", "src", "run", "blk", "pos", "v", "len", "n", "keys", "held", "tried")


def _judge(fields: list[Field], k: float, few: int, series: int, least: int = 8):
    """Pass over the blocks: spikes, levels held, and stretches by length; those at a block's edges separately."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, starts in _whole_groups(batches, ["src", "run", "blk"]):
            out: dict[str, list] = {c: [] for c in _FOUND}

            def put(**values):
                for c in _FOUND:
                    out[c].append(values.get(c))

            own = (g["own"] == g["blk"]).to_numpy()
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(g)]))
            key, src, runs, blk = (g[c].to_numpy() for c in ("key", "src", "run", "blk"))
            known = {c: g[c].to_numpy() for c in ("sigma", "res", "prior", "after")}
            for i, f in enumerate(fields):
                v = g[f"v{i}"].to_numpy(dtype=float)
                at = np.flatnonzero(~np.isnan(v))
                if not len(at):
                    continue
                x, gr, mine = v[at], group[at], own[at]
                new = np.r_[True, gr[1:] != gr[:-1]]
                first = np.flatnonzero(new)
                bounds = np.r_[first, len(x)]
                step = np.where(new, 0.0, np.abs(np.diff(x, prepend=x[0])))
                most = np.maximum.reduceat(step, first)
                marked = np.zeros(len(x), dtype=bool)
                for j, a, b in zip(range(len(first)), bounds[:-1].tolist(), bounds[1:].tolist()):
                    if most[j] == 0.0:
                        continue
                    if f.levels:
                        marked[a:b] = setting_chart(x[a:b], few)
                        continue
                    row = at[a]
                    sigma, res, prior, after = (known[c][row][i] if known[c][row] is not None else None for c in ("sigma", "res", "prior", "after"))
                    if sigma is None or not sigma == sigma:
                        continue
                    # The level lags by at most 1 / 0.3 of the largest step: below this none can be off.
                    if most[j] > 0.29 * max(k * sigma, 2.9 * (res or 0.0), 1e-9):
                        nothing = lambda y: y is None or not y == y
                        marked[a:b] = chart(x[a:b], sigma, res or 0.0, k, few, prior=None if nothing(prior) else prior, after=None if nothing(after) else after)
                if f.levels:
                    # Lengths reach into the overlap; they are only held against few and series.
                    begin = np.flatnonzero(new | (np.r_[True, x[1:] != x[:-1]]))
                    length = np.repeat(np.diff(np.r_[begin, len(x)]), np.diff(np.r_[begin, len(x)]))
                    lasts = length >= series
                    for q in np.flatnonzero(mine & (~lasts | marked)).tolist():
                        put(what="odd", field=i, src=src[at[q]], run=runs[at[q]], v=float(x[q]), keys=[key[at[q]]])
                    held = pd.DataFrame({"g": gr[mine], "v": x[mine], "h": (lasts & ~marked)[mine], "t": lasts[mine]}).groupby(["g", "v"], sort=False).max().reset_index()
                    for j, val, h, t in held.itertuples(index=False):
                        put(what="level", field=i, src=src[starts[j]], run=runs[starts[j]], v=float(val), held=bool(h), tried=bool(t))
                else:
                    for q in np.flatnonzero(marked & mine).tolist():
                        put(what="spike", field=i, keys=[key[at[q]]])
                if f.frozen and mine.any():
                    xo, go, ao = x[mine], gr[mine], at[mine]
                    fresh = np.r_[True, go[1:] != go[:-1]]
                    begin = np.flatnonzero(fresh | np.r_[True, xo[1:] != xo[:-1]])
                    end = np.r_[begin[1:], len(xo)]
                    size = end - begin
                    # First and last stretch of a block may go on in its neighbours.
                    is_first = fresh[begin]
                    is_last = np.r_[is_first[1:], True]
                    inner = ~(is_first | is_last)
                    for q in np.flatnonzero(~inner | (size >= least)).tolist():
                        a, b = begin[q], end[q]
                        where = {"src": src[ao[a]], "run": runs[ao[a]], "blk": int(blk[ao[a]])}
                        put(what="long" if inner[q] else "edge", field=i, **where, pos=0 if is_first[q] else 1, v=float(xo[a]), len=int(size[q]), keys=key[ao[a:b]].tolist())
                    hist = pd.DataFrame({"src": src[ao[begin[inner]]], "len": size[inner]}).groupby(["src", "len"], sort=False).size().reset_index(name="n")
                    for s, m, c in hist.itertuples(index=False):
                        put(what="hist", field=i, src=s, len=int(m), n=int(c))
            yield _table(out)

    return run


def flag_fields(df: DataFrame, source: str, run: str, order: str, key: str, fields: list[Field], k: float = 7.0, few: int = 4, series: int = 3) -> DataFrame:
    """The implausible readings of several fields: key, field_name, reason, score.

    Runs of a source follow each other in the order of `run`. Reasons per field:

    limit   the reading is outside the physically possible range; score: the distance from it.
    frozen  it is part of a stretch of equal readings longer than the source
            reaches by chance; score: the length. Only where Field.frozen.
    spike   it is part of an excursion of the control chart (k scales off the level for at most `few`
            readings, then back). For settings (Field.levels): the chart of a
            value without noise, or a stretch of under `series` readings, at a
            value that isn't usual. A run holds a value for `series` readings in a row that
            are no excursion. A value is usual in a run that holds it, and in all runs of the
            source if at least half of those that have it hold it, or if so many,
            and at least three, have `series` readings of it in any way.

    One row per key and field; limit goes before frozen before spike. A key that is repeated with
    the same source, run and order counts once. Nulls and NaN are no readings: they are never
    reported and don't interrupt a stretch. Rows without source, run or order
    are only held against the range. Ties in order are read by key. Order counts
    from 0; a chart of negative places ends at -1. An empty
    table gives no rows. Runs actions: readings by block and what was found in
    them are checkpointed.
    """

    def number(f: Field):
        v = F.col(f.name).cast("double")
        return F.when(~F.isnan(v), v)

    names = F.array(*[F.lit(f.name) for f in fields])
    cols = [F.col(source).alias("src"), F.col(run).alias("run"), F.col(order).cast("long").alias("ord"), F.col(key).alias("key")]
    rows = df.select(*cols, *[number(f).alias(f"v{i}") for i, f in enumerate(fields)])
    rows = rows.where(F.coalesce(*[F.col(f"v{i}") for i in range(len(fields))]).isNotNull())

    def beyond(i: int, f: Field):
        return F.greatest(F.lit(f.low) - F.col(f"v{i}"), F.col(f"v{i}") - F.lit(f.high))

    out_of_range = F.array_compact(F.array(*[F.when(beyond(i, f) > 0, F.struct(F.lit(i).alias("field"), beyond(i, f).alias("score"))) for i, f in enumerate(fields)]))
    limits = rows.select("key", F.explode(out_of_range).alias("b")).select("key", "b.field", F.lit("limit").alias("reason"), "b.score")

    # Overlapping blocks; a row is reported by its own block.
    own = F.floor(F.col("ord") / BLOCK)
    fit = rows.where(F.col("src").isNotNull() & F.col("run").isNotNull() & F.col("ord").isNotNull())
    blocks = (
        fit.select("src", "run", "ord", "key", own.alias("own"), *[F.when(beyond(i, f) <= 0, F.col(f"v{i}")).alias(f"v{i}") for i, f in enumerate(fields)])
        .withColumn("blk", F.explode(F.sequence(F.greatest(F.floor((F.col("ord") - OVERLAP) / BLOCK), F.floor(F.least("ord", F.lit(0)) / BLOCK)), F.floor((F.col("ord") + OVERLAP) / BLOCK))))
        .repartition("src", "run", "blk")
        .sortWithinPartitions("src", "run", "blk", "ord", "key")
    )
    # Both passes read the sorted partitions as they are.
    blocks = cut(blocks)
    types = dict(blocks.dtypes)
    told = cut(blocks.mapInPandas(_steps_and_ends(len(fields)), f"src {types['src']}, run {types['run']}, blk long, field int, d double, n long, head array<double>, tail array<double>"))
    # Normal noise and step of each source, from the steps between neighbours.
    # Quantiles up to 0.85 are the trimmed half of the distribution: 0.929 of sigma for normal noise.
    parts = [round(0.05 + 0.1 * i, 2) for i in range(9)]
    steps = told.where("field is not null").groupBy("src", "field", "d").agg(F.sum("n").alias("n"))
    quantiles = steps.groupBy("src", "field").agg(
        F.percentile("d", F.array(*map(F.lit, parts)), F.col("n")).alias("q"), F.percentile(F.when(F.col("d") > 1e-9, F.col("d")), F.lit(0.02), F.col("n")).alias("res")
    )
    noise = F.aggregate("q", F.lit(0.0), lambda a, x: a + x) / len(parts) / 0.929

    def per_field(value):
        return F.array(*[F.max(F.when(F.col("field") == i, value)) for i in range(len(fields))])

    scale = quantiles.groupBy("src").agg(per_field(noise).alias("sigma"), per_field(F.col("res")).alias("res"))
    runs = told.where("field is null").groupBy("src", "run").agg(
        F.min_by("head", "blk").alias("head"), F.max_by("tail", "blk").alias("tail"), F.min("blk").alias("from_blk"), F.max("blk").alias("to_blk")
    )
    line = Window.partitionBy("src").orderBy("run")
    runs = runs.select("src", "run", "from_blk", "to_blk", F.lag("tail").over(line).alias("prior"), F.lead("head").over(line).alias("after"))
    known = cut(runs.join(scale, "src", "left"))
    small = known.count() <= BROADCAST_RUNS
    joined = blocks.join(F.broadcast(known) if small else known, ["src", "run"], "left").select(
        "src", "run", "blk", "own", "ord", "key", *[f"v{i}" for i in range(len(fields))], "sigma", "res",
        F.when(F.col("blk") <= F.col("from_blk"), F.col("prior")).alias("prior"), F.when(F.col("blk") >= F.col("to_blk"), F.col("after")).alias("after"),
    )
    if not small:
        joined = joined.repartition("src", "run", "blk").sortWithinPartitions("src", "run", "blk", "ord", "key")
    schema = f"what string, field int, src {types['src']}, run {types['run']}, blk long, pos int, v double, len long, n long, keys array<{types['key']}>, held boolean, tried boolean"
    found = cut(joined.mapInPandas(_judge(fields, k, few, series), schema))

    each = found.select("what", "field", "src", "run", "v", F.explode("keys").alias("key"))
    none = F.lit(None).cast("double")
    parts_found = [limits, each.where("what = 'spike'").select("key", "field", F.lit("spike").alias("reason"), none.alias("score"))]
    if any(f.levels for f in fields):
        levels = found.where("what = 'level'").groupBy("field", "src", "run", "v").agg(F.max("held").alias("held"), F.max("tried").alias("tried"))
        held, tried, n = F.count_if("held"), F.count_if("tried"), F.count("*")
        used = levels.groupBy("field", "src", "v").agg(((2 * held >= n) | ((tried >= 3) & (2 * tried >= n))).alias("used")).where("used").select("field", "src", "v")
        odd = each.where("what = 'odd'").join(used, ["field", "src", "v"], "left_anti")
        odd = odd.join(levels.where("held").select("field", "src", "run", "v"), ["field", "src", "run", "v"], "left_anti")
        parts_found.append(odd.select("key", "field", F.lit("spike").alias("reason"), none.alias("score")))
    if any(f.frozen for f in fields):
        # Stretches that cross blocks: of each block only its first and last one.
        at = Window.partitionBy("field", "src", "run").orderBy("blk", "pos")
        goes_on = (F.col("pos") == 0) & (F.lag("v").over(at) == F.col("v"))
        edges = found.where("what = 'edge'").withColumn("__new", (~F.coalesce(goes_on, F.lit(False))).cast("long"))
        edges = edges.withColumn("__no", F.sum("__new").over(at))
        edges = edges.withColumn("total", F.sum("len").over(Window.partitionBy("field", "src", "run", "__no")))
        # One count per source and length.
        counts = found.where("what = 'hist'").select("field", "src", "len", "n").unionByName(edges.where("__new = 1").select("field", "src", F.col("total").alias("len"), F.lit(1).cast("long").alias("n")))
        hist = counts.groupBy("field", "src", "len").agg(F.sum("n").alias("n"))

        def tail(pdf: pd.DataFrame) -> pd.DataFrame:
            limit = frozen_limit(pdf["len"].to_numpy(), pdf["n"].to_numpy())
            return pd.DataFrame({"field": [pdf["field"].iloc[0]], "src": [pdf["src"].iloc[0]], "frozen_from": [limit]})

        tails = hist.groupBy("field", "src").applyInPandas(tail, f"field int, src {types['src']}, frozen_from int")
        stuck = found.where("what = 'long'").select("field", "src", "len", "keys").unionByName(edges.select("field", "src", F.col("total").alias("len"), "keys"))
        stuck = stuck.join(tails, ["field", "src"]).where(F.col("len") >= F.col("frozen_from"))
        parts_found.append(stuck.select(F.explode("keys").alias("key"), "field", F.lit("frozen").alias("reason"), F.col("len").cast("double").alias("score")))
    out = parts_found[0]
    for part in parts_found[1:]:
        out = out.unionByName(part)
    rank = F.when(F.col("reason") == "limit", 0).when(F.col("reason") == "frozen", 1).otherwise(2)
    best = out.groupBy("key", "field").agg(F.min_by(F.struct("reason", "score"), F.struct(rank, F.col("score"))).alias("b"))
    return best.select(F.col("key").alias(key), F.get(names, F.col("field")).alias("field_name"), F.col("b.reason").alias("reason"), F.col("b.score").alias("score"))


def flag_implausible(
    df: DataFrame,
    source: str,
    run: str,
    order: str,
    key: str,
    value: str,
    low: float,
    high: float,
    levels: bool = False,
    frozen: bool = True,
    k: float = 7.0,
    few: int = 4,
    series: int = 3,
) -> DataFrame:
    """flag_fields for one column: key, reason, score."""
    out = flag_fields(df, source, run, order, key, [Field(value, low, high, levels, frozen)], k, few, series)
    return out.select(key, "reason", "score")
