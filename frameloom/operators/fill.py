"""Filling missing values from records of the same group, in time order.

The scan along an entity is done in two levels, so that one entity may hold
any share of the rows: rows fall into blocks of the order column, the blocks'
first and last known values are scanned (a few rows per entity), and each block
is then filled on its own with the values carried into it from both sides.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def fill_ordered(
    df: DataFrame,
    entity: list[str],
    order: str,
    value: str,
    known: Column | None = None,
    numeric: bool = True,
    gap_limit: int | None = None,
    block: int = 512,
    keep: list[str] | None = None,
) -> DataFrame:
    """Fill `value` along integer `order` within `entity`.

    known      condition under which a value counts as observed (default: not null and not NaN).
    numeric    interpolate between the observed neighbours (equal neighbours
               give exactly that value); otherwise carry the nearest neighbour,
               the earlier one on ties.
    gap_limit  don't fill from a neighbour further away than this in `order`.
    keep       further input columns of the result.

    Returns entity, order, keep, value (observed or filled), `fill_method`
    (`observed`, `interpolated`, `carried_forward`, `carried_back`, `missing`)
    and `fill_distance` (steps to the nearer neighbour used; null if observed
    or missing). At an end of the entity the one neighbour is carried. Rows with
    a null entity or order stay as they are (`observed` or `missing`): they have
    no neighbours. A missing row that ties in `order` with observed ones lies
    between the largest and the smallest of them. One row out per row in; an
    empty table gives an empty table.
    """
    ok = F.col(value).isNotNull() if known is None else known
    if known is None and dict(df.dtypes)[value] in ("double", "float"):
        ok = ok & ~F.isnan(value)
    own = F.when(ok, F.col(value))
    placeable = F.lit(True)
    for c in [*entity, order]:
        placeable = placeable & F.col(c).isNotNull()
    rows = df.select(
        *dict.fromkeys([*entity, order, *(keep or [])]),
        own.alias("__v"),
        placeable.alias("__ok"),
        F.floor(F.col(order) / block).alias("__b"),
    )
    near = F.when(F.col("__v").isNotNull() & F.col("__ok"), F.struct(F.col(order).cast("long").alias("o"), F.col("__v").alias("v")))
    rows = rows.withColumn("__k", near)
    edges = rows.where("__ok").groupBy(*entity, "__b").agg(F.min("__k").alias("__first"), F.max("__k").alias("__last"))
    # Maxima of (order, value) are the last known values. Both directions look back
    # along their own sort, as frames that end at the partition's end cost n².
    line = Window.partitionBy(*entity)
    before = Window.unboundedPreceding
    carried = edges.select(
        *entity,
        "__b",
        F.max("__last").over(line.orderBy("__b").rowsBetween(before, -1)).alias("__in"),
        F.min("__first").over(line.orderBy(F.desc("__b")).rowsBetween(before, -1)).alias("__out"),
    )
    joined = rows.join(carried, [*entity, "__b"], "left")
    inside = Window.partitionBy(*entity, "__b")
    prev = F.coalesce(F.max("__k").over(inside.orderBy(order).rangeBetween(before, 0)), F.col("__in"))
    nxt = F.coalesce(F.min("__k").over(inside.orderBy(F.desc(order)).rangeBetween(before, 0)), F.col("__out"))
    near = joined.select(
        *dict.fromkeys([*entity, order, *(keep or [])]),
        "__v",
        F.when(F.col("__ok"), prev).alias("__p"),
        F.when(F.col("__ok"), nxt).alias("__n"),
    )
    dp, dn = F.col(order) - F.col("__p.o"), F.col("__n.o") - F.col(order)
    if gap_limit is not None:
        near = near.withColumn("__p", F.when(dp <= gap_limit, F.col("__p"))).withColumn("__n", F.when(dn <= gap_limit, F.col("__n")))
    both = F.col("__p").isNotNull() & F.col("__n").isNotNull()
    pv, nv = F.col("__p.v"), F.col("__n.v")
    if numeric:
        span = F.nullif(dp + dn, F.lit(0))
        mid = F.when(pv == nv, pv.cast("double")).otherwise(F.coalesce(pv + (nv - pv) * dp / span, pv))
        filled = F.when(both, mid).otherwise(F.coalesce(pv, nv).cast("double"))
        between = F.lit("interpolated")
    else:
        filled = F.when(both, F.when(dp <= dn, pv).otherwise(nv)).otherwise(F.coalesce(pv, nv))
        between = F.when(dp <= dn, "carried_forward").otherwise("carried_back")
    seen = F.col("__v").isNotNull()
    method = (
        F.when(seen, "observed")
        .when(both, between)
        .when(F.col("__p").isNotNull(), "carried_forward")
        .when(F.col("__n").isNotNull(), "carried_back")
        .otherwise("missing")
    )
    return near.select(
        *dict.fromkeys([*entity, order, *(keep or [])]),
        F.when(seen, F.col("__v")).otherwise(filled).alias(value),
        method.alias("fill_method"),
        F.when(~seen, F.least(dp, dn)).cast("long").alias("fill_distance"),
    )


@dataclass
class Fill:
    """A field to fill from its own run, then from the runs around it.

    known    condition under which a value counts as observed.
    numeric  interpolate between the observed neighbours of the run; otherwise carry the nearest one.
    within   further columns that neighbours of a run must agree on.
    beyond   columns that runs must agree on to stand in for a run that knows nothing (none: no run does).
    """

    name: str
    known: Column
    numeric: bool = True
    within: list[str] = field(default_factory=list)
    beyond: list[str] = field(default_factory=list)


def _between(o: Column, p: Column, n: Column, numeric: bool) -> Column:
    """struct(value, fill_method, fill_distance) of a place o between the known places p and n; null without either."""
    dp, dn = o - p["o"], n["o"] - o
    both = p.isNotNull() & n.isNotNull()
    if numeric:
        mid = F.when(p["v"] == n["v"], p["v"]).otherwise(F.coalesce(p["v"] + (n["v"] - p["v"]) * dp / F.nullif(dp + dn, F.lit(0)), p["v"]))
        method = F.lit("interpolated")
    else:
        mid = F.when(dp <= dn, p["v"]).otherwise(n["v"])
        method = F.when(dp <= dn, "carried_forward").otherwise("carried_back")
    value = F.when(both, mid).otherwise(F.coalesce(p["v"], n["v"]))
    told = F.when(both, method).when(p.isNotNull(), "carried_forward").otherwise("carried_back")
    return F.when(value.isNotNull(), F.struct(value.alias("value"), told.alias("fill_method"), F.least(dp, dn).cast("long").alias("fill_distance")))


def fill_fields(df: DataFrame, run: str, order: str, key: str, fills: list[Fill], at: DataFrame | None = None, received: str | None = None, block: int = 512) -> DataFrame:
    """The filled values of several fields in one pass: key, field_name, value, fill_method, fill_distance, fill_level.

    Neighbours along integer `order` within `run` come first (fill_level `run`);
    a run that knows nothing takes the value of the nearest run that agrees on
    Fill.beyond, the earlier one on ties (`beyond`, the distance in days). `at`
    has run and `day` (since 1970); a run that is not in it takes the first day of
    `received`. Only missing values that could be filled give a row, once per
    key and field. Rows without run or order, or with a null in Fill.within or
    Fill.beyond, get nothing there. A missing row that ties in `order` with
    observed ones lies between the largest and the smallest of them. An empty
    table gives no rows.

    Two scans, as in fill_ordered: the first finds the first and last known
    values of each block, which are scanned along the run and, for whole runs,
    along what they share; the second fills each block on its own. Blocks in
    which nothing is missing are left out before that. Runs an action: the known
    values of the blocks are checkpointed.
    """
    others = list(dict.fromkeys(c for f in fills for c in [*f.within, *f.beyond]))
    cols = {c: f"__c{i}" for i, c in enumerate(others)}

    def sure(names: list[str]) -> Column:
        out = F.lit(True)
        for c in names:
            out = out & F.col(cols[c]).isNotNull()
        return out

    got = F.datediff(F.to_date(received), F.lit("1970-01-01").cast("date")) if received else F.lit(None).cast("int")
    rows = df.where(F.col(run).isNotNull() & F.col(order).isNotNull()).select(
        F.col(run).alias("__run"), F.col(order).cast("long").alias("__o"), F.col(key).alias("__key"), got.alias("__got"),
        *[F.col(c).alias(a) for c, a in cols.items()],
        *[F.coalesce(f.known, F.lit(False)).alias(f"__ok{i}") for i, f in enumerate(fills)],
        *[F.col(f.name).cast("double").alias(f"__v{i}") for i, f in enumerate(fills)],
    )
    rows = rows.withColumn("__b", F.floor(F.col("__o") / block))
    place = [F.when(F.col(f"__ok{i}"), F.struct(F.col("__o").alias("o"), F.col(f"__v{i}").alias("v"))) for i in range(len(fills))]
    rows = rows.withColumns({f"__k{i}": F.when(sure(f.within), place[i]) for i, f in enumerate(fills)})
    # First scan: what each block knows first and last.
    # Read twice below, for the runs and for what they share; a row per block and combination of columns.
    edges = cut(rows.groupBy("__run", "__b", *cols.values()).agg(
        F.min("__got").alias("__got"),
        *[g(f"__k{i}").alias(f"__{n}{i}") for i in range(len(fills)) for n, g in (("first", F.min), ("last", F.max))],
        *[F.max(~F.col(f"__ok{i}")).alias(f"__open{i}") for i in range(len(fills))],
    ))
    ahead = Window.unboundedPreceding
    carried = {}
    for i, f in enumerate(fills):
        line = Window.partitionBy("__run", *[cols[c] for c in f.within])
        carried[f"__in{i}"] = F.max(f"__last{i}").over(line.orderBy("__b").rangeBetween(ahead, -1))
        carried[f"__out{i}"] = F.min(f"__first{i}").over(line.orderBy(F.desc("__b")).rangeBetween(ahead, -1))
    scanned = edges.withColumns(carried)
    opened = F.lit(False)
    for i in range(len(fills)):
        opened = opened | F.col(f"__open{i}")
    # Per block, its carried values; where neighbours must agree on more, one per combination.
    carry = scanned.groupBy("__run", "__b").agg(
        F.max(opened).alias("__any"),
        *[F.collect_set(F.struct(*[F.col(cols[c]) for c in f.within], F.col(f"__in{i}").alias("i"), F.col(f"__out{i}").alias("o"))).alias(f"__carry{i}") for i, f in enumerate(fills)],
    ).where("__any").drop("__any")
    wide = [(i, f) for i, f in enumerate(fills) if f.beyond]
    if wide:
        shared = list(dict.fromkeys(cols[c] for _, f in wide for c in f.beyond))
        whole = edges.groupBy("__run", *shared).agg(F.min("__got").alias("__got"), *[F.max(f"__last{i}").alias(f"__last{i}") for i, _ in wide])
        if at is not None:
            whole = whole.join(at.select(F.col(run).alias("__run"), F.col("day").cast("int").alias("__at")), "__run", "left")
            whole = whole.withColumn("__day", F.coalesce("__at", "__got"))
        else:
            whole = whole.withColumn("__day", F.col("__got"))
        near = {}
        for i, f in wide:
            mine = F.when(F.col("__day").isNotNull() & F.col(f"__last{i}").isNotNull(), F.struct(F.col("__day").cast("long").alias("o"), F.col(f"__last{i}.v").alias("v")))
            line = Window.partitionBy(*[cols[c] for c in f.beyond])
            near[f"__p{i}"] = F.max(mine).over(line.orderBy("__day").rangeBetween(ahead, 0))
            near[f"__n{i}"] = F.min(mine).over(line.orderBy(F.desc("__day")).rangeBetween(ahead, 0))
        spread = whole.withColumns(near)
        day = F.col("__day").cast("long")
        stand = [F.when(sure(f.beyond) & F.col("__day").isNotNull(), _between(day, F.col(f"__p{i}"), F.col(f"__n{i}"), False)).alias(f"__w{i}") for i, f in wide]
        each = F.struct(*shared, *stand)
        carry = carry.join(spread.groupBy("__run").agg(F.collect_set(each).alias("__wide")), "__run", "left")
    # Second scan: blocks with something missing.
    joined = rows.join(carry, ["__run", "__b"])
    inside = {}
    for i, f in enumerate(fills):
        part = Window.partitionBy("__run", "__b", *[cols[c] for c in f.within])
        inside[f"__p{i}"] = F.max(f"__k{i}").over(part.orderBy("__o").rangeBetween(ahead, 0))
        inside[f"__n{i}"] = F.min(f"__k{i}").over(part.orderBy(F.desc("__o")).rangeBetween(ahead, 0))
    looked = joined.withColumns(inside)

    def same(x: Column, names: list[str]) -> Column:
        out = F.lit(True)
        for c in names:
            out = out & (x[cols[c]] == F.col(cols[c]))
        return out

    def pick(i: int, f: Fill) -> Column:
        held = F.get(F.filter(f"__carry{i}", lambda x: same(x, f.within)), F.lit(0))
        p, n = F.coalesce(F.col(f"__p{i}"), held["i"]), F.coalesce(F.col(f"__n{i}"), held["o"])
        own = F.when(sure(f.within), _between(F.col("__o"), p, n, f.numeric))
        best = F.when(own.isNotNull(), F.struct(own["value"].alias("value"), own["fill_method"].alias("fill_method"), own["fill_distance"].alias("fill_distance"), F.lit("run").alias("fill_level")))
        if f.beyond:
            w = F.get(F.filter("__wide", lambda x: same(x, f.beyond) & x[f"__w{i}"].isNotNull()), F.lit(0))[f"__w{i}"]
            best = F.coalesce(best, F.when(w.isNotNull(), F.struct(w["value"].alias("value"), w["fill_method"].alias("fill_method"), w["fill_distance"].alias("fill_distance"), F.lit("beyond").alias("fill_level"))))
        return F.when(~F.col(f"__ok{i}") & best.isNotNull(), F.struct(F.lit(f.name).alias("field_name"), best.alias("x")))

    out = looked.select("__key", F.explode(F.array_compact(F.array(*[pick(i, f) for i, f in enumerate(fills)]))).alias("f"))
    out = out.select(F.col("__key").alias(key), "f.field_name", "f.x.value", "f.x.fill_method", "f.x.fill_distance", "f.x.fill_level")
    return out.dropDuplicates([key, "field_name"])
