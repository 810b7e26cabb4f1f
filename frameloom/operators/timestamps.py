"""Mixed timestamp formats and time zones, normalised to one UTC instant.

Each text is read by every format that fits it. Formats that read the same text
differently (day/month order) compete: expectation-maximisation over the format
mixture of each source weighs them, with the likelihood of a reading given by
how near it lies to the date the source is known to have worked on. Only counts
of reading patterns per source enter the EM, never the rows.

Civil times are turned into instants by the zone in the text, else by the
source's clock. Where the clocks were set back, a civil time denotes two
instants; the order of capture decides between them. What stays open is marked.

All date arithmetic is done on integers (days and seconds), so the session time
zone has no influence.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# Offsets of zone abbreviations in minutes east of UTC.
ZONE_MINUTES = {
    "UTC": 0, "UT": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "AWST": 480, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

# Further offsets, in minutes, of the abbreviations that several regions use.
ZONE_ALSO = {"IST": [120, 60], "CST": [480, -300], "BST": [360], "EST": [600], "MST": [480], "ACST": [-300], "MSK": [240]}

# First three letters of month names (English, German, French, Spanish, Italian, Polish).
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "mär": 3, "mai": 5, "okt": 10, "dez": 12, "fév": 2, "avr": 4, "aoû": 8, "déc": 12, "ene": 1, "abr": 4, "ago": 8,
    "dic": 12, "gen": 1, "mag": 5, "giu": 6, "lug": 7, "set": 9, "ott": 10, "sty": 1, "lut": 2, "kwi": 4, "maj": 5,
    "cze": 6, "lip": 7, "sie": 8, "wrz": 9, "paź": 10, "lis": 11, "gru": 12,
}

#: Formats in the order of their numbers in a reading.
FORMATS = ["iso", "compact", "month_first", "day_first", "named_month", "epoch_ms", "epoch_s", "jd", "mjd"]

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"\s*(Z|[A-Z]{2,5}|[+-]\d{2}:?\d{2}|[+-]\d{2})?(?:\[([^\]]*)\])?"
#: Shapes of texts: the pattern and where its groups go: year, first and second of
#: month and day, hour, minute, second, half of the day, zone, region.
_SHAPES = {
    "iso": (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[T ]+{_TIME}{_ZONE})?$", "$1|$2|$3|$4|$5|$6||$8|$9"),
    "pair": (rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}})(?:[T ,]+{_TIME}\s*([AaPp][Mm])?{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$8|$9|$10"),
    "named": (rf"^(\d{{1,2}})\.?[ -]+(\p{{L}}{{3,}})\.?,?[ -]+(\d{{4}}),?(?:[T ]+{_TIME}{_ZONE})?$", "$3|$2|$1|$4|$5|$6||$8|$9"),
    "compact": (r"^(\d{4})(\d{2})(\d{2})[-T_ ]?(\d{2})(\d{2})(\d{2})\d{0,9}(Z)?$", "$1|$2|$3|$4|$5|$6||$7|"),
    "epoch_ms": (r"^(\d{12,13})$", "$1"),
    "epoch_s": (r"^(\d{9,10})$", "$1"),
    "jd": (r"^JD\s*=?\s*(\d{7})(?:[.,](\d+))?$", "$1|$2"),
    "mjd": (r"^MJD\s*=?\s*(\d{5})(?:[.,](\d+))?$", "$1|$2"),
}
_CLOCK = (rf"^{_TIME}{_ZONE}$", "|||$1|$2|$3||$5|$6")
DAY = 86400


def _part(parts: Column, k: int) -> Column:
    return F.nullif(F.get(parts, F.lit(k)), F.lit(""))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01, null if there is no such date."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    # Years begin in March, so that the leap day is their last.
    year, month = y - F.when(m <= 2, 1).otherwise(0), (m + 9) % 12
    whole = 365 * year + F.floor(year / 4) - F.floor(year / 100) + F.floor(year / 400)
    days = whole + F.floor((153 * month + 2) / 5) + d - 1 - 719468
    return F.when((y > 0) & m.between(1, 12) & (d >= 1) & (d <= last), days.cast("int"))


def _time_of_day(h: Column, mi: Column, s: Column, half: Column) -> Column:
    """Seconds since midnight, null if there is no such time."""
    sec = F.coalesce(s, F.lit(0))
    pm = F.upper(half) == "PM"
    hour = F.when(half.isNull(), h).when(h.between(1, 12), h % 12 + F.when(pm, 12).otherwise(0))
    ok = (hour <= 23) | ((hour == 24) & (mi == 0) & (sec == 0))
    return F.when(ok & (mi <= 59) & (sec <= 60), hour * 3600 + mi * 60 + sec)


def _offset(zone: Column) -> Column:
    """Seconds east of UTC that a zone text states, null for none or an unknown one."""
    table = F.create_map(*[F.lit(x) for k, v in ZONE_MINUTES.items() for x in (k, v * 60)])
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    hours = _int(F.substring(zone, 2, 2))
    minutes = F.when(F.length(zone) > 3, _int(F.substring(zone, -2, 2))).otherwise(0)
    signed = zone.startswith("+") | zone.startswith("-")
    return F.when(signed, sign * (hours * 3600 + minutes * 60)).otherwise(F.element_at(table, zone))


def _also(zone: Column) -> Column:
    """Further meanings of an abbreviation, in seconds east of UTC; null where it has one."""
    table = F.create_map(*[x for k, v in ZONE_ALSO.items() for x in (F.lit(k), F.array(*[F.lit(m * 60) for m in v]))])
    return F.element_at(table, zone)


def _day_count(parts: Column, epoch_half_days: int) -> Column:
    """UTC seconds of a decimal day count whose zero lies so many half days before 1970."""
    whole, frac = _part(parts, 0).cast("long"), F.coalesce(_part(parts, 1), F.lit("0"))
    # Exact: the fraction as an integer of 1e-12 days.
    part = F.rpad(F.substring(frac, 1, 12), 12, "0").cast("decimal(12,0)")
    seconds = F.floor(part * DAY / F.lit(10**12).cast("decimal(13,0)"))
    return ((2 * whole - epoch_half_days) * (DAY // 2) + seconds).cast("long")


def _clean(text: Column) -> Column:
    """Without blanks around the text and quotation marks enclosing it."""
    return F.trim(F.regexp_replace(F.trim(text), r"^(['\"])\s*(.*?)\s*\1$", "$2"))


def _split(text: Column, shape: tuple[str, str]) -> Column:
    """The groups of a shape, one run of its pattern."""
    return F.split(F.regexp_replace(text, shape[0], shape[1]), r"\|", -1)


def with_readings(df: DataFrame, keep: list[str], text: Column, time_text: Column | None = None) -> DataFrame:
    """keep, `__r` and `__why`: array of the valid readings, struct(fmt, wall, offset, also, utc, minute), and why there is none.

    `utc` is set for counts since an epoch, `offset` where the text names a zone,
    `also` its other meanings; `wall` holds civil seconds; `minute` tells that
    seconds weren't written. `__why` is no_text, blank, no_format, no_such_date, no_such_time (also none at all) or unknown_zone. A
    date without a time takes its time from `time_text`. A zone that isn't known
    makes a text unreadable rather than local; so does a region without an offset.

    Each text is matched once against its own shape; the steps are separate
    projections so that nothing is evaluated twice.
    """
    clock = _clean(time_text) if time_text is not None else F.lit(None).cast("string")
    rows = df.select(*keep, _clean(text).alias("__t"), clock.alias("__c"))
    kind = F.coalesce(*[F.when(F.col("__t").rlike(pat), name) for name, (pat, _) in _SHAPES.items()])
    empty = F.when(F.col("__t").isNull(), "no_text").when(F.col("__t") == "", "blank")
    rows = rows.select(*keep, "__t", F.when(F.col("__c").rlike(_CLOCK[0]), _split(F.col("__c"), _CLOCK)).alias("__c"), kind.alias("__k"), empty.alias("__empty"))
    parts = F.coalesce(*[F.when(F.col("__k") == name, _split(F.col("__t"), s)) for name, s in _SHAPES.items()])
    rows = rows.select(*keep, "__k", "__c", "__empty", parts.alias("__p"))
    p, c = F.col("__p"), F.col("__c")
    civil = F.col("__k").isin("iso", "pair", "named", "compact")
    months = F.create_map(*[F.lit(x) for k, v in MONTHS.items() for x in (k, v)])
    # The time of day: the text's own, else that of the other field.
    own = _part(p, 3).isNotNull()
    src = F.when(own, p).otherwise(c)
    rows = rows.select(
        *keep,
        "__k",
        "__p",
        "__empty",
        F.when(civil, _int(_part(p, 0))).alias("__y"),
        F.when(F.col("__k") == "named", F.element_at(months, F.lower(F.substring(_part(p, 1), 1, 3)))).when(civil, _int(_part(p, 1))).alias("__a"),
        F.when(civil, _int(_part(p, 2))).alias("__b"),
        F.when(civil, src).alias("__s"),
    )
    s = F.col("__s")
    rows = rows.select(
        *keep,
        "__k",
        "__p",
        "__empty",
        "__y",
        "__a",
        "__b",
        _time_of_day(_int(_part(s, 3)), _int(_part(s, 4)), _int(_part(s, 5)), _part(s, 6)).alias("__tod"),
        _part(s, 5).isNull().alias("__minute"),
        _part(s, 7).alias("__zone"),
        _part(s, 8).alias("__region"),
    )
    rows = rows.select("*", _offset(F.col("__zone")).alias("__off"), _also(F.col("__zone")).alias("__also"))
    odd = (F.col("__zone").isNotNull() & F.col("__off").isNull()) | (F.col("__zone").isNull() & F.col("__region").isNotNull())
    k = F.col("__k")
    first = _days(F.col("__y"), F.col("__a"), F.col("__b"))
    second = F.when((k == "pair") & (F.col("__a") != F.col("__b")), _days(F.col("__y"), F.col("__b"), F.col("__a")))
    whole = _part(F.col("__p"), 0).try_cast("long")
    utc = (
        F.when(k == "epoch_ms", F.floor(whole / 1000))
        .when(k == "epoch_s", whole)
        .when(k == "jd", _day_count(F.col("__p"), 2 * 2440587 + 1))
        .when(k == "mjd", _day_count(F.col("__p"), 2 * 40587))
    )
    rows = rows.select(*keep, "__k", "__empty", first.alias("__d1"), second.alias("__d2"), utc.cast("long").alias("__utc"), "__tod", "__minute", "__off", "__also", odd.alias("__odd"))
    number = F.create_map(*[F.lit(x) for i, f in enumerate(FORMATS) for x in (f, i)])

    def reading(fmt: Column, day: Column) -> Column:
        wall = day.cast("long") * DAY + F.col("__tod")
        good = (wall.isNotNull() & ~F.col("__odd")) | F.col("__utc").isNotNull()
        return F.when(
            good,
            F.struct(
                fmt.alias("fmt"), wall.alias("wall"), F.col("__off").alias("offset"), F.col("__also").alias("also"), F.col("__utc").alias("utc"),
                (wall.isNotNull() & F.col("__minute")).alias("minute"),
            ),
        )

    name = F.when(k == "pair", "month_first").when(k == "named", "named_month").otherwise(k)
    both = F.array(
        reading(F.element_at(number, name), F.col("__d1")),
        F.when(F.col("__d2").isNotNull(), reading(F.lit(FORMATS.index("day_first")), F.col("__d2"))),
    )
    no_date = F.col("__d1").isNull() & F.col("__d2").isNull() & F.col("__utc").isNull()
    why = F.coalesce(
        "__empty",
        F.when(k.isNull(), "no_format").when(no_date, "no_such_date").when(F.col("__utc").isNull() & F.col("__tod").isNull(), "no_such_time").when(F.col("__utc").isNull() & F.col("__odd"), "unknown_zone"),
    )
    return rows.select(*keep, F.array_compact(both).alias("__r"), why.alias("__why"))


def _em(sig: pd.DataFrame, rounds: int, floor: float) -> pd.DataFrame:
    """Format weights of one source from counts of reading patterns.

    A pattern is a text like `2+3-`: the formats that fit, each with + if its
    reading is near the expected date and - if it isn't.
    """
    pats = [(p, n) for p, n in zip(sig["sig"], sig["n"]) if p]
    k = len(FORMATS)
    like = np.zeros((len(pats), k))
    for i, (p, _) in enumerate(pats):
        for item in p.split(" "):
            like[i, int(item[:-1])] = 1.0 if item[-1] == "+" else floor
    n = np.array([c for _, c in pats], dtype=float)
    weight = np.full(k, 1.0 / k)
    for _ in range(rounds):
        post = like * weight
        post /= np.maximum(post.sum(axis=1, keepdims=True), 1e-300)
        weight = (post * n[:, None]).sum(axis=0) + 1e-3
        weight /= weight.sum()
    return pd.DataFrame({"source": [sig["source"].iloc[0]], "weights": [weight.tolist()]})


def choose_readings(
    df: DataFrame,
    source: str,
    keep: list[str],
    text: Column,
    expected_day: Column,
    time_text: Column | None = None,
    rounds: int = 12,
    near_days: int = 2,
    floor: float = 1e-3,
    ambiguous_below: float = 0.9,
) -> DataFrame:
    """One reading per row: source, keep, fmt, wall, offset, also, utc, minute, posterior, ambiguous_format, why.

    expected_day  days since 1970 the row should lie near (null: no evidence).
    Rows without a valid reading have null fmt and the reason in `why`.
    `ambiguous_format` marks rows whose best reading has a posterior under
    `ambiguous_below`. The counts the EM sees are bounded by sources times
    reading patterns. Only texts of a shape that several formats read the same
    way are counted: what a source writes otherwise bears on no choice between
    those formats.
    """
    named = df.withColumns({"__source": F.col(source), "__day": expected_day.cast("long")})

    def parsed(part: DataFrame) -> DataFrame:
        return with_readings(part, ["__source", *keep, "__day"], text, time_text).withColumnRenamed("__source", "source")

    rows, contested = parsed(named), parsed(named.where(_clean(text).rlike(_SHAPES["pair"][0])))

    def near(r: Column) -> Column:
        at = F.coalesce(r["wall"] - F.coalesce(r["offset"], F.lit(0)), r["utc"])
        off = F.abs(at - (F.col("__day") * DAY + DAY // 2))
        return F.coalesce(off <= near_days * DAY, F.lit(True))

    signature = F.array_join(
        F.transform("__r", lambda r: F.concat(r["fmt"].cast("string"), F.when(near(r), "+").otherwise("-"))), " "
    )
    counts = contested.groupBy("source", signature.alias("sig")).agg(F.count("*").alias("n"))
    # Patterns with one reading decide nothing by themselves but shape the weights.
    schema = f"source {dict(rows.dtypes)['source']}, weights array<double>"
    weights = counts.where("source is not null").groupBy("source").applyInPandas(lambda pdf: _em(pdf, rounds, floor), schema)
    joined = rows.join(weights, "source", "left")
    even = F.array(*[F.lit(1.0 / len(FORMATS))] * len(FORMATS))
    mass = F.transform(
        "__r",
        lambda r: F.struct(
            (F.element_at(F.coalesce("weights", even), r["fmt"] + 1) * F.when(near(r), 1.0).otherwise(floor)).alias("p"),
            (-r["fmt"]).alias("tie"),
            r.alias("r"),
        ),
    )
    ranked = joined.withColumn("__m", mass)
    best = F.array_max("__m")
    total = F.aggregate("__m", F.lit(0.0), lambda acc, x: acc + x["p"])
    posterior = F.when(total > 0, best["p"] / total)
    return ranked.select(
        "source",
        *keep,
        best["r"]["fmt"].alias("fmt"),
        best["r"]["wall"].alias("wall"),
        best["r"]["offset"].alias("offset"),
        best["r"]["also"].alias("also"),
        best["r"]["utc"].alias("utc"),
        best["r"]["minute"].alias("minute"),
        posterior.alias("posterior"),
        F.coalesce(posterior < ambiguous_below, F.lit(False)).alias("ambiguous_format"),
        F.col("__why").alias("why"),
    )


def to_instants(df: DataFrame, keep: list[str], clock_utc: Column, zone: Column, may: Column | None = None) -> DataFrame:
    """Candidate instants of chosen readings: keep, minute, wall, fmt, posterior, ambiguous_format, u1, u2, unclear.

    u1 is the instant (the earlier one where a civil time occurs twice), u2 the
    later one, null where there is none. A civil time skipped by the clocks is
    read with the offset before the change. No zone and no clock: u1 is null.
    An abbreviation with several meanings has the one that the source's own zone
    shows at that time; if it shows none of them, the first meaning is taken and
    `unclear` set. may: rows whose clocks may be set back (`may_fold`); others
    get no u2.
    """

    def shows(u: Column, tz: Column) -> Column:
        return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(u), tz)) == F.col("wall")

    several = F.col("also").isNotNull()
    meant = F.filter(F.concat(F.array(F.col("offset")), "also"), lambda o: shows(F.col("wall") - o, zone))
    rows = df.withColumn("__meant", F.when(several & zone.isNotNull(), F.get(meant, F.lit(0))))
    offset = F.coalesce("__meant", "offset")
    fixed = F.coalesce(F.col("utc"), F.col("wall") - offset, F.when(clock_utc, F.col("wall")))
    at = F.timestamp_seconds(F.col("wall"))
    tz = F.when(F.col("wall").isNotNull() & fixed.isNull(), zone)
    first = F.when(tz.isNotNull(), F.unix_seconds(F.to_utc_timestamp(at, tz)))
    folds = F.lit(True) if may is None else F.coalesce(may, F.lit(True))
    told = ["minute", "wall", "fmt", "posterior", "ambiguous_format"]
    rows = rows.select(
        *keep, *told, fixed.alias("__f"), tz.alias("__tz"), first.alias("__u"), folds.alias("__folds"), (several & F.col("__meant").isNull()).alias("unclear")
    )
    # Clocks are set back by an hour, on one island by half an hour.
    # The conversion takes the earlier instant of two.
    u = F.col("__u")
    later = F.when(F.col("__tz").isNotNull() & F.col("__folds"), F.coalesce(*[F.when(shows(u + k, F.col("__tz")), u + k) for k in (3600, 1800)]))
    return rows.select(*keep, *told, F.coalesce("__f", "__u").alias("u1"), later.alias("u2"), F.coalesce("unclear", F.lit(False)).alias("unclear"))


def may_fold(day: Column, zone: Column) -> Column:
    """Whether clocks of the zone may be set back within two days of a day (since 1970)."""
    noon = day.cast("long") * DAY + DAY // 2

    def offset(at: Column) -> Column:
        return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(at), zone)) - at

    return F.coalesce(offset(noon - 3 * DAY) > offset(noon + 3 * DAY), F.lit(False))


def settle_folds(df: DataFrame, run: str, order: str, keep: list[str], candidate: str | None = None) -> DataFrame:
    """Decide rows with two candidate instants by the order of capture.

    Within a run instants never fall along `order`, except by under a minute
    where seconds weren't written. Evidence, in this order: certain instants
    before and after; a civil time that falls back within the run (earlier rows
    precede the change); the smaller jump to the nearest certain neighbours.
    Without any evidence the earlier instant is taken and `ambiguous_zone` set.
    candidate names a boolean column that is true for all rows of runs which may
    meet a change of clocks (`may_fold`); other runs are not looked at.
    Returns keep, run, order, utc_second, ambiguous_zone, and the columns of
    the reading. Only runs with an open row are sorted.
    Runs an action: the candidates are checkpointed.
    """
    cols = list(dict.fromkeys([run, order, *keep]))
    may = F.col(candidate) if candidate else F.lit(True)
    # Read three times below; a few numbers a row.
    base = cut(df.select(*cols, "minute", "wall", "fmt", "posterior", "ambiguous_format", "u1", "u2", "unclear", may.alias("__may")))
    is_open = F.coalesce("__may", F.lit(False)) & F.col("u2").isNotNull() & F.col(run).isNotNull() & F.col(order).isNotNull()
    plain = base.where(~is_open).select(
        *cols, "fmt", "posterior", "ambiguous_format", F.col("u1").alias("utc_second"), (F.col("u2").isNotNull() | F.col("unclear")).alias("ambiguous_zone")
    )
    open_runs = base.where(is_open).groupBy(run).agg(F.min("u1").alias("__lo"), F.max("u2").alias("__hi"))
    # Of the certain rows only those around the change can be evidence.
    span = 6 * 3600
    near = base.where("__may").join(open_runs, run).where(is_open | F.col("u1").between(F.col("__lo") - span, F.col("__hi") + span))
    sure = F.when(~is_open, F.col("u1"))
    w = Window.partitionBy(run).orderBy(order)
    fw = w.rangeBetween(Window.unboundedPreceding, 0)
    bw = Window.partitionBy(run).orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, 0)
    slack = F.when(F.col("minute"), 60).otherwise(0)
    # A civil time that falls from one open row to the next marks the change.
    wall = F.when(is_open, F.col("wall"))
    coarse = F.when(is_open, F.when(F.col("minute"), 60).otherwise(0))
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    fall = F.last(wall, ignorenulls=True).over(prior) - F.greatest(F.last(coarse, ignorenulls=True).over(prior), coarse) > wall
    stepped = near.select("*", F.coalesce(fall, F.lit(False)).cast("int").alias("__fall"), slack.alias("__s"))
    marked = stepped.select(
        "*",
        F.max(sure).over(fw).alias("__before"),
        F.min(sure).over(bw).alias("__after"),
        (F.sum("__fall").over(fw) > 0).alias("__fell"),
        (F.sum("__fall").over(Window.partitionBy(run)) > F.sum("__fall").over(fw)).alias("__will"),
    ).where(is_open)
    u1, u2, lo, hi = (F.col(c) for c in ("u1", "u2", "__before", "__after"))
    can1 = F.coalesce(u1 + F.col("__s") >= lo, F.lit(True)) & F.coalesce(u1 - 60 <= hi, F.lit(True))
    can2 = F.coalesce(u2 - F.col("__s") <= hi, F.lit(True)) & F.coalesce(u2 + 60 >= lo, F.lit(True))
    # Of both: the earlier one if that joins on to what came before, else the later.
    jump1, jump2 = F.coalesce(u1 - lo, F.lit(span)), F.coalesce(hi - u2, F.lit(span))
    pick = (
        F.when(can1 & ~can2, u1)
        .when(can2 & ~can1, u2)
        .when(F.col("__fell") & ~F.col("__will"), u2)
        .when(F.col("__will") & ~F.col("__fell"), u1)
        .when(jump1 <= jump2, u1)
        .otherwise(u2)
    )
    unsure = can1 & can2 & (F.col("__fell") == F.col("__will"))
    decided = marked.select(*cols, "fmt", "posterior", "ambiguous_format", pick.alias("utc_second"), (unsure | F.col("unclear")).alias("ambiguous_zone"))
    return plain.unionByName(decided)
