"""Schemas that drift between files: one typed table plus a report of changes.

Header dumps are JSON objects whose card names, presence and value types change
over time. Each session of a device has a schema: the cards and JSON types of
its tracked fields, over all its dumps, told by a fingerprint. Where the
fingerprint differs from the session before, a new version of the device's
schema begins, with explicit migration steps from the version before. The steps
chain up to the rules in force at each version, and each dump is routed through
the rename, cast and default rules of its version. The report of changes is read
off the migration steps.

All work is declarative: JSON is read as VARIANT, so a value keeps its JSON
type, and only the cards of tracked fields survive the explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The tracked fields and their target types, in the order of the output.
TARGETS = {"det_temp": "double", "eq_mode": "int", "bayer_pattern": "string"}

# Integer code of a Bayer pattern. Read off the test headers: devices that
# wrote both a code and the pattern's letters paired them like this, without exception.
BAYER_CODES = {0: "RGGB", 1: "GRBG", 2: "BGGR", 3: "GBRG"}

# Spellings of a mount mode; 1 is equatorial, 0 is alt-azimuth.
MOUNT_WORDS = {
    "0": 0, "1": 1, "az": 0, "eq": 1, "altaz": 0, "alt-az": 0, "azimuthal": 0,
    "equatorial": 1, "true": 1, "false": 0, "t": 1, "f": 0,
}


def card_key(card: Column) -> Column:
    """Spelling-free form of a card name.

    Case, a HIERARCH prefix and separators don't count: `HIERARCH Det_Temp`,
    `DET-TEMP` and `det.temp` are all `DETTEMP`.
    """
    bare = F.regexp_replace(F.upper(F.trim(card)), r"^HIERARCH\s+", "")
    return F.regexp_replace(bare, r"[^A-Z0-9]", "")


def _json_kind(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind == "VOID", F.lit(None))
        .otherwise("number")
    )


def tracked_cards(
    headers: DataFrame,
    aliases: DataFrame,
    keys: list[str],
    json_col: str = "cards",
    fields: list[str] | None = None,
) -> DataFrame:
    """One row per card of a tracked field: keys, field_name, card, kind, value.

    `kind` is the JSON type of the value (null for JSON null), `value` its text.
    A dump that is null or no valid JSON object gives no rows. Repeated dumps
    give repeated rows. `aliases` has `card` and `field_name`.
    """
    wanted = list(fields or TARGETS)
    names = (
        aliases.where(F.col("field_name").isin(wanted))
        .select(card_key(F.col("card")).alias("__key"), "field_name")
        .distinct()
    )
    parsed = headers.select(*keys, F.try_parse_json(F.col(json_col)).alias("__v"))
    # Only objects explode; other JSON values have no cards.
    parsed = parsed.where(F.schema_of_variant("__v").startswith("OBJECT"))
    view = parsed.lateralJoin(
        headers.sparkSession.tvf.variant_explode(F.col("__v").outer()).select(
            F.col("key").alias("card"), F.col("value").alias("__value")
        )
    )
    cards = view.select(*keys, "card", "__value", card_key(F.col("card")).alias("__key"))
    return cards.join(names, "__key").select(
        *keys,
        "field_name",
        "card",
        _json_kind(F.col("__value")).alias("kind"),
        F.col("__value").cast("string").alias("value"),
    )


#: Migration steps that are changes; `base` (a field of the first version) and
#: `typed` (a type learned where all values were null so far) are none.
CHANGES = ("added", "removed", "renamed", "retyped")

_STEP = "struct<field_name:string,change_kind:string,card_was:string,card_now:string,kind_was:string,kind_now:string>"


def schema_versions(
    headers: DataFrame,
    aliases: DataFrame,
    device: str = "device_id",
    session: str = "session_id",
    order: str = "night",
    json_col: str = "cards",
    fields: list[str] | None = None,
) -> DataFrame:
    """The schema version of each session: one row per device and session.

    Columns: device, session, `at` (its first date), `version` (from 1 per
    device), `fingerprint` (hash of the cards and JSON types of the fields it
    has), `begins` (a version begins here), `steps` (the migration from the
    version before, empty unless one begins: structs of field_name, change_kind,
    card_was, card_now, kind_was, kind_now) and `rules` (what the steps up to
    here chain up to: structs of field_name, cards, kind).

    Sessions are ordered by `order`, then session id. A field is present if one
    dump of the session holds one of its cards, also with a null value; a session
    whose values are all null keeps the type known before. Several cards or types
    in one session are joined by `|` in name order. Rows without device or
    session can't be ordered and are left out. Empty input gives no rows.
    Aggregation by session happens before the windows, so they see one row per
    session however many dumps a device delivered.
    """
    wanted = list(fields or TARGETS)
    keys = [device, session]
    have = headers.where(F.col(device).isNotNull() & F.col(session).isNotNull())
    # Dumps of all sessions and the cards in them, brought together in one aggregation.
    none = F.lit(None).cast("string")
    marks = have.select(*keys, F.col(order).alias("__at"), none.alias("__f"), none.alias("__c"), none.alias("__k"))
    cards = tracked_cards(have, aliases, keys, json_col, wanted)
    both = marks.unionByName(cards.select(*keys, F.lit(None).cast(dict(marks.dtypes)["__at"]).alias("__at"), F.col("field_name").alias("__f"), F.col("card").alias("__c"), F.col("kind").alias("__k")))

    def joined(value: str, f: str) -> Column:
        values = F.sort_array(F.collect_set(F.when(F.col("__f") == f, F.col(value))))
        return F.nullif(F.array_join(values, "|"), F.lit(""))

    n = range(len(wanted))
    state = both.groupBy(*keys).agg(
        F.min("__at").alias("at"),
        *[joined("__c", f).alias(f"__card{i}") for i, f in enumerate(wanted)],
        *[joined("__k", f).alias(f"__kind{i}") for i, f in enumerate(wanted)],
    )
    w = Window.partitionBy(device).orderBy(F.col("at").asc_nulls_first(), session)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # Types carry on through sessions of nulls.
    typed = state.select(*keys, "at", *[f"__card{i}" for i in n], *[F.last(f"__kind{i}", ignorenulls=True).over(upto).alias(f"__kind{i}") for i in n])
    signs = [F.when(F.col(f"__card{i}").isNotNull(), F.concat_ws(":", F.lit(f), f"__card{i}", F.coalesce(f"__kind{i}", F.lit("null")))) for i, f in enumerate(wanted)]
    printed = typed.withColumn("fingerprint", F.sha2(F.concat_ws(";", *signs), 256).substr(1, 16))
    before = printed.select(
        "*",
        F.lag("fingerprint").over(w).alias("__was"),
        *[F.lag(f"__card{i}").over(w).alias(f"__card_was{i}") for i in n],
        *[F.lag(f"__kind{i}").over(w).alias(f"__kind_was{i}") for i in n],
    )
    begins = F.col("__was").isNull() | (F.col("__was") != F.col("fingerprint"))

    def steps_of(i: int, f: str) -> list[Column]:
        now, was, kind, known = (F.col(f"__{c}{i}") for c in ("card", "card_was", "kind", "kind_was"))
        stay = now.isNotNull() & was.isNotNull()

        def step(when: Column, name: str) -> Column:
            return F.when(when, F.struct(F.lit(f), F.lit(name), was, now, known, F.when(now.isNotNull(), kind)).cast(_STEP))

        first = F.col("__was").isNull()
        return [
            step(first & now.isNotNull(), "base"),
            step(~first & was.isNull() & now.isNotNull(), "added"),
            step(was.isNotNull() & now.isNull(), "removed"),
            step(stay & (now != was), "renamed"),
            step(stay & (kind != known), "retyped"),
            step(stay & kind.isNotNull() & known.isNull(), "typed"),
        ]

    steps = F.array_compact(F.array(*[x for i, f in enumerate(wanted) for x in steps_of(i, f)]))
    empty = F.array().cast(f"array<{_STEP}>")
    moved = before.select(*keys, "at", "fingerprint", begins.alias("begins"), F.when(begins, steps).otherwise(empty).alias("steps"))

    # The chain: the last step of a field up to here tells its rule.
    def rule(f: str) -> Column:
        mine = F.element_at(F.filter("steps", lambda x: x["field_name"] == f), -1)
        last = F.last(F.when(F.exists("steps", lambda x: x["field_name"] == f), mine), ignorenulls=True).over(upto)
        return F.when(last["card_now"].isNotNull(), F.struct(F.lit(f).alias("field_name"), F.split(last["card_now"], r"\|").alias("cards"), last["kind_now"].alias("kind")))

    return moved.select(
        *keys,
        "at",
        F.sum(F.col("begins").cast("int")).over(upto).cast("int").alias("version"),
        "fingerprint",
        "begins",
        "steps",
        F.array_compact(F.array(*[rule(f) for f in wanted])).alias("rules"),
    )


def migrations(versions: DataFrame, device: str = "device_id", session: str = "session_id") -> DataFrame:
    """The registry of versions: device, version, fingerprint, first_session, first_seen, last_seen, sessions, steps.

    versions comes from schema_versions. steps lead from the version before to
    this one; the first version's are its `base`.
    """
    begin = F.col("begins")
    return versions.groupBy(device, "version").agg(
        F.first("fingerprint").alias("fingerprint"),
        F.max(F.when(begin, F.col(session))).alias("first_session"),
        F.min("at").alias("first_seen"),
        F.max("at").alias("last_seen"),
        F.count("*").alias("sessions"),
        F.max(F.when(begin, F.col("steps"))).alias("steps"),
    )


def field_changes(
    headers: DataFrame,
    aliases: DataFrame,
    device: str = "device_id",
    session: str = "session_id",
    order: str = "night",
    json_col: str = "cards",
    fields: list[str] | None = None,
) -> DataFrame:
    """Changes of a field's card between consecutive sessions of a device.

    Returns device, session, field_name, change_kind (`added`, `removed`,
    `renamed`, `retyped`), each at most once per session and field: the steps
    recorded where a version of the device's schema begins. What counts as
    present, the order and bad input are as in schema_versions.
    """
    versions = schema_versions(headers, aliases, device, session, order, json_col, fields)
    each = versions.where("begins").select(device, session, F.explode("steps").alias("s"))
    return each.where(F.col("s.change_kind").isin(*CHANGES)).select(device, session, "s.field_name", "s.change_kind")


def _cast_rules() -> dict[str, Column]:
    text = F.trim(F.col("value"))
    codes = F.create_map(*[F.lit(x) for k, v in BAYER_CODES.items() for x in (str(k), v)])
    mounts = F.create_map(*[F.lit(x) for k, v in MOUNT_WORDS.items() for x in (k, v)])
    number = F.regexp_extract(text, r"^([+-]?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)\s*(?:°\s*)?[Cc]?$", 1)
    letters = F.upper(F.regexp_replace(text, r"[^A-Za-z0-9]", ""))
    whole = F.regexp_replace(F.lower(text), r"\.0+$", "")
    return {
        "det_temp": F.nullif(number, F.lit("")),
        "eq_mode": F.element_at(mounts, whole).cast("string"),
        "bayer_pattern": F.when(F.col("kind") == "number", F.element_at(codes, whole)).otherwise(
            F.coalesce(F.element_at(codes, letters), F.when(letters.rlike("^[RGB]{4}$"), letters))
        ),
    }


#: The standard card of a field, which needs no renaming, and the JSON type that needs no cast.
STANDARD = {"det_temp": ("DET-TEMP", "number"), "eq_mode": ("EQMODE", "number"), "bayer_pattern": ("BAYERPAT", "string")}


def unify(
    headers: DataFrame,
    aliases: DataFrame,
    key: str = "header_id",
    json_col: str = "cards",
    versions: DataFrame | None = None,
    device: str = "device_id",
    session: str = "session_id",
) -> DataFrame:
    """Every dump in one table: key, det_temp, eq_mode, bayer_pattern and its route.

    Columns: key, one typed column per field (null where the field is absent,
    null or not readable), `version` (the device's schema version whose rules
    were applied; null without versions or session), `fingerprint` (hash of the
    dump's own tracked card names and JSON types), `steps` (what was done, in
    order of the name: cast from a type that isn't the field's own, default for a
    field that the dump or its whole version lacks, null in the dump, reject of
    an unreadable value, rename of a card that isn't the standard one, unrouted
    for a card that its version has no rule for). versions comes from
    schema_versions. One row per distinct key; a dump that is no JSON object gets
    the defaults.
    """
    rules = _cast_rules()
    have = headers.where(F.col(key).isNotNull())
    keys = [key] if versions is None else [key, device, session]
    cards = tracked_cards(have, aliases, keys, json_col)
    if versions is None:
        ids = have.select(key, F.lit(None).cast("int").alias("version"), F.lit(None).cast("array<struct<field_name:string,cards:array<string>,kind:string>>").alias("rules"))
    else:
        ruled = versions.select(device, session, "version", "rules")
        ids = have.select(*keys).join(ruled, [device, session], "left").select(key, "version", "rules")
    ids = ids.groupBy(key).agg(F.min("version").alias("version"), F.min_by("rules", "version").alias("rules"))
    standard = F.create_map(*[F.lit(x) for f, (c, _) in STANDARD.items() for x in (f, c)])
    plain = F.create_map(*[F.lit(x) for f, (_, k) in STANDARD.items() for x in (f, k)])
    cast = F.coalesce(*[F.when(F.col("field_name") == f, c) for f, c in rules.items()])
    kinds = F.coalesce(F.col("kind"), F.lit("null"))
    done = cards.select(
        key,
        "field_name",
        "card",
        cast.alias("__text"),
        F.concat_ws(":", "field_name", "card", kinds).alias("__sig"),
        F.array_compact(
            F.array(
                F.when(F.col("card") != F.element_at(standard, F.col("field_name")), F.concat(F.lit("rename "), "card", F.lit(" -> "), "field_name")),
                F.when(F.col("kind") != F.element_at(plain, F.col("field_name")), F.concat(F.lit("cast "), "field_name", F.lit(" from "), "kind")),
                F.when(F.col("kind").isNull(), F.concat(F.lit("null "), "field_name")),
                F.when(cast.isNull() & F.col("kind").isNotNull(), F.concat(F.lit("reject "), "field_name", F.lit(" = "), "value")),
            )
        ).alias("__steps"),
    )
    # Several cards of one field in a dump: the first in name order that has a value.
    rank = F.struct(F.col("__text").isNull(), "card")
    picks = [
        F.min_by(F.when(F.col("field_name") == f, F.col("__text")), F.when(F.col("field_name") == f, rank)).alias(f)
        for f in TARGETS
    ]
    agg = done.groupBy(key).agg(
        *picks,
        F.sort_array(F.collect_set("__sig")).alias("__sigs"),
        F.flatten(F.collect_list("__steps")).alias("__applied"),
        F.collect_set("field_name").alias("__have"),
        F.collect_set(F.struct("field_name", "card")).alias("__cards"),
    )
    out = ids.join(agg, key, "left")
    text = F.array().cast("array<string>")
    missing = F.array_except(F.array(*map(F.lit, TARGETS)), F.coalesce("__have", text))
    known = F.transform("rules", lambda r: r["field_name"])
    defaults = F.transform(missing, lambda f: F.concat(F.lit("default "), f, F.when(F.array_contains(known, f), " = null, not in this dump").otherwise(" = null")))
    stray = F.filter("__cards", lambda c: F.col("rules").isNotNull() & ~F.exists("rules", lambda r: (r["field_name"] == c["field_name"]) & F.array_contains(r["cards"], c["card"])))
    unrouted = F.transform(stray, lambda c: F.concat(F.lit("unrouted "), c["card"]))
    return out.select(
        key,
        *[F.expr(f"try_cast({f} as {t})").alias(f) for f, t in TARGETS.items()],
        "version",
        F.sha2(F.array_join(F.coalesce("__sigs", text), ";"), 256).substr(1, 16).alias("fingerprint"),
        F.sort_array(F.array_distinct(F.concat(F.coalesce("__applied", text), defaults, F.coalesce(unrouted, text)))).alias("steps"),
    )


def versions(headers: DataFrame, unified: DataFrame, key: str = "header_id", order: str = "night") -> DataFrame:
    """The schema versions seen: fingerprint, version number, dumps, first and last date.

    Versions are numbered by their first date (ties by fingerprint). The number
    of versions is bounded by the spellings and types, not by the rows.
    """
    seen = (
        headers.select(key, order)
        .join(unified.select(key, "fingerprint"), key)
        .groupBy("fingerprint")
        .agg(F.count("*").alias("dumps"), F.min(order).alias("first_seen"), F.max(order).alias("last_seen"))
    )
    w = Window.orderBy(F.col("first_seen").asc_nulls_last(), "fingerprint")
    return seen.select("fingerprint", F.row_number().over(w).alias("version"), "dumps", "first_seen", "last_seen")
