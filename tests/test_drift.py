import json
from datetime import date

from frameloom.operators import drift
from tests.conftest import rows

ALIASES = [("DET-TEMP", "det_temp"), ("CCD-TEMP", "det_temp"), ("EQMODE", "eq_mode"), ("BAYERPAT", "bayer_pattern"), ("GAIN", "gain")]


def make(spark, dumps):
    data = [(i, d, s, None if n is None else date(2024, 1, n), None if c is None else c if isinstance(c, str) else json.dumps(c)) for i, (d, s, n, c) in enumerate(dumps)]
    heads = spark.createDataFrame(data, "header_id long, device_id string, session_id long, night date, cards string")
    return heads, spark.createDataFrame(ALIASES, "card string, field_name string")


def test_each_kind_of_change(spark):
    heads, al = make(
        spark,
        [
            ("a", 1, 1, {"DET-TEMP": 1.5, "EQMODE": 1}),
            ("a", 2, 2, {"CCD-TEMP": "1.5 C", "EQMODE": True, "BAYERPAT": ["R", "G", "G", "B"]}),
            ("a", 3, 3, {"HIERARCH ccd_temp": "1", "BAYERPAT": None}),
            ("b", 4, 1, {"EQMODE": 1}),
        ],
    )
    got = rows(drift.field_changes(heads, al))
    assert got == [
        ("a", 2, "bayer_pattern", "added"),
        ("a", 2, "det_temp", "renamed"),
        ("a", 2, "det_temp", "retyped"),
        ("a", 2, "eq_mode", "retyped"),
        ("a", 3, "det_temp", "renamed"),
        ("a", 3, "eq_mode", "removed"),
    ]


def test_a_dump_that_lacks_a_card_or_holds_null_is_no_change(spark):
    heads, al = make(spark, [("a", 1, 1, {"EQMODE": 1}), ("a", 2, 2, {"EQMODE": None}), ("a", 2, 2, {}), ("a", 2, 2, {"EQMODE": 0}), ("a", 3, 3, {"EQMODE": None}), ("a", 4, 4, {"EQMODE": 1})])
    assert rows(drift.field_changes(heads, al)) == []


def test_order_is_by_night_not_by_session(spark):
    heads, al = make(spark, [("a", 1, 9, {"EQMODE": 1}), ("a", 2, 3, {})])
    assert rows(drift.field_changes(heads, al)) == [("a", 1, "eq_mode", "added")]


def test_bad_input_gives_defined_results(spark):
    heads, al = make(spark, [("a", 1, 1, "no json"), ("a", 2, 2, None), ("a", 3, None, "[1, 2]"), (None, 4, 1, {"EQMODE": 1}), ("a", 5, 5, {"EQMODE": "x" * 100_000})])
    assert rows(drift.field_changes(heads, al)) == [("a", 5, "eq_mode", "added")]
    assert drift.field_changes(heads.limit(0), al).count() == 0


def test_extra_columns_do_not_clash(spark):
    heads, al = make(spark, [("a", 1, 1, {}), ("a", 2, 2, {"EQMODE": 1})])
    from pyspark.sql import functions as F

    for c in ("field_name", "card", "kind", "value", "change_kind", "key"):
        heads = heads.withColumn(c, F.lit("x"))
    assert rows(drift.field_changes(heads, al)) == [("a", 2, "eq_mode", "added")]


def test_one_typed_table(spark):
    heads, al = make(
        spark,
        [
            ("a", 1, 1, {"DET-TEMP": "+85.0°C", "EQMODE": "altaz", "BAYERPAT": 2}),
            ("a", 1, 1, {"CCD-TEMP": -3, "EQMODE": True, "BAYERPAT": ["G", "R", "B", "G"]}),
            ("a", 1, 1, {"DET-TEMP": "warm", "BAYERPAT": "rggb"}),
            ("a", 1, 1, None),
        ],
    )
    out = {r.header_id: r for r in drift.unify(heads, al).collect()}
    assert [(out[i].det_temp, out[i].eq_mode, out[i].bayer_pattern) for i in range(4)] == [(85.0, 0, "BGGR"), (-3.0, 1, "GRBG"), (None, None, "RGGB"), (None, None, None)]
    assert "rename CCD-TEMP -> det_temp" in out[1].steps and "reject det_temp = warm" in out[2].steps and "default eq_mode = null" in out[2].steps
    assert len({r.fingerprint for r in out.values()}) == 4
    v = drift.versions(heads, drift.unify(heads, al)).collect()
    assert [r.version for r in v] == [1, 2, 3, 4] and sum(r.dumps for r in v) == 4


def test_versions_chain_migration_steps_to_rules(spark):
    heads, al = make(
        spark,
        [
            ("a", 1, 1, {"DET-TEMP": 1.5}),
            ("a", 2, 2, {"DET-TEMP": 1.0}),
            ("a", 3, 3, {"CCD-TEMP": None}),
            ("a", 4, 4, {"CCD-TEMP": "2"}),
            ("a", 5, 5, {}),
            ("a", 6, 6, {"CCD-TEMP": "3", "EQMODE": None}),
            ("a", 7, 7, {"CCD-TEMP": "3", "EQMODE": 1}),
            ("b", 8, 1, {"EQMODE": 0}),
        ],
    )
    v = drift.schema_versions(heads, al)
    got = {r.session_id: r for r in v.collect()}
    assert [got[i].version for i in range(1, 9)] == [1, 1, 2, 3, 4, 5, 6, 1]
    kinds = {i: [(s.change_kind, s.field_name) for s in got[i].steps] for i in got}
    assert kinds == {
        1: [("base", "det_temp")], 2: [], 3: [("renamed", "det_temp")], 4: [("retyped", "det_temp")], 5: [("removed", "det_temp")],
        6: [("added", "det_temp"), ("added", "eq_mode")], 7: [("typed", "eq_mode")], 8: [("base", "eq_mode")],
    }
    assert [(r.field_name, r.cards, r.kind) for r in got[3].rules] == [("det_temp", ["CCD-TEMP"], "number")] and got[5].rules == []
    m = {(r.device_id, r.version): r for r in drift.migrations(v).collect()}
    assert len(m) == 7 and m["a", 1].sessions == 2 and m["a", 2].first_session == 3
    out = {r.header_id: r for r in drift.unify(heads, al, versions=v).collect()}
    assert out[3].version == 3 and out[3].det_temp == 2.0 and out[3].steps == ["cast det_temp from string", "default bayer_pattern = null", "default eq_mode = null", "rename CCD-TEMP -> det_temp"]
    assert "default det_temp = null" in out[4].steps and out[4].version == 4


def test_a_dump_that_lacks_a_card_of_its_version_is_told(spark):
    heads, al = make(spark, [("a", 1, 1, {"EQMODE": 1}), ("a", 1, 1, {}), (None, 2, 1, {"EQMODE": 1})])
    out = {r.header_id: r for r in drift.unify(heads, al, versions=drift.schema_versions(heads, al)).collect()}
    assert "default eq_mode = null, not in this dump" in out[1].steps and out[2].version is None and out[2].eq_mode == 1
    assert drift.schema_versions(heads.limit(0), al).count() == drift.migrations(drift.schema_versions(heads.limit(0), al)).count() == 0
