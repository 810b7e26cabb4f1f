"""Equipment and report operators on small cases: nulls, ties, nothing at all."""

import json

import pytest
from pyspark.sql import functions as F

from frameloom.operators import colour, equipment, groups, reports
from tests.conftest import rows


def test_mounts(spark):
    data = [(0, 0, None, None, "Petrel"), (1, 1, "ALTAZ", None, None), (2, None, "alt-az", None, ""), (3, None, None, "AltAz fork", None), (4, None, None, None, "Dwarf 3 mini"), (5, None, None, None, "Seestar S50"), (6, None, "", "", "Petrel"), (7, None, None, None, " "), (8, 7, None, None, None)]
    df = spark.createDataFrame(data, "k int, q int, e string, m string, t string")
    m = equipment.mount_type(*(F.col(c) for c in "qemt"))
    assert rows(df.select("k", m["mount"], m["source"])) == [
        (0, "az", "mode"), (1, "eq", "mode"), (2, "az", "equat"), (3, "az", "mount"), (4, "az", "telescope"), (5, "az", "telescope"), (6, "eq", "default"), (7, "eq", "unknown"), (8, "eq", "unknown"),
    ]
    a = equipment.registration_advice(F.col("q") == 1, F.lit("Duo-Band"))
    assert rows(df.where("k < 3").select("k", a["advice"], a["max_rotation"])) == [(0, "astroalign", 30), (1, "astroalign", None), (2, "astroalign", 30)]


def test_scale_placeholders_and_profiles(spark):
    one = spark.range(1)
    f = lambda *a: tuple(one.select(equipment.debayer_factor(*a).alias("f")).first().f)
    t = F.lit(True)
    assert f(F.lit("superpixel"), ~t) == (2.0, "auto_data") and f(F.lit("superpixel"), t) == (1.0, "auto_data") and f(F.lit("x"), ~t) == (2.0, "default")
    assert f(F.lit("malvar"), ~t, F.lit(3)) == (3.0, "explicit") and f(F.lit("malvar"), ~t, F.lit(None), F.lit(1.5)) == (1.5, "preset")
    p = spark.createDataFrame([("",), ("Unknown",), ("0",), (" a ",), (None,)], "v string")
    assert [r[0] for r in p.select(equipment.placeholder_null(F.col("v"))).collect()] == [None, None, None, "a", None]
    items = spark.createDataFrame([(1, "DWARF mini", 1), (2, "dwarf", None), (3, "other", 0), (4, None, None)], "k int, t string, q int")
    profiles = spark.createDataFrame([("small", "dwarf", 0, "az"), ("mini", "Dwarf Mini", 1, "az"), ("none", "unknown", 2, "eq")], "name string, pattern string, ord int, mount string")
    assert rows(equipment.detect_profile(items, "k", "t", profiles, "q")) == [(1, "mini", "eq"), (2, "small", "az"), (3, None, None), (4, None, None)]
    assert {r[1] for r in rows(equipment.detect_profile(items, "k", "t", profiles.limit(0), "q"))} == {None}


def test_majorities_and_sources(spark):
    df = spark.createDataFrame([("a", 3, 1, 1), ("a", 1, 2, 0), ("a", 2, 2, None), ("a", 0, 1, 0), ("b", 0, None, None)], "k string, i int, v int, eq_mode int")
    assert rows(equipment.majority_value(df, "k", "v", "i")) == [("a", 1, 2)]
    assert rows(equipment.mode_majority(df, "k")) == [("a", 1, 2, 1, 0, False), ("b", 0, 0, 1, None, True)]
    s = equipment.with_source({"x": F.col("v"), "y": F.col("eq_mode")})
    assert rows(df.select("i", s["source"]).where("k = 'b'")) == [(0, "none")]
    assert rows(equipment.first_known(df, "k", "i", {"v": F.col("eq_mode")})) == [("a", 0), ("b", None)]


def test_header_gaps_and_filters(spark):
    df = spark.createDataFrame([(1, {"OBJECT": "x", "XPIXSZ": "2.92"}, True), (2, {"XPIXSZ": "7"}, False), (3, None, None), (4, {"OBJECT": "x", "XPIXSZ": "no", "D": "1"}, True)], "k int, c map<string,string>, d boolean")
    assert rows(reports.header_gaps(df, ["k"], "c", ["OBJECT"], drizzled=F.col("d"), drizzle_cards=["D"])) == [(1, "D", "FAIL"), (2, "OBJECT,XPIXSZ", "FAIL"), (3, "", "SKIPPED"), (4, "XPIXSZ", "FAIL")]
    f = spark.createDataFrame([(1, " vis"), (2, None), (3, "Red")], "k int, f string")
    assert rows(reports.of_filters(f, "f", ["VIS", ""]).select("k")) == [(1,)] and reports.of_filters(f, "f", None).count() == 3 and reports.of_filters(f, "f", []).count() == 0
    assert rows(reports.unknown_filters(f, "f", ["x", "red", "X", ""])) == [("x", 0)]


def test_scans_suggestions_and_lookups(spark):
    light = spark.createDataFrame([("s", 1.0, 1, "A"), ("s", 1.0, 0, " B "), ("s", 2.0, 0, "A"), ("s", 3.0, 0, "B"), ("s", 4.0, 0, ""), ("t", 1.0, 0, "A"), ("u", 1.0, 0, None)], "k string, g double, i int, object_name string")
    assert rows(reports.object_scan(light, "k", "g", "i")) == [("s", "B", "B|A", True), ("t", "A", "A", False)]
    names = spark.createDataFrame([(2, "QV 7"), (1, "qv-7"), (3, None)], "entry_id long, name string")
    heads = spark.createDataFrame(
        [("a", "QV7", "VIS", 60.0, "Seestar", None, None, None, False), ("b", "Other", None, 150.0, None, None, None, None, True), ("c", None, "VIS", 10.0, "Petrel", 1, None, None, None)],
        "k string, object_name string, filter_name string, exptime double, telescope string, eq_mode int, equat string, mount string, mixed boolean",
    )
    types = spark.createDataFrame([(1, "galaxy")], "entry_id long, target_type string")
    presets = spark.createDataFrame([("galaxy", "galaxy")], "target_type string, preset string")
    got = {r.k: r for r in reports.suggest(heads, "k", names, types, presets).collect()}
    assert (got["a"].target_source, got["a"].preset, got["a"].mount, got["a"].registration, got["a"].warnings, got["a"].colour_calibration) == ("cache", "galaxy", "az", "astroalign", "", True)
    assert (got["b"].target_source, got["b"].mount, got["b"].options, got["b"].missing, got["b"].warnings) == ("header", "unknown", "astroalign|fft", "FILTER,TELESCOP", "mixed_targets,header_incomplete,mount_unknown")
    assert (got["c"].target_source, got["c"].mount, got["c"].registration, got["c"].missing) == ("none", "eq", "fft", "OBJECT")


def test_reports_of_a_run(spark):
    tables = {
        "groups": spark.createDataFrame([("a", 3, 30.0), ("b", 2, None)], "group_hash string, frame_count long, total_exposure double"),
        "registrations": spark.createDataFrame([("ok",), ("ok",), ("rejected",)], "status string"),
        "reference": spark.createDataFrame([("a", "quality")], "group_hash string, method string"),
        "merge_skipped": spark.createDataFrame([("b", "low_corr_hp")], "group_hash string, reason string"),
    }
    doc = reports.run_report(tables)
    got = json.loads(doc.first().report)
    assert got["frames_registered"] == 2 and got["groups"][0] == {"group_hash": "a", "frame_count": 3, "total_exposure": 30.0} and got["skipped"][0]["reason"] == "low_corr_hp"
    read = reports.read_report(doc, "report", {"ref": ["$.merge.reference", "$.reference.group_hash"], "none": ["$.x"]}).first()
    assert read.ref == "a" and read.none is None
    with pytest.raises(ValueError):
        reports.run_report({})
    g = spark.createDataFrame([("a", 5, 1.0, 0), ("b", 9, 1.0, 1)], "k string, frame_count int, score double, ord int")
    r = reports.selection_report(g, "k", groups.reference_by_signal(g, "k"), "signal").first()
    assert (r.method, r.reference, json.loads(r.scores)) == ("largest", "b", {"a": 1.0, "b": 1.0}) and r.fallback
    files = spark.createDataFrame([("r", "x_stack.fits"), ("r", "x_merged.fits"), ("s", "z.fits"), ("s", None)], "run string, path string")
    assert rows(reports.final_products(files, "run", "path")) == [("r", "x_merged.fits"), ("s", "z.fits")]


def test_worst_runs_temperatures_and_busiest(spark):
    checks = spark.createDataFrame([("t", 1, "PASS"), ("t", 2, "FAIL"), ("u", 3, "SKIPPED")], "t string, r int, status string")
    assert rows(reports.worst_runs(checks, "r", "t")) == [("t", 2, 2), ("u", 1, 1)]
    f = spark.createDataFrame([(1, "light", 10.0), (1, "dark", 2.0), (2, "light", 500.0), (2, "dark", 1.0)], "k int, frame_type string, ccd_temp double")
    assert rows(reports.temperature_gap(f, "k")) == [(1, 2, 1, 8.0, True), (2, 2, 1, None, False)]
    t = spark.createDataFrame([("b",), ("a",), ("a",), ("c",), (None,)], "o string")
    assert rows(reports.busiest(t, "o", 2)) == [("a", 2, 1), ("b", 1, 2)]
    w = spark.createDataFrame([("g", c, float(v)) for c in range(2) for v in (0, 10 * (c + 1))], "g string, c int, value double")
    assert rows(colour.gray_world(w, "g")) == [("g", 0, 1.5), ("g", 1, 0.75)]
