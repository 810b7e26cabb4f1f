import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.plans import config, pipeline, steps
from frameloom.streaming import ingest
from tests.conftest import SMALL, rows
from tests.test_kernels import scene


def test_configuration(tmp_path):
    assert config.expand_env({"a": ["${X}", "${Y:-d}", "${Z}"]}, {"X": "1"}) == {"a": ["1", "d", "${Z}"]}
    assert config.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert config.get_path(config.set_path({}, "a.b", 1), "a.b") == 1 and config.get_path({}, "a.b", 5) == 5
    (tmp_path / "c.json").write_text(json.dumps({"merge": {"method": "median"}}))
    p = config.resolve({"stacking": {"method": "median"}}, config.load_tree(str(tmp_path / "c.json")), {"stacking": {"method": "average", "normalise": "add"}})
    assert (p.stacking.method, p.stacking.normalise, p.merge.method, p.selection.keep_percent) == ("median", "add", "median", 92.0)
    with pytest.raises(ValueError):
        config.resolve({"no_such": 1})
    (tmp_path / ".env").write_text("# x\nexport A='1 2'\nB=3\n")
    assert config.read_env_file(str(tmp_path / ".env")) == {"A": "1 2", "B": "3"}
    assert config.preset_for("star", [{"target_types": ["galaxy"]}, {"target_types": ["star"], "n": 1}])["n"] == 1


def test_steps():
    r = steps.Registry()
    assert r.add(steps.FunctionStep("a", lambda c: {"t": 1})) and not r.add(steps.FunctionStep("a", lambda c: {})) and not r.add(object())
    r.add(steps.FunctionStep("bad", lambda c: 1 / 0))
    c = steps.Context({})
    out = steps.run_steps(["a", "bad", "unknown", "done"], r, c, {"done"})
    assert [x.ok for x in out] == [True, False, False] and c.tables == {"t": 1} and r.names() == ["a", "bad"]


def observation(spark):
    img, _ = scene(32, 32, 6, 5)
    frames, tensors = [], []
    for g, (exp, gain) in enumerate([(15.0, 60), (60.0, 60)]):
        for i in range(4):
            fid = f"l{g}{i}"
            frames.append((fid, i, "light", exp, gain, "QV 1", -5.0, None))
            moved = np.roll(img, (i, -i), (0, 1)) + 10
            tensors.append((fid, 32, 32, 1, moved.ravel().tolist()))
        frames.append((f"d{g}", 0, "dark", exp, gain, None, -5.0, None))
        tensors.append((f"d{g}", 32, 32, 1, np.full((32, 32), 10.0).ravel().tolist()))
    f = spark.createDataFrame(frames, "frame_id string, idx int, frame_type string, exptime double, gain int, object_name string, ccd_temp double, filter_name string")
    return f, spark.createDataFrame(tensors, "frame_id string, h int, w int, ch int, data array<double>"), img


def test_the_whole_plan(spark):
    f, t, img = observation(spark)
    c, results = pipeline.process(f, t, {"steps": ["calibrate", "register", "select", "stack", "gradient", "merge"], "stacking": {"method": "sigma_clip", "normalise": "none"}})
    assert all(r.ok for r in results), [r.notes for r in results]
    assert c.tables["reference"].first().group_hash in ("15s60", "60s60")
    merged = {(r.y, r.x): r.merged for r in c.tables["merged"].collect()}
    out = np.array([[merged[y, x] for x in range(32)] for y in range(32)])
    assert np.corrcoef(out[6:-6, 6:-6].ravel(), img[6:-6, 6:-6].ravel())[0, 1] > 0.8
    assert {r.status for r in c.tables["registrations"].collect()} <= {"ok", "zero_shift"}
    assert c.tables["quality"].count() == 8
    assert rows(pipeline.inspect(f).select("group_hash", "frames", "incomplete")) == [("15s60", 4, 0), ("60s60", 4, 0)]
    assert rows(pipeline.darks_coverage(f)) == [("15s60", 4, 1, "few"), ("60s60", 4, 1, "few")]


def test_selection_within_the_plan(spark):
    f, t, _ = observation(spark)
    c, results = pipeline.process(f, t, {"steps": ["register", "select"], "selection": {"enabled": True, "keep_percent": 50.0, "min_frames": 1}})
    assert all(r.ok for r in results)
    assert c.tables["quality"].groupBy("decision").count().count() >= 1 and c.tables["selected"].count() <= 4


def test_colour_and_repairs(spark):
    f, t, _ = observation(spark)
    c, results = pipeline.process(f, t, {"steps": ["cosmetic", "debayer", "stack", "gradient"], "cosmetic": {"enabled": True, "threshold": 500.0}, "gradient": {"enabled": True, "cells": 8, "degree": 1}, "stacking": {"method": "median"}})
    assert all(r.ok for r in results), [r.notes for r in results]
    assert {r.c for r in c.tables["stacks"].select("c").distinct().collect()} == {0, 1, 2}
    assert {r.overall for r in pipeline.qc(c.tables["stacks"]).collect()} <= {"PASS", "FAIL"}


def test_cosmetic_of_mixed_sizes_and_channels(spark):
    """Each size is repaired at its own positions, within a group as well; colour lights stay in the plan."""
    frames, tensors = [], []

    def add(fid, exp, img):
        frames.append((fid, len(frames), "light", exp, 60, "QV 1", -5.0, None))
        h, w, ch = (*img.shape, 1)[:3]
        tensors.append((fid, h, w, ch, img.ravel().tolist()))

    for i in range(3):
        for name, exp, shape, at in (("wide", 15.0, (8, 16), (3, 11)), ("narrow", 60.0, (12, 8), (9, 5)), ("tall", 15.0, (16, 8), (13, 2))):
            img = np.full(shape, 10.0)
            img[at] = 900.0
            add(f"{name}{i}", exp, img)
        add(f"colour{i}", 15.0, np.arange(8 * 16 * 3, dtype=float).reshape(8, 16, 3))
    f = spark.createDataFrame(frames, "frame_id string, idx int, frame_type string, exptime double, gain int, object_name string, ccd_temp double, filter_name string")
    t = spark.createDataFrame(tensors, "frame_id string, h int, w int, ch int, data array<double>")
    c, results = pipeline.process(f, t, {"steps": ["cosmetic"], "cosmetic": {"enabled": True, "threshold": 500.0}})
    assert all(r.ok for r in results), [r.notes for r in results]
    got = {r.frame_id: r for r in c.tables["images"].collect()}
    assert set(got) == {r[0] for r in tensors}
    for fid, h, w, ch, data in tensors:
        assert (got[fid].h, got[fid].w, got[fid].ch) == (h, w, ch)
        assert got[fid].data == (data if ch == 3 else [10.0] * (h * w))
    assert rows(c.tables["bad_pixels"].select("group_hash", "h", "w", "y", "x", "hits")) == [("15s60", 16, 8, 13, 2, 3), ("15s60", 8, 16, 3, 11, 3), ("60s60", 12, 8, 9, 5, 3)]


def test_drizzle_and_alignment_of_groups(spark):
    f, t, _ = observation(spark)
    c, results = pipeline.process(f, t, {"steps": ["register", "stack", "drizzle", "cross_register", "merge"], "drizzle": {"enabled": True, "min_frames": 3}, "stacking": {"method": "median", "normalise": "none"}})
    assert all(r.ok for r in results), [r.notes for r in results]
    d = c.tables["drizzled"]
    assert d.where("weight <= 0").count() == 0 and d.groupBy("group_hash").count().count() <= 2
    cross = c.tables["cross_group"].collect()
    assert len(cross) == 2 and all(r.ok and abs(r.dy) < 1 and abs(r.dx) < 1 for r in cross)
    assert c.tables["merged"].count() == 32 * 32
    assert {r.phases > 0 for r in c.tables["drizzle_stats"].collect()} <= {True}


def test_drizzle_takes_calibrated_selected_frames(spark):
    f, t, _ = observation(spark)
    t = t.withColumn("data", F.transform("data", lambda v: v + 500.0))
    c, results = pipeline.process(f, t, {"steps": ["calibrate", "cosmetic", "debayer", "register", "select", "drizzle"], "cosmetic": {"enabled": True, "threshold": 5000.0}, "drizzle": {"enabled": True, "min_frames": 1}, "selection": {"enabled": True, "keep_percent": 50.0, "min_frames": 1}})
    assert all(r.ok for r in results), [r.notes for r in results]
    kept = c.tables["registrations"].where("status = 'ok'").join(c.tables["selected"].select("frame_id"), "frame_id").groupBy("group_hash").count()
    kept = {r[0]: r[1] for r in kept.collect()}
    got = {r.group_hash: r for r in c.tables["drizzled"].groupBy("group_hash").agg(F.sum("weight").alias("weight"), F.median("value").alias("value"), F.collect_set("c").alias("c")).collect()}
    assert kept and set(got) == set(kept) and all(n < 4 for n in kept.values())
    for g, r in got.items():
        assert abs(r.weight - kept[g] * 32 * 32) < 0.1 and r.value < 500 and set(r.c) == {0, 1, 2}


def test_drizzle_scales_shifts_to_the_mosaic(spark):
    mosaic = np.array([[1.0, 2.0], [2.0, 3.0]])
    mosaic = np.tile(mosaic, (2, 2)).ravel()
    schema = "frame_id string, h int, w int, ch int, data array<double>"
    shots = lambda off: spark.createDataFrame([(i, 4, 4, 1, (mosaic + off).tolist()) for i in "abc"], schema)
    reg = [("a", "g", 0, 2, 2, 3, 0.0, 0.0, "ok"), ("b", "g", 1, 2, 2, 3, 1.0, -1.0, "ok"), ("c", "g", 2, 2, 2, 3, 9.0, 9.0, "ok")]
    reg = spark.createDataFrame(reg, "frame_id string, group_hash string, idx int, h int, w int, ch int, dy double, dx double, status string")
    chosen = spark.createDataFrame([("a", "g"), ("b", "g")], "frame_id string, group_hash string")
    tables = {"tensors": shots(500.0), "unregistered": shots(0.0), "registrations": reg, "selected": chosen}
    out = pipeline.drizzle_groups(steps.Context(tables, config.resolve({"drizzle": {"enabled": True, "min_frames": 2}})))
    got = {(r.y, r.x, r.c): (r.value, r.weight) for r in out["drizzled"].collect()}
    want = {}
    for y0, x0 in ((0, 0), (2, -2)):
        for y in range(4):
            for x in range(4):
                at = (2 * (y + y0), 2 * (x + x0), y % 2 + x % 2)
                want[at] = (1.0 + y % 2 + x % 2, want.get(at, (0, 0))[1] + 1.0)
    assert got == want
    assert [r.phases for r in out["drizzle_stats"].collect()] == [2]
    none = pipeline.drizzle_groups(steps.Context(tables, config.resolve({"drizzle": {"enabled": True, "min_frames": 3}})))
    assert none["drizzled"].count() == 0


def test_registration_methods(spark):
    f, t, _ = observation(spark)
    found = {}
    for method in ("fft", "upsampled_fft", "grid", "astroalign"):
        c, results = pipeline.process(f, t, {"steps": ["register"], "registration": {"method": method}})
        found[method] = results[0].ok and {r.frame_id: (r.dy, r.dx) for r in c.tables["registrations"].collect()}
    assert found["grid"]["l02"] == (-2.0, 2.0) and all(abs(a - b) < 0.6 for a, b in zip(found["upsampled_fft"]["l02"], (-2, 2)))
    assert found["astroalign"] is False and "astroalign" in results[0].notes["reason"]


def test_groups_without_alignment_are_not_merged(spark):
    px = [(g, y, 0, 0, 1, v) for g, v in (("a", 1.0), ("b", 50.0), ("d", 70.0)) for y in range(2)]
    tables = {
        "stacks": spark.createDataFrame(px, "group_hash string, y int, x int, c int, n long, value double"),
        "groups": spark.createDataFrame([("a", 5), ("b", 4), ("d", 3)], "group_hash string, frame_count long"),
        "registrations": spark.createDataFrame([(g, "ok", 0.9) for g in "abd"], "group_hash string, status string, corr_hp double"),
        "cross_group": spark.createDataFrame([("a", 1.0, True), ("b", 0.1, False), ("d", None, False)], "group_hash string, corr_hp double, ok boolean"),
    }
    out = pipeline.merge(steps.Context(tables, config.resolve()))
    assert [r.merged for r in out["merged"].collect()] == [1.0, 1.0]
    assert rows(out["merge_skipped"]) == [("b", "low_corr_hp"), ("d", "other_size")]


def test_streaming_counts_each_frame_once(spark, tmp_path):
    batch = spark.read.parquet(f"{SMALL}/frames.parquet").select("frame_id", "device_id", "exptime", "received_at")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.delivered(spark, str(tmp_path / "in"), batch.schema, late="20000 days")
    n = stream.groupBy().count().writeStream.format("memory").queryName("n").outputMode("complete").trigger(availableNow=True).start()
    n.awaitTermination()
    assert spark.table("n").first()[0] == batch.select("frame_id").distinct().count()
    q = ingest.run(ingest.hourly_counts(ingest.delivered(spark, str(tmp_path / "in"), batch.schema)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert q.exception() is None and spark.read.parquet(str(tmp_path / "out")).columns == ["start", "device_id", "frames", "exposure"]

FRAME = "frame_id string, idx int, frame_type string, exptime double, gain int, object_name string, ccd_temp double, filter_name string"
TENSOR = "frame_id string, h int, w int, ch int, data array<double>"


def flats_of(values):
    return [float(v) for v in values]


def test_darks_reach_filtered_lights_by_tier(spark):
    """Headerless darks have no filter; exposure, gain and temperature decide."""
    frames = [("l1", 0, "light", 60.0, 40, "x", -5.0, "Duo-Band"), ("l2", 1, "light", 60.0, 40, "x", -5.0, None), ("l3", 2, "light", 30.0, 40, "x", 20.0, "VIS"), ("l4", 3, "light", 5.0, 80, "x", -5.0, None)]
    frames += [("d1", 4, "dark", 60.4, 40, None, -4.0, None), ("d2", 5, "dark", 60.0, 80, None, -5.0, None)]
    data = {"l1": 100, "l2": 100, "l3": 100, "l4": 100, "d1": 10, "d2": 90, "k1": 30}
    t = spark.createDataFrame([(k, 2, 2, 1, flats_of([v] * 4)) for k, v in data.items()], TENSOR)
    c = steps.Context({"frames": pipeline.discover(spark.createDataFrame(frames, FRAME)), "tensors": t, "library": spark.createDataFrame([("k1", 30.0, 40, 12.0)], "frame_id string, exptime double, gain int, ccd_temp double")}, config.resolve())
    out = pipeline.calibrate(c)
    got = {r.frame_id: (r.dark_mode, r.data[0]) for r in out["images"].collect()}
    assert got == {"l1": ("full", 90.0), "l2": ("full", 90.0), "l3": ("full", 70.0), "l4": ("none", 100.0)}
    assert rows(out["dark_tiers"]) == [("30s40_vis", "library_nearest", 1), ("5s80", "none", 0), ("60s40", "local", 1), ("60s40_duo-band", "local", 1)]


def test_flats_and_bias(spark):
    frames = [("l1", 0, "light", 60.0, 40, "x", -5.0, "VIS"), ("l2", 1, "light", 60.0, 40, "x", -5.0, "Red"), ("b", 2, "bias", 0.0, 40, None, None, None)]
    frames += [(f"f{i}", 3 + i, "flat", 1.0, 40, None, None, "VIS") for i in range(2)] + [("f9", 9, "flat", 1.0, 40, None, None, "Red")]
    data = {"l1": [110, 60, 110, 110], "l2": [110, 60, 110, 110], "b": [10] * 4, "f0": [20, 10, 20, 20], "f1": [40, 20, 40, 40], "f9": [1, 2, 3, 4]}
    t = spark.createDataFrame([(k, 2, 2, 1, flats_of(v)) for k, v in data.items()], TENSOR)
    c = steps.Context({"frames": pipeline.discover(spark.createDataFrame(frames, FRAME)), "tensors": t}, config.resolve({"calibration": {"use_bias": True, "use_flats": True}}))
    got = {r.frame_id: r.data for r in pipeline.calibrate(c)["images"].collect()}
    # A filter with one flat has no master.
    assert got == {"l1": [100.0] * 4, "l2": [100.0, 50.0, 100.0, 100.0]}


def test_bad_pixels_where_the_dark_is_normal(spark):
    frames = [(f"l{i}", i, "light", 60.0, 40, "x", -5.0, None) for i in range(3)] + [("d", 9, "dark", 60.0, 40, None, -5.0, None)]
    img, dark = np.full((8, 8), 100.0), np.full((8, 8), 10.0)
    img[2, 2] = img[5, 5] = 900.0
    dark[5, 5] = 400.0
    t = spark.createDataFrame([(f"l{i}", 8, 8, 1, img.ravel().tolist()) for i in range(3)] + [("d", 8, 8, 1, dark.ravel().tolist())], TENSOR)
    c, results = pipeline.process(spark.createDataFrame(frames, FRAME), t, {"steps": ["calibrate", "cosmetic"], "cosmetic": {"enabled": True}})
    assert all(r.ok for r in results), [r.notes for r in results]
    assert rows(c.tables["bad_pixels"].select("y", "x", "hits")) == [(2, 2, 3)]
    assert {r.fixed for r in c.tables["interpolated"].collect()} == {1}
    got = np.array(c.tables["images"].first().data).reshape(8, 8)
    assert got[2, 2] == 90.0 and got[5, 5] == 500.0


def gate_tables(spark, cross, exposure=None):
    groups = [("a", 9, exposure and exposure[0]), ("b", 5, exposure and exposure[1]), ("d", 4, exposure and exposure[2])]
    return {
        "stacks": spark.createDataFrame([(g, 0, 0, 0, 1, v) for g, v in (("a", 1.0), ("b", 4.0), ("d", 70.0))], "group_hash string, y int, x int, c int, n long, value double"),
        "groups": spark.createDataFrame(groups, "group_hash string, frame_count long, total_exposure double"),
        "registrations": spark.createDataFrame([(g, "ok", q) for g, q in (("a", 0.9), ("b", 0.8), ("d", 0.7)) for _ in range(3)], "group_hash string, status string, corr_hp double"),
        "cross_group": spark.createDataFrame(cross, "group_hash string, corr_hp double, rotation_deg double, n_control_points int, ok boolean"),
    }


def test_the_merge_heeds_gate_weight_and_reference(spark):
    cross = [("a", 1.0, 0.0, None, True), ("b", 0.5, 0.0, 40, True), ("d", 0.4, 0.0, 12, True)]
    tables = gate_tables(spark, cross, (90.0, 10.0, 100.0))
    out = pipeline.merge(steps.Context(dict(tables), config.resolve({"merge": {"weight": "total_exposure"}})))
    assert rows(out["merge_skipped"]) == [("d", "few_control_points")]
    assert [round(r.merged, 9) for r in out["merged"].collect()] == [round((90 * 1 + 10 * 4) / 100, 9)]
    s = out["merge_stats"].first()
    assert (s.groups_merged, s.groups_skipped, s.integration_lost_percent, s.min, s.max) == (2, 1, 50.0, 1.3, 1.3)
    out = pipeline.merge(steps.Context(dict(tables), config.resolve({"merge": {"min_correlation": 0.6, "reference": "b"}})))
    assert rows(out["reference"]) == [("b", "explicit")] and [r[0] for r in rows(out["merge_skipped"])] == ["d"]
    for how, want in (("quality", ("a", "quality")), ("largest", ("a", "largest")), ("no such group", ("a", "largest")), ("signal", ("a", "largest"))):
        assert rows(pipeline.reference(steps.Context(dict(tables), config.resolve({"merge": {"reference": how}})))) == [want]


def test_display_and_other_debayering(spark):
    f, t, _ = observation(spark)
    p = {"steps": ["debayer", "stack", "merge", "display"], "debayer": {"method": "bilinear"}, "stacking": {"method": "average", "normalise": "none"}}
    c, results = pipeline.process(f, t, p)
    tables = dict(c.tables)
    assert results[0].ok and results[1].ok
    c = steps.Context(tables | {"merged": tables["stacks"].groupBy("y", "x", "c").agg(F.avg("value").alias("merged"))}, config.resolve({"display": {"saturation": 1.2}}))
    shown = pipeline.display(c)["display"]
    assert shown.count() == 32 * 32 and shown.where("least(r, g, b) < 0 or greatest(r, g, b) > 1.000001").count() == 0
    with pytest.raises(ValueError):
        pipeline.debayer(steps.Context(tables, config.resolve({"debayer": {"method": "other"}})))


def test_drizzle_drops(spark):
    """A drop of pixfrac times a pixel covers the cells within half of it; weights sum up, values are kept."""
    from frameloom.operators import image

    px = spark.createDataFrame([("g", y, x, 7.0) for y in range(4) for x in range(4)], "g string, y int, x int, value double")
    for kernel in ("tophat", "gaussian", "lanczos3"):
        out = image.drizzle_footprint(px, ["g"], 2.0, F.lit(0.3), F.lit(-0.2), F.lit(1.0), kernel).collect()
        assert all(abs(r.value - 7.0) < 1e-9 and r.weight > 0 for r in out)
    assert {(r.oy, r.ox): r.weight for r in image.drizzle_footprint(px, ["g"], 2.0, F.lit(0.0), F.lit(0.0), F.lit(0.5), "tophat").collect()} == {(2 * y, 2 * x): 1.0 for y in range(4) for x in range(4)}
    d = spark.createDataFrame([("g", float(i % 5), 0.0) for i in range(12)], "g string, dy double, dx double")
    assert rows(image.dither(d, "g", "dy", "dx")) == [("g", 12, 5, 0.7)]


def test_colour_against_a_catalogue(spark):
    """A scene whose red is twice and blue half of the catalogue's; the factors bring it back."""
    rnd = np.random.default_rng(2)
    h, w, scale = 80, 90, 2.0
    y, x = np.indices((h, w))
    spots = [(12 + 16 * (i // 4), 12 + 20 * (i % 4)) for i in range(16)]
    one = sum(200 * np.exp(-((y - a) ** 2 + (x - b) ** 2) / 4.0) for a, b in spots)
    img = np.dstack([one * 1.6, one, one * 0.7]) + 10 + rnd.normal(0, 0.3, (h, w, 3))
    px = [("g", i, j, k, 1, float(img[i, j, k])) for i in range(h) for j in range(w) for k in range(3)]
    sky = [(n, 150.0 + (b - (w - 1) / 2) * scale / 3600 / np.cos(np.radians(20.0)), 20.0 + ((h - 1) / 2 - a) * scale / 3600, 10.0, 10.0, 10.0) for n, (a, b) in enumerate(spots)]
    tables = {
        "stacks": spark.createDataFrame(px, "group_hash string, y int, x int, c int, n long, value double"),
        "wcs": spark.createDataFrame([("g", 150.0, 20.0, scale)], "group_hash string, ra0 double, dec0 double, scale double"),
        "catalog": spark.createDataFrame([(int(r[0]), *map(float, r[1:])) for r in sky], "entry int, ra double, dec double, mag_r double, mag_g double, mag_b double"),
    }
    out = pipeline.colour_step(steps.Context(dict(tables), config.resolve({"colour": {"enabled": True}})))
    r = out["colour"].first()
    assert r.source == "catalog" and r.status == "ok" and abs(r.r_factor - 1 / 1.6) < 0.03 and abs(r.b_factor - 1 / 0.7) < 0.06
    means = {m.c: m.v for m in out["stacks"].groupBy("c").agg(F.max("value").alias("v")).collect()}
    assert abs(means[0] / means[1] - 1) < 0.05 and abs(means[2] / means[1] - 1) < 0.08
    far = dict(tables, catalog=tables["catalog"].withColumn("mag_r", F.lit(13.0)))
    for how, want in (("gray_world", "gray_world"), ("skip", "skip")):
        got = pipeline.colour_step(steps.Context(dict(far), config.resolve({"colour": {"enabled": True, "fallback": how}})))["colour"].first()
        assert (got.source, got.status) == (want, "rejected")
    none = pipeline.colour_step(steps.Context({"stacks": tables["stacks"]}, config.resolve({"colour": {"enabled": True}})))
    assert none["colour"].first().status == "no_catalogue" and none["stacks"].count() == len(px)
