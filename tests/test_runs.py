"""Run discovery, capture sessions, pattern overrides and exports on folders of files."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions import keys
from frameloom.sources import runs, sinks
from tests.conftest import rows


def put(root, path, text="x"):
    f = root / path
    f.parent.mkdir(parents=True, exist_ok=True)
    f.write_text(text)


def test_runs_and_smoke_runs(spark, tmp_path):
    put(tmp_path, "m1/generated/a/run-info.json", json.dumps({"limit": None}))
    put(tmp_path, "m1/generated/b/run-info.json", json.dumps({"smoke_mode": True}))
    put(tmp_path, "m1/generated/c/x.fits")
    put(tmp_path, "m1/generated/d/notes.txt")
    put(tmp_path, "m2/generated/e/agent-log.yaml")
    put(tmp_path, "m2/generated/f/run-info.json", "no json")
    put(tmp_path, "m2/generated/g/run-info.json", json.dumps({"limit": 5}))
    put(tmp_path, "_old/generated/h/run-info.json", "{}")
    put(tmp_path, "m1/lights/y.fits")
    found = runs.discover_runs(runs.listing(spark, str(tmp_path)))
    assert rows(found.select("target", "run")) == [("m1", "a"), ("m1", "b"), ("m1", "c"), ("m2", "e"), ("m2", "f"), ("m2", "g")]
    assert rows(runs.without_smoke(found).select("run")) == [("a",), ("c",), ("e",), ("f",)]


def test_capture_sessions(spark, tmp_path):
    put(tmp_path, "a/z.txt")
    assert runs.capture_session(spark, str(tmp_path)).count() == 0
    put(tmp_path, "b/shotsInfo.json", "broken")
    assert runs.capture_session(spark, str(tmp_path)).first().error == "parse_failed"
    put(tmp_path, "a/shotsInfo.json", json.dumps({"eq": False, "shotsTaken": 7, "exp": "15", "gain": 60}))
    r = runs.capture_session(spark, str(tmp_path)).first()
    assert (r.eq, r.shots_taken, r.exp, r.gain, r.target, r.error) == (False, 7, "15", 60, None, None)
    put(tmp_path, "shotsInfo.json", json.dumps({"eq": True}))
    assert runs.capture_session(spark, str(tmp_path)).first().eq is True


def test_file_patterns_can_be_replaced(spark):
    df = spark.createDataFrame([("myDARK 30 at 40",), ("dark_exp_15.0_gain_60_bin_1_stack_9",)], "n string")
    m = keys.file_metadata(F.col("n"), {"dark_compact": r"mydark (\d+) at (\d+)"})
    assert [(r[0].pattern, r[0].exptime, r[0].gain) for r in df.select(m).collect()] == [("dark_compact", 30.0, 40), ("dark", 15.0, 60)]
    with pytest.raises(ValueError):
        keys.file_metadata(F.col("n"), {"other": "x"})


def test_exports(spark, tmp_path):
    img = np.linspace(0, 1, 24).reshape(2, 4, 3)
    df = spark.createDataFrame([(1, 2, 4, 3, img.ravel().tolist())], "k int, h int, w int, ch int, data array<double>")
    got = rows(sinks.export(df, "k", str(tmp_path / "out"), stretched=True).select("k", "kind"))
    assert got == [("1", "fits"), ("1", "preview"), ("1_stretched", "stretched")]
    raw = (tmp_path / "out" / "1.tiff").read_bytes()
    assert raw[:4] == b"II*\0" and struct.unpack("<H", raw[8:10])[0] == int(np.arcsinh(img[1, 0, 0] * 0.01) / np.arcsinh(0.01) * 65535)
    grey = sinks.tiff16(np.array([[0.0, np.nan], [2.0, 0.5]]))
    assert struct.unpack("<4H", grey[8:16]) == (65535, 32767, 0, 0)
