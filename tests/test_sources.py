import numpy as np
from pyspark.sql import functions as F

from frameloom.sources import fits, headers, listing, sinks, target_cache
from tests.conftest import rows


def put(folder, name, img, **cards):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(fits.write_image(img, cards))


def test_images_come_back():
    rnd = np.random.default_rng(1)
    for shape in ((5, 7), (4, 6, 3)):
        img = rnd.normal(0, 1, shape).astype(np.float32)
        cards, back = fits.read_image(fits.write_image(img, {"OBJECT": "it's", "EXPTIME": 15.5, "LONGKEYNAME": 3}))
        assert np.array_equal(back.reshape(shape), img)
        assert cards["OBJECT"] == "it's" and float(cards["EXPTIME"]) == 15.5 and cards["HIERARCH LONGKEYNAME"] == "3"


def test_integers_are_scaled():
    head = "".join(c.ljust(80) for c in ["SIMPLE  =                    T", "BITPIX  =                   16 / bits", "NAXIS   =                    2", "NAXIS1  =                    2", "NAXIS2  =                    1", "BZERO   =                32768", "COMMENT x", "END"])
    data = head.ljust(2880).encode() + np.array([-32768, 100], ">i2").tobytes()
    assert fits.read_image(data)[1].ravel().tolist() == [0.0, 32868.0]


def test_scan_types_fallback_and_rejects(spark, tmp_path):
    img = np.ones((4, 6), np.float32)
    put(tmp_path / "in", "light_1.fits", img, OBJECT="QV 1", EXPTIME="30s", GAIN=60, **{"CCD-TEMP": "-5C", "FILTER": "Duo-Band"})
    put(tmp_path / "in" / "sub", "dark_15s_60g_30C_1.fit", img)
    put(tmp_path / "in", "dark_nothing.fits", img)
    put(tmp_path / "in" / "stacked", "x.fits", img)
    put(tmp_path / "in", "a_final.fits", img)
    (tmp_path / "in" / "broken.fits").write_bytes(b"nonsense")
    (tmp_path / "in" / "notes.txt").write_text("x")
    scanned = fits.scan(spark, str(tmp_path / "in"))
    assert {r.name for r in scanned.collect()} == {"light_1.fits", "dark_15s_60g_30C_1.fit", "dark_nothing.fits", "broken.fits"}
    typed = headers.typed_frames(scanned)
    got = {r.name: r for r in typed.collect()}
    light, dark = got["light_1.fits"], got["dark_15s_60g_30C_1.fit"]
    assert (light.exptime, light.gain, light.ccd_temp, light.filter_name, light.frame_type) == (30.0, 60, -5.0, "Duo-Band", "light")
    assert (dark.exptime, dark.gain, dark.ccd_temp, dark.frame_type) == (15.0, 60, 30.0, "dark")
    assert sorted(r.reason[:11] for r in headers.rejects(scanned, typed).collect()) == ["ValueError:", "calibration"]
    px = fits.scan(spark, str(tmp_path / "in"), pixels=True).where("name = 'light_1.fits'").first()
    assert (px.h, px.w, px.ch, sum(px.data)) == (4, 6, 1, 24.0)


def test_data_source_and_writer(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, 2, 1, [1.0, 2.0, 3.0, 4.0], {"OBJECT": "x"}), ("b", 1, 2, 1, [5.0, 6.0], None)], "id string, h int, w int, ch int, data array<float>, raw_cards map<string,string>")
    assert fits.write_frames(df, "id", str(tmp_path / "out")).count() == 2
    spark.dataSource.register(fits.FitsSource)
    back = spark.read.format("fits").option("path", str(tmp_path / "out")).load()
    assert sorted((r.path[-6:], r.h, r.w, list(r.data)) for r in back.collect()) == [("a.fits", 2, 2, [1.0, 2.0, 3.0, 4.0]), ("b.fits", 1, 2, [5.0, 6.0])]


def test_sequences(spark, tmp_path):
    df = spark.createDataFrame([("g", i, f"n {i}") for i in range(3)], "g string, i int, n string")
    lines = listing.sequence_lines(df, "g", ["i"], "n", 4)
    assert [r[1] for r in rows(lines)] == ["0001 n 0", "0002 n 1", "0003 n 2"]
    listing.write_sequence(lines, str(tmp_path / "s"))
    assert [(r.name, r.ordinal) for r in sorted(listing.read_sequence(spark, str(tmp_path / "s")).collect())] == [("n 0", 1), ("n 1", 2), ("n 2", 3)]


def test_caches(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"catalog_number": "M 1", "type": "snr", "aliases": null}]')
    (tmp_path / "c.md").write_text("# x\n### M 1\n| Field | Value |\n|---|---|\n| type | snr |\n| RA | 05h |\n### M 2\n")
    assert rows(target_cache.read_cache(spark, str(tmp_path / "c.json"))) == [(0, "M 1", None, "snr", None, None, None)]
    assert [(r.catalog_number, r.type, r.ra) for r in target_cache.read_cache(spark, str(tmp_path / "c.md")).collect()] == [("M 1", "snr", "05h"), ("M 2", None, None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("f", 0, 0, 0, -1.0), ("f", 1, 0, 0, 0.5), ("f", 2, 0, 0, 2.0), ("f", 3, 0, 0, None)], "f string, y int, x int, c int, value double")
    assert [(r.y, r.value) for r in sorted(sinks.preview(df, ["f"], 4, 8).collect(), key=lambda r: r.y)] == [(0, 0), (1, 255), (2, 127), (3, 0)]
    doc = sinks.report(df.where("y = 3").withColumn("k", F.lit(1)), "f", {"place": ["x", "k"], "data": ["value"]}).first()
    assert doc.document == '{"f":"f","place":{"x":0,"k":1},"data":{}}'
    sinks.write_report(sinks.report(df, "f", {"p": ["x"]}), str(tmp_path / "r"))
    sinks.write_products(df, str(tmp_path / "p"), "f")
    assert spark.read.parquet(str(tmp_path / "p")).where("f = 'f'").count() == 4


def test_header_helpers(spark):
    ref = spark.createDataFrame([({"RA": "1", "OBJECT": "x", "GAIN": "5"},)], "raw_cards map<string,string>")
    tgt = spark.createDataFrame([("a", {"RA": "9"}), ("b", None)], "k string, raw_cards map<string,string>")
    assert {r.k: r.raw_cards for r in headers.propagate(tgt, ref, ["RA", "OBJECT"]).collect()} == {"a": {"RA": "9", "OBJECT": "x"}, "b": {"RA": "1", "OBJECT": "x"}}
    lines = spark.createDataFrame([("- 60s, gain 40, Duo-Band",), ("15s60 Astro",), ("nothing",), (None,)], "value string")
    assert rows(headers.intended_captures(lines)) == [(15.0, 60, "astro"), (60.0, 40, "duo-band")]
    df = spark.createDataFrame([(1000, 500, 10.0, 20.0, 3.6, 2)], "w int, h int, ra double, dec double, s double, xbinning int")
    r = df.select(*[v.alias(k) for k, v in headers.sky_header("w", "h", "ra", "dec", "s").items()]).first()
    assert (r.CRPIX1, r.CDELT2, r.XBINNING, r.SCALE_BINNED_BY) == (500.5, 0.001, 1, 2)
