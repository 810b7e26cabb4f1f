import random

from pyspark.sql import functions as F

from frameloom.operators.fill import Fill, fill_fields, fill_ordered
from tests.conftest import rows


def series(spark, data):
    return spark.createDataFrame(data, "id string, g string, t int, v double")


def test_interpolates_between_neighbours_and_carries_at_the_ends(spark):
    df = series(spark, [(str(i), "a", i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])])
    got = [(r[1], r[3], r[4], r[5]) for r in sorted(fill_ordered(df, ["g"], "t", "v", keep=["id"]).select("g", "t", "id", "v", "fill_method", "fill_distance").collect(), key=lambda r: r[1])]
    assert got == [(0, 1.0, "carried_back", 1), (1, 1.0, "observed", None), (2, 2.0, "interpolated", 1), (3, 3.0, "interpolated", 1), (4, 4.0, "observed", None), (5, 4.0, "carried_forward", 1)]


def test_categories_gap_limits_nulls_and_missing_entities(spark):
    df = series(spark, [("a", "a", 0, 1.0), ("b", "a", 1, None), ("c", "a", 9, None), ("d", "a", 10, 2.0), ("e", "b", 0, None), ("f", None, 0, None), ("g", "a", None, None), ("h", None, 1, 7.0)])
    out = {r.id: (r.v, r.fill_method, r.fill_distance) for r in fill_ordered(df, ["g"], "t", "v", numeric=False, keep=["id"]).collect()}
    assert out["b"] == (1.0, "carried_forward", 1) and out["c"] == (2.0, "carried_back", 1)
    assert all(out[k] == (None, "missing", None) for k in "efg") and out["h"] == (7.0, "observed", None)
    near = {r.id: r.v for r in fill_ordered(df, ["g"], "t", "v", numeric=False, gap_limit=0, keep=["id"]).collect()}
    assert near["b"] is None and near["c"] is None


def test_sentinels_nan_and_ties(spark):
    df = series(spark, [("a", "a", 0, -1.0), ("b", "a", 0, 5.0), ("c", "a", 1, float("nan")), ("d", "a", 1, 5.0), ("d2", "a", 1, 5.0)])
    out = {r.id: r.v for r in fill_ordered(df, ["g"], "t", "v", F.col("v") > 0, keep=["id"]).collect()}
    assert out["a"] == 5.0 and out["b"] == 5.0 and len(out) == 5
    out = {r.id: r.v for r in fill_ordered(df, ["g"], "t", "v", F.col("v").between(0, 100), keep=["id"]).collect()}
    assert out["c"] == 5.0


def test_blocks_agree_with_a_plain_scan(spark):
    rnd = random.Random(4)
    data = [(f"{g}{i}", g, i * 3 - 100, float(rnd.randint(1, 9)) if rnd.random() < 0.1 else None) for g in "ab" for i in range(400)]
    got = {r.id: r.v for r in fill_ordered(series(spark, data), ["g"], "t", "v", numeric=False, keep=["id"], block=16).collect()}
    for g in "ab":
        part = [(t, v) for _, k, t, v in data if k == g and v is not None]
        for i, k, t, v in data:
            if k == g:
                want = v if v is not None else min(part, key=lambda p: (abs(p[0] - t), p[0] > t))[1]
                assert got[i] == want


def test_empty_and_clashing_columns(spark):
    df = series(spark, [("a", "a", 0, 1.0), ("b", "a", 1, None)])
    for c in ("fill_method", "fill_distance", "o"):
        df = df.withColumn(c, F.lit(3))
    assert rows(fill_ordered(df, ["g"], "t", "v").select("v")) == [(1.0,), (1.0,)]
    assert fill_ordered(df.limit(0), ["g"], "t", "v").count() == 0


def fills():
    return [
        Fill("gain", F.col("gain") >= 0, numeric=False, within=["exp"]),
        Fill("pix", F.col("pix") > 0, beyond=["dev", "bin"]),
        Fill("foc", ~F.isnan("foc") & (F.col("foc") > 0), beyond=["dev"]),
    ]


SCHEMA = "id string, ses long, dev string, t int, exp double, bin int, gain int, pix double, foc double, got timestamp, value string, __o int"


def filled(spark, data, **kw):
    df = spark.createDataFrame([(*r, None, "x", 1) for r in data], SCHEMA)
    at = spark.createDataFrame([(1, 10), (2, 20), (3, 26), (4, 30)], "ses long, day int")
    return {(r.id, r.field_name): (r.value, r.fill_method, r.fill_distance, r.fill_level) for r in fill_fields(df, "ses", "t", "id", fills(), at, "got", **kw).collect()}


def test_fields_together_from_run_and_beyond(spark):
    nan = float("nan")
    data = [
        ("a", 1, "d", 0, 5.0, 1, 100, 3.0, 500.0), ("b", 1, "d", 1, 5.0, 1, None, None, nan), ("c", 1, "d", 2, 9.0, 1, None, 0.0, 0.0), ("d", 1, "d", 4, 5.0, 1, 120, 5.0, 500.0),
        ("e", 2, "d", 0, 5.0, 1, 0, None, None), ("f", 2, "d", 1, 5.0, 2, -1, None, None),
        ("g", 3, "d", 0, None, 1, None, 7.0, 600.0), ("h", 4, "x", 0, 5.0, 1, None, None, None), ("i", None, "d", 1, 5.0, 1, None, None, None), ("j", 1, "d", None, 5.0, 1, None, None, None),
        ("b", 1, "d", 1, 5.0, 1, None, None, nan),
    ]
    want = {
        ("b", "gain"): (100.0, "carried_forward", 1, "run"), ("b", "pix"): (3.5, "interpolated", 1, "run"), ("b", "foc"): (500.0, "interpolated", 1, "run"),
        ("c", "pix"): (4.0, "interpolated", 2, "run"), ("c", "foc"): (500.0, "interpolated", 2, "run"),
        ("e", "pix"): (7.0, "carried_back", 6, "beyond"), ("e", "foc"): (600.0, "carried_back", 6, "beyond"),
        ("f", "gain"): (0.0, "carried_forward", 1, "run"), ("f", "foc"): (600.0, "carried_back", 6, "beyond"),
    }
    for block in (1, 2, 512):
        assert filled(spark, data, block=block) == want
    assert filled(spark, []) == {}


def test_fields_together_agree_with_each_alone(spark):
    rnd = random.Random(5)
    data = [(str(i), rnd.choice([1, 2]), "d", i, rnd.choice([1.0, 2.0]), 1, rnd.choice([None, None, 7, 9]), rnd.choice([None, None, 1.0, 4.0]), 1.0) for i in range(300)]
    got = filled(spark, data, block=16)
    df = spark.createDataFrame([(*r, None, "x", 1) for r in data], SCHEMA)
    gain = {(r.id, "gain"): (float(r.gain), r.fill_method, r.fill_distance, "run") for r in fill_ordered(df, ["ses", "exp"], "t", "gain", numeric=False, keep=["id"]).where("fill_method not in ('observed', 'missing')").collect()}
    pix = {(r.id, "pix"): (r.pix, r.fill_method, r.fill_distance, "run") for r in fill_ordered(df, ["ses"], "t", "pix", keep=["id"]).where("fill_method not in ('observed', 'missing')").collect()}
    assert got == gain | pix


def test_two_scans_and_few_exchanges(spark):
    from frameloom.plans.data_queries import p4_fills
    from tests.conftest import SMALL

    plan = p4_fills(spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert sum("frame_type" in line and "Scan" in line for line in plan.splitlines()) <= 2
