import numpy as np
from pyspark.sql import functions as F

from frameloom.operators import spikes
from tests.conftest import rows


def test_chart_flags_excursions_not_drift_steps_or_cooling():
    rnd = np.random.default_rng(1)
    x = 10 + np.cumsum(np.full(400, -0.02)) + rnd.normal(0, 0.2, 400)
    x[100] += 9
    x[200:203] -= [6, 8, 5]
    x[300:] += 15
    got = set(np.flatnonzero(spikes.chart(x, 0.2, 0.1)))
    assert got == {100, 200, 201, 202}
    cooling = 18 * np.exp(-np.arange(60) / 4) + rnd.normal(0, 0.2, 60)
    assert not spikes.chart(cooling, 0.2, 0.1).any()
    assert not spikes.chart(np.array([5.0]), 0.1, 0.1).any() and not len(spikes.chart(np.array([]), 0.1, 0.1))
    # An excursion that never returns is none.
    assert not spikes.chart(np.r_[np.full(50, 3.0), 30.0], 0.1, 0.1).any()


def test_frozen_limit_follows_the_source():
    rnd = np.random.default_rng(2)
    few, counts = np.unique(np.r_[rnd.geometric(0.9, 5000), 20], return_counts=True)
    assert 8 <= spikes.frozen_limit(few, counts) <= 12
    many, counts = np.unique(rnd.geometric(0.25, 5000), return_counts=True)
    assert spikes.frozen_limit(many, counts) > many.max()
    assert spikes.frozen_limit(np.array([1]), np.array([1])) >= 8


def readings(spark, data):
    return spark.createDataFrame(data, "dev string, ses long, idx int, id string, v double")


def flags(df, **kw):
    return {r[0]: r[1] for r in rows(spikes.flag_implausible(df, "dev", "ses", "idx", "id", "v", **({"low": -100.0, "high": 80.0} | kw)))}


def test_reasons_nulls_and_blocks(spark):
    rnd = np.random.default_rng(3)
    n = 9000  # over two blocks
    x = 5 + rnd.normal(0, 0.3, n).round(1)
    x[4095], x[4096] = 25, 26
    x[10] = 999
    x[6000:6030] = 5.5
    data = [("a", 1, i, f"f{i}", float(v)) for i, v in enumerate(x)]
    data[6010] = ("a", 1, 6010, "f6010", None)
    data += [("b", 2, 0, "null", None), ("b", 2, 1, "nan", float("nan")), (None, 2, 1, "nosource", 500.0), ("b", None, 1, "norun", 3.0)]
    got = flags(readings(spark, data))
    assert got["f10"] == "limit" and got["nosource"] == "limit" and got["f4095"] == got["f4096"] == "spike"
    assert {k for k, r in got.items() if r == "frozen"} >= {f"f{i}" for i in range(6000, 6030) if i != 6010}
    assert not {"null", "nan", "norun", "f6010"} & set(got)
    assert len(got) <= 4 + 31


def test_blocks_agree_with_one_chart(spark):
    rnd = np.random.default_rng(5)
    x = np.round(10 + rnd.normal(0, 0.3, 6000) + np.sin(np.arange(6000) / 200), 1)
    at = rnd.choice(np.arange(50, 5950), 60, replace=False)
    x[at] += rnd.choice([-12.0, 12.0], 60)
    got = flags(readings(spark, [("a", 1, i, str(i), float(v)) for i, v in enumerate(x)]), frozen=False)
    assert {int(k) for k in got} == set(at.tolist())


def test_settings_jump_between_used_levels(spark):
    x = [10.0] * 20 + [600.0] + [10.0] * 5 + [60.0] * 10 + [10.0] + [60.0] * 4 + [0.0, 60.0]
    got = flags(readings(spark, [("a", 1, i, str(i), v) for i, v in enumerate(x)]), low=1e-6, high=86400.0, levels=True, frozen=False)
    assert got == {"20": "spike", "41": "limit"} or got == {"20": "spike", str(len(x) - 2): "limit"}


def test_settings_left_for_a_few_frames(spark):
    """Runs of one device; a level is used by its share of runs, not by one stretch of three."""
    usual = [10.0] * 12
    runs = [
        usual + [777.0] * 4 + usual,  # 4 frames, then back
        usual + [777.0] + usual,  # the stretch above doesn't clear it
        usual + [55.0] + usual,  # held by the next run only, of three that have it
        usual + [55.0] * 9 + [10.0] * 3 + [55.0],
        usual + [55.0] + usual,
        *[usual + [60.0] * 3 + usual] * 3,  # a short series in many runs is usual
        usual + [20.0] * 9,
        [20.0] + usual,  # held by half of the runs that have it
        [30.0] * 3 + [40.0] * 3 + [30.0] * 3 + [40.0] * 3 + [30.0] * 3,  # bracketing
    ]
    data = [("a", s, i, f"{s}.{i}", v) for s, r in enumerate(runs) for i, v in enumerate(r)]
    got = flags(readings(spark, data), low=1e-6, high=86400.0, levels=True, frozen=False)
    assert got == dict.fromkeys(["0.12", "0.13", "0.14", "0.15", "1.12", "2.12", "4.12"], "spike")


def test_empty_and_clashing_columns(spark):
    df = readings(spark, [("a", 1, i, str(i), 1.0 + (i % 3) / 10) for i in range(30)])
    for c in ("src", "run", "ord", "key", "own", "blk", "reason"):
        df = df.withColumn(c, F.lit(1))
    assert flags(df) == {} and flags(df.limit(0)) == {}


def noisy(n, level, seed):
    return np.round(level + np.random.default_rng(seed).normal(0, 0.2, n), 1)


def test_excursions_at_the_ends_of_a_run(spark):
    """The level of the neighbouring runs tells an excursion from a lasting change."""
    runs = [noisy(60, 10, 1), np.r_[40.0, noisy(59, 10, 2)], np.r_[noisy(57, 10, 3), 31.0, 32.0, 30.0], noisy(60, 10, 4), np.r_[noisy(58, 10, 5), 55.0, 56.0]]
    runs.append(noisy(60, 50, 6))  # the change at the end of the run before lasts
    runs.append(np.r_[35.0, 20.0, 14.0, 11.5, noisy(56, 10, 7)])  # cooling
    data = [("a", s, i, f"{s}.{i}", float(v)) for s, r in enumerate(runs) for i, v in enumerate(r)]
    got = flags(readings(spark, data), frozen=False)
    assert got == dict.fromkeys(["1.0", "2.57", "2.58", "2.59"], "spike")


def test_suspected_readings_are_clipped_before_the_update():
    x = np.r_[np.full(40, 5.0), 90.0, 5.0, 95.0, 5.0, np.full(20, 5.0), 6.5, np.full(20, 5.0)]
    x[::2] += 0.1
    # Unclipped, the level after 90 and 95 would be so far off that 5 is an excursion and 6.5 none.
    assert set(np.flatnonzero(spikes.chart(x, 0.1, 0.1))) == {40, 42, 64}


def test_stretches_across_block_edges_are_whole(spark):
    """A source that holds values for long: a frozen stretch keeps all its readings wherever blocks begin."""
    rnd = np.random.default_rng(11)
    base = np.repeat(np.round(rnd.normal(5, 1, 700), 2), rnd.integers(1, 40, 700))[:13000]
    for start in (4086, 3396, 8192 - 350, 4096, 4096 - 700, 100):
        x = base.copy()
        x[start : start + 700] = 77.0
        got = flags(readings(spark, [("a", 1, i, str(i), float(v)) for i, v in enumerate(x)]))
        assert {int(k) for k, r in got.items() if r == "frozen" and x[int(k)] == 77} == set(range(start, start + 700)), start
    x = base.copy()
    x[2000:12000] = 77.0  # over two whole blocks
    got = flags(readings(spark, [("a", 1, i, str(i), float(v)) for i, v in enumerate(x)]))
    assert {int(k) for k, r in got.items() if r == "frozen" and x[int(k)] == 77} == set(range(2000, 12000))


def test_many_runs_are_joined_and_repeated_rows_count_once(spark, monkeypatch):
    data = []
    for s in range(6):
        x = noisy(300, s, s + 20)
        x[100] += 20
        x[200:230] = 3.3
        data += [("a" if s % 2 else "b", s, i, f"{s}.{i}", float(v)) for i, v in enumerate(x)]
    df = readings(spark, data)
    want = flags(df)
    assert len([r for r in want.values() if r == "spike"]) == 6 and len(want) >= 6 * 31
    assert flags(df.unionByName(df.where("idx % 3 = 0"))) == want
    monkeypatch.setattr(spikes, "BROADCAST_RUNS", 0)
    assert flags(df) == want


def test_the_setting_chart_needs_a_held_level():
    c = spikes.setting_chart
    held = [10.0] * 6
    assert set(np.flatnonzero(c(np.array(held + [45.0, 45, 777, 777] + held)))) == {6, 7, 8, 9}
    assert not c(np.array([30.0] * 3 + [40.0] * 3 + [30.0] * 3)).any()
    assert set(np.flatnonzero(c(np.array([30.0] * 3 + [40.0] * 3 + [30.0] * 6)))) == {3, 4, 5}
    assert not c(np.array(held + [45.0] * 5 + held)).any() and not c(np.array([])).any()
