from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from frameloom.operators import timestamps as T
from tests.conftest import rows


def utc(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp())


def day(y, m, d):
    return (datetime(y, m, d) - datetime(1970, 1, 1)).days


def read(spark, data, clock_utc=False, zone="Europe/Berlin", keep=("id",)):
    df = spark.createDataFrame(data, "id string, dev string, ses long, idx int, txt string, clock string, day int")
    c = T.choose_readings(df, "dev", ["id", "ses", "idx"], F.col("txt"), F.col("day"), F.col("clock"))
    i = T.to_instants(c.where("fmt is not null"), ["id", "ses", "idx"], F.lit(clock_utc), F.lit(zone))
    return {r.id: r for r in T.settle_folds(i, "ses", "idx", ["id"]).collect()}


def one(spark, texts, **kw):
    got = read(spark, [(str(i), "d", i, 0, t, None, day(2022, 5, 30)) for i, t in enumerate(texts)], **kw)
    return [got[str(i)].utc_second if str(i) in got else None for i in range(len(texts))]


def test_spellings_with_a_zone_or_an_epoch(spark):
    want = utc(2022, 5, 30, 20, 57, 4)
    texts = [
        "2022-05-30T22:57:04+02:00[Europe/Berlin]", "2022-05-30T20:57:04Z", "'2022-05-30T20:57:04.999Z'", "2022-05-30T22:57:04+0200  ", "2022-05-30 20:57:04 UT", "2022-05-30 22:57:04 CEST",
        "2022-05-30 16:57:04 EDT", "2022-05-31 02:27:04 +05:30", "1653944224", "1653944224999", "MJD 59729.87296297", "JD2459730.37296297", "JD=2459730.37296297",
    ]
    assert one(spark, texts) == [want] * len(texts)


def test_civil_times(spark):
    want = utc(2022, 5, 30, 20, 57, 4)
    texts = ["2022-05-30T22:57:04", "2022-05-30 22:57:04.123456", "2022/05/30 22:57:04", "2022-05-30T22:57:04,5", "30.05.2022 22:57:04", "05/30/2022 10:57:04 PM", "20220530-225704123", "30 May 2022 22:57:04", "30. Mai 2022, 22:57:04"]
    assert one(spark, texts) == [want] * len(texts)
    assert one(spark, ["2022-05-30T22:57"]) == [utc(2022, 5, 30, 20, 57, 0)]
    assert one(spark, ["05/30/2022 12:05:00 AM", "05/30/2022 12:05:00 PM"]) == [utc(2022, 5, 29, 22, 5), utc(2022, 5, 30, 10, 5)]
    assert one(spark, ["2022-05-30T22:57:04"], clock_utc=True) == [utc(2022, 5, 30, 22, 57, 4)]
    assert one(spark, ["2022-05-30T22:57:04"], zone=None) == [None]


def test_what_is_no_timestamp(spark):
    bad = [None, "", "--", "n/a", "0000-00-00T00:00:00", "2022-02-30T00:00:00", "2022-05-30T25:00:00", "2022-05-30", "2022-05-30T22:57:04 XYZ", "12", "x" * 10_000, "13/13/2022 01:00:00 PM"]
    assert one(spark, bad) == [None] * len(bad)


def test_the_rest_of_a_date_is_in_another_field(spark):
    got = read(spark, [("a", "d", 1, 0, "2022-05-30", "22:57:04", day(2022, 5, 30)), ("b", "d", 1, 1, "2022-05-30", "nonsense", None)])
    assert got["a"].utc_second == utc(2022, 5, 30, 20, 57, 4) and "b" not in got


def test_the_mixture_decides_the_order_of_day_and_month(spark):
    data = [(f"a{i}", "us", i, 0, f"{m:02d}/{d:02d}/2022 01:00:00", None, None) for i, (m, d) in enumerate([(5, 20), (6, 25), (7, 13), (3, 4)])]
    data += [(f"b{i}", "eu", 10 + i, 0, f"{d:02d}/{m:02d}/2022 01:00:00", None, None) for i, (m, d) in enumerate([(5, 20), (6, 25), (7, 13), (3, 4)])]
    data += [("open", "new", 30, 0, "03/04/2022 01:00:00", None, None), ("night", "new2", 31, 0, "03/04/2022 01:00:00", None, day(2022, 4, 3))]
    got = read(spark, data, clock_utc=True)
    assert got["a3"].utc_second == utc(2022, 3, 4, 1) and got["b3"].utc_second == utc(2022, 3, 4, 1)
    assert got["night"].utc_second == utc(2022, 4, 3, 1) and not got["night"].ambiguous_format
    assert got["open"].ambiguous_format and not got["a3"].ambiguous_format


def test_order_of_capture_decides_when_clocks_go_back(spark):
    # Berlin, 30 October 2022: 03:00 summer time is 02:00 again.
    zone = ZoneInfo("Europe/Berlin")
    start = utc(2022, 10, 29, 23, 40)
    data, want = [], {}
    for i in range(60):
        u = start + i * 240
        local = datetime.fromtimestamp(u, zone)
        data.append((f"f{i}", "d", 1, i, local.strftime("%Y-%m-%d %H:%M:%S"), None, day(2022, 10, 29)))
        want[f"f{i}"] = u
    got = read(spark, data)
    assert {k: r.utc_second for k, r in got.items()} == want
    assert not any(r.ambiguous_zone for r in got.values())


def test_an_hour_alone_stays_marked(spark):
    got = read(spark, [("a", "d", 1, 0, "2022-10-30 02:30:00", None, day(2022, 10, 29)), ("b", "d", None, 0, "2022-10-30 02:30:00", None, None)])
    assert got["a"].ambiguous_zone and got["b"].ambiguous_zone
    assert got["a"].utc_second == utc(2022, 10, 30, 0, 30)
    # Skipped by the clocks: read with the offset before.
    assert one(spark, ["2022-03-27 02:30:00"]) == [utc(2022, 3, 27, 1, 30)]


def test_may_fold(spark):
    df = spark.createDataFrame([(day(2022, 10, 29), "Europe/Berlin"), (day(2022, 3, 26), "Europe/Berlin"), (day(2022, 6, 1), "Europe/Berlin"), (day(2022, 10, 29), "UTC"), (None, "UTC")], "d int, z string")
    assert [r[0] for r in df.select(T.may_fold(F.col("d"), F.col("z"))).collect()] == [True, False, False, False, False]


def test_empty_input(spark):
    assert read(spark, []) == {}
    assert rows(spark.range(0)) == []
