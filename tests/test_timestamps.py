"""Timestamps against hand-made cases and a plain reading with the standard library."""

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from quirework.operators import timestamps

SETTINGS = [("de", "Europe/Berlin", True), ("us", "America/New_York", False), ("plain", None, None), ("de", "Europe/Berlin", True), ("bad", "No/Zone", None)]


def micros(y, mo, d, h=0, mi=0, s=0, us=0, zone="UTC"):
    wall = datetime(y, mo, d, h, mi, s, tzinfo=ZoneInfo(zone))
    return int((wall.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)) + us


def read(spark, values, declared="binding"):
    rows = spark.createDataFrame([(i, v, s, "kept") for i, (v, s) in enumerate(values)], "n long, v string, source string, zone string")
    settings = spark.createDataFrame(SETTINGS, "source string, default_zone string, day_first boolean")
    out = timestamps.normalise(rows, "v", "source", settings, declared)
    assert out.columns == ["n", "v", "source", "zone", "utc_micros", "status", "format", "posterior"]
    return [(r.utc_micros, r.status) for r in out.orderBy("n").collect()]


def test_notations(spark):
    cases = [
        ("2024-05-06T07:08:09Z", "us", micros(2024, 5, 6, 7, 8, 9)),
        ("2024-05-06 07:08:09.1234567", "us", micros(2024, 5, 6, 7, 8, 9, 123456, "America/New_York")),
        ("2024-05-06 07:08:09,5", None, micros(2024, 5, 6, 7, 8, 9, 500000)),
        ("2024-05-06T07:08+05:45", "de", micros(2024, 5, 6, 1, 23)),
        ("2024-05-06T07:08:09[Asia/Tokyo]", "de", micros(2024, 5, 5, 22, 8, 9)),
        ("2024-05-06 07:08:09 America/New_York", "de", micros(2024, 5, 6, 11, 8, 9)),
        ("2024-05-06 07:08:09 AEDT", "de", micros(2024, 5, 5, 20, 8, 9)),
        ("05/06/2024 07:08", "de", micros(2024, 6, 5, 7, 8, zone="Europe/Berlin")),
        ("05/06/2024 07:08", "us", micros(2024, 5, 6, 7, 8, zone="America/New_York")),
        ("05.06.2024", "plain", micros(2024, 5, 6)),
        ("5/6/2024 12:08 AM", "unknown", micros(2024, 5, 6, 0, 8)),
        ("20240506070809", "plain", micros(2024, 5, 6, 7, 8, 9)),
        ("20240506T070809Z", "us", micros(2024, 5, 6, 7, 8, 9)),
        ("6. März 2024 07:08", "de", micros(2024, 3, 6, 7, 8, zone="Europe/Berlin")),
        ("6 février 2024 à 7h08", "plain", micros(2024, 2, 6, 7, 8)),
        ("06-May-24 07:08", "plain", micros(2024, 5, 6, 7, 8)),
        ("Mon, 6 May 2024 07:08:09 GMT", "de", micros(2024, 5, 6, 7, 8, 9)),
        ("Mon May 06 2024 07:08:09 GMT+0200", "us", micros(2024, 5, 6, 5, 8, 9)),
        ("May 6, 2024 7:08 PM", "us", micros(2024, 5, 6, 19, 8, zone="America/New_York")),
        ("1714979289", "de", 1714979289000000),
        ("1714979289.25", "de", 1714979289250000),
        ("1714979289123", "de", 1714979289123000),
        ("1714979289123456", "de", 1714979289123456),
        ("1714979289123456789", "de", 1714979289123456),
        (" 2024/05/06\n", "bad", micros(2024, 5, 6)),
        # twice: the earlier; skipped: with the offset before
        ("2023-10-29 02:30:00", "de", micros(2023, 10, 29, 0, 30)),
        ("2023-03-26 02:30:00", "de", micros(2023, 3, 26, 1, 30)),
    ]
    got = read(spark, [(v, s) for v, s, _ in cases])
    assert got == [(want, "ok") for *_, want in cases]


def test_unreadable(spark):
    values = ["", " ", None, "N/A", "pending", "25:61", "31/11/2021 9:05", "13.13.2020", "2021-02-29", "2021-01-01 24:00:00", "1/2/2021 13:05 PM", "2021-01-01 10:00 ZZZZ", "x" * 5000, "2021-01-01T10:00:00[No/Where]"]
    assert read(spark, [(v, "de") for v in values]) == [(None, "unreadable")] * len(values)


def test_bound_order_wins_over_validity(spark):
    # a day-first source cannot mean month 30
    assert read(spark, [("09-30-2024 01:16", "de")]) == [(None, "unreadable")]


def test_mixture_decides_where_settings_are_only_a_prior(spark):
    clear = [(f"{d}/03/2024", "us") for d in range(13, 29)] * 4
    got = read(spark, [("05/06/2024", "us"), *clear], declared="prior")
    assert got[0] == (micros(2024, 6, 5, zone="America/New_York"), "ok") or got[0][1] == "ambiguous"
    few = read(spark, [("05/06/2024", "plain"), ("25/06/2024", "plain"), ("06/25/2024", "plain")] * 20, declared="prior")
    assert few[0][1] == "ambiguous" and few[1][1] == few[2][1] == "ok"


def test_empty(spark):
    assert read(spark, []) == []


def test_em_shares():
    weight, best = timestamps._em({"dmy": 90, "mdy": 10, "mdy,dmy": 50}, {})
    assert best["mdy,dmy"][0] == "dmy" and abs(weight["dmy"] - 0.9) < 0.01


def test_long_short_and_negative_values(spark):
    cases = [
        (" " * 200 + "2024-01-02T03:04:05Z", micros(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02" + " " * 100_000 + "03:04:05", micros(2024, 1, 2, 3, 4, 5)),
        ("86400", 86400 * 10**6),
        ("-86400.5", -86400_500000),
        ("20240115", micros(2024, 1, 15)),
        ("2016-12-31T23:59:60Z", micros(2017, 1, 1)),
        ("2016-12-31T23:58:60Z", None),
        ("1" * 30, None),
        ("1 Jan 2024" + "," * 100_000 + "10:00", None),
    ]
    assert [u for u, _ in read(spark, [(v, "plain") for v, _ in cases])] == [want for _, want in cases]


def test_open_zones_and_folds_are_marked(spark):
    ist = "2024-01-02 10:00 IST"
    shown = [("2024-01-02 10:00 +02:00", "us")] * 300
    got = read(spark, [(ist, "us"), (ist, "plain"), ("2023-10-29 02:30:00", "de"), ("03/04/2024", "plain"), *shown], "prior")
    assert got[:3] == [(micros(2024, 1, 2, 8), "ok"), (micros(2024, 1, 2, 4, 30), "ambiguous"), (micros(2023, 10, 29, 0, 30), "ambiguous")]
    assert got[3] == (micros(2024, 3, 4), "ambiguous")
    assert read(spark, [(ist, "us"), *shown])[0] == (micros(2024, 1, 2, 4, 30), "ok")
