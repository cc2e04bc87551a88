from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from webloom.operators.timestamps import days_from_civil, normalise_timestamps


def ms(*parts, zone="UTC", fold=0):
    return int(datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold).timestamp() * 1000)


CASES = [
    ("2024-10-11T18:05:45.566Z", ms(2024, 10, 11, 18, 5, 45) + 566),
    ("2024-10-11t18:05:45z", ms(2024, 10, 11, 18, 5, 45)),
    (" 2024-10-11 18:05:45,9999 ", ms(2024, 10, 11, 18, 5, 45, zone="America/New_York") + 999),
    ("2024-10-11T11:05:45-07:00[America/Los_Angeles]", ms(2024, 10, 11, 18, 5, 45)),
    ("2024-10-11T18:05+0530", ms(2024, 10, 11, 12, 35)),
    ("2024-10-11T18:05:00+05", ms(2024, 10, 11, 13, 5)),
    ("20241011T180545Z", ms(2024, 10, 11, 18, 5, 45)),
    ("Fri, 11 Oct 2024 18:05:45 GMT", ms(2024, 10, 11, 18, 5, 45)),
    ("11 Oct 2024 18:05:45 -0330", ms(2024, 10, 11, 21, 35, 45)),
    ("October 11, 2024", ms(2024, 10, 11, zone="America/New_York")),
    ("Oct 11, 2024 at 12:05 am", ms(2024, 10, 11, 0, 5, zone="America/New_York")),
    ("October 11, 2024 6:05 PM PDT", ms(2024, 10, 12, 1, 5)),
    ("11. Oktober 2024, 18:05 Uhr", ms(2024, 10, 11, 18, 5, zone="America/New_York")),
    ("11 octobre 2024 à 9h05", ms(2024, 10, 11, 9, 5, zone="America/New_York")),
    ("11 de octubre de 2024, 18:05", ms(2024, 10, 11, 18, 5, zone="America/New_York")),
    ("10/11/2024 6:05 PM", ms(2024, 10, 11, 18, 5, zone="America/New_York")),
    ("1728669945", 1728669945000),
    ("1728669945566", 1728669945566),
    ("2024-03-10 02:30:00", ms(2024, 3, 10, 7, 30)),  # skipped, read with the offset before
    ("2024-11-03 01:30:00", ms(2024, 11, 3, 5, 30)),  # twice, the first
    ("2024-02-29", ms(2024, 2, 29, zone="America/New_York")),
] + [(v, None) for v in ("2023-02-29", "2024-02-30", "0000-00-00", "2024-13-01", "24/11/2024", "2024-10-11T25:00:00Z", "13:05 PM", "yesterday", "3 hours ago", "June 2024 issue", "", " ", "-", "{{date}}", "vol. 12", "null", "\x02\x01x", "9" * 5000)]


def frame(spark, values, domain="us.example"):
    return spark.createDataFrame([("s", i, domain, v) for i, v in enumerate(values)], "src string, rec_id long, domain string, value string")


SITES = [("us.example", "America/New_York", "en-US"), ("gb.example", "Europe/London", "en-GB"), ("none.example", None, "en-US"), ("odd.example", "Mars/Base", "en-US"), ("free.example", "UTC", None)]


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame(SITES, "domain string, site_zone string, locale string")


def run(spark, sites, values, domain="us.example", digits="epoch"):
    out = {r.rec_id: r.utc_ms for r in normalise_timestamps(frame(spark, values, domain), sites, digits).collect()}
    return [out.get(i) for i in range(len(values))]


def test_formats(spark, sites):
    got = run(spark, sites, [v for v, _ in CASES])
    assert [(v, g) for (v, _), g in zip(CASES, got, strict=True)] == CASES


def test_orders_zones_and_unknown_domains(spark, sites):
    assert run(spark, sites, ["03/04/2024", "2024-01-05T10:00:00Z"], "gb.example") == [ms(2024, 4, 3, zone="Europe/London"), ms(2024, 1, 5, 10)]
    for domain in ("none.example", "odd.example", "unknown.example"):
        assert run(spark, sites, ["2024-01-05", "2024-01-05T10:00:00Z"], domain) == [None, ms(2024, 1, 5, 10)]
    assert run(spark, sites, ["03/04/2024", "13/04/2024", "04/04/2024"], "free.example") == [None, ms(2024, 4, 13), ms(2024, 4, 4)]


def test_capture_prefixes(spark, sites):
    values = ["2024", "202405", "20240506", "2024050607", "202405060708", "20240506070809", "20240506070809123", "20240500", "2024-05-06T07:08:09Z", "20245", None, "timestamp"]
    want = [ms(2024, 1, 1), ms(2024, 5, 1), ms(2024, 5, 6), ms(2024, 5, 6, 7), ms(2024, 5, 6, 7, 8), ms(2024, 5, 6, 7, 8, 9), ms(2024, 5, 6, 7, 8, 9) + 123, None, ms(2024, 5, 6, 7, 8, 9), None, None, None]
    assert run(spark, sites, values, "unknown.example", "cdx") == want


def test_empty_tables(spark, sites):
    assert run(spark, sites, []) == []
    assert run(spark, sites.limit(0), ["2024-01-05T10:00:00Z", "2024-01-05"]) == [ms(2024, 1, 5, 10), None]


def test_days(spark):
    days = spark.range(0, 40_000, 37).select(F.date_add(F.lit("1930-01-01"), F.col("id").cast("int")).alias("d"))
    bad = days.where(days_from_civil(F.year("d"), F.month("d"), F.day("d")) != F.datediff("d", F.lit("1970-01-01")))
    assert bad.count() == 0
    assert datetime(1970, 1, 1, tzinfo=UTC).timestamp() == 0
