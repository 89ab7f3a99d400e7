import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidemill.operators import clocks as c

LA, BERLIN, IST = "America/Los_Angeles", "Europe/Berlin", "Asia/Kolkata"


def us(*a):
    return int(datetime(*a[:6], tzinfo=UTC).timestamp()) * 1_000_000 + (a[6] if len(a) > 6 else 0)


@pytest.mark.parametrize(
    ("text", "zone", "want"),
    [
        ("2026-01-15T17:43:17Z", LA, us(2026, 1, 15, 17, 43, 17)),
        (" 2026-01-15t17:43:17.5z ", LA, us(2026, 1, 15, 17, 43, 17, 500000)),
        ("2026-01-15 17:43:17.123456789+05:30", None, us(2026, 1, 15, 12, 13, 17, 123456)),
        ("2026-01-15 17:43:17-0800", None, us(2026, 1, 16, 1, 43, 17)),
        ("2026-01-15 17:43:17+05", None, us(2026, 1, 15, 12, 43, 17)),
        ("2026-01-15T17:43:17-00:00", IST, us(2026, 1, 15, 17, 43, 17)),
        ("2026-01-15 17:43", LA, us(2026, 1, 16, 1, 43, 0)),
        ("2026-07-15 17:43:00", LA, us(2026, 7, 16, 0, 43, 0)),
        ("2026-07-15 17:43:00 PST", LA, us(2026, 7, 16, 1, 43, 0)),
        ("2026-07-15 17:43:00 IST", IST, us(2026, 7, 15, 12, 13, 0)),
        ("2026-07-15 17:43:00 IST", LA, None),
        ("2026-07-15 17:43:00 GMT", LA, us(2026, 7, 15, 17, 43, 0)),
        ("2026-07-15 17:43:00 America/Los_Angeles", IST, us(2026, 7, 16, 0, 43, 0)),
        ("2026-07-15 05:43:00.25 Asia/Kolkata", None, us(2026, 7, 15, 0, 13, 0, 250000)),
        ("Thu, 15 Jan 2026 17:43:17 +1100", LA, us(2026, 1, 15, 6, 43, 17)),
        ("01/14/2026 12:13:50 PM", "UTC", us(2026, 1, 14, 12, 13, 50)),
        ("01/14/2026 12:13:50 AM", "UTC", us(2026, 1, 14, 0, 13, 50)),
        ("11.08.2026 00:49:23", "UTC", us(2026, 8, 11, 0, 49, 23)),
        ("20260503T024757Z", LA, us(2026, 5, 3, 2, 47, 57)),
        ("20260912_0551", "UTC", us(2026, 9, 12, 5, 51, 0)),
        ("202609120551", "UTC", us(2026, 9, 12, 5, 51, 0)),
        ("20260912055130", LA, us(2026, 9, 12, 12, 51, 30)),
        ("1774647621", LA, 1774647621000000),
        ("1774647621371", LA, 1774647621371000),
        ("1774647621371123", LA, 1774647621371123),
        ("1765834789242513610", LA, 1765834789242513),
        ("1789053122.2245678", LA, 1789053122224567),
        # none
        ("2026-03-08 02:30:00", LA, None),  # never
        ("2025-11-02 01:30:00", LA, None),  # twice
        ("2025-11-02 01:30:00 America/Los_Angeles", IST, None),
        ("2025-11-02 01:30:00 PDT", LA, us(2025, 11, 2, 8, 30, 0)),
        ("2026-02-30 10:00:00", LA, None),
        ("2026-02-03 24:00:00", LA, None),
        ("2026-02-03 23:59:60", LA, None),
        ("01/14/2026 13:13:50 PM", LA, None),
        ("2026-01-15", LA, None),
        ("20260115", LA, None),
        ("yesterday 14:05", LA, None),
        ("", LA, None),
        (None, LA, None),
        ("pending", LA, None),
        ("٢٠٢٦-01-15 10:00:00", LA, None),
        ("2026-01-15 10:00:00", None, None),
        ("2026-01-15 10:00:00 Mars/Olympus", LA, None),
    ],
)
def test_moment(text, zone, want):
    assert c.moment(c.Zones(), text, zone) == want


def test_estimate_finds_an_unlisted_zone(spark):
    rows = [(f"2026-0{1 + i % 6}-1{i % 9} 0{i % 10}:15:00", "h1") for i in range(60)]
    z = c.Zones()
    values = [("t", str(i), text, host, datetime.fromtimestamp(z.utc("Asia/Tokyo", c.read_clock(text)[0]) / 1e6 + 300, UTC)) for i, (text, host) in enumerate(rows)]
    values += [("t", "n", None, None, None), ("t", None, "1774647621", "h9", None), ("t", "d", "1774647621", "h1", None), ("t", "d", "1774647621", "h1", None)]
    frame = spark.createDataFrame(values, "source_table string, row_key string, text string, host string, loaded_at timestamp").selectExpr("*", "'x' AS zone")
    hosts = spark.createDataFrame([("h1", None), ("h2", "Europe/Berlin")], "host string, tz_name string")
    zones = {r.host: r for r in c.host_zones(frame, hosts).collect()}
    assert z.utc(zones["h1"].zone, us(2026, 5, 1, 0, 0, 0)) == us(2026, 4, 30, 15, 0, 0) and zones["h1"].violations == 0 and zones["h2"].zone == "Europe/Berlin"
    got = c.normalise(frame, hosts)
    assert got.columns == ["source_table", "row_key", "utc_us"] and got.count() == 62
    assert c.normalise(frame.limit(0), hosts).count() == 0
    assert c.normalise(frame, hosts.limit(0)).count() == 62


def test_the_estimate_decides_with_or_without_the_list(spark):
    """Zones all over the database, two years of rows, some of them late."""
    z, r = c.Zones(), random.Random(2)
    zones = {"a": "Asia/Kathmandu", "b": "America/Sao_Paulo", "c": "Pacific/Chatham", "d": "Africa/Cairo", "e": "America/St_Johns", "f": "Europe/Lisbon", "g": "Australia/Lord_Howe"}
    values, want = [], set()
    for host, zone in zones.items():
        for i in range(250):
            local = us(2025, 1, 1, 0, 0, 0) + r.randrange(700 * 86400) * 1_000_000
            at = z.utc(zone, local)
            if at is None:
                continue
            late = r.randrange(3_000_000_000) if r.random() < 0.92 else r.randrange(10**11, 10**12)
            text = str(datetime.fromtimestamp(local / 1e6, UTC).replace(tzinfo=None))
            values.append(("t", f"{host}{i}", text, host, datetime.fromtimestamp((at + late) // 1_000_000, UTC)))
            want.add((f"{host}{i}", at))
    frame = spark.createDataFrame(values, "source_table string, row_key string, text string, host string, loaded_at timestamp")
    listed = spark.createDataFrame(list(zones.items()), "host string, tz_name string")
    for hosts in (listed, listed.limit(0), listed.withColumn("tz_name", F.lit("Asia/Tokyo"))):
        assert {(x.row_key, x.utc_us) for x in c.normalise(frame, hosts).collect()} == want
    assert {x.host for x in c.host_zones(frame, listed.withColumn("tz_name", F.lit("Asia/Tokyo"))).where("disagrees").collect()} == set(zones)
    assert c.host_zones(frame, listed).where("disagrees").count() == 0


def test_listed_zone_wins_what_chance_explains(spark):
    values = [("t", str(i), f"2026-05-1{i} 10:00:00", "h", datetime(2026, 5, 10 + i, 10, 5, tzinfo=UTC)) for i in range(9)]
    frame = spark.createDataFrame(values, "source_table string, row_key string, text string, host string, loaded_at timestamp")
    zone_of = lambda f, zone: c.host_zones(f, spark.createDataFrame([("h", zone)], "host string, tz_name string")).first()
    wrong = zone_of(frame, IST)
    assert wrong.disagrees and wrong.listed_violations == 9 and wrong.violations == 0 and c.Zones().utc(wrong.zone, us(2026, 5, 10, 10, 0, 0)) == us(2026, 5, 10, 10, 0, 0)
    assert zone_of(frame, "Africa/Abidjan").zone == "Africa/Abidjan"  # ties with all zones of its history
    assert zone_of(frame.limit(1), IST).zone == IST  # one row proves nothing
    assert zone_of(frame, "Mars/Olympus").zone != "Mars/Olympus"


def test_offset_history():
    h = c.offset_history(c.ZoneInfo(LA), us(2025, 1, 1, 0, 0, 0), us(2026, 1, 1, 0, 0, 0))
    hour = 3_600_000_000
    assert h == ((us(2025, 1, 1, 0, 0, 0), us(2025, 3, 9, 10, 0, 0), -8 * hour), (us(2025, 3, 9, 10, 0, 0), us(2025, 11, 2, 9, 0, 0), -7 * hour), (us(2025, 11, 2, 9, 0, 0), us(2026, 1, 1, 0, 0, 0), -8 * hour))
