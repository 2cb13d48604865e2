from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.operators import timestamps

ROWS = [
    ("2025-03-01T10:00:00Z", None, None, "2025-03-01T10:00:00+00:00"),
    ("2025-03-01 10:00:00.123456789+00", None, None, "2025-03-01T10:00:00.123456+00:00"),
    ("2025-03-01T10:00:00+05:30", "Europe/London", None, "2025-03-01T04:30:00+00:00"),
    ("2026-03-08T00:04:14−05:00", None, None, "2026-03-08T05:04:14+00:00"),
    ("1735747067.607408", None, None, "2025-01-01T15:57:47.607408+00:00"),
    ("1735761614086", None, None, "2025-01-01T20:00:14.086000+00:00"),
    ("/Date(1783931688504)/", None, None, "2026-07-13T08:34:48.504000+00:00"),
    ("20260428115028", "Asia/Kolkata", None, "2026-04-28T06:20:28+00:00"),
    ("20260628T043101Z", None, None, "2026-06-28T04:31:01+00:00"),
    ("03/04/2025 10:00", "Asia/Kolkata", "dmy", "2025-04-03T04:30:00+00:00"),
    ("03/04/2025 10:00", "America/New_York", "mdy", "2025-03-04T15:00:00+00:00"),
    ("Thu, 03 Jul 2025 05:06:50 +0545", None, None, "2025-07-02T23:21:50+00:00"),
    ("Sun Jan 19 2025 00:22:44 GMT+0530", None, None, "2025-01-18T18:52:44+00:00"),
    ("Nov 21, 2025 9:20 PM IST", "Asia/Kolkata", None, "2025-11-21T15:50:00+00:00"),
    ("14 May 2025 20:26 GST", "Asia/Dubai", None, "2025-05-14T16:26:00+00:00"),
    ("9 March 2025 13:12 EDT", "America/New_York", "mdy", "2025-03-09T17:12:00+00:00"),
    ("१० जनवरी २०२६, १४:५९ बजे", "Asia/Kolkata", None, "2026-01-10T09:29:00+00:00"),
    ("27-Feb-2026 8:25 am", "Asia/Kathmandu", None, "2026-02-27T02:40:00+00:00"),
    ("2025-06-19T07:24:00-04:00[America/New_York]", "Asia/Kolkata", None, "2025-06-19T11:24:00+00:00"),
    ("January 1, 2025 12:00 AM", "Asia/Kolkata", None, "2024-12-31T18:30:00+00:00"),
    ("2025.10.26 01.55", "Europe/London", None, "ambiguous"),
    ("2025-11-02 01:23:58", "America/New_York", None, "ambiguous"),
    ("03/09/2025 02:06", "America/New_York", "mdy", "nonexistent"),
    ("2025-04-06 02:30:00", "Australia/Sydney", None, "ambiguous"),
    ("2026-08-05 04:10", None, None, "no_zone"),
    ("2026-08-05 04:10 IST", "Europe/London", None, "no_zone"),
    ("2025-02-29 10:00:00Z", None, None, "invalid"),
    ("2025-13-04 09:00:00+05:30", None, None, "invalid"),
    ("0000-00-00 00:00:00", "Asia/Kolkata", None, "invalid"),
    ("2025-01-01T25:00:00Z", None, None, "invalid"),
    ("2025-01-01", "Asia/Kolkata", None, "unparsed"),
    ("yesterday, 4 pm", "Asia/Kolkata", None, "unparsed"),
    ("", "Asia/Kolkata", None, "unparsed"),
    (None, "Asia/Kolkata", None, "unparsed"),
    ("2025-03-01 10:00:00", "Not/AZone", None, "no_zone"),
    ("x" * 100_000, "Asia/Kolkata", None, "unparsed"),
    ("1965-06-01 10:00:00", "Asia/Kolkata", None, "1965-06-01T04:30:00+00:00"),
    ("1850-06-01 12:00:00", "America/New_York", None, "1850-06-01T16:56:02+00:00"),
    ("2085-07-01 10:00:00", "America/New_York", None, "2085-07-01T14:00:00+00:00"),
    ("2150-07-01 10:00:00", "America/New_York", None, "2150-07-01T14:00:00+00:00"),
    ("2150-03-08 02:30:00", "America/New_York", None, "nonexistent"),
    ("2150-11-01 01:30:00", "America/New_York", None, "ambiguous"),
    ("2024-03-01 10:00:00 [Europe/London]", "Asia/Kolkata", None, "2024-03-01T10:00:00+00:00"),
    ("2024-07-01 10:00:00[Etc/GMT+5]", None, None, "2024-07-01T15:00:00+00:00"),
    ("2024-07-01 10:00:00 [No/Where]", "Asia/Kolkata", None, "no_zone"),
    ("2024-03-01 10:00:00 +99:99", "Asia/Kolkata", None, "invalid"),
    ("2024-03-01 10:00:00 +05:75", "Asia/Kolkata", None, "invalid"),
    ("Tue Mar  3 10:00:00 2026", "Asia/Kolkata", None, "2026-03-03T04:30:00+00:00"),
    ("Tue Mar 3 10:00:00 EST 2026", "America/New_York", None, "2026-03-03T15:00:00+00:00"),
    ("Tuesday, 03-Mar-26 10:00:00 GMT", None, None, "2026-03-03T10:00:00+00:00"),
    ("Sunday, 06-Nov-94 08:49:37 GMT", None, None, "1994-11-06T08:49:37+00:00"),
]


def test_each_form(spark):
    # extra columns with names of their own, and each row twice
    df = spark.createDataFrame([(i, *r, "x", "y") for i, r in enumerate(ROWS + ROWS)], "id int, v string, z string, o string, want string, utc string, zone string")
    out = timestamps.normalise(df, "v", "z", "o")
    assert out.columns == [*df.columns, "utc_us", "utc_us_status"]
    rows = out.collect()
    assert len(rows) == 2 * len(ROWS)
    for r in rows:
        if r.utc_us is None:
            assert r.utc_us_status == r.want, r.v
        else:
            assert datetime.fromtimestamp(r.utc_us / 1e6, timezone.utc).isoformat() == r.want, r.v


def test_empty(spark):
    df = spark.createDataFrame([], "v string, z string, o string")
    assert timestamps.normalise(df, "v", "z", "o").count() == 0


@pytest.mark.parametrize("zone", ["Asia/Kolkata", "America/New_York", "Australia/Sydney", "Asia/Kathmandu"])
def test_intervals_against_the_zone_database(zone):
    held = dict(timestamps.zone_intervals(zone))
    tz = ZoneInfo(zone)

    @settings(max_examples=150, deadline=None)
    @given(st.datetimes(datetime(2000, 1, 2), datetime(2037, 12, 30)))
    def check(local):
        local = local.replace(second=0, microsecond=0)
        wall = int((local - datetime(1970, 1, 1)).total_seconds())
        found = {o for a, b, o, _ in held[local.year] if a <= wall < b}
        want = set()
        for fold in (0, 1):
            there = local.replace(tzinfo=tz, fold=fold)
            if there.astimezone(timezone.utc).astimezone(tz).replace(tzinfo=None) == local:
                want.add(int(there.utcoffset().total_seconds()))
        assert found == want

    check()
