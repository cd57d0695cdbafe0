"""Dates against the standard library, plus the calendar's edges."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from formflow.operators.instants import civil_from_days, days_from_civil, normalize_instants, parse_instant


def micros(*args, tz="UTC", fold=0):
    at = datetime(*args, tzinfo=ZoneInfo(tz), fold=fold)
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


ZURICH = "Europe/Zurich"


@pytest.mark.parametrize(
    ("text", "tz", "order", "want"),
    [
        ("Tue, 05 Jan 2021 05:16:46 +0100 (CET)", ZURICH, "dmy", micros(2021, 1, 5, 4, 16, 46)),
        ("Date: Thu, 14 Jan 21 17:46:53 +0100", ZURICH, "dmy", micros(2021, 1, 14, 16, 46, 53)),
        ("  04.01.2021 09:50:00 MEZ ", ZURICH, "dmy", micros(2021, 1, 4, 8, 50)),
        ("06.12.2021 06:47:41 EST", "America/New_York", "mdy", micros(2021, 12, 6, 11, 47, 41)),
        ("11/06/2022 1:17 AM", "America/New_York", "mdy", micros(2022, 11, 6, 5, 17)),
        ("11/06/2022 1:17 AM", "Europe/London", "dmy", micros(2022, 6, 11, 0, 17)),
        ("2022/06/11 01:17", "America/New_York", "mdy", micros(2022, 6, 11, 5, 17)),
        ("06.05.2022, 12:08:50 pm", ZURICH, "dmy", micros(2022, 5, 6, 10, 8, 50)),
        ("12:08 AM", ZURICH, "dmy", None),
        ("20 décembre 2022 à 09h20", ZURICH, "dmy", micros(2022, 12, 20, 8, 20)),
        ("1er novembre 2024 à 17h37", ZURICH, "dmy", micros(2024, 11, 1, 16, 37)),
        ("12. November 2022, 14:47 Uhr", ZURICH, "dmy", micros(2022, 11, 12, 13, 47)),
        ("26 marzo 2023 02.18", ZURICH, "dmy", micros(2023, 3, 26, 1, 18)),
        ("February 1, 2022 7:10:39 AM", ZURICH, "dmy", micros(2022, 2, 1, 6, 10, 39)),
        ("Sun Oct 08 2023 20:33:20 GMT+0200 (Mitteleuropäische Sommerzeit)", ZURICH, "dmy", micros(2023, 10, 8, 18, 33, 20)),
        ("Sat Jan 23 15:44:18 2021", ZURICH, "dmy", micros(2021, 1, 23, 14, 44, 18)),
        ("2025-W21-4T09:27:24+0200", ZURICH, "dmy", micros(2025, 5, 22, 7, 27, 24)),
        ("2020-W54-1T00:00:00Z", ZURICH, "dmy", None),
        ("20231116 111908", ZURICH, "dmy", micros(2023, 11, 16, 10, 19, 8)),
        ("20210311T053611-0500", ZURICH, "dmy", micros(2021, 3, 11, 10, 36, 11)),
        ("2021-01-24T15:55:18.577018999+01:00", ZURICH, "dmy", micros(2021, 1, 24, 14, 55, 18, 577018)),
        ("2021-01-17T12:31:21,816+0100", ZURICH, "dmy", micros(2021, 1, 17, 11, 31, 21, 816000)),
        ("2022-10-30T02:58:18+01:00[Europe/Zurich]", ZURICH, "dmy", micros(2022, 10, 30, 1, 58, 18)),
        ("1609778113231403331", ZURICH, "dmy", 1609778113231403),
        ("1669618012.538869", ZURICH, "dmy", 1669618012538869),
        ("1724251629537", ZURICH, "dmy", 1724251629537000),
        # 30 October 2022 02:30 occurs twice in Zurich: the earlier one; 27 March 2022 02:30 is skipped.
        ("2022-10-30 02:30:00", ZURICH, "dmy", micros(2022, 10, 30, 0, 30)),
        ("2022-03-27 02:30:00", ZURICH, "dmy", micros(2022, 3, 27, 1, 30)),
        ("2021-02-29 10:00:00", ZURICH, "dmy", None),
        ("2024-02-29 10:00:00Z", ZURICH, "dmy", micros(2024, 2, 29, 10)),
        ("31 Jun 2025 14:06:07 +0000", ZURICH, "dmy", None),
        ("2025-06-14T32:20:00+01:00", ZURICH, "dmy", None),
        ("2022-04-25T12:94:00Z", ZURICH, "dmy", None),
        ("13.05.2025", ZURICH, "dmy", None),
        ("yesterday 20:47", ZURICH, "dmy", None),
        ("0000-00-00 00:00:00", ZURICH, "dmy", None),
        ("15/08/2021 10:30 XYZ", ZURICH, "dmy", None),
        ("12 Jul 2025 10:00:00 IST", "Asia/Kolkata", "dmy", micros(2025, 7, 12, 4, 30)),
        ("12 Jul 2025 10:00:00", None, None, None),
        ("12 Jul 2025 10:00:00 +0200", None, None, micros(2025, 7, 12, 8)),
        ("", ZURICH, "dmy", None),
        (None, ZURICH, "dmy", None),
    ],
)
def test_notations(text, tz, order, want):
    assert parse_instant(text, tz, order) == want


@given(st.dates(min_value=datetime(1, 1, 1).date(), max_value=datetime(9999, 12, 31).date()))
@settings(max_examples=300)
def test_day_numbers(day):
    n = days_from_civil(day.year, day.month, day.day)
    assert n == (day - datetime(1970, 1, 1).date()).days
    assert civil_from_days(n) == (day.year, day.month, day.day)


@given(st.datetimes(min_value=datetime(2000, 1, 1), max_value=datetime(2037, 1, 1)), st.sampled_from(["Europe/Athens", "Australia/Sydney", "America/New_York"]))
@settings(max_examples=200)
def test_wall_times(at, tz):
    at = at.replace(microsecond=0)
    assert parse_instant(at.strftime("%Y-%m-%d %H:%M:%S"), tz, "dmy") == micros(*at.timetuple()[:6], tz=tz)


def test_table(spark):
    schema = "email_id string, path string, modification_time timestamp, mailbox string, date_header string, tz string, _key string"
    t = datetime(2021, 1, 1)
    rows = [
        ("a", "1", t, "m", "2021-01-05 12:00:00", "x", "y"),
        ("a", "2", t + timedelta(1), "m", "2021-01-06 12:00:00", "x", "y"),  # redelivered with another date: the first counts
        ("b", "1", t, "m", "nonsense", "x", "y"),
        ("b", "2", t + timedelta(1), "m", "2021-01-06 12:00:00Z", None, None),
        ("c", "1", t, None, "2021-01-06 12:00:00", None, None),  # no place, no zone
        ("d", "1", t, "unknown", "2021-01-06 12:00:00+01:00", None, None),
        (None, "1", t, "m", "2021-01-06 12:00:00", None, None),
        ("e", None, None, "m", "9" * 200_000, None, None),
        ("f", None, None, "m", None, None, None),
        ("g", None, None, "m", "2021-01-06 12:00", None, None),
        ("g", None, None, "m", "2021-01-06 12:00", None, None),
    ]
    places = spark.createDataFrame([("m", "Europe/Zurich", "dmy", "z"), (None, "UTC", "dmy", "z")], "mailbox string, tz string, date_order string, path string")
    got = {r[0]: r[1] for r in normalize_instants(spark.createDataFrame(rows, schema), places).collect()}
    assert got == {
        "a": micros(2021, 1, 5, 11), "b": micros(2021, 1, 6, 12), "d": micros(2021, 1, 6, 11), "g": micros(2021, 1, 6, 11),
    }
    assert normalize_instants(spark.createDataFrame([], schema), places).count() == 0
