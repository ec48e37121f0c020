"""Parsing of timestamp texts, without Spark."""

from __future__ import annotations

import datetime as dt

import pytest

from larkspur.functions.instants import parse

NY, BERLIN, KOLKATA, SHANGHAI = "America/New_York", "Europe/Berlin", "Asia/Kolkata", "Asia/Shanghai"


def us(*parts: int) -> int:
    return int((dt.datetime(*parts) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


@pytest.mark.parametrize(
    ("text", "home", "order", "expected"),
    [
        ("2024-01-02T03:04:05Z", None, None, us(2024, 1, 2, 3, 4, 5)),
        (" 2024-01-02 03:04:05z\t", None, None, us(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02T03:04:05.1234567Z", None, None, us(2024, 1, 2, 3, 4, 5, 123456)),
        ("2024-01-02T03:04:05,5+05:45", None, None, us(2024, 1, 1, 21, 19, 5, 500000)),
        ("2024-01-02T03:04:05−03:30", None, None, us(2024, 1, 2, 6, 34, 5)),
        ("2024-01-02T03:04+01", None, None, us(2024, 1, 2, 2, 4)),
        ("20240102T030405+0100", None, None, us(2024, 1, 2, 2, 4, 5)),
        ("2024-060T00:00:00Z", None, None, us(2024, 2, 29)),
        ("1704164645", None, None, us(2024, 1, 2, 3, 4, 5)),
        ("1704164645123", None, None, us(2024, 1, 2, 3, 4, 5, 123000)),
        ("1704164645123456", None, None, us(2024, 1, 2, 3, 4, 5, 123456)),
        ("1704164645123456789", None, None, us(2024, 1, 2, 3, 4, 5, 123456)),
        ("1704164645.89", None, None, us(2024, 1, 2, 3, 4, 5, 890000)),
        ("1.704164645E9", None, None, us(2024, 1, 2, 3, 4, 5)),
        ("03/04/2024 12:00", BERLIN, "DMY", us(2024, 4, 3, 10)),
        ("03/04/2024 12:00", NY, "MDY", us(2024, 3, 4, 17)),
        ("2024/03/04 12:00:00", NY, "DMY", us(2024, 3, 4, 17)),
        ("1/17/24 3:37 pm EST", NY, "MDY", us(2024, 1, 17, 20, 37)),
        ("12/12/2023 12:05 AM", NY, "MDY", us(2023, 12, 12, 5, 5)),
        ("December 11, 2023 8:00 p.m. UTC", None, None, us(2023, 12, 11, 20)),
        ("13. Dezember 2023, 06:55 Uhr", BERLIN, "DMY", us(2023, 12, 13, 5, 55)),
        ("10 décembre 2023 à 09h14", "Europe/Paris", "DMY", us(2023, 12, 10, 8, 14)),
        ("28 de octubre de 2023, 23:10 UTC", None, None, us(2023, 10, 28, 23, 10)),
        ("27 декабря 2023 04:09 MSK", "Europe/Moscow", "DMY", us(2023, 12, 27, 1, 9)),
        ("Fri, 15 Dec 2023 23:25:13 +0530 (IST)", None, None, us(2023, 12, 15, 17, 55, 13)),
        ("18 Dec 2023 21:30:10 CST", SHANGHAI, "YMD", us(2023, 12, 18, 13, 30, 10)),
        ("18 Dec 2023 21:30:10 CST", "America/Chicago", "MDY", us(2023, 12, 19, 3, 30, 10)),
        ("2024-01-02T03:04:05[Europe/Berlin]", None, None, us(2024, 1, 2, 2, 4, 5)),
        ("2024-01-02 03:04:05 Asia/Kolkata", None, None, us(2024, 1, 1, 21, 34, 5)),
        ("15 October 2024, 14:00 GMT+2", None, None, us(2024, 10, 15, 12)),
        ("2024-11-03 01:30:00 EDT", NY, "MDY", us(2024, 11, 3, 5, 30)),
    ],
)
def test_denotes_one_instant(text: str, home: str | None, order: str | None, expected: int) -> None:
    assert parse(text, home, order) == expected


@pytest.mark.parametrize(
    ("text", "home", "order"),
    [
        (None, NY, "MDY"), ("", NY, "MDY"), ("  ", NY, "MDY"), ("TBD", NY, "MDY"), ("n/a", NY, "MDY"), ("yesterday", NY, "MDY"), ("2 hours ago", NY, "MDY"),
        ("2024-05-01", NY, "MDY"), ("1 December 2023", NY, "MDY"), ("20240501", NY, "MDY"), ("2024-05", NY, "MDY"), ("09:45", NY, "MDY"),
        ("2023-02-29T08:00:00+01:00", NY, "MDY"), ("2024-06-31T25:10:00Z", NY, "MDY"), ("2024-13-05T08:00:00Z", NY, "MDY"), ("31.02.2024 10:15", BERLIN, "DMY"), ("01/01/2024 13:05 PM", NY, "MDY"),
        ("2024-03-10 02:30:00", NY, "MDY"), ("2024-11-03 01:30:00", NY, "MDY"), ("2024-03-31T02:30:00[Europe/Berlin]", None, None),
        ("2024-05-01 10:00:00", None, None), ("03/04/2024 12:00 UTC", None, None), ("2024-05-01 10:00 CST", None, None), ("2024-05-01 10:00 XYZ", NY, "MDY"), ("x" * 500, NY, "MDY"),
    ],
)
def test_denotes_none(text: str | None, home: str | None, order: str | None) -> None:
    assert parse(text, home, order) is None
