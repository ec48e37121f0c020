"""Parsing of timestamp texts to microseconds since 1970-01-01 UTC.

Plain Python, without Spark: parse() takes one text with the zone and the
order of day and month that its source uses. It answers None where the text
does not denote exactly one instant.
"""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal, InvalidOperation
from functools import lru_cache
from zoneinfo import ZoneInfo

# Names of the months, by language; short forms are their beginnings.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "ru nominative": "январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь",
}
# Short forms that are no beginnings, or are shorter than the ambiguous beginnings.
SHORT_MONTHS = {"sept": 9, "mrz": 3, "maa": 3, "mrt": 3, "jän": 1, "jänner": 1, "feber": 2, "avr": 4, "fév": 2, "fev": 2, "févr": 2, "fevrier": 2, "aout": 8, "decembre": 12, "marz": 3, "maerz": 3, "ene": 1, "abr": 4, "ago": 8, "dic": 12, "gen": 1, "mag": 5, "giu": 6, "lug": 7, "set": 9, "ott": 10, "mai": 5, "out": 10, "dez": 12, "okt": 10, "mei": 5, "сен": 9, "сент": 9, "нояб": 11}


def _months() -> dict[str, int]:
    seen: dict[str, set[int]] = {}
    for names in MONTHS.values():
        for n, name in enumerate(names.split(), 1):
            for size in range(3, len(name) + 1):
                seen.setdefault(name[:size], set()).add(n)
    return {k: min(v) for k, v in seen.items() if len(v) == 1} | SHORT_MONTHS


_MONTH = _months()
_MINUS = str.maketrans({"−": "-", "‐": "-", "‑": "-", "–": "-", " ": " ", " ": " ", " ": " "})
_NUMBER = re.compile(r"(\d+)(?:\.(\d+))?(?:[eE]\+?(\d{1,2}))?")
_WEEKDAY = r"(?:[^\W\d_]{2,13}\.?,\s+)?"
_DATES = [
    ("ymd", re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})")),
    ("ordinal", re.compile(r"(\d{4})-(\d{3})(?!\d)")),
    ("compact", re.compile(r"(\d{4})(\d{2})(\d{2})(?=[T ])")),
    ("numeric", re.compile(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})(?!\d)")),
    ("day name", re.compile(_WEEKDAY + r"(\d{1,2})(?:st|nd|rd|th|er|º|ª|\.)?(?:\s+|-)(?:de\s+|of\s+)?([^\W\d_]{3,12})\.?,?(?:\s+|-)(?:de\s+|del\s+)?(\d{4})(?!\d)")),
    ("name day", re.compile(_WEEKDAY + r"([^\W\d_]{3,12})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?!\d)")),
    ("name last", re.compile(r"(\d{4})\s+([^\W\d_]{3,12})\.?\s+(\d{1,2})(?!\d)")),
]
_JOINT = re.compile(r"\s*(?:T(?=\d)|t(?=\d)|,?\s+(?:à|at|um|a las|às|alle|om|в)\s+|,\s*|\s+)", re.I)
_TIME = re.compile(r"(\d{1,2})(?:(?::|[hH](?=\d))(\d{2})(?:(?::|\s?m(?:in)?\s?)(\d{2})(?:[.,](\d+))?)?|[hH](?!\w))(?:\s?(?:h|Uhr|uur|ч)\b)?(?!\d)")
_COMPACT_TIME = re.compile(r"(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?(?!\d)")
_HALF = re.compile(r"\s*([aApP])\.?\s?[mM]\b\.?")
_OFFSET = re.compile(r"(?:UTC|GMT|utc|gmt)?\s?([+-])(\d{1,2})(?::?(\d{2}))?(?::?(\d{2}))?(?:\s*\([A-Za-z][A-Za-z ]*\))?")
_NAMED = re.compile(r"\[?([A-Z][A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)+)\]?")
_ABBREVIATION = re.compile(r"[\[(]?([A-Za-z]{1,5})[\])]?")
_EPOCH = dt.datetime(1970, 1, 1)
_FIRST, _LAST = 1900, 2200


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


@lru_cache(maxsize=4096)
def _abbreviations(home: str, year: int) -> dict[str, set[int]]:
    """Offsets in seconds by the abbreviation that the zone uses in and about that year."""
    zone, out = _zone(home), {}
    if zone is not None:
        for month in range(-12, 24):
            y, m = divmod(year * 12 + month, 12)
            at = dt.datetime(max(1, min(9998, y)), m + 1, 15, tzinfo=zone)
            out.setdefault((at.tzname() or "").upper(), set()).add(int(at.utcoffset().total_seconds()))
    return out


def _at(local: dt.datetime, zone: ZoneInfo) -> dt.timedelta | None:
    """The zone's offset at a local reading; None where the zone skips or repeats it."""
    early, late = local.replace(tzinfo=zone, fold=0).utcoffset(), local.replace(tzinfo=zone, fold=1).utcoffset()
    return early if early == late else None


def _micros(delta: dt.timedelta) -> int:
    return (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds


def _number(text: str) -> int | None:
    m = _NUMBER.fullmatch(text)
    if not m:
        return None
    try:
        value = Decimal(text)
    except InvalidOperation:
        return None
    for below, scale in ((10**11, 10**6), (10**14, 10**3), (10**17, 1), (10**20, Decimal("0.001"))):
        if value < below:
            # A shorter run of digits is a date, a year or a time, and no Unix time.
            return int(value * scale) if value >= 10**8 or scale != 10**6 else None
    return None


def _date(text: str, order: str | None) -> tuple[list[tuple[int, int, int]], int] | None:
    """The readings (year, month, day) of the date at the text's start, and its end."""
    for kind, pattern in _DATES:
        m = pattern.match(text)
        if not m:
            continue
        g = m.groups()
        if kind == "ymd":
            return [(int(g[0]), int(g[2]), int(g[3]))], m.end()
        if kind == "compact":
            return [(int(g[0]), int(g[1]), int(g[2]))], m.end()
        if kind == "ordinal":
            try:
                day = dt.date(int(g[0]), 1, 1) + dt.timedelta(int(g[1]) - 1)
            except (ValueError, OverflowError):
                return None
            if int(g[1]) < 1 or day.year != int(g[0]):
                return None
            return [(day.year, day.month, day.day)], m.end()
        if kind == "numeric":
            a, b, y = int(g[0]), int(g[2]), int(g[3])
            if len(g[3]) == 2:
                y += 2000 if y < 70 else 1900
            if order == "DMY":
                return [(y, b, a)], m.end()
            if order == "MDY":
                return [(y, a, b)], m.end()
            if order == "YMD" and len(g[3]) == 2 and len(g[0]) == 2:
                return [(2000 + a if a < 70 else 1900 + a, b, int(g[3]))], m.end()
            return [(y, a, b), (y, b, a)], m.end()
        name, day, year = {"day name": (1, 0, 2), "name day": (0, 1, 2), "name last": (1, 2, 0)}[kind]
        month = _MONTH.get(g[name].lower())
        if month is None:
            continue
        return [(int(g[year]), month, int(g[day]))], m.end()
    return None


def parse(text: str | None, home: str | None = None, order: str | None = None) -> int | None:
    """Microseconds since 1970-01-01 UTC, or None.

    home is the IANA zone and order the order of day and month (DMY, MDY or
    YMD) of the text's source, None where the source is not known. None comes
    out for null and blank texts, placeholders, days without a time, times
    without a day, relative times, impossible dates and times, local readings
    that the zone skips or repeats, and readings that need an unknown source.
    Digits beyond microseconds are cut off.
    """
    if text is None:
        return None
    text = text.translate(_MINUS).strip()
    if len(text) < 8 or len(text) > 80:
        return None
    if text[0].isdigit() and _NUMBER.fullmatch(text):
        return _number(text)
    found = _date(text, order)
    if found is None:
        return None
    readings, end = found
    rest = text[end:]
    m = _JOINT.match(rest)
    if not m:
        return None
    rest = rest[m.end():]
    m = _TIME.match(rest) or _COMPACT_TIME.match(rest)
    if not m:
        return None
    hour, minute, second = int(m[1]), int(m[2] or 0), int(m[3] or 0)
    micro = int(((m[4] or "") + "000000")[:6])
    rest = rest[m.end():]
    if half := _HALF.match(rest):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if half[1] in "pP" else 0)
        rest = rest[half.end():]
    if hour > 23 or minute > 59 or second > 59:
        return None
    rest = rest.strip()
    out = set()
    for y, mo, d in readings:
        if not _FIRST <= y <= _LAST:
            continue
        try:
            local = dt.datetime(y, mo, d, hour, minute, second, micro)
        except ValueError:
            continue
        out.add(_instant(local, rest, home))
    return out.pop() if len(out) == 1 else None


def _instant(local: dt.datetime, rest: str, home: str | None) -> int | None:
    """The instant of a local reading with the zone that the rest of the text names, else the source's."""
    since = local - _EPOCH
    if not rest:
        zone = _zone(home) if home else None
        offset = _at(local, zone) if zone else None
        return None if offset is None else _micros(since - offset)
    if m := _OFFSET.fullmatch(rest):
        hours, minutes = int(m[2]), int(m[3] or 0)
        if hours > 18 or minutes > 59:
            return None
        offset = dt.timedelta(hours=hours, minutes=minutes, seconds=int(m[4] or 0))
        return _micros(since - (offset if m[1] == "+" else -offset))
    if m := _NAMED.fullmatch(rest):
        zone = _zone(m[1])
        offset = _at(local, zone) if zone else None
        return None if offset is None else _micros(since - offset)
    if m := _ABBREVIATION.fullmatch(rest):
        name = m[1].upper()
        if name in ("Z", "UTC", "GMT", "UT"):
            return _micros(since)
        offsets = _abbreviations(home, local.year).get(name, ()) if home else ()
        if len(offsets) == 1:
            return _micros(since - dt.timedelta(seconds=next(iter(offsets))))
    return None
