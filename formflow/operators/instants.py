"""Free-text dates to unambiguous UTC instants.

All notations are compiled into ONE alternation of named groups. A text is
matched once; the components found are range-checked against the calendar and
assembled into an instant with integer day arithmetic (days since the epoch
times microseconds per day), so no date library parses anything per format.

The only time-zone lookups are for texts without an offset: IANA rules give
the offset of the wall time, with the earlier instant for repeated wall times
and the offset in force before the change for skipped ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from formflow.session import spread

# Month names in English, German, French and Italian.
MONTH_NAMES = {
    1: "jan january januar jänner janvier janv gennaio gen",
    2: "feb february februar février fevrier févr fevr febbraio",
    3: "mar march märz maerz mrz mars marzo",
    4: "apr april avril avr aprile",
    5: "may mai maggio mag",
    6: "jun june juni juin giugno giu",
    7: "jul july juli juillet juil luglio lug",
    8: "aug august août aout agosto ago",
    9: "sep sept september septembre settembre set",
    10: "oct october okt oktober octobre ottobre ott",
    11: "nov november novembre",
    12: "dec december dez dezember décembre decembre déc dicembre dic",
}
MONTHS = {name: number for number, names in MONTH_NAMES.items() for name in names.split()}

# Usual meaning of zone abbreviations in minutes east of UTC,
# used when the mailbox's own zone doesn't know the abbreviation.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60,
    "cet": 60, "mez": 60, "met": 60, "cest": 120, "mesz": 120, "mest": 120,
    "eet": 120, "oez": 120, "eest": 180, "oesz": 180, "msk": 180, "ist": 330,
    "jst": 540, "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660,
    "nzst": 720, "nzdt": 780, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}
#: German names of zones, as the zone database spells them.
GERMAN_ZONES = {"mez": "cet", "mesz": "cest", "oez": "eet", "oesz": "eest"}

# Names of weekdays, which are read over.
WEEKDAYS = (
    "mon monday tue tues tuesday wed wednesday thu thur thurs thursday fri friday sat saturday sun sunday "
    "mo montag di dienstag mi mittwoch do donnerstag fr freitag sa samstag so sonntag "
    "lun lundi mar mardi mer mercredi jeu jeudi ven vendredi sam samedi dim dimanche "
    "lunedì martedì mercoledì giovedì venerdì sabato domenica"
)

_GAP = r"(?:\s*,\s*|\s+|\s+à\s+|\s+um\s+|\s+at\s+|\s+alle\s+|\s*,\s*um\s+)"
_TIME = (
    r"(?P<H{i}>\d{{1,2}})(?:[:.h]|\s?h\s?)(?P<M{i}>\d{{2}})"
    r"(?:[:.](?P<S{i}>\d{{2}})(?:[.,](?P<F{i}>\d+))?)?(?:\s*(?P<P{i}>[AaPp])\.?[Mm]\.?)?(?:\s*Uhr)?"
)
_ZONE = (
    r"(?:\s*(?:(?:GMT|UTC|UT)?(?P<O{i}>[+-]\d{{2}}:?\d{{2}}|(?<=\d)[+-]\d{{2}}(?!\d))|(?P<A{i}>(?!(?:AM|PM)\b)[A-Za-z]{{1,5}})))?"
    r"(?:\s*\[(?P<R{i}>[A-Za-z_]+(?:/[A-Za-z_+-]+)*)\])?(?:\s*\([^()]*\))?"
)
_DAY, _MONTH = r"(?P<d{i}>\d{{1,2}})", r"(?P<b{i}>[^\W\d_]{{3,10}})\.?"
_YEAR = r"(?P<y{i}>\d{{4}}|\d{{2}})"

#: One pattern a notation; ``{i}`` becomes the number of the alternative.
NOTATIONS = {
    "iso": r"(?P<Y{i}>\d{{4}})(?P<s{i}>[-/.])(?P<m{i}>\d{{1,2}})(?P=s{i})(?P<d{i}>\d{{1,2}})(?:T|" + _GAP + ")" + _TIME + _ZONE,
    "iso_week": r"(?P<Y{i}>\d{{4}})-?W(?P<w{i}>\d{{2}})-?(?P<k{i}>\d)(?:T|\s+)" + _TIME + _ZONE,
    "iso_ordinal": r"(?P<Y{i}>\d{{4}})-(?P<n{i}>\d{{3}})(?:T|\s+)" + _TIME + _ZONE,
    "compact": r"(?P<Y{i}>\d{{4}})(?P<m{i}>\d{{2}})(?P<d{i}>\d{{2}})(?:T|\s+)(?P<H{i}>\d{{2}})(?P<M{i}>\d{{2}})"
    r"(?:(?P<S{i}>\d{{2}})(?:[.,](?P<F{i}>\d+))?)?" + _ZONE,
    "numeric": r"(?P<p{i}>\d{{1,2}})(?P<s{i}>[-/.])(?P<q{i}>\d{{1,2}})(?P=s{i})" + _YEAR + _GAP + _TIME + _ZONE,
    "day_name": _DAY + r"(?:\.|er|st|nd|rd|th)?(?:\s+|-|\s+de\s+)" + _MONTH + r"(?:\s+|-|,\s*)" + _YEAR + _GAP + _TIME + _ZONE,
    "name_day": _MONTH + r"\s+" + _DAY + r"(?:st|nd|rd|th)?,?\s+" + _YEAR + _GAP + _TIME + _ZONE,
    "year_last": _MONTH + r"\s+" + _DAY + r"\s+" + _TIME + r"(?:\s+(?P<A{i}>[A-Z]{{2,5}}))?\s+(?P<Y{i}>\d{{4}})",
    "epoch": r"(?P<e{i}>\d{{10}})(?:[.,](?P<F{i}>\d+))?",
    "epoch_fine": r"(?P<f{i}>\d{{13}}|\d{{16}}|\d{{19}})",
}

MICROS_A_DAY = 86_400_000_000


@lru_cache(maxsize=1)
def compiled() -> tuple[re.Pattern, list[dict[str, int]]]:
    """The alternation, and for each alternative its components' group numbers."""
    parts = []
    for i, pattern in enumerate(NOTATIONS.values()):
        parts.append(f"(?P<alt{i}>{pattern.format(i=i)})")
    days = "|".join(sorted(set(WEEKDAYS.split()), key=len, reverse=True))
    whole = re.compile(rf"\s*(?:Date:\s*)?(?:(?i:{days})\b\.?,?\s+)?(?:{'|'.join(parts)})\s*")
    groups: list[dict[str, int]] = [{} for _ in NOTATIONS]
    for name, number in whole.groupindex.items():
        if not name.startswith("alt"):
            groups[int(name[1:])][name[0]] = number
    for i in range(len(groups)):
        groups[i]["alt"] = whole.groupindex[f"alt{i}"]
    return whole, groups


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days from 1970-01-01 to the Gregorian date, by integer arithmetic."""
    y -= m <= 2
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def days_in_month(y: int, m: int) -> int:
    if m == 2:
        return 29 if y % 4 == 0 and (y % 100 != 0 or y % 400 == 0) else 28
    return 30 if m in (4, 6, 9, 11) else 31


@lru_cache(maxsize=256)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


@lru_cache(maxsize=4096)
def _abbreviation(text: str, tz: str | None) -> int | None:
    """Minutes east of UTC of an abbreviation, by the usage of ``tz`` first."""
    key = text.lower()
    key = GERMAN_ZONES.get(key, key)
    zone = _zone(tz) if tz else None
    if zone is not None and key not in ("z", "ut", "utc"):
        for year in (2024, 2014, 2004):
            for month in (1, 7):
                at = datetime(year, month, 1, tzinfo=zone)
                if (at.tzname() or "").lower() == key:
                    return int(at.utcoffset().total_seconds() // 60)
    return ABBREVIATIONS.get(key)


@lru_cache(maxsize=65536)
def _wall_offset(tz: str, y: int, m: int, d: int, minute: int) -> int | None:
    """Seconds east of UTC of a wall time; fold 0 is the earlier instant of a
    repeated time and the offset before the change for a skipped one."""
    zone = _zone(tz)
    if zone is None:
        return None
    return int(datetime(y, m, d, minute // 60, minute % 60, tzinfo=zone, fold=0).utcoffset().total_seconds())


def parse_instant(text: str | None, tz: str | None, order: str | None, dotted_day_first: bool = True) -> int | None:
    """Microseconds since the epoch, or None where ``text`` denotes no moment."""
    if not text:
        return None
    pattern, groups = compiled()
    hit = pattern.fullmatch(text)
    if hit is None:
        return None
    got = next({k: hit.group(n) for k, n in g.items()} for g in groups if hit.group(g["alt"]) is not None)
    get = got.get

    fraction = int((get("F") or "0")[:6].ljust(6, "0"))
    if get("e"):
        return int(got["e"]) * 1_000_000 + fraction
    if get("f"):
        number = got["f"]
        return int(number) * 1000 if len(number) == 13 else int(number[:16])

    year_text = get("Y") or got["y"]
    year = int(year_text) + (2000 if len(year_text) == 2 else 0)
    if not 1 <= year <= 9998:
        return None
    if get("w"):
        week, weekday = int(got["w"]), int(got["k"])
        jan4 = days_from_civil(year, 1, 4)
        monday = jan4 - (jan4 + 3) % 7
        next4 = days_from_civil(year + 1, 1, 4)
        weeks = (next4 - (next4 + 3) % 7 - monday) // 7
        if not (1 <= week <= weeks and 1 <= weekday <= 7):
            return None
        days = monday + (week - 1) * 7 + weekday - 1
        month = day = None
    elif get("n"):
        ordinal = int(got["n"])
        if not 1 <= ordinal <= days_from_civil(year + 1, 1, 1) - days_from_civil(year, 1, 1):
            return None
        days, month, day = days_from_civil(year, 1, 1) + ordinal - 1, None, None
    else:
        if get("b"):
            month, day = MONTHS.get(got["b"].lower(), 0), int(got["d"])
        elif get("p"):
            a, b = int(got["p"]), int(got["q"])
            month_first = order == "mdy" and not (dotted_day_first and got["s"] == ".")
            month, day = (a, b) if month_first else (b, a)
        else:
            month, day = int(got["m"]), int(got["d"])
        if not (1 <= month <= 12 and 1 <= day <= days_in_month(year, month)):
            return None
        days = days_from_civil(year, month, day)

    hour, minute, second = int(got["H"]), int(got["M"]), int(get("S") or 0)
    if get("P"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if got["P"] in "pP" else 0)
    if hour > 23 or minute > 59 or second > 59:
        return None
    wall = days * MICROS_A_DAY + ((hour * 60 + minute) * 60 + second) * 1_000_000 + fraction

    if get("O"):
        digits = got["O"][1:].replace(":", "").ljust(4, "0")
        if int(digits[2:]) > 59 or int(digits[:2]) > 18:
            return None
        offset = (int(digits[:2]) * 60 + int(digits[2:])) * 60 * (-1 if got["O"][0] == "-" else 1)
    elif get("A"):
        minutes = _abbreviation(got["A"], tz)
        if minutes is None:
            return None
        offset = minutes * 60
    else:
        place = get("R") or tz
        if not place:
            return None
        if month is None:
            y, m, d = civil_from_days(days)
        else:
            y, m, d = year, month, day
        offset = _wall_offset(place, y, m, d, hour * 60 + minute)
        if offset is None:
            return None
    return wall - offset * 1_000_000


def civil_from_days(z: int) -> tuple[int, int, int]:
    """The Gregorian date of a day number; inverse of :func:`days_from_civil`."""
    z += 719468
    era = z // 146097
    doe = z - era * 146097
    yoe = (doe - doe // 1460 + doe // 36524 - doe // 146096) // 365
    doy = doe - (365 * yoe + yoe // 4 - yoe // 100)
    mp = (5 * doy + 2) // 153
    m = mp + (3 if mp < 10 else -9)
    return yoe + era * 400 + (m <= 2), m, doy - (153 * mp + 2) // 5 + 1


def instant_column(text: Column, tz: Column, order: Column, dotted_day_first: bool = True) -> Column:
    """Column of microseconds since 1970-01-01 UTC (null: no moment)."""

    @pandas_udf("long")
    def parse(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, zones, orders in batches:
            yield pd.Series(
                [parse_instant(t, z, o, dotted_day_first) for t, z, o in zip(texts, zones, orders, strict=True)],
                dtype="Int64",
            )

    return parse(text, tz, order)


def normalize_instants(
    df: DataFrame,
    places: DataFrame,
    key: str = "email_id",
    text: str = "date_header",
    place: str = "mailbox",
    zone: str = "tz",
    order: str = "date_order",
    tie: tuple[str, ...] = ("modification_time", "path"),
    dotted_day_first: bool = True,
) -> DataFrame:
    """One row ``(key, utc_micros)`` per key whose text denotes a moment.

    * ``places`` gives each place's IANA zone and day/month order; it is joined
      on equality, so Spark broadcasts it only while its size allows. A place
      that is unknown or null leaves texts with an own offset readable and
      makes the others no moment (there is no zone to read them in).
    * An offset or zone in the text decides; an abbreviation is read as the
      place's zone uses it, else by its usual meaning.
    * Null, empty, garbled or impossible texts (31 April, 25:10) and dates
      without a time of day yield no row.
    * Rows repeated under one key give one row: that of the least ``tie``
      values which denotes a moment. A null key is no key and yields no row.
    * ``dotted_day_first``: a date with dots (``04.01.2021``) is day first
      whatever the place's order; no month-first notation uses dots.
    * Other columns of ``df`` are not read; an empty ``df`` gives no rows.
    """
    names = places.select(
        F.col(place).alias("_place"), F.col(zone).alias("_zone"), F.col(order).alias("_order")
    ).groupBy("_place").agg(F.min("_zone").alias("_zone"), F.min("_order").alias("_order"))
    rows = df.select(
        F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(place).alias("_place"),
        F.struct(*[F.col(c) for c in tie]).alias("_tie"),
    ).filter(F.col("_key").isNotNull() & F.col("_text").isNotNull() & (F.length("_text") > 0))
    timed = spread(rows).join(names, "_place", "left").select(
        "_key", "_tie", instant_column(F.col("_text"), F.col("_zone"), F.col("_order"), dotted_day_first).alias("_at")
    )
    return (
        timed.filter(F.col("_at").isNotNull())
        .groupBy("_key")
        .agg(F.min_by("_at", F.struct("_tie", "_at")).alias("utc_micros"))
        .select(F.col("_key").alias(key), "utc_micros")
    )
