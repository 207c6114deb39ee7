"""Dates of the Extended Date/Time Format, level 1, as half-open spans of milliseconds in UTC."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000
POINT = re.compile(r"Y(?P<far>-?\d+)|(?P<digits>\d{1,3})(?P<open>X{1,3})|(?P<year>-?\d{4})(?:-(?P<month>\d\d)(?:-(?P<day>\d\d))?)?", re.A)
INSTANT = re.compile(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?(Z|[+-]\d\d:\d\d)", re.A)
SEASONS = {21: 3, 22: 6, 23: 9, 24: 12}

Span = tuple[int, int]


def days(year: int, month: int, day: int) -> int:
    """Days since 1970-01-01 in the Gregorian calendar; months beyond 12 and days beyond a month's end run on."""
    year, month = year + (month - 1) // 12, (month - 1) % 12
    shifted = year - (month < 2)  # years begin in March
    before = 365 * shifted + shifted // 4 - shifted // 100 + shifted // 400
    return before + (153 * ((month - 2) % 12) + 2) // 5 + day - 1 - 719468


def civil(number: int) -> tuple[int, int, int]:
    """The date of a day number."""
    era, rest = divmod(number + 719468, 146097)
    year = (rest - rest // 1460 + rest // 36524 - rest // 146096) // 365
    left = rest - (365 * year + year // 4 - year // 100)
    month = (5 * left + 2) // 153
    return era * 400 + year + (month >= 10), (month + 2) % 12 + 1, left - (153 * month + 2) // 5 + 1


def instant_ms(text: str) -> int | None:
    m = INSTANT.fullmatch(text)
    if not m:
        return None
    try:
        moment = datetime.fromisoformat(m[1] + m[3].replace("Z", "+00:00"))
    except ValueError:
        return None
    seconds = (moment - datetime.fromisoformat("1970-01-01T00:00:00+00:00")) // (datetime.resolution * 1_000_000)
    return seconds * 1000 + int((m[2] or "").ljust(9, "0")) // 1_000_000


def _shift(ms: int, years: int) -> int:
    number, rest = divmod(ms, DAY)
    year, month, day = civil(number)
    return days(year + years, month, day) * DAY + rest


def point(text: str) -> Span | None:
    """One date, month, season, year, unspecified year or instant, with or without a qualifier."""
    text = text[:-1] if text[-1:] in "?~%" and text else text
    if "T" in text and not text.startswith("Y"):
        at = instant_ms(text)
        return None if at is None else (at, at)
    m = POINT.fullmatch(text)
    if not m or (m["digits"] and len(text) != 4):
        return None
    if m["far"] or m["digits"]:
        width = 10 ** len(m["open"] or "")
        first = int(m["far"] or m["digits"]) * (width if m["digits"] else 1)
        bounds = (first, 1, 1), (first + width, 1, 1)
    else:
        year, month, day = int(m["year"]), m["month"] and int(m["month"]), m["day"] and int(m["day"])
        if month is None:
            bounds = (year, 1, 1), (year + 1, 1, 1)
        elif day is None and month in SEASONS:
            bounds = (year, SEASONS[month], 1), (year, SEASONS[month] + 3, 1)
        elif not 1 <= month <= 12 or day is not None and not 1 <= day <= 31:
            return None
        else:
            bounds = ((year, month, 1), (year, month + 1, 1)) if day is None else ((year, month, day), (year, month, day + 1))
    return days(*bounds[0]) * DAY, days(*bounds[1]) * DAY


def span(text: str | None) -> Span | None:
    """(start, end) of a date or interval, None where the text is neither. An open or unknown bound is a year wide."""
    if not text:
        return None
    if "/" in text:
        left, right = text.split("/", 1)
        left, right = ("" if x == ".." else x for x in (left, right))
        strict = True
    elif text.startswith("..") and len(text) > 2:
        left, right, strict = "", text[2:], False
    elif text.endswith("..") and len(text) > 2:
        left, right, strict = text[:-2], "", False
    else:
        return point(text)
    a, b = left and point(left), right and point(right)
    if a is None or b is None or not (a or b):
        return None
    start, end = a[0] if a else _shift(b[0], -1), b[1] if b else _shift(a[1], 1)
    return None if strict and start >= end else (start, end)


def midpoint_ms(text: str | None) -> int | None:
    found = span(text)
    return None if found is None else (found[0] + found[1]) // 2


def with_spans(rows: DataFrame, column: str = "dated") -> DataFrame:
    """rows with dated_start_ms, dated_end_ms and dated_mid_ms; each distinct value is parsed once, in Arrow batches."""
    names = ["_value", "dated_start_ms", "dated_end_ms", "dated_mid_ms"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            spans = [span(x) for x in values]
            cells = [[s and s[0] for s in spans], [s and s[1] for s in spans], [s and (s[0] + s[1]) // 2 for s in spans]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cells)], names=names)

    spans = rows.select(F.col(column).alias("_value")).where("_value is not null").distinct().mapInArrow(parse, "_value string, " + ", ".join(f"{n} long" for n in names[1:]))
    return rows.drop(*names[1:]).join(spans, F.col(column) == F.col("_value"), "left").drop("_value")
