"""Timetable clocks: text that may pass 24:00, compact times, spans in running text, dates and weekdays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86_400
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def seconds(text: Column) -> Column:
    """"HH:MM:SS" (or "HH:MM") to seconds after midnight; hours may exceed 23; anything else is null."""
    parts = F.split(F.trim(text), ":")
    number = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("int"), F.lit(0))
    return F.when(F.trim(text).rlike(r"^\d{1,3}:\d{1,2}(:\d{1,2})?$"), number(1) * 3600 + number(2) * 60 + number(3))


def text(secs: Column) -> Column:
    """Seconds to "HH:MM:SS", hours unwrapped."""
    part = lambda v: F.lpad(v.cast("long").cast("string"), 2, "0")
    hours = F.floor(secs / 3600)
    return F.concat(
        F.when(hours < 100, part(hours)).otherwise(hours.cast("string")), F.lit(":"), part(F.floor(F.pmod(secs, F.lit(3600)) / 60)), F.lit(":"), part(F.pmod(secs, F.lit(60)))
    )


def compact_minutes(value: Column) -> Column:
    """"530", "0530" or "05:30" to minutes after midnight."""
    digits = F.lpad(F.regexp_replace(F.trim(value), ":", ""), 4, "0")
    return F.when(digits.rlike(r"^\d{4}$"), F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int"))


def spans(value: Column) -> Column:
    """All "H:MM-H:MM" spans inside a text as an array of (start, end) minutes; an end at or before its start is the next day."""
    found = F.regexp_extract_all(value, F.lit(r"(\d{1,2}:\d{2}\s*[-~]\s*\d{1,2}:\d{2})"), F.lit(1))

    def parse(span):
        ends = F.split(F.regexp_replace(span, r"\s", ""), "[-~]")
        start, end = compact_minutes(F.element_at(ends, 1)), compact_minutes(F.element_at(ends, 2))
        return F.struct(start.alias("start"), F.when(end <= start, end + 1440).otherwise(end).alias("end"))

    return F.transform(found, parse)


def in_peak(start: Column, end: Column, peaks=((7 * 3600, 9 * 3600), (16.5 * 3600, 19 * 3600))) -> Column:
    """Whether the middle of a window lies in one of the peaks."""
    middle = (start + end) / 2
    out = F.lit(False)
    for low, high in peaks:
        out = out | ((middle >= low) & (middle < high))
    return out


def weekday_name(day: Column) -> Column:
    return F.lower(F.date_format(day, "EEEE"))


def day_type(day: Column) -> Column:
    """weekday, saturday or sunday."""
    return F.when(F.dayofweek(day) == 1, "sunday").when(F.dayofweek(day) == 7, "saturday").otherwise("weekday")


def date_range(first: Column, last: Column) -> Column:
    return F.sequence(first, last, F.expr("interval 1 day"))
