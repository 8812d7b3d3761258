"""Column helpers for times: elapsed units, ISO days, local time, windows of hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Time zone of a country's code; others are UTC.
ZONES = {
    "MX": "America/Mexico_City", "ES": "Europe/Madrid", "FR": "Europe/Paris", "DE": "Europe/Berlin", "GB": "Europe/London", "UK": "Europe/London", "IT": "Europe/Rome",
    "PT": "Europe/Lisbon", "NL": "Europe/Amsterdam", "BE": "Europe/Brussels", "US": "America/New_York", "BR": "America/Sao_Paulo", "AR": "America/Argentina/Buenos_Aires",
    "CO": "America/Bogota", "CL": "America/Santiago", "PE": "America/Lima",
}


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds from a to b."""
    return F.timestamp_diff("SECOND", a, b)


def minutes_between(a: Column, b: Column) -> Column:
    """Whole elapsed minutes from a to b."""
    return F.timestamp_diff("MINUTE", a, b)


def iso_day(ts: Column) -> Column:
    """1 on Mondays to 7 on Sundays."""
    return F.weekday(ts) + 1


def local_time(ts: Column, zone: str = "UTC") -> Column:
    """Wall-clock time in a zone of a UTC time."""
    return ts if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def zone_of(country: str) -> str:
    return ZONES.get(country.upper(), "UTC")


def in_hours(hour: Column, first: int, last: int) -> Column:
    """Closed window of hours; one that ends before it starts wraps around midnight."""
    return hour.between(first, last) if first <= last else (hour >= first) | (hour <= last)


def in_hours_half_open(hour: Column, first: int, end: int) -> Column:
    return (hour >= first) & (hour < end) if first <= end else (hour >= first) | (hour < end)


def week_start(date: Column) -> Column:
    """Monday of the week as an ISO date."""
    return F.date_format(F.date_trunc("week", F.to_date(date)), "yyyy-MM-dd")
