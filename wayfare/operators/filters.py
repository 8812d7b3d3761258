"""Filters of pings and devices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeutil import in_hours, iso_day, local_time, minutes_between
from ..sources.schema import HUMAN_DAYS, MAX_ACCURACY_M


def valid_pings(pings: DataFrame, *, max_accuracy: float = MAX_ACCURACY_M) -> DataFrame:
    """Typed pings with an id, coordinates and an accuracy that is unknown or below the limit.

    Columns: ad_id, date, utc_timestamp, lat, lng, zip, region, city, h3, origin_type, circle, poi_ids, country.
    """
    number = lambda c: F.col(c).try_cast("double")
    geo, quality = F.col("geo_fields"), F.col("quality_fields")
    good = (F.trim("ad_id") != "") & number("latitude").isNotNull() & number("longitude").isNotNull() & (F.col("horizontal_accuracy").isNull() | (number("horizontal_accuracy") < max_accuracy))
    return pings.filter(good).select(
        "ad_id", "date", "utc_timestamp", number("latitude").alias("lat"), number("longitude").alias("lng"), geo["zipcode"].alias("zip"), geo["region"].alias("region"), geo["city"].alias("city"),
        geo["h3_res10"].alias("h3"), quality["ping_origin_type"].alias("origin_type"), quality["ping_circle_score"].try_cast("double").alias("circle"), "poi_ids", F.col("iso_country_code").alias("country"),
    )


def date_range(pings: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """ISO dates, both ends in; on partitioned data only these folders are read."""
    if first:
        pings = pings.filter(F.col("date") >= first)
    return pings.filter(F.col("date") <= last) if last else pings


def in_hour_window(pings: DataFrame, first: int, last: int, *, zone: str = "UTC") -> DataFrame:
    return pings.filter(in_hours(F.hour(local_time(F.col("utc_timestamp"), zone)), first, last))


def on_days(pings: DataFrame, days: list[int], *, zone: str = "UTC") -> DataFrame:
    """ISO days 1 to 7; none or all of them mean no filter."""
    if not days or len(set(days)) == 7:
        return pings
    return pings.filter(iso_day(local_time(F.col("utc_timestamp"), zone)).isin(days))


def gps_only(pings: DataFrame) -> DataFrame:
    """Pings of GPS origin or of none."""
    return pings.filter(F.col("origin_type").isNull() | (F.col("origin_type") == "gps"))


def max_circle(pings: DataFrame, score: float) -> DataFrame:
    return pings.filter(F.col("circle").isNull() | (F.col("circle") <= score))


def human_ids(pings: DataFrame, *, min_days: int = HUMAN_DAYS) -> DataFrame:
    """ad_id of devices seen on enough distinct days."""
    return pings.groupBy("ad_id").agg(F.countDistinct("date").alias("days_")).filter(F.col("days_") >= min_days).select("ad_id")


def only_humans(pings: DataFrame, *, min_days: int = HUMAN_DAYS) -> DataFrame:
    return pings.join(human_ids(pings, min_days=min_days), "ad_id", "left_semi")


def routine(pings: DataFrame, *, zone: str = "UTC") -> DataFrame:
    """ad_id, days, avg_dwell (whole minutes a day), work_share and overnight_share of pings at places.

    The work share is the mean over days of the share of pings from 8 to before 20h; the overnight share is the
    share of days with a ping from 2 to before 5h.
    """
    hour = F.hour(local_time(F.col("utc_timestamp"), zone))
    daily = pings.groupBy("ad_id", "date").agg(
        minutes_between(F.min("utc_timestamp"), F.max("utc_timestamp")).alias("dwell"),
        F.avg(((hour >= 8) & (hour < 20)).cast("double")).alias("work"),
        F.max(((hour >= 2) & (hour < 5)).cast("double")).alias("overnight"),
    )
    return daily.groupBy("ad_id").agg(F.count(F.lit(1)).alias("days"), F.avg("dwell").alias("avg_dwell"), F.round(F.avg("work"), 9).alias("work_share"), F.avg("overnight").alias("overnight_share"))


def employee_ids(pings: DataFrame, *, min_days: int = 15, min_dwell: float = 240.0, work_share: float = 0.6, overnight_share: float = 0.3, zone: str = "UTC") -> DataFrame:
    r = routine(pings, zone=zone)
    return r.filter((F.col("days") >= min_days) & (F.col("avg_dwell") >= min_dwell) & (F.col("work_share") >= work_share) & (F.col("overnight_share") <= overnight_share)).select("ad_id")


def resident_ids(pings: DataFrame, *, min_days: int = 15, min_dwell: float = 240.0, overnight_share: float = 0.5, zone: str = "UTC") -> DataFrame:
    r = routine(pings, zone=zone)
    return r.filter((F.col("days") >= min_days) & (F.col("avg_dwell") >= min_dwell) & (F.col("overnight_share") >= overnight_share)).select("ad_id")


def without_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids, "ad_id", "left_anti")


def min_visit_days(rows: DataFrame, n: int) -> DataFrame:
    return only_humans(rows, min_days=n)


@dataclass(frozen=True)
class VisitorFilter:
    """Filters that reports apply to pings before they look for visits, and to visitors after it."""

    hours: tuple[int, int] | None = None
    days: tuple[int, ...] = ()
    gps: bool = False
    circle: float | None = None
    employees: bool = False
    residents: bool = False
    min_visits: int = 1
    zone: str = "UTC"

    def pings(self, pings: DataFrame) -> DataFrame:
        if self.hours:
            pings = in_hour_window(pings, *self.hours, zone=self.zone)
        pings = on_days(pings, list(self.days), zone=self.zone)
        pings = gps_only(pings) if self.gps else pings
        return max_circle(pings, self.circle) if self.circle is not None else pings

    def visitors(self, at_poi: DataFrame) -> DataFrame:
        out = at_poi
        if self.employees:
            out = without_ids(out, employee_ids(at_poi, zone=self.zone))
        if self.residents:
            out = without_ids(out, resident_ids(at_poi, zone=self.zone))
        return min_visit_days(out, self.min_visits) if self.min_visits > 1 else out
