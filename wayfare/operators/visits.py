"""Dwell and visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import materialize
from ..functions.timeutil import minutes_between, seconds_between
from ..sources.schema import DWELL_BUCKETS


def device_day_dwell(at_poi: DataFrame) -> DataFrame:
    """ad_id, date, arrival, departure, ping_count, dwell_seconds, dwell_minutes (one decimal) of pings at a place."""
    seconds = seconds_between(F.col("arrival"), F.col("departure"))
    days = at_poi.groupBy("ad_id", "date").agg(F.min("utc_timestamp").alias("arrival"), F.max("utc_timestamp").alias("departure"), F.count(F.lit(1)).alias("ping_count"))
    return days.withColumns({"dwell_seconds": seconds, "dwell_minutes": F.round(seconds / 60.0, 1)})


def dwell_between(at_poi: DataFrame, *, low: float | None = None, high: float | None = None) -> DataFrame:
    """Pings of device-days whose dwell is within the limits, with dwell_minutes.

    A window over each device-day, so that rows are dealt once, and not at all where they lie in buckets by ad_id.
    """
    day = Window.partitionBy("ad_id", "date")
    seconds = seconds_between(F.min("utc_timestamp").over(day), F.max("utc_timestamp").over(day))
    d = at_poi.withColumn("dwell_minutes", F.round(seconds / 60.0, 1))
    if low is not None:
        d = d.filter(F.col("dwell_minutes") >= low)
    return d if high is None else d.filter(F.col("dwell_minutes") <= high)


def whole_minute_days(at_poi: DataFrame, *, low: int = 0, high: int | None = None) -> DataFrame:
    """ad_id, date, minutes of device-days by whole elapsed minutes."""
    d = at_poi.groupBy("ad_id", "date").agg(minutes_between(F.min("utc_timestamp"), F.max("utc_timestamp")).alias("minutes")).filter(F.col("minutes") >= low)
    return d if high is None else d.filter(F.col("minutes") <= high)


def dwell_table(at_poi: DataFrame) -> DataFrame:
    """ad_id, date, utc_timestamp, lat, lng, dwell_minutes: every ping at a place, with its day's dwell."""
    return dwell_between(at_poi).select("ad_id", "date", "utc_timestamp", "lat", "lng", "dwell_minutes")


def _fits(dwell: Column, buckets: tuple[int, ...]) -> Column:
    """One row for each bucket (least minutes) that a dwell reaches; the bucket 0 takes all."""
    return F.explode(F.filter(F.array(*map(F.lit, buckets)), lambda b: (b == 0) | (b <= dwell))).alias("bucket")


def bucket_activity(dwell: DataFrame, *keys: Column, buckets: tuple[int, ...] = DWELL_BUCKETS) -> DataFrame:
    """bucket, keys, pings and devices of all days that dwell at least so many minutes, by the keys.

    Pings are counted for each dwell, and a device once by its longest day, before buckets multiply them.
    """
    names = [f"k{i}_" for i in range(len(keys))]
    per = dwell.select("ad_id", "dwell_minutes", *[k.alias(n) for k, n in zip(keys, names, strict=True)]).groupBy("ad_id", "dwell_minutes", *names).agg(F.count(F.lit(1)).alias("n"))
    pings = per.groupBy("dwell_minutes", *names).agg(F.sum("n").alias("n")).select("n", *names, _fits(F.col("dwell_minutes"), buckets)).groupBy("bucket", *names).agg(F.sum("n").alias("pings"))
    devices = per.groupBy("ad_id", *names).agg(F.max("dwell_minutes").alias("most")).select(*names, _fits(F.col("most"), buckets)).groupBy("bucket", *names).agg(F.count(F.lit(1)).alias("devices"))
    return pings.join(devices, ["bucket", *names])


def bucket_days(dwell: DataFrame, *, buckets: tuple[int, ...] = DWELL_BUCKETS) -> DataFrame:
    """bucket and device_days."""
    days = dwell.select("ad_id", "date", "dwell_minutes").distinct().groupBy("dwell_minutes").agg(F.count(F.lit(1)).alias("n"))
    return days.select("n", _fits(F.col("dwell_minutes"), buckets)).groupBy("bucket").agg(F.sum("n").alias("device_days"))


def bucket_summary(dwell: DataFrame, *, buckets: tuple[int, ...] = DWELL_BUCKETS) -> DataFrame:
    """bucket, device_days, devices, pings."""
    return bucket_activity(dwell, buckets=buckets).join(bucket_days(dwell, buckets=buckets), "bucket").select("bucket", "device_days", "devices", "pings")


def bucket_reports(pings: DataFrame, at_poi: DataFrame, catalogue: DataFrame, *, buckets: tuple[int, ...] = DWELL_BUCKETS) -> dict[str, DataFrame]:
    """The reports of each dwell bucket: od, hourly, catchment, mobility, temporal and total, each with ``bucket``.

    The pings at places are written once with their day's dwell; each report then takes one pass over all buckets.
    """
    from . import reports

    dwell = materialize(dwell_table(at_poi), "dwell")
    days = dwell.groupBy("ad_id", "date").agg(F.max("dwell_minutes").alias("dwell_minutes"), F.min("utc_timestamp").alias("arrival"))
    ends = reports.day_ends(pings)
    at = lambda c: F.round(c, 4).alias(c)
    hour = lambda c: F.hour(c).cast("long")
    flow = ["origin_lat", "origin_lng", "dest_lat", "dest_lng"]
    flows = ends.join(days, ["ad_id", "date"]).select(*map(at, flow), hour("first_seen").alias("departure_hour"), hour("arrival").alias("poi_arrival_hour"), _fits(F.col("dwell_minutes"), buckets))
    longest = days.groupBy("ad_id").agg(F.max("dwell_minutes").alias("most"))
    starts = ends.join(longest, "ad_id").select(*map(at, flow[:2]), hour("first_seen").alias("departure_hour"), _fits(F.col("most"), buckets))
    near = reports.around_visits(pings, days.withColumnRenamed("arrival", "visit_time"), catalogue).select("timing", "category", _fits(F.col("dwell_minutes"), buckets))
    count = lambda df, *keys: df.groupBy("bucket", *keys).agg(F.count(F.lit(1)).alias("device_days"))
    return {
        "od": count(flows, *flow, "departure_hour", "poi_arrival_hour"),
        "hourly": bucket_activity(dwell, hour("utc_timestamp"), buckets=buckets).withColumnRenamed("k0_", "touch_hour"),
        "catchment": count(starts, *flow[:2], "departure_hour"),
        "mobility": count(near, "timing", "category").withColumn("hits", F.col("device_days")),
        "temporal": bucket_activity(dwell, F.col("date"), buckets=buckets).withColumnRenamed("k0_", "date"),
        "total": bucket_activity(dwell, buckets=buckets).select("bucket", F.col("devices").alias("total_unique_devices")),
    }


def poi_visits(poi_pings: DataFrame) -> DataFrame:
    """ad_id, date, poi_id, category, start, end, ping_count, dwell_minutes (one decimal), visit_hour."""
    v = poi_pings.groupBy("ad_id", "date", "poi_id", "category").agg(F.min("utc_timestamp").alias("start"), F.max("utc_timestamp").alias("end"), F.count(F.lit(1)).alias("ping_count"))
    return v.withColumns({"dwell_minutes": F.round(seconds_between(F.col("start"), F.col("end")) / 60.0, 1), "visit_hour": F.hour("start")})


def qualified_days(at_poi: DataFrame, *, min_pings: int = 2, min_seconds: int = 120) -> DataFrame:
    return device_day_dwell(at_poi).filter((F.col("ping_count") >= min_pings) & (F.col("dwell_seconds") >= min_seconds))
