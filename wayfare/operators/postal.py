"""Signals of postal codes: devices, hot cells, signatures and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeutil import in_hours, iso_day, local_time
from .reports import first_by, tenth_key

BUCKETS = ("morning", "midday", "afternoon", "evening", "night")


def zip_devices(pings: DataFrame, visitors: DataFrame, zips: list[str], *, zone: str = "UTC") -> DataFrame:
    """One row per visitor and requested zip where its days start: device-days, quality, position, hour buckets, weekend days."""
    known = pings.join(visitors.select("ad_id").distinct(), "ad_id", "left_semi").filter(F.coalesce("zip", F.lit("")) != "")
    hour = F.hour(local_time(F.col("utc_timestamp"), zone))
    first = F.min(F.struct("utc_timestamp", "lat", "lng", "zip", "region", "city", "h3"))
    day = known.groupBy("ad_id", "date").agg(
        first.alias("first"), F.max(in_hours(hour, 22, 6).cast("int")).alias("overnight"), F.avg((F.coalesce("origin_type", F.lit("")) == "gps").cast("double")).alias("gps"), F.avg("circle").alias("circle"),
    )
    day = day.select("ad_id", "date", "first.*", "overnight", "gps", "circle")
    at = local_time(F.col("utc_timestamp"), zone)
    h = F.hour(at)
    parts = {"morning": h.between(5, 10), "midday": h.between(11, 13), "afternoon": h.between(14, 17), "evening": h.between(18, 21), "night": (h >= 22) | (h <= 4)}
    return day.filter(F.col("zip").isin(zips)).groupBy("ad_id", "zip").agg(
        F.min("region").alias("region"), F.min("city").alias("city"), F.count(F.lit(1)).alias("device_days"), F.max("overnight").alias("has_overnight"), F.avg("gps").alias("avg_gps"), F.avg("circle").alias("avg_circle"),
        F.avg("lat").alias("avg_lat"), F.avg("lng").alias("avg_lng"), *[F.count_if(c).alias(f"{k}_dd") for k, c in parts.items()], F.count_if(iso_day(at) >= 6).alias("weekend_dd"),
    )


def hot_cells(pings: DataFrame, visitors: DataFrame, zips: list[str], *, least: int = 2) -> DataFrame:
    """zip, h3, devices, pings (device-days), lat, lng of cells where enough device-days start."""
    known = pings.join(visitors.select("ad_id").distinct(), "ad_id", "left_semi").filter(F.col("zip").isin(zips) & F.col("h3").isNotNull())
    day = known.groupBy("ad_id", "date").agg(*[first_by(F.col(c)).alias(c) for c in ("zip", "h3", "lat", "lng")])
    return day.groupBy("zip", "h3").agg(F.countDistinct("ad_id").alias("devices"), F.count(F.lit(1)).alias("pings"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng")).filter(F.col("pings") >= least)


def geocoded_origins(pings: DataFrame, visitors: DataFrame, geocode: DataFrame, zips: list[str]) -> DataFrame:
    """ad_id, zipcode, device_days: starts of days by the geocode cache, for datasets without own zip codes."""
    met = pings.join(visitors.select("ad_id").distinct(), "ad_id", "left_semi")
    day = met.groupBy("ad_id", "date").agg(first_by(F.col("lat")).alias("lat"), first_by(F.col("lng")).alias("lng"))
    keyed = day.select("ad_id", tenth_key(F.col("lat")).alias("lat_key"), tenth_key(F.col("lng")).alias("lng_key"))
    return keyed.join(geocode.filter(F.col("zipcode").isin(zips)), ["lat_key", "lng_key"]).groupBy("ad_id", "zipcode").agg(F.count(F.lit(1)).alias("device_days"))


def tier(gps: Column, circle: Column, middle: str = "medium") -> Column:
    return F.when((gps > 0.7) & (circle < 1), "high").when(gps > 0.4, middle).otherwise("low")


def _weighted(c: str) -> Column:
    return F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col("device_days")) / F.sum("device_days")


def device_rollup(rows: DataFrame) -> DataFrame:
    """ad_id, device_days, postal_codes (sorted, joined), quality_tier, overnight."""
    per = rows.groupBy("ad_id").agg(F.sum("device_days").alias("device_days"), F.array_join(F.array_sort(F.collect_set("zip")), ",").alias("postal_codes"), _weighted("avg_gps").alias("g"), _weighted("avg_circle").alias("c"), (F.max("has_overnight") > 0).alias("overnight"))
    return per.select("ad_id", "device_days", "postal_codes", tier(F.col("g"), F.col("c")).alias("quality_tier"), "overnight")


def signatures(rows: DataFrame) -> DataFrame:
    """One row per zip: devices, days, peak bucket, shares, quality, persistence of its devices, centroid and region."""
    dd = F.col("device_days")
    held = {"once_only": dd == 1, "casual": dd.between(2, 7), "regular": dd.between(8, 30), "resident": dd > 30}
    per = rows.groupBy("zip").agg(
        F.countDistinct("ad_id").alias("devices"), F.sum(dd).alias("device_days"), *[F.sum(f"{b}_dd").alias(b) for b in BUCKETS], F.sum("weekend_dd").alias("weekend"), F.sum(F.when(F.col("has_overnight") > 0, dd).otherwise(0)).alias("overnight"),
        _weighted("avg_gps").alias("gps_share"), _weighted("avg_circle").alias("avg_circle"), _weighted("avg_lat").alias("lat"), _weighted("avg_lng").alias("lng"), *[F.count_if(c).alias(k) for k, c in held.items()],
    )
    top = F.greatest(*BUCKETS)
    peak = F.when(F.lit(False), F.lit(""))
    for b in BUCKETS:
        peak = peak.when(F.col(b) == top, b)
    share = lambda c: F.round(F.col(c) / F.col("device_days"), 6)
    most = rows.groupBy("zip", "region").agg(F.sum(dd).alias("n")).groupBy("zip").agg(F.max(F.struct(F.col("n"), "region"))["region"].alias("region"))
    named = per.join(most, "zip")
    return named.select("zip", "region", "devices", "device_days", peak.alias("peak_bucket"), share("weekend").alias("weekend_share"), share("overnight").alias("overnight_share"), tier(F.col("gps_share"), F.col("avg_circle"), "mixed").alias("quality_tier"), F.round("gps_share", 6).alias("gps_share"), F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), *held)


def top_named(rows: DataFrame, name: str, n: int, *, value: str = "device_days") -> DataFrame:
    """zip and its n largest of a column by summed value, as a joined list."""
    per = rows.groupBy("zip", name).agg(F.sum(value).alias("v"))
    w = Window.partitionBy("zip").orderBy(F.desc("v"), name)
    best = per.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    return best.groupBy("zip").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", name))), lambda x: x[name]), ",").alias(f"top_{name}"))


def region_rollup(signed: DataFrame, matched: DataFrame) -> DataFrame:
    """region, devices, zips and the share of all matched devices."""
    total = matched.agg(F.countDistinct("ad_id").alias("total"))
    per = signed.groupBy(F.coalesce("region", F.lit("UNKNOWN")).alias("region")).agg(F.sum("devices").alias("devices"), F.countDistinct("zip").alias("zips"))
    return per.join(total).select("region", "devices", "zips", F.round(F.col("devices") / F.col("total"), 6).alias("share_of_total"))


def zips_filled(rows: DataFrame, zips: list[str], *, name: str = "zipcode") -> DataFrame:
    """postal_code, devices, device_days of every requested zip, zero where none is."""
    wanted = rows.sparkSession.createDataFrame([(z,) for z in zips], "postal_code string")
    per = rows.groupBy(F.col(name).alias("postal_code")).agg(F.countDistinct("ad_id").alias("devices"), F.sum("device_days").alias("device_days"))
    return wanted.join(per, "postal_code", "left").select("postal_code", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("devices", "device_days")])


def top_devices(rolled: DataFrame, n: int) -> DataFrame:
    """The report's optional size limit."""
    return rolled.orderBy(F.desc("device_days"), "ad_id").limit(n)
