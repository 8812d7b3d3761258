"""Homes and residency."""

from __future__ import annotations

from datetime import date
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..functions.timeutil import iso_day, local_time, week_start
from .reports import first_by


#: Days of a mean month, and the months that a device id lives.
MONTH_DAYS = 30.44
LIFESPAN_MONTHS = 12


def detect(pings: DataFrame, *, min_nights: int = 3) -> DataFrame:
    """One home per device: the cell (2 decimals) of most weekday nights (19 to 7h UTC).

    Columns: ad_id, cell, home_lat, home_lng, home_zip, home_city, home_region, n_nights, home_confidence (the
    cell's share of all cells' nights).
    """
    hour = F.hour("utc_timestamp")
    night = pings.filter(((hour >= 19) | (hour < 7)) & iso_day(F.col("utc_timestamp")).between(1, 5))
    keyed = night.withColumn("cell", F.concat_ws("_", F.format_string("%.2f", F.round("lat", 2)), F.format_string("%.2f", F.round("lng", 2))))
    cells = keyed.groupBy("ad_id", "cell").agg(
        F.countDistinct("date").alias("n_nights"), F.count(F.lit(1)).alias("n_pings"), F.avg("lat").alias("home_lat"), F.avg("lng").alias("home_lng"), F.min("zip").alias("home_zip"), F.min("city").alias("home_city"), F.min("region").alias("home_region")
    )
    w = Window.partitionBy("ad_id")
    best = cells.withColumn("total_", F.sum("n_nights").over(w)).filter(F.col("n_nights") >= min_nights).withColumn("rn_", F.row_number().over(w.orderBy(F.desc("n_nights"), F.desc("n_pings"), "cell")))
    return best.filter("rn_ = 1").select("ad_id", "cell", "home_lat", "home_lng", "home_zip", "home_city", "home_region", "n_nights", (F.col("n_nights") / F.col("total_")).alias("home_confidence"))


def residential(pings: DataFrame, *, min_pings: int = 3, min_nights: int = 2, away_only: bool = True, exact: bool = False) -> DataFrame:
    """ad_id and the median night position (20 to 4h UTC, 4 decimals); ``away_only`` leaves out pings at marked places."""
    hour = F.hour("utc_timestamp")
    night = pings.filter((hour >= 20) | (hour < 4))
    if away_only:
        night = night.filter(F.coalesce(F.size("poi_ids"), F.lit(0)) <= 0)
    middle = (lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})")) if exact else (lambda c: F.percentile_approx(c, 0.5))
    per = night.groupBy("ad_id").agg(middle("lat").alias("lat"), middle("lng").alias("lng"), F.count(F.lit(1)).alias("n"), F.countDistinct("date").alias("nights"))
    return per.filter((F.col("n") >= min_pings) & (F.col("nights") >= min_nights)).select("ad_id", F.round("lat", 4).alias("home_lat"), F.round("lng", 4).alias("home_lng"))


def activation_keys(pings: DataFrame, **options: bool) -> DataFrame:
    """ad_id, lat_key, lng_key: homes by tenths of a degree, for the geocode cache."""
    h = residential(pings, **{"away_only": False, **options})
    return h.select("ad_id", (F.round("home_lat", 1) * 10).cast("int").alias("lat_key"), (F.round("home_lng", 1) * 10).cast("int").alias("lng_key"))


def day_starts(pings: DataFrame, decimals: int) -> DataFrame:
    first = pings.groupBy("ad_id", "date").agg(F.round(first_by(F.col("lat")), decimals).alias("home_lat"), F.round(first_by(F.col("lng")), decimals).alias("home_lng"))
    return first.groupBy("ad_id", "home_lat", "home_lng").agg(F.count(F.lit(1)).alias("days"))


def first_ping_homes(pings: DataFrame, *, min_days: int = 3, decimals: int = 1) -> DataFrame:
    """Every position where enough of a device's days start; a device may have several."""
    return day_starts(pings, decimals).filter(F.col("days") >= min_days)


def top_home(pings: DataFrame, *, decimals: int = 4) -> DataFrame:
    """The position where most of a device's days start; ties by coordinates."""
    w = Window.partitionBy("ad_id").orderBy(F.desc("days"), "home_lat", "home_lng")
    return day_starts(pings, decimals).withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").drop("rn_")


def _night(zone: str) -> Column:
    hour = F.hour(local_time(F.col("utc_timestamp"), zone))
    return (hour >= 22) | (hour <= 6)


def mode_zip(pings: DataFrame, *, zone: str = "UTC") -> DataFrame:
    """ad_id, home_zip, home_region: most frequent zip at night (22 to 6h), or at any hour where no night is known."""
    known = pings.filter((F.col("zip").isNotNull()) & (F.col("zip") != ""))
    per = known.groupBy("ad_id", "zip", "region").agg(F.count_if(_night(zone)).alias("night"), F.count(F.lit(1)).alias("every"))
    w = Window.partitionBy("ad_id").orderBy(F.when(F.col("night") > 0, 0).otherwise(1), F.desc(F.when(F.col("night") > 0, F.col("night")).otherwise(F.col("every"))), "zip", "region")
    return per.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").select("ad_id", F.col("zip").alias("home_zip"), F.col("region").alias("home_region"))


def mean_position(pings: DataFrame, *, zone: str = "UTC") -> DataFrame:
    """ad_id, home_lat, home_lng: mean position at night, or of all pings where no night is known."""
    mean = lambda c: F.coalesce(F.avg(F.when(_night(zone), F.col(c))), F.avg(c))
    return pings.groupBy("ad_id").agg(mean("lat").alias("home_lat"), mean("lng").alias("home_lng"))


def residents(homes: DataFrame, pings: DataFrame, *, weeks: int, confidence: float = 0.5, min_nights: int = 3, active_share: float = 0.5) -> DataFrame:
    """ad_id of devices with a sure home that are active in enough ISO weeks of the window."""
    sure = homes.filter((F.col("home_confidence") >= confidence) & (F.col("n_nights") >= min_nights)).select("ad_id")
    active = pings.groupBy("ad_id").agg(F.countDistinct(week_start(F.col("date"))).alias("weeks_")).filter(F.col("weeks_") >= ceil(weeks * active_share)).select("ad_id")
    return sure.join(active, "ad_id", "left_semi")


def months_between(first: str, last: str) -> float:
    """Days between two ISO dates over the mean month; 0 if the second is earlier."""
    return max(0.0, (date.fromisoformat(last) - date.fromisoformat(first)).days / MONTH_DAYS)


def audience_estimate(counts: DataFrame, *, first: str, last: str, now: str, kappa: float, ceiling_millions: float) -> DataFrame:
    """Adds unique_users (ids less those renewed in a long span), users_today (those still reachable) and over_ceiling.

    ``counts`` has maids, seen from ``first`` to ``last``. Ids live for a year: a longer span counts people several
    times, and half of them are gone a year after it. The ceiling is compared with the ids themselves; counts of
    none give null.
    """
    churn = 1 + max(0.0, months_between(first, last) - LIFESPAN_MONTHS) / LIFESPAN_MONTHS
    decay = 0.5 ** (months_between(last, now) / LIFESPAN_MONTHS)
    some, users = F.col("maids") > 0, F.col("maids") / churn * kappa
    over = (F.lit(ceiling_millions) > 0) & (F.col("maids") > ceiling_millions * 1_000_000)
    return counts.withColumns({"unique_users": F.when(some, half_up(users)), "users_today": F.when(some, half_up(users * decay)), "over_ceiling": F.when(some, over)})


def catchment_methods(pings: DataFrame, at_poi: DataFrame, *, cells: int = 30) -> DataFrame:
    """home_lat, home_lng (2 decimals), old and new device counts of the top cells that both methods name."""
    visitors = at_poi.select("ad_id").distinct()
    met = pings.join(visitors, "ad_id", "left_semi")

    def top(df: DataFrame, name: str) -> DataFrame:
        per = df.groupBy(F.round("home_lat", 2).alias("home_lat"), F.round("home_lng", 2).alias("home_lng")).agg(F.countDistinct("ad_id").alias(name))
        return per.orderBy(F.desc(name), "home_lat", "home_lng").limit(cells)

    return top(top_home(met), "old_devices").join(top(detect(met), "new_devices"), ["home_lat", "home_lng"])


def quality_histogram(homes: DataFrame) -> DataFrame:
    """measure (nights/confidence), bucket and devices."""
    n, c = F.col("n_nights"), F.col("home_confidence")
    nights = F.when(n < 5, "3-4").when(n < 10, "5-9").when(n < 20, "10-19").otherwise("20+")
    sure = F.when(c < 0.3, "<0.3").when(c < 0.5, "0.3-0.5").when(c < 0.7, "0.5-0.7").when(c < 0.9, "0.7-0.9").otherwise(">=0.9")
    pairs = F.array(F.struct(F.lit("nights").alias("measure"), nights.alias("bucket")), F.struct(F.lit("confidence").alias("measure"), sure.alias("bucket")))
    return homes.select(F.inline(pairs)).groupBy("measure", "bucket").agg(F.count(F.lit(1)).alias("devices"))
