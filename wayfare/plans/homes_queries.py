"""Queries for homes and residency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import homes
from ..sources.fixtures import Tables
from .registry import query
from .visits_queries import at_poi, valid

HOMES_SQL = """
night_pings AS (SELECT *, printf('%.2f', round(lat, 2)) || '_' || printf('%.2f', round(lng, 2)) AS cell FROM raw_pings WHERE (accuracy IS NULL OR accuracy < 1000) AND (hour(utc_timestamp) >= 19 OR hour(utc_timestamp) < 7) AND isodow(utc_timestamp) <= 5),
cells AS (SELECT ad_id, cell, count(DISTINCT date) AS n_nights, count(*) AS n_pings, avg(lat) AS home_lat, avg(lng) AS home_lng, min(zip) AS home_zip, min(city) AS home_city, min(region) AS home_region FROM night_pings GROUP BY ALL),
totals AS (SELECT ad_id, sum(n_nights) AS total FROM cells GROUP BY 1),
homes AS (SELECT ad_id, cell, home_lat, home_lng, home_zip, home_city, home_region, n_nights, CAST(n_nights AS DOUBLE) / total AS home_confidence FROM cells JOIN totals USING (ad_id) WHERE n_nights >= 3 QUALIFY row_number() OVER (PARTITION BY ad_id ORDER BY n_nights DESC, n_pings DESC, cell) = 1)
"""
STARTS_SQL = "starts AS (SELECT ad_id, home_lat, home_lng, count(*) AS days FROM (SELECT ad_id, date, round(arg_min(lat, utc_timestamp), {d}) AS home_lat, round(arg_min(lng, utc_timestamp), {d}) AS home_lng FROM {src} GROUP BY ALL) GROUP BY ALL)\n"


def detected(t: Tables) -> DataFrame:
    return homes.detect(valid(t, max_accuracy=1000.0))


@query(HOMES_SQL + "SELECT ad_id, round(home_lat, 6) AS home_lat, round(home_lng, 6) AS home_lng, home_zip, home_city, home_region, n_nights, round(home_confidence, 6) AS home_confidence FROM homes")
def home_tcwk197(t: Tables) -> DataFrame:
    return detected(t).select("ad_id", F.round("home_lat", 6).alias("home_lat"), F.round("home_lng", 6).alias("home_lng"), "home_zip", "home_city", "home_region", "n_nights", F.round("home_confidence", 6).alias("home_confidence"))


MEDIAN_SQL = "SELECT ad_id, round(quantile_disc(lat, 0.5), 4) AS home_lat, round(quantile_disc(lng, 0.5), 4) AS home_lng FROM raw_pings WHERE (accuracy IS NULL OR accuracy < 200) AND (hour(utc_timestamp) >= 20 OR hour(utc_timestamp) < 4) {where} GROUP BY ad_id HAVING count(*) >= 3 AND count(DISTINCT date) >= 2"


@query(MEDIAN_SQL.format(where="AND len(poi_ids) = 0 AND ad_id IN (SELECT ad_id FROM at_poi)"))
def residential_median(t: Tables) -> DataFrame:
    visitors = at_poi(t).select("ad_id").distinct()
    return homes.residential(valid(t, max_accuracy=200.0).join(visitors, "ad_id", "left_semi"), exact=True)


@query(f"SELECT ad_id, CAST(round(home_lat, 1) * 10 AS INTEGER) AS lat_key, CAST(round(home_lng, 1) * 10 AS INTEGER) AS lng_key FROM ({MEDIAN_SQL.format(where='')})")
def activation_home(t: Tables) -> DataFrame:
    return homes.activation_keys(valid(t, max_accuracy=200.0), exact=True)


@query(STARTS_SQL.format(d=1, src="raw_pings WHERE accuracy IS NULL OR accuracy < 100") + "SELECT * FROM starts WHERE days >= 3")
def first_ping_home(t: Tables) -> DataFrame:
    return homes.first_ping_homes(valid(t, max_accuracy=100.0))


@query(STARTS_SQL.format(d=4, src="pings") + "SELECT * FROM starts QUALIFY row_number() OVER (PARTITION BY ad_id ORDER BY days DESC, home_lat, home_lng) = 1")
def top_home(t: Tables) -> DataFrame:
    return homes.top_home(valid(t))


ZIP_SQL = """
home_zips AS (SELECT ad_id, zip AS home_zip, region AS home_region FROM (SELECT ad_id, zip, region, count(*) AS freq, 1 AS priority FROM pings WHERE hour(utc_timestamp) >= 22 OR hour(utc_timestamp) <= 6 GROUP BY ALL UNION ALL SELECT ad_id, zip, region, count(*), 2 FROM pings GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY ad_id ORDER BY priority, freq DESC, zip, region) = 1),
home_points AS (SELECT ad_id, coalesce(avg(lat) FILTER (hour(utc_timestamp) >= 22 OR hour(utc_timestamp) <= 6), avg(lat)) AS home_lat, coalesce(avg(lng) FILTER (hour(utc_timestamp) >= 22 OR hour(utc_timestamp) <= 6), avg(lng)) AS home_lng FROM pings GROUP BY 1)
"""


@query(ZIP_SQL + "SELECT ad_id, home_zip, home_region, round(home_lat, 6) AS home_lat, round(home_lng, 6) AS home_lng FROM home_zips JOIN home_points USING (ad_id)")
def persona_home(t: Tables) -> DataFrame:
    both = homes.mode_zip(valid(t)).join(homes.mean_position(valid(t)), "ad_id")
    return both.select("ad_id", "home_zip", "home_region", F.round("home_lat", 6).alias("home_lat"), F.round("home_lng", 6).alias("home_lng"))


@query(HOMES_SQL + "SELECT ad_id FROM homes WHERE home_confidence >= 0.5 AND n_nights >= 3 AND ad_id IN (SELECT ad_id FROM pings GROUP BY 1 HAVING count(DISTINCT date_trunc('week', CAST(date AS DATE))) >= 3)")
def resident_count(t: Tables) -> DataFrame:
    return homes.residents(detected(t), valid(t), weeks=5)


@query("""SELECT date, maids, CAST(floor(maids / churn * 0.8::DOUBLE + 0.5) AS BIGINT) AS unique_users, CAST(floor(maids / churn * 0.8::DOUBLE * pow(0.5::DOUBLE, 184 / 30.44::DOUBLE / 12) + 0.5) AS BIGINT) AS users_today, maids > 0.00005::DOUBLE * 1000000 AS over_ceiling
FROM (SELECT date, count(DISTINCT ad_id) AS maids, 1 + (731 / 30.44::DOUBLE - 12) / 12 AS churn FROM pings GROUP BY 1)""")
def audience_estimate(t: Tables) -> DataFrame:
    counts = valid(t).groupBy("date").agg(F.countDistinct("ad_id").alias("maids"))
    return homes.audience_estimate(counts, first="2024-01-01", last="2026-01-01", now="2026-07-04", kappa=0.8, ceiling_millions=0.00005)


@query(HOMES_SQL.replace("FROM raw_pings WHERE (accuracy IS NULL OR accuracy < 1000)", "FROM pings WHERE ad_id IN (SELECT ad_id FROM at_poi)") + "," + STARTS_SQL.format(d=4, src="pings WHERE ad_id IN (SELECT ad_id FROM at_poi)") + """,
top_starts AS (SELECT * FROM starts QUALIFY row_number() OVER (PARTITION BY ad_id ORDER BY days DESC, home_lat, home_lng) = 1),
old AS (SELECT round(home_lat, 2) AS home_lat, round(home_lng, 2) AS home_lng, count(DISTINCT ad_id) AS old_devices FROM top_starts GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 30),
new AS (SELECT round(home_lat, 2) AS home_lat, round(home_lng, 2) AS home_lng, count(DISTINCT ad_id) AS new_devices FROM homes GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 30)
SELECT * FROM old JOIN new USING (home_lat, home_lng)""")
def catchment_methods(t: Tables) -> DataFrame:
    return homes.catchment_methods(valid(t), at_poi(t))


@query(HOMES_SQL + """SELECT 'nights' AS measure, CASE WHEN n_nights < 5 THEN '3-4' WHEN n_nights < 10 THEN '5-9' WHEN n_nights < 20 THEN '10-19' ELSE '20+' END AS bucket, count(*) AS devices FROM homes GROUP BY 2
UNION ALL SELECT 'confidence', CASE WHEN home_confidence < 0.3 THEN '<0.3' WHEN home_confidence < 0.5 THEN '0.3-0.5' WHEN home_confidence < 0.7 THEN '0.5-0.7' WHEN home_confidence < 0.9 THEN '0.7-0.9' ELSE '>=0.9' END, count(*) FROM homes GROUP BY 2""")
def home_quality(t: Tables) -> DataFrame:
    return homes.quality_histogram(detected(t))
