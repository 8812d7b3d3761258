"""Queries over pings, places, dwell and visits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import among, as_targets, at_poi_pings, closest_poi, haversine_km, haversine_m, planar_m, spatial_join, within_box
from ..functions.timeutil import local_time
from ..operators import filters, poi_sets, visits
from ..sources.fixtures import Tables
from .registry import query


def valid(t: Tables, **options: float) -> DataFrame:
    return filters.valid_pings(t.pings, **options)


def targets(t: Tables) -> DataFrame:
    return as_targets(t.pois, "category")


def at_poi(t: Tables) -> DataFrame:
    return at_poi_pings(valid(t), targets(t))


@query("SELECT ad_id, date, utc_timestamp, lat, lng, zip, origin_type, circle FROM pings")
def valid_pings(t: Tables) -> DataFrame:
    return valid(t).select("ad_id", "date", "utc_timestamp", "lat", "lng", "zip", "origin_type", "circle")


@query("""
SELECT a.id AS a, b.id AS b, round(111320 * sqrt(pow(a.plat - b.plat, 2) + pow((a.plng - b.plng) * cos(radians((a.plat + b.plat) / 2)), 2)), 4) AS planar_m,
  round(2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)), 4) AS haversine_m, round(2 * 6371 * asin(least(1, sqrt(h))), 6) AS haversine_km
FROM (SELECT a, b, pow(sin(radians(b.plat - a.plat) / 2), 2) + cos(radians(a.plat)) * cos(radians(b.plat)) * pow(sin(radians(b.plng - a.plng) / 2), 2) AS h FROM pois a JOIN pois b ON CAST(substr(b.id, 5) AS BIGINT) = CAST(substr(a.id, 5) AS BIGINT) + 7)
""")
def poi_distances(t: Tables) -> DataFrame:
    """Each place and the one seven places on."""
    k = F.substring("id", 5, 20).cast("long")
    a = t.pois.select((k + 7).alias("k"), F.col("id").alias("a"), F.col("latitude").alias("la"), F.col("longitude").alias("na"))
    b = t.pois.select(k.alias("k"), F.col("id").alias("b"), F.col("latitude").alias("lb"), F.col("longitude").alias("nb"))
    at = [F.col(c) for c in ("la", "na", "lb", "nb")]
    return a.join(b, "k").select("a", "b", F.round(planar_m(*at), 4).alias("planar_m"), F.round(haversine_m(*at), 4).alias("haversine_m"), F.round(haversine_km(*at), 6).alias("haversine_km"))


@query("SELECT * FROM at_poi")
def at_poi_spatial(t: Tables) -> DataFrame:
    return at_poi(t)


@query("SELECT ad_id, utc_timestamp, poi_id, round(distance, 4) AS distance_m FROM near WHERE distance <= 200 QUALIFY row_number() OVER (PARTITION BY ad_id, utc_timestamp ORDER BY distance, poi_id) = 1")
def closest_place(t: Tables) -> DataFrame:
    return closest_poi(valid(t), targets(t)).select("ad_id", "utc_timestamp", "poi_id", F.round("distance_m", 4).alias("distance_m"))


@query("""SELECT ad_id, utc_timestamp, lat, lng FROM pings, (SELECT min(plat) a, max(plat) b, min(plng) c, max(plng) d FROM pois WHERE category = 'gym')
WHERE lat BETWEEN a - 0.02 AND b + 0.02 AND lng BETWEEN c - 0.02 AND d + 0.02""")
def box_prefilter(t: Tables) -> DataFrame:
    return within_box(valid(t), targets(t).filter("category = 'gym'")).select("ad_id", "utc_timestamp", "lat", "lng")


@query("""SELECT poi_lat, poi_lng, min(radius) AS poi_radius_m FROM (SELECT round(plat, 4) AS poi_lat, round(plng, 4) AS poi_lng, radius FROM pois) GROUP BY ALL""")
def target_coordinates(t: Tables) -> DataFrame:
    jobs = t.pois.select(F.col("latitude").alias("radius_lat"), F.col("longitude").alias("radius_lng"), F.col("radius").alias("radius_m"), F.lit(None).cast("double").alias("list_lat"), F.lit(None).cast("double").alias("list_lng"))
    return poi_sets.target_coordinates(jobs.unionByName(jobs))


@query("SELECT ad_id, date, n AS ping_count, round(seconds / 60.0::DOUBLE, 1) AS dwell_minutes FROM dwell")
def dwell_device_day(t: Tables) -> DataFrame:
    return visits.device_day_dwell(at_poi(t)).select("ad_id", "date", "ping_count", "dwell_minutes")


@query("SELECT a.*, round(d.seconds / 60.0::DOUBLE, 1) AS dwell_minutes FROM at_poi a JOIN dwell d USING (ad_id, date) WHERE round(d.seconds / 60.0::DOUBLE, 1) BETWEEN 10 AND 240")
def dwell_filtered(t: Tables) -> DataFrame:
    return visits.dwell_between(at_poi(t), low=10, high=240).select("ad_id", "date", "utc_timestamp", "lat", "lng", "dwell_minutes")


@query("SELECT ad_id, date, CAST(date_sub('minute', arrival, departure) AS BIGINT) AS minutes FROM dwell WHERE date_sub('minute', arrival, departure) BETWEEN 5 AND 300")
def dwell_whole_minutes(t: Tables) -> DataFrame:
    return visits.whole_minute_days(at_poi(t), low=5, high=300).select("ad_id", "date", F.col("minutes").cast("long").alias("minutes"))


@query("SELECT a.*, round(d.seconds / 60.0::DOUBLE, 1) AS dwell_minutes FROM at_poi a JOIN dwell d USING (ad_id, date)")
def dwell_table(t: Tables) -> DataFrame:
    return visits.dwell_table(at_poi(t))


@query("""
dt AS (SELECT a.*, round(d.seconds / 60.0::DOUBLE, 1) AS m FROM at_poi a JOIN dwell d USING (ad_id, date)), b AS (SELECT unnest([0, 2, 5, 10, 15, 30, 60, 120, 180]) AS bucket)
SELECT CAST(bucket AS INTEGER) AS bucket, count(DISTINCT ad_id || '|' || date) AS device_days, count(DISTINCT ad_id) AS devices, count(*) AS pings FROM dt JOIN b ON m >= bucket GROUP BY bucket
""")
def dwell_bucket_summary(t: Tables) -> DataFrame:
    return visits.bucket_summary(visits.dwell_table(at_poi(t)))


BUCKETS_SQL = """
dt AS (SELECT a.*, round(d.seconds / 60.0::DOUBLE, 1) AS m FROM at_poi a JOIN dwell d USING (ad_id, date)), b AS (SELECT CAST(unnest([0, 2, 5, 10, 15, 30, 60, 120, 180]) AS INTEGER) AS bucket),
ends AS (SELECT ad_id, date, round(arg_min(lat, utc_timestamp), 4) AS olat, round(arg_min(lng, utc_timestamp), 4) AS olng, CAST(hour(min(utc_timestamp)) AS BIGINT) AS left_at, round(arg_max(lat, utc_timestamp), 4) AS dlat, round(arg_max(lng, utc_timestamp), 4) AS dlng FROM pings GROUP BY ALL),
bd AS (SELECT DISTINCT bucket, ad_id, date FROM dt JOIN b ON m >= bucket)
"""


def bucketed(t: Tables) -> dict[str, DataFrame]:
    near = among(targets(t), valid(t))
    return visits.bucket_reports(valid(t), at_poi_pings(valid(t), near), near)


@query(BUCKETS_SQL + "SELECT bucket, olat AS origin_lat, olng AS origin_lng, dlat AS dest_lat, dlng AS dest_lng, left_at AS departure_hour, CAST(hour(arrival) AS BIGINT) AS poi_arrival_hour, count(*) AS device_days FROM bd JOIN ends USING (ad_id, date) JOIN dwell USING (ad_id, date) GROUP BY ALL")
def bucket_od(t: Tables) -> DataFrame:
    return bucketed(t)["od"]


@query(BUCKETS_SQL + "SELECT bucket, CAST(hour(utc_timestamp) AS BIGINT) AS touch_hour, count(*) AS pings, count(DISTINCT ad_id) AS devices FROM dt JOIN b ON m >= bucket GROUP BY ALL")
def bucket_hourly(t: Tables) -> DataFrame:
    return bucketed(t)["hourly"]


@query(BUCKETS_SQL + "SELECT bucket, olat AS origin_lat, olng AS origin_lng, left_at AS departure_hour, count(*) AS device_days FROM (SELECT DISTINCT bucket, ad_id FROM bd) JOIN ends USING (ad_id) GROUP BY ALL")
def bucket_catchment(t: Tables) -> DataFrame:
    return bucketed(t)["catchment"]


@query(BUCKETS_SQL + """,
around AS (SELECT DISTINCT p.ad_id, p.date, p.lat, p.lng, CASE WHEN p.utc_timestamp < d.arrival THEN 'before' ELSE 'after' END AS timing FROM pings p JOIN dwell d USING (ad_id, date)
  WHERE abs(date_sub('minute', d.arrival, p.utc_timestamp)) > 0 AND abs(date_sub('minute', d.arrival, p.utc_timestamp)) <= 120),
hit AS (SELECT DISTINCT a.ad_id, a.date, a.timing, o.category FROM around a JOIN pois o ON abs(a.lat - o.plat) < 0.02 AND abs(a.lng - o.plng) < 0.03 AND 111320 * sqrt(pow(a.lat - o.plat, 2) + pow((a.lng - o.plng) * cos(radians((a.lat + o.plat) / 2)), 2)) <= 200)
SELECT bucket, timing, category, count(*) AS device_days, count(*) AS hits FROM hit JOIN bd USING (ad_id, date) GROUP BY ALL""")
def bucket_mobility(t: Tables) -> DataFrame:
    return bucketed(t)["mobility"]


@query(BUCKETS_SQL + "SELECT bucket, date, count(*) AS pings, count(DISTINCT ad_id) AS devices FROM dt JOIN b ON m >= bucket GROUP BY ALL")
def bucket_temporal(t: Tables) -> DataFrame:
    return bucketed(t)["temporal"]


@query(BUCKETS_SQL + "SELECT bucket, count(DISTINCT ad_id) AS total_unique_devices FROM bd GROUP BY 1")
def bucket_total(t: Tables) -> DataFrame:
    return bucketed(t)["total"]


VISITS_SQL = """
closest AS (SELECT * FROM near WHERE distance <= 200 QUALIFY row_number() OVER (PARTITION BY ad_id, utc_timestamp ORDER BY distance, poi_id) = 1),
visits AS (SELECT ad_id, date, poi_id, category, count(*) AS ping_count, round(CAST(date_sub('second', min(utc_timestamp), max(utc_timestamp)) AS DOUBLE) / 60, 1) AS dwell_minutes, CAST(hour(min(utc_timestamp)) AS BIGINT) AS visit_hour FROM closest GROUP BY ALL)
"""


def lab_visits(t: Tables) -> DataFrame:
    v = visits.poi_visits(closest_poi(valid(t), targets(t)))
    return v.select("ad_id", "date", "poi_id", "category", "ping_count", "dwell_minutes", F.col("visit_hour").cast("long").alias("visit_hour"))


@query(VISITS_SQL + "SELECT * FROM visits")
def poi_visits(t: Tables) -> DataFrame:
    return lab_visits(t)


@query("SELECT ad_id, date, n AS ping_count, CAST(seconds AS BIGINT) AS dwell_seconds FROM dwell WHERE n >= 2 AND seconds >= 120")
def qualified_visits(t: Tables) -> DataFrame:
    return visits.qualified_days(at_poi(t)).select("ad_id", "date", "ping_count", F.col("dwell_seconds").cast("long").alias("dwell_seconds"))


@query("SELECT date, count(*) AS pings, count(DISTINCT ad_id) AS devices FROM at_poi WHERE ad_id IN (SELECT ad_id FROM at_poi GROUP BY ad_id HAVING count(DISTINCT date) >= 2) GROUP BY date")
def bot_filtered_daily(t: Tables) -> DataFrame:
    return filters.only_humans(at_poi(t)).groupBy("date").agg(F.count(F.lit(1)).alias("pings"), F.countDistinct("ad_id").alias("devices"))


ROUTINE_SQL = """
per_day AS (SELECT ad_id, date, date_sub('minute', min(utc_timestamp), max(utc_timestamp)) AS dwell, avg(CASE WHEN hour(utc_timestamp) >= 8 AND hour(utc_timestamp) < 20 THEN 1.0::DOUBLE ELSE 0 END) AS work, max(CASE WHEN hour(utc_timestamp) >= 2 AND hour(utc_timestamp) < 5 THEN 1 ELSE 0 END) AS overnight FROM {rows} GROUP BY ALL),
routine AS (SELECT ad_id, count(*) AS days, avg(dwell) AS avg_dwell, round(avg(work), 9) AS work_share, avg(overnight) AS overnight_share FROM per_day GROUP BY ad_id)
"""


@query(ROUTINE_SQL.format(rows="pings WHERE len(poi_ids) > 0") + "SELECT ad_id FROM routine WHERE days >= 15 AND avg_dwell >= 60 AND work_share >= 0.6 AND overnight_share <= 0.3")
def employee_devices(t: Tables) -> DataFrame:
    return filters.employee_ids(valid(t).filter(F.size("poi_ids") > 0), min_dwell=60)


@query(ROUTINE_SQL.format(rows="at_poi") + "SELECT count(*) AS pings, count(DISTINCT ad_id) AS devices FROM at_poi WHERE ad_id NOT IN (SELECT ad_id FROM routine WHERE days >= 15 AND avg_dwell >= 240 AND work_share >= 0.6 AND overnight_share <= 0.3)")
def employee_exclusion(t: Tables) -> DataFrame:
    rows = at_poi(t)
    return filters.without_ids(rows, filters.employee_ids(rows)).agg(F.count(F.lit(1)).alias("pings"), F.countDistinct("ad_id").alias("devices"))


@query(ROUTINE_SQL.format(rows="pings") + "SELECT ad_id FROM routine WHERE days >= 15 AND avg_dwell >= 240 AND overnight_share >= 0.2")
def resident_devices(t: Tables) -> DataFrame:
    return filters.resident_ids(valid(t), overnight_share=0.2)


@query(ROUTINE_SQL.format(rows="pings") + "SELECT count(*) AS pings, count(DISTINCT ad_id) AS devices FROM pings WHERE ad_id NOT IN (SELECT ad_id FROM routine WHERE days >= 15 AND avg_dwell >= 240 AND overnight_share >= 0.2)")
def resident_exclusion(t: Tables) -> DataFrame:
    rows = valid(t)
    return filters.without_ids(rows, filters.resident_ids(rows, overnight_share=0.2)).agg(F.count(F.lit(1)).alias("pings"), F.countDistinct("ad_id").alias("devices"))


@query("SELECT ad_id, utc_timestamp FROM pings WHERE hour(utc_timestamp) >= 22 OR hour(utc_timestamp) <= 6")
def hour_window(t: Tables) -> DataFrame:
    return filters.in_hour_window(valid(t), 22, 6).select("ad_id", "utc_timestamp")


@query("SELECT ad_id, utc_timestamp FROM pings WHERE isodow(utc_timestamp) IN (6, 7)")
def weekend_pings(t: Tables) -> DataFrame:
    return filters.on_days(valid(t), [6, 7]).select("ad_id", "utc_timestamp")


@query("SELECT ad_id, utc_timestamp FROM pings WHERE origin_type = 'gps' AND (circle IS NULL OR circle <= 1)")
def gps_and_circle(t: Tables) -> DataFrame:
    return filters.max_circle(filters.gps_only(valid(t)), 1.0).select("ad_id", "utc_timestamp")


@query("SELECT DISTINCT ad_id FROM at_poi GROUP BY ad_id HAVING count(DISTINCT date) >= 10")
def frequent_visitors(t: Tables) -> DataFrame:
    return filters.min_visit_days(at_poi(t), 10).select("ad_id").distinct()


@query("SELECT ad_id, utc_timestamp, CAST(timezone('America/Mexico_City', timezone('UTC', utc_timestamp)) AS TIMESTAMP) AS local_timestamp FROM pings")
def local_times(t: Tables) -> DataFrame:
    return valid(t).select("ad_id", "utc_timestamp", local_time(F.col("utc_timestamp"), "America/Mexico_City").alias("local_timestamp"))


@query(ROUTINE_SQL.format(rows="fp") .replace("\nper_day", "\nfp AS (SELECT * FROM at_poi WHERE (ad_id, utc_timestamp) IN (SELECT (ad_id, utc_timestamp) FROM pings WHERE origin_type = 'gps' AND hour(utc_timestamp) BETWEEN 9 AND 17 AND isodow(utc_timestamp) <= 5)),\nper_day") + """
SELECT count(*) AS pings, count(DISTINCT ad_id) AS devices FROM fp WHERE ad_id NOT IN (SELECT ad_id FROM routine WHERE days >= 15 AND avg_dwell >= 240 AND work_share >= 0.6 AND overnight_share <= 0.3)
  AND ad_id IN (SELECT ad_id FROM fp GROUP BY ad_id HAVING count(DISTINCT date) >= 3)""")
def visitor_filter(t: Tables) -> DataFrame:
    f = filters.VisitorFilter(hours=(9, 17), days=(1, 2, 3, 4, 5), gps=True, employees=True, min_visits=3)
    rows = f.visitors(at_poi_pings(f.pings(valid(t)), targets(t)))
    return rows.agg(F.count(F.lit(1)).alias("pings"), F.countDistinct("ad_id").alias("devices"))


@query("""RECURSIVE pos AS (SELECT id, plat, plng, row_number() OVER (ORDER BY id) AS n FROM pois),
pairs AS (SELECT a.n AS a, b.n AS b FROM pos a JOIN pos b ON a.n < b.n AND abs(a.plat - b.plat) < 0.02 AND abs(a.plng - b.plng) < 0.02
  WHERE 2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(b.plat - a.plat) / 2), 2) + cos(radians(a.plat)) * cos(radians(b.plat)) * pow(sin(radians(b.plng - a.plng) / 2), 2)))) <= 1800),
taken AS (SELECT 1::BIGINT AS n, CAST([1] AS BIGINT[]) AS kept UNION ALL
  SELECT n + 1, CASE WHEN EXISTS (SELECT 1 FROM pairs WHERE b = n + 1 AND list_contains(kept, a)) THEN kept ELSE list_append(kept, n + 1) END FROM taken WHERE n < (SELECT count(*) FROM pos))
SELECT id FROM pos WHERE n IN (SELECT unnest(kept) FROM taken WHERE n = (SELECT count(*) FROM pos))
""")
def distinct_places(t: Tables) -> DataFrame:
    """Greedy removal of places within a cell's reach, in the order of their ids; longitudes are compared as numbers, also beyond 180."""
    return poi_sets.greedy_distinct(t.pois.select("id", "latitude", "longitude", F.col("id").alias("position")), radius_m=1800.0, globe=False)


@query("""
own AS (SELECT id, category, plat, plng, CASE WHEN CAST(substr(id, 5) AS BIGINT) % 500 = 0 THEN 10000 WHEN CAST(substr(id, 5) AS BIGINT) % 3 = 0 THEN 150 ELSE 450 END AS r FROM pois)
SELECT o.id AS poi_id, count(*) AS pings, count(DISTINCT ad_id) AS devices FROM pings p JOIN own o ON abs(p.lat - o.plat) < 0.1 AND abs(p.lng - o.plng) < 0.1 AND 111320 * sqrt(pow(p.lat - o.plat, 2) + pow((p.lng - o.plng) * cos(radians((p.lat + o.plat) / 2)), 2)) <= r GROUP BY 1""")
def mixed_radius_join(t: Tables) -> DataFrame:
    """Places of 150, 450 and 10000 m."""
    k = F.substring("poi_id", 5, 20).cast("long")
    own = targets(t).withColumn("poi_radius_m", F.when(k % 500 == 0, 10000.0).when(k % 3 == 0, 150.0).otherwise(450.0))
    return spatial_join(valid(t), own).groupBy("poi_id").agg(F.count(F.lit(1)).alias("pings"), F.countDistinct("ad_id").alias("devices"))


@query("""
north AS (SELECT ad_id, utc_timestamp, lat + 50 AS lat, lng FROM pings), fjords AS (SELECT id, plat + 50 AS plat, plng FROM pois)
SELECT ad_id, utc_timestamp, id AS poi_id FROM north JOIN fjords ON abs(lat - plat) < 0.02 AND abs(lng - plng) < 0.06 AND 111320 * sqrt(pow(lat - plat, 2) + pow((lng - plng) * cos(radians((lat + plat) / 2)), 2)) <= 900""")
def northern_join(t: Tables) -> DataFrame:
    """The same pings and places fifty degrees further north, where cells are narrow."""
    north = valid(t).withColumn("lat", F.col("lat") + 50)
    return spatial_join(north, targets(t).withColumn("poi_lat", F.col("poi_lat") + 50), radius_m=900.0).select("ad_id", "utc_timestamp", "poi_id")


@query("SELECT category, count(*) AS pings, count(DISTINCT ad_id) AS devices FROM near WHERE distance <= 400 GROUP BY category")
def wide_radius_join(t: Tables) -> DataFrame:
    return spatial_join(valid(t), targets(t), radius_m=400.0).groupBy("category").agg(F.count(F.lit(1)).alias("pings"), F.countDistinct("ad_id").alias("devices"))
