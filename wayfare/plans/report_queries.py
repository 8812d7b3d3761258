"""Queries for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import materialize
from ..functions.geo import as_targets
from ..functions.numbers import medians
from ..operators import homes, reports, visits
from ..sources.fixtures import Tables
from .homes_queries import HOMES_SQL
from .registry import query
from .visits_queries import at_poi, valid

ENDS_SQL = """
ends AS (SELECT ad_id, date, arg_min(lat, utc_timestamp) AS olat, arg_min(lng, utc_timestamp) AS olng, min(utc_timestamp) AS seen, arg_max(lat, utc_timestamp) AS dlat, arg_max(lng, utc_timestamp) AS dlng FROM pings GROUP BY ALL),
flows AS (SELECT round(olat, 4) AS origin_lat, round(olng, 4) AS origin_lng, round(dlat, 4) AS dest_lat, round(dlng, 4) AS dest_lng, CAST(hour(seen) AS BIGINT) AS departure_hour, CAST({arrival} AS BIGINT) AS poi_arrival_hour, count(*) AS device_days
  FROM ends JOIN dwell USING (ad_id, date) GROUP BY ALL)
"""
FLOWS_SQL = ENDS_SQL.format(arrival="hour(arrival)")
CATCHMENT_SQL = ENDS_SQL.split("flows AS")[0] + "catchment AS (SELECT round(olat, 4) AS origin_lat, round(olng, 4) AS origin_lng, CAST(hour(seen) AS BIGINT) AS departure_hour, count(*) AS device_days FROM ends JOIN dwell USING (ad_id, date) GROUP BY ALL)\n"
MOBILITY_SQL = """
around AS (SELECT DISTINCT p.ad_id, p.date, p.lat, p.lng, CASE WHEN p.utc_timestamp < d.arrival THEN 'before' ELSE 'after' END AS timing FROM pings p JOIN dwell d USING (ad_id, date)
  WHERE abs(date_sub('minute', d.arrival, p.utc_timestamp)) > 0 AND abs(date_sub('minute', d.arrival, p.utc_timestamp)) <= 120),
hit AS (SELECT DISTINCT a.ad_id, a.date, a.timing, o.category FROM around a JOIN pois o ON abs(a.lat - o.plat) < 0.02 AND abs(a.lng - o.plng) < 0.03 AND 111320 * sqrt(pow(a.lat - o.plat, 2) + pow((a.lng - o.plng) * cos(radians((a.lat + o.plat) / 2)), 2)) <= 200),
mobility AS (SELECT timing, category, count(*) AS device_days, count(*) AS hits FROM hit GROUP BY ALL)
"""


def flows(t: Tables) -> DataFrame:
    return reports.origin_destination(valid(t), at_poi(t))


def catalogue(t: Tables) -> DataFrame:
    return as_targets(t.pois, "category")


def mob(t: Tables) -> DataFrame:
    return reports.mobility(valid(t), reports.visit_times(at_poi(t)), catalogue(t))


@query(FLOWS_SQL + "SELECT * FROM flows")
def od_matrix(t: Tables) -> DataFrame:
    return flows(t)


@query(ENDS_SQL.format(arrival="CASE WHEN arrival = seen THEN -1 ELSE hour(arrival) END") + "SELECT * FROM flows")
def od_start_marked(t: Tables) -> DataFrame:
    return reports.origin_destination(valid(t), at_poi(t), mark_starts=True)


@query("SELECT CAST(hour(utc_timestamp) AS BIGINT) AS touch_hour, count(*) AS pings, count(DISTINCT ad_id) AS devices FROM at_poi GROUP BY 1")
def poi_hourly(t: Tables) -> DataFrame:
    return reports.hourly(at_poi(t))


@query("SELECT CAST(isodow(utc_timestamp) AS BIGINT) AS dow, CAST(hour(utc_timestamp) AS BIGINT) AS hour, count(*) AS pings, count(DISTINCT ad_id) AS devices FROM at_poi GROUP BY 1, 2")
def poi_dayhour(t: Tables) -> DataFrame:
    return reports.day_hour(at_poi(t))


@query("SELECT date, count(*) AS pings, count(DISTINCT ad_id) AS devices FROM at_poi GROUP BY 1")
def daily_activity(t: Tables) -> DataFrame:
    return reports.daily(at_poi(t))


@query("SELECT count(DISTINCT ad_id) AS total_unique_devices FROM at_poi")
def total_devices(t: Tables) -> DataFrame:
    return reports.total_devices(at_poi(t))


@query("SELECT DISTINCT ad_id FROM at_poi")
def maid_list(t: Tables) -> DataFrame:
    return at_poi(t).select("ad_id").distinct().orderBy("ad_id")


@query(CATCHMENT_SQL + "SELECT * FROM catchment")
def catchment_first_ping(t: Tables) -> DataFrame:
    return reports.catchment_first_ping(valid(t), at_poi(t))


@query(HOMES_SQL + "SELECT round(home_lat, 4) AS origin_lat, round(home_lng, 4) AS origin_lng, CAST(0 AS BIGINT) AS departure_hour, min(home_zip) AS native_zip, count(*) AS device_days FROM homes WHERE ad_id IN (SELECT ad_id FROM at_poi) GROUP BY 1, 2")
def catchment_home(t: Tables) -> DataFrame:
    return reports.catchment_home(homes.detect(valid(t, max_accuracy=1000.0)), at_poi(t))


@query(HOMES_SQL + """, both_homes AS (SELECT * FROM homes UNION ALL SELECT ad_id, cell, home_lat + 1, home_lng, home_zip, home_city, home_region, n_nights + CASE WHEN n_nights % 2 = 0 THEN 1 ELSE 0 END, home_confidence FROM homes)
SELECT ad_id, round(home_lat, 6) AS home_lat, n_nights FROM both_homes QUALIFY row_number() OVER (PARTITION BY ad_id ORDER BY n_nights DESC, home_lat, home_lng) = 1""")
def home_over_datasets(t: Tables) -> DataFrame:
    h = homes.detect(valid(t, max_accuracy=1000.0))
    other = h.withColumns({"home_lat": F.col("home_lat") + 1, "n_nights": F.col("n_nights") + F.when(F.col("n_nights") % 2 == 0, 1).otherwise(0)})
    return reports.best_home(h.unionByName(other)).select("ad_id", F.round("home_lat", 6).alias("home_lat"), "n_nights")


@query(MOBILITY_SQL + "SELECT * FROM mobility")
def mobility_2h(t: Tables) -> DataFrame:
    return mob(t)


@query(MOBILITY_SQL.replace("FROM pings p JOIN dwell d", "FROM pings p JOIN marked d").replace("\naround", """
marked AS (SELECT ad_id, date, make_timestamp(quantile_disc(epoch_us(utc_timestamp) // 1000000, 0.5) * 1000000) AS arrival FROM pings WHERE len(poi_ids) > 0 GROUP BY ALL),
around""") + "SELECT * FROM mobility")
def mobility_median(t: Tables) -> DataFrame:
    """Visit time by the middle ping; so few pings a day have an exact one."""
    marked = valid(t).filter(F.size("poi_ids") > 0)
    return reports.mobility(valid(t), reports.median_visit_times(marked), catalogue(t))


@query("SELECT ad_id, round(arg_min(lat, utc_timestamp), 1) AS origin_lat, round(arg_min(lng, utc_timestamp), 1) AS origin_lng FROM pings WHERE ad_id IN (SELECT ad_id FROM at_poi) GROUP BY ad_id")
def nse_origins(t: Tables) -> DataFrame:
    return reports.nse_origins(valid(t), at_poi(t))


@query("SELECT ad_id, round(arg_min(lat, utc_timestamp), 4) AS origin_lat, round(arg_min(lng, utc_timestamp), 4) AS origin_lng FROM pings WHERE (ad_id, date) IN (SELECT (ad_id, date) FROM at_poi) GROUP BY ad_id")
def nse_origins_visit_days(t: Tables) -> DataFrame:
    return reports.nse_origins(valid(t), at_poi(t), decimals=4, visit_days_only=True)


AFFINITY_INPUT_SQL = HOMES_SQL + """,
affinity_in AS (SELECT round(home_lat, 4) AS origin_lat, round(home_lng, 4) AS origin_lng, count(*) AS total_visits, count(DISTINCT ad_id) AS unique_devices, round(avg(round(seconds / 60.0::DOUBLE, 1)) + 1e-9::DOUBLE, 3) AS avg_dwell, round(CAST(count(*) AS DOUBLE) / count(DISTINCT ad_id), 6) AS avg_frequency
  FROM dwell JOIN homes USING (ad_id) GROUP BY 1, 2)
"""


def affinity_rows(t: Tables) -> DataFrame:
    return reports.affinity_input(homes.detect(valid(t, max_accuracy=1000.0)), visits.device_day_dwell(at_poi(t)))


@query(AFFINITY_INPUT_SQL + "SELECT * FROM affinity_in")
def affinity_input(t: Tables) -> DataFrame:
    return affinity_rows(t)


@query("SELECT poi_id, count(*) AS visits, count(DISTINCT ad_id) AS devices FROM (SELECT DISTINCT ad_id, date, unnest(poi_ids) AS poi_id FROM pings) GROUP BY 1")
def visits_by_poi(t: Tables) -> DataFrame:
    return reports.visits_by_poi(valid(t))


@query("SELECT poi_id, count(*) AS visits, count(DISTINCT ad_id) AS devices FROM (SELECT DISTINCT ad_id, date, unnest(poi_ids) AS poi_id FROM pings WHERE (ad_id, date) IN (SELECT (ad_id, date) FROM dwell WHERE n >= 2 AND seconds >= 120)) GROUP BY 1")
def visits_by_poi_qualified(t: Tables) -> DataFrame:
    return reports.visits_by_poi(valid(t), visits.qualified_days(at_poi(t)))


@query("SELECT (SELECT count(*) FROM pings) AS pings, (SELECT count(DISTINCT ad_id) FROM pings) AS devices, (SELECT count(DISTINCT date) FROM pings) AS days, (SELECT count(DISTINCT p) FROM (SELECT unnest(poi_ids) AS p FROM pings)) AS pois")
def dataset_summary(t: Tables) -> DataFrame:
    return reports.summary(valid(t))


@query("SELECT strftime(d, '%Y-%m-%d') AS date, coalesce(pings, 0) AS pings, coalesce(devices, 0) AS devices FROM (SELECT unnest(generate_series(DATE '2023-12-20', DATE '2024-02-10', INTERVAL 1 DAY)) AS d) s LEFT JOIN (SELECT date, count(*) AS pings, count(DISTINCT ad_id) AS devices FROM pings GROUP BY 1) x ON x.date = strftime(d, '%Y-%m-%d')")
def daily_zero_filled(t: Tables) -> DataFrame:
    return reports.daily_filled(valid(t), "2023-12-20", "2024-02-10")


DAILY_SQL = "days AS (SELECT date, count(*) AS pings, count(DISTINCT ad_id) AS devices FROM pings GROUP BY 1)\n"


@query(DAILY_SQL + "SELECT strftime(date_trunc('week', CAST(date AS DATE)), '%Y-%m-%d') AS week_start, CAST(sum(pings) AS BIGINT) AS pings, CAST(sum(devices) AS BIGINT) AS devices FROM days GROUP BY 1")
def weekly_rollup(t: Tables) -> DataFrame:
    return reports.weekly(reports.daily(valid(t)))


@query(DAILY_SQL + "SELECT date[1:7] AS month, CAST(sum(pings) AS BIGINT) AS pings, CAST(sum(devices) AS BIGINT) AS devices FROM days GROUP BY 1")
def monthly_rollup(t: Tables) -> DataFrame:
    return reports.monthly(reports.daily(valid(t)))


@query(DAILY_SQL + "SELECT CAST(d AS BIGINT) AS day, CAST(coalesce(floor(avg(pings) + 0.5), 0) AS BIGINT) AS avg_pings, CAST(coalesce(floor(avg(devices) + 0.5), 0) AS BIGINT) AS avg_devices FROM (SELECT unnest(range(7)) AS d) LEFT JOIN days ON dayofweek(CAST(date AS DATE)) = d GROUP BY d")
def weekday_means(t: Tables) -> DataFrame:
    return reports.by_weekday(reports.daily(valid(t)))


ZIP_OF = "LEFT JOIN geocode g ON g.lat_key = CAST(round({lat} * 10) AS INTEGER) AND g.lng_key = CAST(round({lng} * 10) AS INTEGER)"


@query(FLOWS_SQL + f"""SELECT 'origin' AS side, coalesce(zipcode, 'UNKNOWN') AS zip, CAST(sum(device_days) AS BIGINT) AS device_days FROM flows {ZIP_OF.format(lat='origin_lat', lng='origin_lng')} GROUP BY 2
UNION ALL SELECT 'destination', coalesce(zipcode, 'UNKNOWN'), CAST(sum(device_days) AS BIGINT) FROM flows {ZIP_OF.format(lat='dest_lat', lng='dest_lng')} GROUP BY 2""")
def od_by_zip(t: Tables) -> DataFrame:
    return reports.od_by_zip(flows(t), t.geocode)


@query(FLOWS_SQL + """SELECT h AS hour, CAST(coalesce((SELECT sum(device_days) FROM flows WHERE departure_hour = h), 0) AS BIGINT) AS departures, CAST(coalesce((SELECT sum(device_days) FROM flows WHERE poi_arrival_hour = h), 0) AS BIGINT) AS arrivals FROM (SELECT unnest(range(24)) AS h)""")
def od_hours(t: Tables) -> DataFrame:
    return reports.od_hours(flows(t))


@query("SELECT h AS touch_hour, coalesce(pings, 0) AS pings, coalesce(devices, 0) AS devices FROM (SELECT unnest(range(24)) AS h) LEFT JOIN (SELECT hour(utc_timestamp) AS th, count(*) AS pings, count(DISTINCT ad_id) AS devices FROM at_poi GROUP BY 1) ON th = h")
def hourly_zero_filled(t: Tables) -> DataFrame:
    return reports.hours_filled(reports.hourly(at_poi(t)))


RINGS_SQL = """
zips AS (SELECT zip, count(*) AS device_days FROM (SELECT ad_id, date, arg_min(zip, utc_timestamp) AS zip FROM pings GROUP BY ALL) SEMI JOIN dwell USING (ad_id, date) GROUP BY 1),
ranked AS (SELECT *, coalesce(sum(device_days) OVER (ORDER BY device_days DESC, zip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(device_days) OVER () AS total FROM zips),
rings AS (SELECT zip, device_days, floor(CAST(device_days AS DOUBLE) / total * 10000 + 0.5) / 100 AS share_percentage, CAST(CASE WHEN (b + device_days) / total <= 0.7 OR b < total * 0.7 THEN 70 WHEN (b + device_days) / total <= 0.8 OR b < total * 0.8 THEN 80 WHEN (b + device_days) / total <= 0.9 OR b < total * 0.9 THEN 90 END AS BIGINT) AS capture_ring FROM ranked)
"""


def zip_days(t: Tables) -> DataFrame:
    first = valid(t).groupBy("ad_id", "date").agg(reports.first_by(F.col("zip")).alias("zip"))
    return first.join(visits.device_day_dwell(at_poi(t)), ["ad_id", "date"], "left_semi").groupBy("zip").agg(F.count(F.lit(1)).alias("device_days"))


@query(RINGS_SQL + "SELECT * FROM rings")
def capture_rings(t: Tables) -> DataFrame:
    return reports.capture_rings(zip_days(t))


@query(RINGS_SQL + "SELECT CAST(r AS BIGINT) AS ring, count(*) AS zips, CAST(sum(device_days) AS BIGINT) AS device_days FROM rings JOIN (SELECT unnest([70, 80, 90]) AS r) ON capture_ring <= r GROUP BY r")
def capture_ring_totals(t: Tables) -> DataFrame:
    return reports.ring_totals(reports.capture_rings(zip_days(t)))


@query(MOBILITY_SQL + """, every AS (SELECT * FROM mobility UNION ALL SELECT 'both', category, CAST(sum(device_days) AS BIGINT), CAST(sum(hits) AS BIGINT) FROM mobility GROUP BY 2)
SELECT timing, row_number() OVER (PARTITION BY timing ORDER BY device_days DESC, category) AS rank, category, device_days, hits FROM every QUALIFY rank <= CASE WHEN timing = 'both' THEN 50 ELSE 25 END""")
def mobility_top(t: Tables) -> DataFrame:
    return reports.mobility_top(mob(t))


@query(AFFINITY_INPUT_SQL + f""", z AS (SELECT coalesce(zipcode, 'UNKNOWN') AS zip, sum(total_visits) AS v, sum(unique_devices) AS u, sum(avg_dwell * total_visits) / sum(total_visits) AS d, sum(avg_frequency * total_visits) / sum(total_visits) AS f FROM affinity_in {ZIP_OF.format(lat='origin_lat', lng='origin_lng')} GROUP BY 1)
SELECT zip, CAST(v AS BIGINT) AS total_visits, CAST(u AS BIGINT) AS unique_devices, floor(d * 10 + 0.5) / 10 AS avg_dwell, floor(f * 100 + 0.5) / 100 AS avg_frequency,
CAST(floor(0.4::DOUBLE * (CAST(v AS DOUBLE) / greatest(max(v) OVER (), 1) * 100) + 0.3::DOUBLE * (least(d / 60, 1) * 100) + 0.3::DOUBLE * (least(log2(greatest(f, 1)) / log2(10), 1) * 100) + 0.5) AS BIGINT) AS affinity_index FROM z""")
def affinity_v1(t: Tables) -> DataFrame:
    return reports.affinity_v1(reports.with_zip(affinity_rows(t), t.geocode))


@query("SELECT DISTINCT zip, lpad(zip, 5, '0') AS postal FROM pings")
def postal_normalised(t: Tables) -> DataFrame:
    return valid(t).select("zip").distinct().select("zip", reports.normal_postal(F.concat(F.lit(" mx-"), F.regexp_replace("zip", "^0+", ""), F.lit(" ")), "MX").alias("postal"))


@query("""
z AS (SELECT zip, count(*) AS devices FROM (SELECT ad_id, arg_min(zip, utc_timestamp) AS zip FROM pings GROUP BY 1) GROUP BY 1)
SELECT zip, devices, floor(devices / CAST((SELECT count(DISTINCT ad_id) FROM raw_pings) AS DOUBLE) * 10000 + 0.5) / 100 AS percent_of_total, floor(devices / CAST(sum(devices) OVER () AS DOUBLE) * 10000 + 0.5) / 100 AS percent_of_classified FROM z""")
def zip_shares(t: Tables) -> DataFrame:
    return reports.zip_shares(valid(t).groupBy("ad_id").agg(reports.first_by(F.col("zip")).alias("zip")), t.pings.agg(F.countDistinct("ad_id")).first()[0])


@query("SELECT ad_id, date, utc_timestamp, lat, lng FROM pings WHERE ad_id IN (SELECT ad_id FROM pings GROUP BY ad_id ORDER BY md5(ad_id), ad_id LIMIT 50) QUALIFY row_number() OVER (PARTITION BY ad_id ORDER BY utc_timestamp, lat, lng) <= 2000")
def movements_sample(t: Tables) -> DataFrame:
    return reports.movements_sample(valid(t), devices=50, per_device=2000)


@query("""
c AS (SELECT CAST(isodow(utc_timestamp) AS BIGINT) AS dow, CAST(hour(utc_timestamp) AS BIGINT) AS hour, count(*) AS pings, count(DISTINCT ad_id) AS devices FROM at_poi GROUP BY 1, 2)
SELECT *, round(0.5::DOUBLE * ((pings - min(pings) OVER ()) / CAST(max(pings) OVER () - min(pings) OVER () AS DOUBLE)) + 0.5::DOUBLE * ((rank() OVER (ORDER BY pings) - 1) / CAST(count(*) OVER () - 1 AS DOUBLE)), 6) AS intensity FROM c""")
def heatmap_contrast(t: Tables) -> DataFrame:
    return reports.heat_contrast(reports.day_hour(at_poi(t)))


@query(MOBILITY_SQL + """, h AS (SELECT CAST(hour(utc_timestamp) AS BIGINT) AS touch_hour, count(*) AS pings FROM at_poi GROUP BY 1)
SELECT (SELECT touch_hour FROM h ORDER BY pings DESC, touch_hour LIMIT 1) AS peak_hour, (SELECT round(max(pings) / CAST(sum(pings) AS DOUBLE), 6) FROM h) AS peak_share, (SELECT category FROM mobility GROUP BY 1 ORDER BY sum(device_days) DESC, category DESC LIMIT 1) AS top_category""")
def headline_metrics(t: Tables) -> DataFrame:
    return reports.headline(reports.hourly(at_poi(t)), mob(t))


@query("SELECT poi_id, count(*) AS pings, count(DISTINCT ad_id) AS devices FROM (SELECT ad_id, unnest(poi_ids) AS poi_id FROM pings) GROUP BY 1")
def poi_usage(t: Tables) -> DataFrame:
    return reports.poi_usage(valid(t))


@query(RINGS_SQL + """SELECT 'p' || zip AS polygon_id, zip, 'MX' AS country, capture_ring, device_days FROM rings""")
def catchment_polygons(t: Tables) -> DataFrame:
    rings = reports.capture_rings(zip_days(t)).withColumn("country", F.lit("MX"))
    shapes = rings.select(F.concat(F.lit("p"), "zip").alias("polygon_id"), "zip", "country")
    return reports.catchment_polygons(rings, shapes)


PCT = "CASE WHEN {x} >= 10 THEN CAST(CAST(floor({x} + 0.5) AS BIGINT) AS VARCHAR) || '%' ELSE printf('%.1f%%', {x}) END"


def _summary_sql() -> str:
    hour = "CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END || CASE WHEN h < 12 THEN 'AM' ELSE 'PM' END || ' (local time)'"
    return f"""
n AS (SELECT count(DISTINCT ad_id) AS devices, count(DISTINCT ad_id || date) AS days, min(date) AS a, max(date) AS b, count(*) AS pings, count(*) FILTER (isodow(utc_timestamp) >= 6) * 100.0::DOUBLE / count(*) AS weekend FROM at_poi),
hours AS (SELECT CAST(hour(utc_timestamp) AS BIGINT) AS h, count(*) * 100.0::DOUBLE / (SELECT pings FROM n) AS share FROM at_poi GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
dows AS (SELECT isodow(utc_timestamp) AS d, count(*) * 100.0::DOUBLE / (SELECT pings FROM n) AS share FROM at_poi GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
stay AS (SELECT avg(round(seconds / 60, 1)) AS dwell FROM dwell), often AS (SELECT count(*) FILTER (k >= 3) * 100.0::DOUBLE / count(*) AS share, quantile_cont(k::DOUBLE, 0.5) AS mid FROM (SELECT ad_id, count(*) AS k FROM dwell GROUP BY 1)),
{MOBILITY_SQL.strip()},
tops AS (SELECT category, sum(hits) * 100.0::DOUBLE / (SELECT sum(hits) FROM mobility) AS share FROM mobility GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1)
SELECT 0 AS position, 'Places: ' || format('{{:,}}', devices) || ' unique devices.' AS sentence FROM n
UNION ALL SELECT 1, '**Scale**: ' || format('{{:,}}', devices) || ' unique devices across ' || format('{{:,}}', days) || ' device-days to ' || format('{{:,}}', (SELECT count(*) FROM pois)) || ' POIs (' || a || ' to ' || b || ').' FROM n
UNION ALL SELECT 2, '**Timing**: peaks at ' || {hour} || ' (' || {PCT.format(x='hours.share')} || ' of daily traffic); busiest day is ' || ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][d] || ' (' || {PCT.format(x='dows.share')} || ' of weekly traffic); ' || {PCT.format(x='weekend')} || ' of visits fall on weekends.' FROM n, hours, dows
UNION ALL SELECT 3, '**Engagement**: average dwell ' || CAST(floor(dwell + 0.5) AS BIGINT) || ' min, median repeat frequency of ' || printf('%.1f', mid) || ' visits per device, ' || {PCT.format(x='share')} || ' of devices return 3+ times.' FROM stay, often
UNION ALL SELECT 4, '**Adjacent behavior**: the top destination category within ±2h of the POIs is *' || category || '* (' || {PCT.format(x='share')} || ' of mobility traffic).' FROM tops"""


@query(_summary_sql())
def executive_summary(t: Tables) -> DataFrame:
    """Sentences made on the driver from a few numbers."""
    rows = materialize(at_poi(t), "at_poi")  # met once, as each number is a job of its own
    n = rows.agg(F.count(F.lit(1)).alias("pings"), F.countDistinct("ad_id").alias("devices"), F.countDistinct("ad_id", "date").alias("days"), F.min("date").alias("a"), F.max("date").alias("b"), F.count_if(F.weekday("utc_timestamp") >= 5).alias("weekend")).first()
    share = lambda x: 100 * x / n["pings"]
    top = lambda df, *order: df.orderBy(*order).first()
    grid = reports.day_hour(rows)
    h = top(grid.groupBy("hour").agg(F.sum("pings").alias("n")), F.desc("n"), "hour")
    d = top(grid.groupBy("dow").agg(F.sum("pings").alias("n")), F.desc("n"), "dow")
    days = visits.device_day_dwell(rows)
    per = days.groupBy("ad_id").agg(F.count(F.lit(1)).alias("k"))
    often = per.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") >= 3).alias("again")).first()
    near = materialize(reports.mobility(valid(t), reports.visit_times(rows), catalogue(t)).groupBy("category").agg(F.sum("hits").alias("n")), "near")
    c = top(near, F.desc("n"), F.desc("category"))
    summary = reports.executive_summary(
        reports.SummaryInput(
            subject="Places", devices=n["devices"], device_days=n["days"], pois=t.pois.count(), first=n["a"], last=n["b"], peak_hour=(h["hour"], share(h["n"])), peak_day=(d["dow"], share(d["n"])), weekend_share=share(n["weekend"]),
            avg_dwell=days.agg(F.avg("dwell_minutes")).first()[0], median_frequency=medians(per, ["k"]).first()["k"], repeat_share=100 * often["again"] / often["n"], top_category=(c["category"], 100 * c["n"] / near.agg(F.sum("n")).first()[0]),
        )
    )
    return t.spark.createDataFrame(list(enumerate([summary["headline"], *summary["bullets"]])), "position int, sentence string")
