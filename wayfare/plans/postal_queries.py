"""Queries for postal codes, comparison, exports and master lists."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import as_targets
from ..operators import compare, filters, homes, poi_sets, postal, reports, visits
from ..operators.audiences import with_all_categories
from ..sources.fixtures import Tables
from ..sources.readers import union_datasets
from .audience_queries import CATEGORY_SQL, cafe_gym
from .homes_queries import MEDIAN_SQL, STARTS_SQL
from .registry import query
from .visits_queries import at_poi, valid

ZIPS = [f"1{a}{b}00" for a in range(4) for b in range(10)] + [f"2{a}{b}00" for a in range(3) for b in range(10)]
ZIP_LIST = ", ".join(f"'{z}'" for z in ZIPS)
DEVICES_SQL = f"""
zday AS (SELECT ad_id, date, arg_min(zip, utc_timestamp) AS zip, arg_min(region, utc_timestamp) AS region, arg_min(city, utc_timestamp) AS city, arg_min(h3, utc_timestamp) AS h3, arg_min(lat, utc_timestamp) AS lat, arg_min(lng, utc_timestamp) AS lng, min(utc_timestamp) AS seen,
  max(CASE WHEN hour(utc_timestamp) >= 22 OR hour(utc_timestamp) <= 6 THEN 1 ELSE 0 END) AS overnight, avg(CASE WHEN origin_type = 'gps' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS gps, avg(circle) AS circle FROM pings WHERE ad_id IN (SELECT ad_id FROM at_poi) GROUP BY ALL),
zdev AS (SELECT ad_id, zip, min(region) AS region, min(city) AS city, count(*) AS device_days, max(overnight) AS has_overnight, avg(gps) AS avg_gps, avg(circle) AS avg_circle, avg(lat) AS avg_lat, avg(lng) AS avg_lng,
  count(*) FILTER (hour(seen) BETWEEN 5 AND 10) AS morning_dd, count(*) FILTER (hour(seen) BETWEEN 11 AND 13) AS midday_dd, count(*) FILTER (hour(seen) BETWEEN 14 AND 17) AS afternoon_dd, count(*) FILTER (hour(seen) BETWEEN 18 AND 21) AS evening_dd,
  count(*) FILTER (hour(seen) >= 22 OR hour(seen) <= 4) AS night_dd, count(*) FILTER (isodow(seen) >= 6) AS weekend_dd FROM zday WHERE zip IN ({ZIP_LIST}) GROUP BY ad_id, zip)
"""


def zip_devices_of(t: Tables) -> DataFrame:
    return postal.zip_devices(valid(t), at_poi(t), ZIPS)


@query(DEVICES_SQL + "SELECT ad_id, zip, region, city, device_days, CAST(has_overnight AS INTEGER) AS has_overnight, round(avg_gps, 6) AS avg_gps, round(avg_circle, 6) AS avg_circle, round(avg_lat, 6) AS avg_lat, round(avg_lng, 6) AS avg_lng, morning_dd, midday_dd, afternoon_dd, evening_dd, night_dd, weekend_dd FROM zdev")
def zcs_devices(t: Tables) -> DataFrame:
    return zip_devices_of(t).withColumns({c: F.round(c, 6) for c in ("avg_gps", "avg_circle", "avg_lat", "avg_lng")})


H3_SQL = f"""
hday AS (SELECT ad_id, date, arg_min(zip, utc_timestamp) AS zip, arg_min(h3, utc_timestamp) AS h3, arg_min(lat, utc_timestamp) AS lat, arg_min(lng, utc_timestamp) AS lng FROM pings WHERE ad_id IN (SELECT ad_id FROM at_poi) AND zip IN ({ZIP_LIST}) GROUP BY ALL),
cells AS (SELECT zip, h3, count(DISTINCT ad_id) AS devices, count(*) AS pings, avg(lat) AS lat, avg(lng) AS lng FROM hday GROUP BY 1, 2 HAVING count(*) >= 2)
"""


@query(H3_SQL + "SELECT zip, h3, devices, pings, round(lat, 6) AS lat, round(lng, 6) AS lng FROM cells")
def h3_hotspots(t: Tables) -> DataFrame:
    return postal.hot_cells(valid(t), at_poi(t), ZIPS).withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


@query(H3_SQL + "SELECT zip, string_agg(h3, ',' ORDER BY rn) AS top_h3 FROM (SELECT zip, h3, row_number() OVER (PARTITION BY zip ORDER BY devices DESC, h3) AS rn FROM cells) WHERE rn <= 5 GROUP BY 1")
def zip_top_cells(t: Tables) -> DataFrame:
    return postal.top_named(postal.hot_cells(valid(t), at_poi(t), ZIPS), "h3", 5, value="devices")


BASIC_SQL = """
bday AS (SELECT ad_id, date, arg_min(lat, utc_timestamp) AS lat, arg_min(lng, utc_timestamp) AS lng FROM pings WHERE ad_id IN (SELECT ad_id FROM at_poi) GROUP BY ALL),
basic AS (SELECT ad_id, zipcode, count(*) AS device_days FROM bday JOIN geocode ON lat_key = CAST(round(lat * 10) AS INTEGER) AND lng_key = CAST(round(lng * 10) AS INTEGER) WHERE zipcode IN ('90001', '90002', '90003') GROUP BY 1, 2)
"""
BASIC = ["90001", "90002", "90003"]


@query(BASIC_SQL + "SELECT * FROM basic")
def basic_origins(t: Tables) -> DataFrame:
    return postal.geocoded_origins(valid(t), at_poi(t), t.geocode, BASIC)


@query(BASIC_SQL + "SELECT z AS postal_code, (SELECT count(DISTINCT ad_id) FROM basic WHERE zipcode = z) AS devices, CAST(coalesce((SELECT sum(device_days) FROM basic WHERE zipcode = z), 0) AS BIGINT) AS device_days FROM (SELECT unnest(['90001', '90002', '90003', '99999']) AS z)")
def basic_zip_counts(t: Tables) -> DataFrame:
    return postal.zips_filled(postal.geocoded_origins(valid(t), at_poi(t), t.geocode, BASIC), [*BASIC, "99999"])


ROLL_SQL = DEVICES_SQL + """,
dev AS (SELECT ad_id, CAST(sum(device_days) AS BIGINT) AS device_days, string_agg(DISTINCT zip, ',' ORDER BY zip) AS postal_codes, sum(coalesce(avg_gps, 0) * device_days) / sum(device_days) AS g, sum(coalesce(avg_circle, 0) * device_days) / sum(device_days) AS c, max(has_overnight) > 0 AS overnight FROM zdev GROUP BY 1),
devices AS (SELECT ad_id, device_days, postal_codes, CASE WHEN g > 0.7 AND c < 1 THEN 'high' WHEN g > 0.4 THEN 'medium' ELSE 'low' END AS quality_tier, overnight FROM dev)
"""


@query(ROLL_SQL + "SELECT * FROM devices")
def device_rollup(t: Tables) -> DataFrame:
    return postal.device_rollup(zip_devices_of(t))


@query(ROLL_SQL + "SELECT ad_id, device_days FROM devices ORDER BY device_days DESC, ad_id LIMIT 25")
def device_rollup_top(t: Tables) -> DataFrame:
    return postal.top_devices(postal.device_rollup(zip_devices_of(t)), 25).select("ad_id", "device_days")


@query(ROLL_SQL + "SELECT quality_tier, count(*) AS devices FROM devices GROUP BY 1")
def quality_histogram(t: Tables) -> DataFrame:
    return postal.device_rollup(zip_devices_of(t)).groupBy("quality_tier").agg(F.count(F.lit(1)).alias("devices"))


SIGN_SQL = DEVICES_SQL + """,
reg AS (SELECT zip, region, sum(device_days) AS n FROM zdev GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY zip ORDER BY sum(device_days) DESC, region DESC) = 1),
s AS (SELECT zip, count(DISTINCT ad_id) AS devices, CAST(sum(device_days) AS BIGINT) AS device_days, sum(morning_dd) AS morning, sum(midday_dd) AS midday, sum(afternoon_dd) AS afternoon, sum(evening_dd) AS evening, sum(night_dd) AS night, sum(weekend_dd) AS weekend,
  sum(CASE WHEN has_overnight > 0 THEN device_days ELSE 0 END) AS overnight, sum(avg_gps * device_days) / sum(device_days) AS g, sum(avg_circle * device_days) / sum(device_days) AS c, sum(avg_lat * device_days) / sum(device_days) AS lat, sum(avg_lng * device_days) / sum(device_days) AS lng,
  count(*) FILTER (device_days = 1) AS once_only, count(*) FILTER (device_days BETWEEN 2 AND 7) AS casual, count(*) FILTER (device_days BETWEEN 8 AND 30) AS regular, count(*) FILTER (device_days > 30) AS resident FROM zdev GROUP BY 1),
signs AS (SELECT s.zip, region, devices, device_days, CASE greatest(morning, midday, afternoon, evening, night) WHEN morning THEN 'morning' WHEN midday THEN 'midday' WHEN afternoon THEN 'afternoon' WHEN evening THEN 'evening' ELSE 'night' END AS peak_bucket,
  round(CAST(weekend AS DOUBLE) / device_days, 6) AS weekend_share, round(CAST(overnight AS DOUBLE) / device_days, 6) AS overnight_share, CASE WHEN g > 0.7 AND c < 1 THEN 'high' WHEN g > 0.4 THEN 'mixed' ELSE 'low' END AS quality_tier, round(g, 6) AS gps_share, round(lat, 6) AS lat, round(lng, 6) AS lng, once_only, casual, regular, resident FROM s JOIN reg USING (zip))
"""


@query(SIGN_SQL + "SELECT * FROM signs")
def zip_signature(t: Tables) -> DataFrame:
    return postal.signatures(zip_devices_of(t))


@query(SIGN_SQL + "SELECT zip, string_agg(city, ',' ORDER BY rn) AS top_city FROM (SELECT zip, city, row_number() OVER (PARTITION BY zip ORDER BY sum(device_days) DESC, city) AS rn FROM zdev GROUP BY 1, 2) WHERE rn <= 3 GROUP BY 1")
def zip_top_cities(t: Tables) -> DataFrame:
    return postal.top_named(zip_devices_of(t), "city", 3)


@query(SIGN_SQL + "SELECT region, CAST(sum(devices) AS BIGINT) AS devices, count(DISTINCT zip) AS zips, round(CAST(sum(devices) AS DOUBLE) / (SELECT count(DISTINCT ad_id) FROM zdev), 6) AS share_of_total FROM signs GROUP BY 1")
def region_rollup(t: Tables) -> DataFrame:
    rows = zip_devices_of(t)
    return postal.region_rollup(postal.signatures(rows), rows)


# comparison

SIDES_SQL = """
pd AS (SELECT ad_id, date, poi_id, count(*) AS n, CAST(date_sub('second', min(utc_timestamp), max(utc_timestamp)) AS DOUBLE) / 60 AS m FROM (SELECT ad_id, date, utc_timestamp, unnest(poi_ids) AS poi_id FROM pings) GROUP BY ALL),
ids AS (SELECT ad_id, CAST(ad_id[2:] AS BIGINT) AS u FROM pd GROUP BY 1 HAVING count(DISTINCT date) >= 2),
a AS (SELECT ad_id FROM ids WHERE u % 2 = 0 OR u % 3 = 0), b AS (SELECT ad_id FROM ids WHERE u % 2 = 1 OR u % 3 = 0)
"""


def sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    u = F.substring("ad_id", 2, 6).cast("long")
    p = valid(t)
    return p.filter((u % 2 == 0) | (u % 3 == 0)), p.filter((u % 2 == 1) | (u % 3 == 0))


@query(SIDES_SQL + "SELECT (SELECT count(*) FROM a) AS total_a, (SELECT count(*) FROM b) AS total_b, (SELECT count(*) FROM a JOIN b USING (ad_id)) AS overlap")
def overlap_counts(t: Tables) -> DataFrame:
    a, b = sides(t)
    return compare.overlap(compare.side_ids(a), compare.side_ids(b))


@query(SIDES_SQL + "SELECT ad_id FROM a JOIN b USING (ad_id)")
def overlap_ids(t: Tables) -> DataFrame:
    a, b = sides(t)
    return compare.overlap_ids(compare.side_ids(a), compare.side_ids(b))


@query(SIDES_SQL + "SELECT poi_id, count(DISTINCT ad_id) AS overlap_devices FROM (SELECT ad_id, unnest(poi_ids) AS poi_id FROM pings) WHERE ad_id IN (SELECT ad_id FROM a JOIN b USING (ad_id)) GROUP BY 1")
def poi_overlap(t: Tables) -> DataFrame:
    a, b = sides(t)
    return compare.poi_overlap(a, compare.overlap_ids(compare.side_ids(a), compare.side_ids(b)))


@query(SIDES_SQL + "," + STARTS_SQL.format(d=1, src="raw_pings WHERE accuracy IS NULL OR accuracy < 100") + """, kept AS (SELECT DISTINCT ad_id FROM starts JOIN geocode ON lat_key = CAST(round(home_lat * 10) AS INTEGER) AND lng_key = CAST(round(home_lng * 10) AS INTEGER) WHERE days >= 3 AND zipcode IN ('90001', '90004'))
SELECT (SELECT count(*) FROM a SEMI JOIN kept USING (ad_id)) AS total_a, (SELECT count(*) FROM b SEMI JOIN kept USING (ad_id)) AS total_b, (SELECT count(*) FROM a JOIN b USING (ad_id) SEMI JOIN kept USING (ad_id)) AS overlap""")
def overlap_home_zip(t: Tables) -> DataFrame:
    a, b = sides(t)
    kept = compare.kept_homes(homes.first_ping_homes(valid(t, max_accuracy=100.0)), t.geocode, ["90001", "90004"])
    return compare.overlap(compare.side_ids(a, kept=kept), compare.side_ids(b, kept=kept))


REACH_SQL = SIDES_SQL + """,
clusters AS (SELECT ad_id, poi_id, count(*) AS pings, CAST(date_sub('minute', min(utc_timestamp), max(utc_timestamp)) AS BIGINT) AS minutes FROM near WHERE distance <= 200 AND category = 'gym' AND ad_id IN (SELECT ad_id FROM a) GROUP BY 1, 2 HAVING count(*) >= 2 OR date_sub('minute', min(utc_timestamp), max(utc_timestamp)) >= 5)
"""


def reached(t: Tables) -> tuple[DataFrame, DataFrame]:
    visitors = compare.side_ids(sides(t)[0])
    return compare.reach(valid(t), visitors, as_targets(t.pois, "category").filter("category = 'gym'")), visitors


@query(REACH_SQL + "SELECT * FROM clusters")
def potential_reach(t: Tables) -> DataFrame:
    return reached(t)[0]


@query(REACH_SQL + "SELECT poi_id, count(DISTINCT ad_id) AS devices, floor(CAST(count(DISTINCT ad_id) AS DOUBLE) / (SELECT count(*) FROM a) * 10000 + 0.5) / 100 AS percent FROM clusters GROUP BY 1")
def reach_summary(t: Tables) -> DataFrame:
    return compare.reach_summary(*reached(t))


@query("""
z AS (SELECT zip, count(DISTINCT ad_id) AS devices FROM pings GROUP BY 1), j AS (SELECT zip, devices, population FROM z JOIN nse ON postal_code = zip)
SELECT zip, devices, population, floor(CAST(devices AS DOUBLE) / CAST(sum(devices) OVER () AS DOUBLE) * 10000 + 0.5) / 100 AS percent_of_match, floor(CAST(devices AS DOUBLE) / population * 10000 + 0.5) / 100 AS percent_of_population FROM j ORDER BY 5 DESC, 1 LIMIT 20""")
def penetration(t: Tables) -> DataFrame:
    rows = valid(t).groupBy("zip").agg(F.countDistinct("ad_id").alias("devices"))
    return compare.penetration(rows, t.nse.select("postal_code", "population"))


@query(SIDES_SQL + "SELECT ad_id, poi_id, date, n AS pings, round(m, 1) AS dwell_minutes FROM pd WHERE n >= 2 AND m > 0")
def export_full(t: Tables) -> DataFrame:
    return compare.export_ids(valid(t), min_dwell=0, min_pings=2)


@query(f"hk AS (SELECT ad_id, CAST(round(home_lat, 1) * 10 AS INTEGER) AS lat_key, CAST(round(home_lng, 1) * 10 AS INTEGER) AS lng_key FROM ({MEDIAN_SQL.format(where='')})) SELECT ad_id, coalesce(zipcode, 'UNKNOWN') AS zipcode FROM (SELECT DISTINCT ad_id FROM pings) LEFT JOIN hk USING (ad_id) LEFT JOIN geocode USING (lat_key, lng_key)")
def activation_join(t: Tables) -> DataFrame:
    return compare.activation(valid(t), homes.activation_keys(valid(t, max_accuracy=200.0), exact=True), t.geocode)


@query(f"hk AS (SELECT ad_id, CAST(round(home_lat, 1) * 10 AS INTEGER) AS lat_key, CAST(round(home_lng, 1) * 10 AS INTEGER) AS lng_key FROM ({MEDIAN_SQL.format(where='')})) SELECT count(*) AS devices, count(zipcode) AS with_zip FROM (SELECT DISTINCT ad_id FROM pings) LEFT JOIN hk USING (ad_id) LEFT JOIN geocode USING (lat_key, lng_key)")
def activation_coverage(t: Tables) -> DataFrame:
    return compare.coverage(activation_join(t))


BRACKETS = [("0-19", 0.0, 19.999), ("20-39", 20.0, 39.999), ("40-59", 40.0, 59.999), ("60-79", 60.0, 79.999), ("80-100", 80.0, 100.0)]
NSE_SQL = """
gz AS (SELECT zipcode AS postal_code, 1000 + 100 * row_number() OVER (ORDER BY zipcode) AS population, CAST((row_number() OVER (ORDER BY zipcode) * 17) % 101 AS DOUBLE) AS score FROM geocode),
bm AS (SELECT lat_key, lng_key, CASE WHEN score < 20 THEN '0-19' WHEN score < 40 THEN '20-39' WHEN score < 60 THEN '40-59' WHEN score < 80 THEN '60-79' ELSE '80-100' END AS bracket_label, population FROM geocode JOIN gz ON postal_code = zipcode),
og AS (SELECT ad_id, round(arg_min(lat, utc_timestamp), 1) AS la, round(arg_min(lng, utc_timestamp), 1) AS ln FROM pings WHERE ad_id IN (SELECT ad_id FROM at_poi) GROUP BY 1),
bi AS (SELECT DISTINCT ad_id, bracket_label FROM og JOIN bm ON lat_key = CAST(round(la * 10) AS INTEGER) AND lng_key = CAST(round(ln * 10) AS INTEGER))
"""


def cached_scores(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.orderBy("zipcode")).cast("long")  # one row per cell of 11 km
    return t.geocode.select(F.col("zipcode").alias("postal_code"), (1000 + 100 * n).alias("population"), ((n * 17) % 101).cast("double").alias("nse"))


def labelled(t: Tables) -> tuple[DataFrame, DataFrame]:
    scores = cached_scores(t)
    labels = compare.bracket_map(t.geocode, scores, BRACKETS)
    return compare.bracket_ids(reports.nse_origins(valid(t), at_poi(t)), labels), scores


@query(NSE_SQL + "SELECT lat_key, lng_key, bracket_label FROM bm")
def nse_bracket_map(t: Tables) -> DataFrame:
    return compare.bracket_map(t.geocode, cached_scores(t), BRACKETS)


@query(NSE_SQL + "SELECT * FROM bi")
def nse_brackets(t: Tables) -> DataFrame:
    return labelled(t)[0]


@query(NSE_SQL + "SELECT bracket_label, CAST(sum(population) AS BIGINT) AS population, (SELECT count(DISTINCT ad_id) FROM bi WHERE bi.bracket_label = bm.bracket_label) AS maids FROM bm GROUP BY 1")
def nse_bracket_summary(t: Tables) -> DataFrame:
    ids, scores = labelled(t)
    return compare.bracket_summary(ids, scores.select(compare.bracket(F.col("nse")).alias("bracket_label"), "population"))


MASTER_SQL = CATEGORY_SQL + """,
master AS (SELECT DISTINCT ad_id, 'plain' AS attr_type, '' AS attr_value, CAST(NULL AS DOUBLE) AS dwell_minutes, CAST(NULL AS VARCHAR) AS postal_code FROM pings WHERE ad_id IN (SELECT ad_id FROM pings GROUP BY 1 HAVING count(DISTINCT date) >= 2)
UNION ALL SELECT ad_id, 'category', category, dwell_minutes, NULL FROM cat_dwell
UNION ALL SELECT ad_id, 'category_and', 'cafe,gym', dwell_minutes, NULL FROM cat_dwell WHERE ad_id IN (SELECT ad_id FROM cat_dwell GROUP BY 1 HAVING count(DISTINCT category) = 2)
UNION ALL SELECT DISTINCT ad_id, 'nse', '20-39', NULL, zip FROM pings WHERE zip IN ('10000', '11000')
UNION ALL SELECT DISTINCT ad_id, 'catchment', '', NULL, NULL FROM at_poi
UNION ALL SELECT ad_id, 'persona', 'Weekend Visitor', NULL, NULL FROM dwell GROUP BY 1 HAVING count(*) >= 10
UNION ALL SELECT ad_id, 'persona_lookalike', 'Weekend Visitor', NULL, NULL FROM dwell GROUP BY 1 HAVING count(*) < 10
UNION ALL SELECT 'x1', 'category', 'gym', 12.5::DOUBLE, NULL UNION ALL SELECT 'x2', 'plain', '', NULL, NULL UNION ALL SELECT 'x3', 'category', 'cafe', 4::DOUBLE, '00001')
"""


def master_list(t: Tables) -> DataFrame:
    both, cats = compare.contribution, cafe_gym(t)
    days = at_poi(t).select("ad_id", "date").distinct().groupBy("ad_id").agg(F.count(F.lit(1)).alias("n"))
    old = t.spark.createDataFrame([("x1", "gym", "12.5", None, ""), ("x2", "", None, "", ""), ("x3", "category", "cafe", "4", "00001"), ("ad_id", "attr_type", "attr_value", "dwell_minutes", "postal_code")], "ad_id string, attr_type string, attr_value string, dwell_minutes string, postal_code string")
    return compare.consolidate([
        both(filters.human_ids(valid(t)), "plain"), both(cats, "category"), both(with_all_categories(cats, 2), "category_and", "cafe,gym"),
        both(valid(t).filter(F.col("zip").isin("10000", "11000")).select("ad_id", F.col("zip").alias("postal_code"), F.lit("20-39").alias("nse_bracket")).distinct(), "nse"),
        both(at_poi(t).select("ad_id").distinct(), "catchment"), compare.legacy_contribution(old),
        both(days.filter("n >= 10"), "persona", "Weekend Visitor"), both(days.filter("n < 10"), "persona_lookalike", "Weekend Visitor"),
    ])


@query(MASTER_SQL + "SELECT * FROM master")
def master_union(t: Tables) -> DataFrame:
    return master_list(t)


@query(MASTER_SQL + "SELECT attr_type, attr_value, count(DISTINCT ad_id) AS maid_count, round(avg(dwell_minutes), 1) AS avg_dwell, round(quantile_disc(dwell_minutes, 0.5), 1) AS median_dwell FROM master GROUP BY 1, 2")
def master_stats(t: Tables) -> DataFrame:
    return compare.master_stats(master_list(t), exact=True)


@query(MASTER_SQL + "SELECT count(DISTINCT ad_id) AS total FROM master")
def master_total(t: Tables) -> DataFrame:
    return compare.master_total(master_list(t))


@query(MASTER_SQL + """SELECT attr_value AS category, count(DISTINCT ad_id) FILTER (dwell_minutes >= 2 AND dwell_minutes < 10) AS dwell_2_10, count(DISTINCT ad_id) FILTER (dwell_minutes >= 10 AND dwell_minutes < 30) AS dwell_10_30,
count(DISTINCT ad_id) FILTER (dwell_minutes >= 30 AND dwell_minutes < 60) AS dwell_30_60, count(DISTINCT ad_id) FILTER (dwell_minutes >= 60 AND dwell_minutes < 180) AS dwell_60_180, count(DISTINCT ad_id) FILTER (dwell_minutes >= 180) AS dwell_180_plus FROM master WHERE attr_type = 'category' AND dwell_minutes IS NOT NULL GROUP BY 1""")
def dwell_distribution(t: Tables) -> DataFrame:
    return compare.dwell_distribution(master_list(t))


@query(MASTER_SQL + "SELECT postal_code, count(DISTINCT ad_id) AS maid_count FROM master WHERE coalesce(postal_code, '') <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def postal_top(t: Tables) -> DataFrame:
    return compare.postal_top(master_list(t))


@query("SELECT event_type AS source, 'plain' AS attr_type, '' AS attr_value, max(ts) AS created_at, arg_max(event_id, {'t': ts, 'e': event_id}) AS entry_id FROM events GROUP BY 1")
def latest_contributions(t: Tables) -> DataFrame:
    index = t.read("events").select(F.col("event_type").alias("source"), F.lit("plain").alias("attr_type"), F.lit("").alias("attr_value"), F.col("ts").alias("created_at"), F.col("event_id").alias("entry_id"))
    return compare.latest_contributions(index)


@query(CATEGORY_SQL + "SELECT ad_id FROM cat_dwell UNION SELECT ad_id FROM at_poi")
def cluster_download(t: Tables) -> DataFrame:
    return compare.cluster_ids([cafe_gym(t), at_poi(t)])


@query(f"SELECT DISTINCT ad_id FROM (SELECT ad_id, arg_min(zip, utc_timestamp) AS z FROM pings WHERE (ad_id, date) IN (SELECT (ad_id, date) FROM dwell WHERE date_sub('minute', arrival, departure) >= 1) GROUP BY 1) WHERE z IN ({ZIP_LIST})")
def nse_export_postal(t: Tables) -> DataFrame:
    days = visits.whole_minute_days(at_poi(t), low=1)
    first = valid(t).join(days, ["ad_id", "date"], "left_semi").groupBy("ad_id").agg(reports.first_by(F.col("zip")).alias("z"))
    return first.filter(F.col("z").isin(ZIPS)).select("ad_id").distinct()


@query("SELECT count(*) AS pings, count(DISTINCT ad_id) AS devices, count(country) AS with_country FROM (SELECT ad_id, country FROM raw_pings UNION ALL SELECT ad_id, NULL FROM raw_pings)")
def union_of_datasets(t: Tables) -> DataFrame:
    p = t.pings
    both = union_datasets([p, p.drop("iso_country_code", "geo_fields")])
    return both.agg(F.count(F.lit(1)).alias("pings"), F.countDistinct("ad_id").alias("devices"), F.count("iso_country_code").alias("with_country"))


# matching and polygons


def squares(t: Tables) -> DataFrame:
    """A square of 0.06 degrees for each of 16 blocks of the area, as a polygon."""
    s = t.spark.range(16).select(F.col("id"), (19.24 + (F.col("id") % 4) * 0.06).alias("a"), (-99.26 + F.floor(F.col("id") / 4) * 0.06).alias("b"))
    point = lambda y, x: F.array(F.col("b") + x, F.col("a") + y)
    ring = F.array(point(0.0, 0.0), point(0.0, 0.06), point(0.06, 0.06), point(0.06, 0.0))
    return s.select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("polygon_id"), F.concat(F.lit("8"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("zip"), F.lit("MX").alias("country"), F.array(ring).alias("rings"))


SQUARES_SQL = "pts AS (SELECT id AS point_id, plat AS lat, plng AS lng FROM pois), sq AS (SELECT i, 19.24::DOUBLE + (i % 4) * 0.06::DOUBLE AS a, -99.26::DOUBLE + (i // 4) * 0.06::DOUBLE AS b FROM (SELECT unnest(range(16)) AS i)), hit AS (SELECT point_id, i FROM pts JOIN sq ON lat > a AND lat < a + 0.06::DOUBLE AND lng > b AND lng < b + 0.06::DOUBLE)\n"


def poi_points(t: Tables) -> DataFrame:
    return t.pois.select(F.col("id").alias("point_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))


@query(SQUARES_SQL + "SELECT point_id, 's' || i AS polygon_id, '8' || lpad(CAST(i AS VARCHAR), 4, '0') AS zip, 'MX' AS country FROM hit")
def points_in_polygons(t: Tables) -> DataFrame:
    return poi_sets.points_in_polygons(poi_points(t), squares(t))


@query(SQUARES_SQL + "SELECT p.point_id, coalesce('8' || lpad(CAST(i AS VARCHAR), 4, '0'), 'UNKNOWN') AS zip, CASE WHEN i IS NULL THEN 'unmatched' ELSE 'geojson_local' END AS source FROM pts p LEFT JOIN hit USING (point_id)")
def geocode_batch(t: Tables) -> DataFrame:
    return poi_sets.classified(poi_points(t), squares(t))


@query(SQUARES_SQL + "SELECT CAST(y AS INTEGER) AS lat_key, CAST(x AS INTEGER) AS lng_key, '8' || lpad(CAST(i AS VARCHAR), 4, '0') AS zipcode FROM (SELECT unnest(range(1920, 1960)) AS y), (SELECT unnest(range(-9930, -9890)) AS x) JOIN sq ON y / 100.0::DOUBLE > a + 1e-9 AND y / 100.0::DOUBLE < a + 0.06::DOUBLE - 1e-9 AND x / 100.0::DOUBLE > b + 1e-9 AND x / 100.0::DOUBLE < b + 0.06::DOUBLE - 1e-9")
def geocode_cache(t: Tables) -> DataFrame:
    # grid points on an edge belong to either side by rounding alone: both sides leave them out
    shapes = squares(t)
    inner = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p[0] + F.when(p[0] == F.array_min(F.transform(r, lambda q: q[0])), 1e-9).otherwise(-1e-9), p[1] + F.when(p[1] == F.array_min(F.transform(r, lambda q: q[1])), 1e-9).otherwise(-1e-9))))
    return poi_sets.cache_grid(shapes.withColumn("rings", inner), (19.20, -99.30), (19.59, -98.91), per_degree=100)


@query("SELECT ad_id, coalesce(zipcode, 'UNKNOWN') AS zip FROM (SELECT ad_id, arg_min(lat, utc_timestamp) AS la, arg_min(lng, utc_timestamp) AS ln FROM pings GROUP BY 1) LEFT JOIN geocode ON lat_key = CAST(round(la * 10) AS INTEGER) AND lng_key = CAST(round(ln * 10) AS INTEGER)")
def grid_cache_geocode(t: Tables) -> DataFrame:
    first = valid(t).groupBy("ad_id").agg(reports.first_by(F.col("lat")).alias("origin_lat"), reports.first_by(F.col("lng")).alias("origin_lng"))
    return reports.with_zip(first, t.geocode).select("ad_id", "zip")


@query("""
q AS (SELECT id AS query_id, category AS wanted, plat + 0.0005::DOUBLE AS la, plng AS ln FROM pois), c AS (SELECT id AS poi_id, category, plat, plng FROM pois UNION ALL SELECT 'alt_' || id, 'other', plat + 0.0006::DOUBLE, plng FROM pois),
m AS (SELECT query_id, poi_id, wanted, category, 111320 * sqrt(pow(la - plat, 2) + pow((ln - plng) * cos(radians((la + plat) / 2)), 2)) AS d FROM q JOIN c ON abs(la - plat) < 0.005 AND abs(ln - plng) < 0.005)
SELECT query_id, poi_id, round(greatest(100 - d, 0) + CASE WHEN wanted = category THEN 50 ELSE 0 END, 4) AS score FROM m WHERE d <= 100 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY greatest(100 - d, 0) + CASE WHEN wanted = category THEN 50 ELSE 0 END DESC, poi_id) = 1""")
def poi_enrichment(t: Tables) -> DataFrame:
    q = t.pois.select(F.col("id").alias("query_id"), "category", (F.col("latitude") + 0.0005).alias("lat"), F.col("longitude").alias("lng"))
    c = as_targets(t.pois, "category")
    alt = c.select(F.concat(F.lit("alt_"), "poi_id").alias("poi_id"), (F.col("poi_lat") + 0.0006).alias("poi_lat"), "poi_lng", F.lit("other").alias("category"))
    return poi_sets.best_match(q, c.unionByName(alt))


@query("SELECT DISTINCT poi_id, plat AS lat, plng AS lng, coalesce(name, poi_id) AS name FROM (SELECT unnest(poi_ids) AS poi_id FROM pings) LEFT JOIN pois ON id = poi_id")
def poi_positions(t: Tables) -> DataFrame:
    ids = valid(t).select(F.explode("poi_ids").alias("poi_id"))
    src = t.pois.select(F.col("id").alias("poi_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng"), "name")
    return poi_sets.positions(ids, src.filter(F.substring("poi_id", 5, 3).cast("int") % 2 == 0), src)


@query("SELECT * FROM (VALUES ('2024-01-10', '2024-01-31', 0, 15000), ('2024-01-10', '2024-01-31', 15000, 30000), ('2024-02-01', '2024-02-29', 0, 15000), ('2024-02-01', '2024-02-29', 15000, 30000), ('2024-03-01', '2024-03-05', 0, 15000), ('2024-03-01', '2024-03-05', 15000, 30000)) v(first_day, last_day, first_poi, end_poi)", base=False)
def split_plan(t: Tables) -> DataFrame:
    plan = poi_sets.split_plan(date(2024, 1, 10), date(2024, 3, 5), 30_000)
    return t.spark.createDataFrame([(a.isoformat(), b.isoformat(), x, y) for a, b, x, y in plan], "first_day string, last_day string, first_poi int, end_poi int")


@query("SELECT * FROM (VALUES ('ES', '28001'), ('MX', '01000'), ('FR', '75001'), ('XX', '123'), ('DE', '10115')) v(country, postal)", base=False)
def postal_properties(t: Tables) -> DataFrame:
    rows = [("MX", {"d_cp": "01000"}), ("ES", {"COD_POSTAL": "28001"}), ("FR", {"codePostal": "75001"}), ("XX", {"postcode": "123"}), ("DE", {"plz": "10115"})]
    df = t.spark.createDataFrame(rows, "country string, properties map<string, string>")
    return df.select("country", poi_sets.postal_property(F.col("properties"), F.col("country")).alias("postal"))

