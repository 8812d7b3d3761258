"""Queries for categories, recipes, audiences and affinity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import at_poi_pings, gaussian_field
from ..operators import affinity, audiences, homes, reports, visits
from ..operators.audiences import Recipe, Step
from ..sources.fixtures import Tables
from .homes_queries import STARTS_SQL
from .registry import query
from .report_queries import AFFINITY_INPUT_SQL, ZIP_OF, affinity_rows, catalogue
from .visits_queries import VISITS_SQL, at_poi, lab_visits, valid

CATEGORY_SQL = """
cat_days AS (SELECT ad_id, date, category, CAST(date_sub('second', min(utc_timestamp), max(utc_timestamp)) AS DOUBLE) / 60 AS m FROM near WHERE distance <= 200 AND category IN ('cafe', 'gym') GROUP BY ALL),
cat_dwell AS (SELECT ad_id, category, round(max(m), 1) AS dwell_minutes FROM cat_days GROUP BY ALL)
"""


def cafe_gym(t: Tables) -> DataFrame:
    return audiences.category_dwell(valid(t), catalogue(t), ["cafe", "gym"])


@query(CATEGORY_SQL + "SELECT * FROM cat_dwell")
def category_or(t: Tables) -> DataFrame:
    return cafe_gym(t)


@query(CATEGORY_SQL + "SELECT * FROM cat_dwell WHERE ad_id IN (SELECT ad_id FROM cat_dwell GROUP BY 1 HAVING count(DISTINCT category) = 2)")
def category_and(t: Tables) -> DataFrame:
    return audiences.with_all_categories(cafe_gym(t), 2)


@query(CATEGORY_SQL + "SELECT ad_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM cat_dwell GROUP BY 1")
def category_labels(t: Tables) -> DataFrame:
    return audiences.category_label(cafe_gym(t))


@query("SELECT category, count(*) AS pois FROM pois WHERE category IN ('cafe', 'gym') GROUP BY 1")
def poi_count(t: Tables) -> DataFrame:
    return audiences.poi_counts(t.pois, ["cafe", "gym"], "mx")


@query(VISITS_SQL + "SELECT count(*) AS visits, count(DISTINCT v.ad_id) AS visitors, (SELECT count(DISTINCT ad_id) FROM pings) AS total_devices FROM visits v")
def lab_totals(t: Tables) -> DataFrame:
    v = lab_visits(t).agg(F.count(F.lit(1)).alias("visits"), F.countDistinct("ad_id").alias("visitors"))
    return v.join(valid(t).agg(F.countDistinct("ad_id").alias("total_devices")))


ORIGINS_SQL = "origins AS (SELECT ad_id, date, round(arg_min(lat, utc_timestamp), 4) AS origin_lat, round(arg_min(lng, utc_timestamp), 4) AS origin_lng FROM pings WHERE ad_id IN (SELECT ad_id FROM at_poi) GROUP BY ALL)\n"


@query(ORIGINS_SQL + "SELECT * FROM origins")
def visitor_origins(t: Tables) -> DataFrame:
    return audiences.visitor_origins(valid(t), at_poi(t))


MORNING = Step(("cafe", "restaurant"), hours=(7, 13))
LONG = Step(("gym",), min_dwell=0.0, max_dwell=600.0)
EVENING = Step(("supermarket", "car_dealer"), hours=(18, 6), min_frequency=1)


def recipe_sql(logic: str) -> str:
    m = ("category IN ('cafe', 'restaurant') AND visit_hour >= 7 AND visit_hour < 13", "category = 'gym' AND dwell_minutes >= 0 AND dwell_minutes <= 600", "category IN ('supermarket', 'car_dealer') AND (visit_hour >= 18 OR visit_hour < 6)")
    d = (m[0], "category = 'gym' AND dwell_minutes >= 0", m[2])
    n = 2 if logic != "OR" else 3
    counts = ", ".join(f"count(*) FILTER ({m[i]}) AS n{i}, min(date) FILTER ({d[i]}) AS d{i}" for i in range(n))
    matched = " + ".join(f"CAST(n{i} >= 1 AS BIGINT)" for i in range(n))
    where = {"OR": "n0 >= 1 OR n1 >= 1 OR n2 >= 1", "AND": "n0 >= 1 AND n1 >= 1", "ORDERED": "n0 >= 1 AND n1 >= 1 AND d0 IS NOT NULL AND d1 >= d0"}[logic]
    return VISITS_SQL + f", per AS (SELECT ad_id, {counts}, count(*) AS total_visits, avg(dwell_minutes) AS mean FROM visits GROUP BY 1) SELECT ad_id, {matched} AS matched_steps, total_visits, floor(mean * 10 + 0.5) / 10 AS avg_dwell FROM per WHERE {where}"


@query(recipe_sql("OR"))
def recipe_or(t: Tables) -> DataFrame:
    return audiences.segment(lab_visits(t), Recipe("any", (MORNING, LONG, EVENING)))


@query(recipe_sql("AND"))
def recipe_and(t: Tables) -> DataFrame:
    return audiences.segment(lab_visits(t), Recipe("all", (MORNING, LONG), "AND"))


@query(recipe_sql("ORDERED"))
def recipe_ordered(t: Tables) -> DataFrame:
    return audiences.segment(lab_visits(t), Recipe("in order", (MORNING, LONG), "AND", ordered=True))


RECORDS_SQL = VISITS_SQL + "," + ORIGINS_SQL.strip() + f""",
zv AS (SELECT v.*, coalesce(zipcode, 'UNKNOWN') AS zip FROM visits v JOIN origins o USING (ad_id, date) {ZIP_OF.format(lat='origin_lat', lng='origin_lng')}),
zc AS (SELECT zip, category, count(*) AS visits, count(DISTINCT ad_id) AS devices, sum(dwell_minutes) AS dwell FROM zv GROUP BY ALL),
zt AS (SELECT *, sum(visits) OVER (PARTITION BY zip) AS zip_total, sum(visits) OVER (PARTITION BY category) AS cat_total, sum(dwell) OVER (PARTITION BY category) AS cat_dwell, sum(visits) OVER () AS total FROM zc),
sc AS (SELECT *, CAST(floor(least(((CAST(visits AS DOUBLE) / zip_total) / (CAST(cat_total AS DOUBLE) / total)) / 5, 1) * 100 + 0.5) AS BIGINT) AS concentration_score,
  CAST(floor(least(greatest(log2(CAST(visits AS DOUBLE) / devices) / log2(16), 0), 1) * 100 + 0.5) AS BIGINT) AS frequency_score,
  CAST(floor(least((dwell / visits) / 120, 1) * 100 + 0.5) AS BIGINT) AS dwell_score FROM zt WHERE zip_total >= 5),
records AS (SELECT zip, category, visits, devices AS unique_devices, floor(dwell / visits * 10 + 0.5) / 10 AS avg_dwell_minutes, floor(CAST(visits AS DOUBLE) / devices * 100 + 0.5) / 100 AS frequency, CAST(zip_total AS BIGINT) AS total_visits,
  concentration_score, frequency_score, dwell_score, CAST(floor(0.4::DOUBLE * concentration_score + 0.35::DOUBLE * frequency_score + 0.25::DOUBLE * dwell_score + 0.5) AS BIGINT) AS affinity_index FROM sc)
"""


def zip_visits(t: Tables) -> DataFrame:
    return reports.with_zip(lab_visits(t).join(audiences.visitor_origins(valid(t), at_poi(t)), ["ad_id", "date"]), t.geocode)


def records(t: Tables) -> DataFrame:
    return audiences.affinity_records(zip_visits(t))


@query(RECORDS_SQL + "SELECT * FROM records")
def lab_affinity(t: Tables) -> DataFrame:
    return records(t)


GROUP_CASE = "CASE category WHEN 'cafe' THEN 'food_and_beverage' WHEN 'restaurant' THEN 'food_and_beverage' WHEN 'gym' THEN 'sports' WHEN 'car_dealer' THEN 'automotive' WHEN 'supermarket' THEN 'retail' ELSE 'other' END"


@query(RECORDS_SQL + f""", top AS (SELECT zip, max(total_visits) AS total_visits, arg_max(category, affinity_index * 1000 + CASE category WHEN 'cafe' THEN 1 WHEN 'car_dealer' THEN 2 WHEN 'gym' THEN 3 WHEN 'restaurant' THEN 4 ELSE 5 END) AS top_category, max(affinity_index) AS top_affinity FROM records GROUP BY 1),
g AS (SELECT zip, {GROUP_CASE} AS grp, avg(affinity_index) AS mean FROM records GROUP BY 1, 2)
SELECT *, (SELECT grp FROM g WHERE g.zip = top.zip ORDER BY mean DESC, grp DESC LIMIT 1) AS dominant_group FROM top""")
def zip_profiles(t: Tables) -> DataFrame:
    return audiences.zip_profiles(records(t))


@query(RECORDS_SQL + """SELECT category, CAST(sum(visits) AS BIGINT) AS visits, (SELECT count(DISTINCT ad_id) FROM zv WHERE zv.category = r.category) AS unique_devices, floor(CAST(sum(visits) AS DOUBLE) / CAST(sum(sum(visits)) OVER () AS DOUBLE) * 10000 + 0.5) / 100 AS percent_of_total,
count(DISTINCT zip) AS zips, CAST(floor(avg(affinity_index) + 0.5) AS BIGINT) AS avg_affinity, max(affinity_index) AS max_affinity FROM records r GROUP BY category""")
def lab_category_stats(t: Tables) -> DataFrame:
    return audiences.category_stats(records(t), zip_visits(t))


@query(RECORDS_SQL + "SELECT * FROM records WHERE affinity_index >= 10 ORDER BY affinity_index DESC, visits DESC, zip, category LIMIT 25")
def lab_hotspots(t: Tables) -> DataFrame:
    return audiences.hotspots(records(t), least=10)


@query(f"SELECT DISTINCT category, {GROUP_CASE} AS category_group FROM pois")
def category_groups(t: Tables) -> DataFrame:
    return t.pois.select("category", audiences.category_group(F.col("category")).alias("category_group")).distinct()


@query(VISITS_SQL + """, each AS (SELECT ad_id, 'coffee' AS audience, count(*) FILTER (category = 'cafe') AS n, 1 AS least FROM visits GROUP BY 1
UNION ALL SELECT ad_id, 'fitness', count(*) FILTER (category = 'gym'), 2 FROM visits GROUP BY 1 UNION ALL SELECT ad_id, 'drivers', count(*) FILTER (category = 'car_dealer' AND visit_hour >= 9 AND visit_hour < 18), 1 FROM visits GROUP BY 1)
SELECT audience, count(*) AS devices, CAST(sum(n) AS BIGINT) AS visits FROM each WHERE n >= least GROUP BY 1""")
def audience_batch(t: Tables) -> DataFrame:
    wanted = [audiences.audience_recipe("coffee", ("cafe",)), audiences.audience_recipe("fitness", ("gym",), min_frequency=2), audiences.audience_recipe("drivers", ("car_dealer",), hours=(9, 18))]
    return audiences.audience_batch(lab_visits(t), wanted)


@query(VISITS_SQL + """, each AS (SELECT ad_id, 'coffee_lovers' AS audience, count(*) FILTER (category = 'cafe') AS n, 3 AS least FROM visits GROUP BY 1
UNION ALL SELECT ad_id, 'gym_visitors', count(*) FILTER (category = 'gym' AND dwell_minutes >= 15), 1 FROM visits GROUP BY 1 UNION ALL SELECT ad_id, 'car_shoppers', count(*) FILTER (category = 'car_dealer'), 1 FROM visits GROUP BY 1 UNION ALL SELECT ad_id, 'supermarket_shoppers', count(*) FILTER (category = 'supermarket'), 1 FROM visits GROUP BY 1)
SELECT audience, count(*) AS devices, CAST(sum(n) AS BIGINT) AS visits FROM each WHERE n >= least GROUP BY 1
UNION ALL SELECT 'both in order', count(*), CAST(sum(a + b) AS BIGINT) FROM (SELECT count(*) FILTER (category = 'cafe') AS a, count(*) FILTER (category = 'gym') AS b, min(date) FILTER (category = 'cafe') AS d, min(date) FILTER (category = 'gym') AS e FROM visits GROUP BY ad_id) WHERE a >= 1 AND b >= 2 AND e >= d""")
def audience_catalogue(t: Tables) -> DataFrame:
    """All audiences of the catalogue and one of two steps, over one table of visits."""
    steps = Recipe("both in order", (Step(("cafe",)), Step(("gym",), min_frequency=2)), "AND", ordered=True)
    return audiences.audience_batch(lab_visits(t), [*audiences.catalogue_recipes(), steps])


@query("""names AS (SELECT unnest(['cafe', ' Barber', 'barber_shop', 'gas_station', 'used_car_dealer', 'car_dealer', 'parking', 'dog_park', 'metro_station', 'town_hall', 'city_hall', 'x', 'public_library', 'spa', 'gym']) AS category)
SELECT category, CASE trim(lower(category)) WHEN 'cafe' THEN 'food_and_beverage' WHEN 'barber' THEN 'beauty' WHEN 'barber_shop' THEN 'food_and_beverage' WHEN 'gas_station' THEN 'automotive' WHEN 'used_car_dealer' THEN 'automotive' WHEN 'car_dealer' THEN 'automotive' WHEN 'parking' THEN 'automotive'
  WHEN 'dog_park' THEN 'attractions' WHEN 'metro_station' THEN 'transport' WHEN 'city_hall' THEN 'government' WHEN 'public_library' THEN 'food_and_beverage' WHEN 'spa' THEN 'beauty' WHEN 'gym' THEN 'sports' ELSE 'other' END AS category_group,
  CASE category WHEN 'cafe' THEN 'food' WHEN 'gym' THEN 'body' WHEN 'spa' THEN 'body' ELSE 'other' END AS catalogue_group FROM names""")
def group_names(t: Tables) -> DataFrame:
    """Groups of names by words, and by a catalogue that lists them."""
    names = ("cafe", " Barber", "barber_shop", "gas_station", "used_car_dealer", "car_dealer", "parking", "dog_park", "metro_station", "town_hall", "city_hall", "x", "public_library", "spa", "gym")
    own = audiences.groups_of(t.spark.createDataFrame([("food", ["cafe", "bar"]), ("body", ["gym", "spa"])], "group string, categories array<string>"))
    c = F.col("category")
    return t.spark.createDataFrame([(n,) for n in names], "category string").select(c, audiences.category_group(c).alias("category_group"), audiences.exact_group(c, own).alias("catalogue_group"))


@query(CATEGORY_SQL + ", " + STARTS_SQL.format(d=1, src="pings") + """, tops AS (SELECT * FROM starts QUALIFY row_number() OVER (PARTITION BY ad_id ORDER BY days DESC, home_lat, home_lng) = 1),
per AS (SELECT ad_id, avg(round(m, 1)) AS d, count(*) AS n FROM (SELECT ad_id, date, CAST(date_sub('second', min(utc_timestamp), max(utc_timestamp)) AS DOUBLE) / 60 AS m FROM (SELECT DISTINCT ad_id, date, utc_timestamp, lat, lng FROM near WHERE distance <= 200 AND category = 'cafe') GROUP BY ALL) GROUP BY 1)
SELECT home_lat AS origin_lat, home_lng AS origin_lng, count(*) AS unique_devices, CAST(sum(n) AS BIGINT) AS total_visit_days, round(avg(d), 3) AS avg_dwell_minutes, round(avg(n), 6) AS avg_frequency FROM per JOIN tops USING (ad_id) GROUP BY 1, 2""")
def category_affinity(t: Tables) -> DataFrame:
    cafes = at_poi_pings(valid(t), catalogue(t).filter("category = 'cafe'"))
    return audiences.category_affinity(visits.device_day_dwell(cafes), homes.top_home(valid(t), decimals=1))


ROUTES_SQL = """
sampled AS (SELECT ad_id FROM dwell GROUP BY 1 ORDER BY md5(ad_id), ad_id LIMIT {n}),
stays AS (SELECT * FROM dwell SEMI JOIN sampled USING (ad_id)),
met AS (SELECT n.ad_id, n.date, n.utc_timestamp, n.category, CASE WHEN n.utc_timestamp < s.arrival THEN 'before' ELSE 'after' END AS direction FROM near n JOIN stays s USING (ad_id, date) WHERE distance <= 200 AND (n.utc_timestamp < s.arrival OR n.utc_timestamp > s.departure))
"""
GYMS_SQL = """
at_gym AS (SELECT DISTINCT ad_id, date, utc_timestamp, lat, lng FROM near WHERE distance <= 200 AND category = 'gym'),
dwell_gym AS (SELECT ad_id, date, min(utc_timestamp) AS arrival, max(utc_timestamp) AS departure FROM at_gym GROUP BY ALL)
""" + "," + ROUTES_SQL.replace("FROM dwell", "FROM dwell_gym")


def at_gyms(t: Tables) -> DataFrame:
    return at_poi_pings(valid(t), catalogue(t).filter("category = 'gym'"))


@query(GYMS_SQL.format(n=10000) + "SELECT direction, category, count(DISTINCT ad_id) AS devices, count(DISTINCT ad_id || date) AS visits FROM met GROUP BY 1, 2")
def sankey_routes(t: Tables) -> DataFrame:
    return audiences.sankey(valid(t), at_gyms(t), catalogue(t))


@query(GYMS_SQL.format(n=1000) + """SELECT ad_id, date, direction, category, min(utc_timestamp) AS first_ts, round(CAST(date_sub('second', min(utc_timestamp), max(utc_timestamp)) AS DOUBLE) / 60, 1) AS dwell_minutes FROM met GROUP BY ALL
UNION ALL SELECT ad_id, date, 'during', 'target', arrival, CAST(date_sub('minute', arrival, departure) AS DOUBLE) FROM stays""")
def sample_routes(t: Tables) -> DataFrame:
    return audiences.sample_routes(valid(t), at_gyms(t), catalogue(t))


# affinity


AFF_SQL = AFFINITY_INPUT_SQL + """,
az AS (SELECT 'z' || CAST(round(origin_lat * 20) AS INTEGER) || '_' || CAST(round(origin_lng * 20) AS INTEGER) AS zip, * FROM affinity_in),
zips AS (SELECT zip, min([origin_lat, origin_lng])[1] AS lat, min([origin_lat, origin_lng])[2] AS lng, CAST(sum(unique_devices) AS BIGINT) AS unique_devices, CAST(sum(total_visits) AS BIGINT) AS total_visit_days, sum(avg_dwell * unique_devices) / sum(unique_devices) AS avg_dwell, sum(avg_frequency * unique_devices) / sum(unique_devices) AS avg_freq FROM az GROUP BY 1),
src AS (SELECT *, greatest(1, total_visit_days) * (1 + ln(1 + avg_dwell / 30) + ln(1 + avg_freq / 2)) AS intensity FROM zips),
pairs AS (SELECT a.zip, b.zip AS other, b.intensity, b.unique_devices AS n, 2 * 6371 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) AS d FROM src a, src b)
"""


def zip_rows(t: Tables) -> DataFrame:
    key = F.concat(F.lit("z"), F.round(F.col("origin_lat") * 20).cast("int").cast("string"), F.lit("_"), F.round(F.col("origin_lng") * 20).cast("int").cast("string"))
    rows = affinity_rows(t).withColumns({"zip": key, "total_visit_days": F.col("total_visits"), "avg_dwell_minutes": F.col("avg_dwell")})
    return affinity.by_zip(rows)


@query(AFF_SQL + "SELECT zip, lat, lng, unique_devices, total_visit_days, round(avg_dwell, 4) AS avg_dwell, round(avg_freq, 4) AS avg_freq, round(intensity, 4) AS intensity FROM src")
def affinity_zips(t: Tables) -> DataFrame:
    r = [F.round(c, 4).alias(c) for c in ("avg_dwell", "avg_freq", "intensity")]
    return zip_rows(t).select("zip", "lat", "lng", "unique_devices", "total_visit_days", *r)


HEAT_SQL = AFF_SQL + ", heat AS (SELECT zip, sum(intensity * exp(-(d * d) / (2 * 12.0::DOUBLE * 12.0::DOUBLE))) AS h FROM pairs WHERE d <= 36 GROUP BY 1)\n"


@query(HEAT_SQL + "SELECT zip, round(h, 4) AS heat, CAST(greatest(1, floor(100 * ln(h + 1) / ln(greatest(max(h) OVER (), 1) + 1) + 0.5)) AS BIGINT) AS affinity_index FROM heat")
def heat_field(t: Tables) -> DataFrame:
    z = zip_rows(t)
    return affinity.heat_index(z).withColumn("affinity_index", F.col("affinity_index").cast("long"))


LIFT_SQL = AFF_SQL + """,
cat AS (SELECT zip, sum(intensity * exp(-(d * d) / (2 * 3.0::DOUBLE * 3.0::DOUBLE))) AS c FROM pairs WHERE d <= 9 GROUP BY 1), base AS (SELECT zip, sum(n * exp(-(d * d) / (2 * 8.0::DOUBLE * 8.0::DOUBLE))) AS b FROM pairs WHERE d <= 24 GROUP BY 1),
lift AS (SELECT zip, c, b, greatest(max(b) OVER (), 1) AS top, c / (b + greatest(max(b) OVER (), 1) * 0.01::DOUBLE) AS l FROM cat JOIN base USING (zip)),
med AS (SELECT l AS m FROM (SELECT l, row_number() OVER (ORDER BY l, zip) - 1 AS i, count(*) OVER () AS n FROM lift WHERE b >= top * 0.05) WHERE i = n // 2)
"""


@query(LIFT_SQL + "SELECT zip, round(c, 4) AS heat_cat, round(b, 4) AS heat_base, CAST(CASE WHEN b < top * 0.05 THEN 0 ELSE greatest(0, least(100, floor(50 + 20 * log2(l / m) + 0.5))) END AS BIGINT) AS affinity_index FROM lift, med")
def lift_score(t: Tables) -> DataFrame:
    z = zip_rows(t)
    return affinity.lift_index(z, z)


@query(HEAT_SQL + """SELECT x.zip, round(x.h, 4) AS heat FROM (SELECT e.zip, sum(b.intensity * exp(-(d * d) / (2 * 12.0::DOUBLE * 12.0::DOUBLE))) AS h FROM (SELECT 'e' || zip AS zip, lat + 0.125 AS lat, lng AS lng FROM src) e, src b,
LATERAL (SELECT 2 * 6371 * asin(least(1, sqrt(pow(sin(radians(b.lat - e.lat) / 2), 2) + cos(radians(e.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - e.lng) / 2), 2)))) AS d) WHERE d <= 36 GROUP BY 1) x""")
def adjacent_heat(t: Tables) -> DataFrame:
    z = zip_rows(t)
    extra = z.select(F.concat(F.lit("e"), "zip").alias("zip"), (F.col("lat") + 0.125).alias("lat"), "lng")
    return gaussian_field(extra, z, sigma_km=12.0, key="zip").select("zip", F.round("heat", 4).alias("heat"))


V2_SQL = """
v2 AS (SELECT zip, total_visits, unique_devices, avg_dwell, avg_frequency FROM (SELECT 'z' || CAST(round(origin_lat * 20) AS INTEGER) || '_' || CAST(round(origin_lng * 20) AS INTEGER) AS zip, CAST(sum(total_visits) AS BIGINT) AS total_visits, CAST(sum(unique_devices) AS BIGINT) AS unique_devices, round(avg(avg_dwell), 2) AS avg_dwell, round(avg(avg_frequency), 2) AS avg_frequency FROM affinity_in GROUP BY 1)),
p AS (SELECT *, count(*) OVER () - 1 AS n1, rank() OVER (ORDER BY ln(1 + unique_devices)) - 1 + (count(*) OVER (PARTITION BY unique_devices) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY total_visits) - 1 + (count(*) OVER (PARTITION BY total_visits) - 1) / 2.0::DOUBLE AS b,
  rank() OVER (ORDER BY avg_dwell) - 1 + (count(*) OVER (PARTITION BY avg_dwell) - 1) / 2.0::DOUBLE AS c, rank() OVER (ORDER BY avg_frequency) - 1 + (count(*) OVER (PARTITION BY avg_frequency) - 1) / 2.0::DOUBLE AS d FROM v2),
q AS (SELECT *, round(0.30::DOUBLE * (a / n1) + 0.25::DOUBLE * (b / n1) + 0.25::DOUBLE * (c / n1) + 0.20::DOUBLE * (d / n1), 12) AS m FROM p)
"""


@query(AFFINITY_INPUT_SQL + "," + V2_SQL + "SELECT zip, total_visits, unique_devices, avg_dwell, avg_frequency, CAST(greatest(1, least(100, floor((rank() OVER (ORDER BY m) - 1 + (count(*) OVER (PARTITION BY m) - 1) / 2.0::DOUBLE) / n1 * 100 + 0.5))) AS BIGINT) AS affinity_index_v2 FROM q")
def affinity_v2(t: Tables) -> DataFrame:
    key = F.concat(F.lit("z"), F.round(F.col("origin_lat") * 20).cast("int").cast("string"), F.lit("_"), F.round(F.col("origin_lng") * 20).cast("int").cast("string"))
    rows = affinity_rows(t).groupBy(key.alias("zip")).agg(F.sum("total_visits").alias("total_visits"), F.sum("unique_devices").alias("unique_devices"), F.round(F.avg("avg_dwell"), 2).alias("avg_dwell"), F.round(F.avg("avg_frequency"), 2).alias("avg_frequency"))
    return affinity.index_v2(rows)


@query(AFFINITY_INPUT_SQL + "," + V2_SQL + """,
v1 AS (SELECT *, CAST(floor(least(100, total_visits / 2.0) + 0.5) AS BIGINT) AS affinity_index, CAST(greatest(1, least(100, floor((rank() OVER (ORDER BY m) - 1 + (count(*) OVER (PARTITION BY m) - 1) / 2.0::DOUBLE) / n1 * 100 + 0.5))) AS BIGINT) AS affinity_index_v2 FROM q)
SELECT zip AS zip_code, '' AS city, 'MX' AS country, affinity_index, affinity_index_v2, avg_dwell AS avg_dwell_min, avg_frequency, unique_devices, total_visits AS total_visit_days FROM v1""")
def affinity_export(t: Tables) -> DataFrame:
    rows = affinity_v2(t).withColumns({"city": F.lit(None).cast("string"), "country": F.lit("MX"), "affinity_index": F.floor(F.least(F.lit(100.0), F.col("total_visits") / 2) + 0.5)})
    return affinity.export_columns(rows)
