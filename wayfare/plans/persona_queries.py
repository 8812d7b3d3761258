"""Queries for personas, look-alikes, brands and their postal affinity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import materialize
from ..functions.numbers import medians
from ..operators import affinity, compare, personas, segments
from ..sources.fixtures import Tables
from .homes_queries import ZIP_SQL
from .registry import query
from .visits_queries import at_poi, valid

LAST_DAY = "2024-01-31"
SHARE = "avg(CASE WHEN {} THEN 1.0::DOUBLE ELSE 0 END)"
FEATURES_SQL = f"""
qualified AS (SELECT *, CAST(hour(arrival) AS INTEGER) AS h, isodow(arrival) AS d FROM dwell WHERE n >= 2 AND seconds >= 120),
visit_part AS (SELECT ad_id, count(DISTINCT date) AS total_visits, sum(seconds / 60) AS total_dwell_min, avg(seconds / 60) AS avg_dwell_min, date_diff('day', max(CAST(date AS DATE)), DATE '{LAST_DAY}') AS recency_days,
  {SHARE.format('h >= 5 AND h < 11')} AS morning_share, {SHARE.format('h >= 11 AND h < 14')} AS midday_share, {SHARE.format('h >= 14 AND h < 18')} AS afternoon_share, {SHARE.format('h >= 18 AND h < 22')} AS evening_share,
  {SHARE.format('h >= 22 OR h < 5')} AS night_share, {SHARE.format('d >= 6')} AS weekend_share, {SHARE.format('d = 5 AND h BETWEEN 19 AND 23')} AS friday_evening_share
  FROM qualified GROUP BY 1 HAVING count(DISTINCT date) >= 2),
mobility_part AS (SELECT ad_id, count(DISTINCT h3) AS unique_h3_cells, avg(CASE WHEN origin_type = 'gps' THEN 1.0::DOUBLE ELSE 0 END) AS gps_share, avg(circle) AS avg_circle_score,
  111.32 * sqrt(pow(max(lat) - min(lat), 2) + pow((max(lng) - min(lng)) * cos(radians((max(lat) + min(lat)) / 2)), 2)) / 2 AS gyration_km FROM pings GROUP BY 1),
brand_map AS (SELECT id AS poi_id, lower(replace(brand, '#', '_')) AS brand FROM pois),
brand_days AS (SELECT ad_id, brand, count(DISTINCT date) AS visits FROM (SELECT ad_id, date, unnest(poi_ids) AS poi_id FROM pings) JOIN brand_map USING (poi_id) GROUP BY 1, 2),
brand_part AS (SELECT ad_id, '{{' || string_agg('"' || brand || '":' || visits, ',' ORDER BY brand) || '}}' AS brand_visits_json, CASE WHEN sum(visits) >= 5 THEN CAST(sum(visits * visits) AS DOUBLE) / (CAST(sum(visits) AS DOUBLE) * sum(visits)) ELSE 0 END AS brand_loyalty_hhi FROM brand_days GROUP BY 1),
{ZIP_SQL.strip()},
features AS (SELECT v.*, m.gyration_km, m.unique_h3_cells, z.home_zip, z.home_region, c.home_lat, c.home_lng, coalesce(m.gps_share, 0) AS gps_share, coalesce(m.avg_circle_score, 9.99) AS avg_circle_score, b.brand_visits_json, coalesce(b.brand_loyalty_hhi, 0) AS brand_loyalty_hhi,
  coalesce(m.gps_share, 0) > 0.7 AND coalesce(m.avg_circle_score, 9.99) < 1.0 AS tier_high_quality, 'all' AS source
  FROM visit_part v LEFT JOIN mobility_part m USING (ad_id) LEFT JOIN home_zips z USING (ad_id) LEFT JOIN home_points c USING (ad_id) LEFT JOIN brand_part b USING (ad_id))
"""


def brand_table(t: Tables) -> DataFrame:
    return t.brands.select("poi_id", F.lower(F.replace("brand", F.lit("#"), F.lit("_"))).alias("brand"))


def features(t: Tables) -> DataFrame:
    """Written once: what follows looks at them several times, and pings meet places a single time."""
    return materialize(personas.device_features(valid(t), at_poi(t), brand_table(t), LAST_DAY, source="all", exact=True), "features")


ROUNDED = ("total_dwell_min", "avg_dwell_min", "morning_share", "midday_share", "afternoon_share", "evening_share", "night_share", "weekend_share", "friday_evening_share", "gyration_km", "home_lat", "home_lng", "gps_share", "avg_circle_score", "brand_loyalty_hhi")


@query("SELECT p.ad_id, p.date, p.utc_timestamp, a.ad_id IS NOT NULL AS is_at_poi FROM pings p LEFT JOIN at_poi a USING (ad_id, date, utc_timestamp, lat, lng) WHERE p.ad_id IN (SELECT ad_id FROM at_poi GROUP BY 1 HAVING count(DISTINCT date) >= 2)")
def persona_visitor_pings(t: Tables) -> DataFrame:
    return personas.visitor_pings(valid(t), at_poi(t)).select("ad_id", "date", "utc_timestamp", "is_at_poi")


@query(FEATURES_SQL + f"SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in ROUNDED)}) FROM features")
def device_features(t: Tables) -> DataFrame:
    return features(t).withColumns({c: F.round(c, 9) for c in ROUNDED})


@query(FEATURES_SQL + "SELECT ad_id, unique_h3_cells, round(gps_share, 6) AS gps_share, round(avg_circle_score, 9) AS avg_circle_score, round(gyration_km, 6) AS gyration_km FROM mobility_part")
def mobility_features(t: Tables) -> DataFrame:
    return personas.mobility_features(valid(t), exact=True).select("ad_id", "unique_h3_cells", F.round("avg_circle_score", 9).alias("avg_circle_score"), *[F.round(c, 6).alias(c) for c in ("gps_share", "gyration_km")])


@query(FEATURES_SQL + "SELECT ad_id, brand_visits_json, round(brand_loyalty_hhi, 6) AS brand_loyalty_hhi FROM brand_part")
def brand_hhi(t: Tables) -> DataFrame:
    return personas.brand_features(personas.brand_days(valid(t), brand_table(t))).withColumn("brand_loyalty_hhi", F.round("brand_loyalty_hhi", 6))


#: Names for places by their number, as catalogues write them.
NAMES = ("Burger King Centro", "BURGER-KING 12", "McDonald's", "Mc Donald Sur", "KFC", "Kentucky Fried Chicken", "Telepizza", "Domino's Pizza", "PIZZA HUT", "Goikó Grill", "Five Guys", "Subway 7", "Taco Bell", "TacoBell", "Starbucks Café", "Tim Hortons", "Foster's Hollywood", "TGB", "TGB Norte", " The Good Burger ", "VIPS", "100 Montaditos", "Cien Montaditos", "La Tagliatella", "Café Ñandú", "", "Tienda 24")


def named_places(t: Tables) -> DataFrame:
    k = F.substring("id", 5, 20).cast("long")
    return t.pois.select("id", F.get(F.array(*map(F.lit, NAMES)), (k % len(NAMES)).cast("int")).alias("name"))


NAMED_SQL = f"named AS (SELECT id, [{', '.join(chr(39) + n.replace(chr(39), chr(39) * 2) + chr(39) for n in NAMES)}][CAST(CAST(substr(id, 5) AS BIGINT) % {len(NAMES)} AS INTEGER) + 1] AS name FROM pois)\n"


@query(NAMED_SQL + """, n AS (SELECT id, name, lower(strip_accents(trim(name))) AS s FROM named)
SELECT id, CASE WHEN regexp_matches(s, 'burger king|burger-king') THEN 'burger_king' WHEN regexp_matches(s, 'mcdonald|mc donald') THEN 'mcdonalds' WHEN regexp_matches(s, 'kfc|kentucky fried chicken') THEN 'kfc' WHEN contains(s, 'telepizza') THEN 'telepizza'
  WHEN contains(s, 'domino') THEN 'dominos' WHEN regexp_matches(s, 'pizza ?hut') THEN 'pizza_hut' WHEN contains(s, 'goiko') THEN 'goiko' WHEN contains(s, 'five guys') THEN 'five_guys' WHEN contains(s, 'subway') THEN 'subway' WHEN regexp_matches(s, 'taco ?bell') THEN 'taco_bell'
  WHEN contains(s, 'starbucks') THEN 'starbucks' WHEN contains(s, 'tim horton') THEN 'tim_hortons' WHEN contains(s, 'foster') THEN 'foster_hollywood' WHEN s IN ('tgb', 'the good burger') THEN 'tgb' WHEN contains(s, 'vips') THEN 'vips'
  WHEN regexp_matches(s, '(100|cien) montaditos') THEN '100_montaditos' WHEN contains(s, 'tagliatella') THEN 'tagliatella' ELSE 'other' END AS brand FROM n""")
def brand_resolution(t: Tables) -> DataFrame:
    return named_places(t).select("id", personas.resolve_brand(F.col("name")).alias("brand"))


@query(f"""
p AS (SELECT id, name, CASE WHEN CAST(substr(id, 5) AS BIGINT) % 40 = 0 THEN brand END AS own FROM pois),
words AS (SELECT DISTINCT id, word FROM (SELECT id, unnest(regexp_split_to_array(lower(strip_accents(trim(name))), '[\\s\\-,/.()&·|]+')) AS word FROM p) WHERE length(word) >= 2 AND NOT regexp_matches(word, '^[0-9]+$') AND word NOT IN ({', '.join(repr(w) for w in personas.STOPWORDS)})),
common AS (SELECT word, count(*) AS n FROM words GROUP BY 1 HAVING count(*) >= greatest(3, ceil((SELECT count(*) FROM p) * 0.005)) ORDER BY n DESC, word LIMIT 200),
best AS (SELECT id, word FROM words JOIN common USING (word) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n, word) = 1)
SELECT id, coalesce(lower(replace(own, '#', '_')), word, 'other') AS brand FROM p LEFT JOIN best USING (id)""")
def brand_discovery(t: Tables) -> DataFrame:
    k = F.substring("id", 5, 20).cast("long")
    return personas.discover_brands(t.pois.select("id", "name", F.when(k % 40 == 0, F.col("brand")).alias("brand_override")))


VECTOR_SQL = FEATURES_SQL + """,
vectors AS (SELECT ad_id, ln(1 + total_visits) AS log_total_visits, ln(1 + total_dwell_min) AS log_total_dwell_min, CAST(recency_days AS DOUBLE) AS recency_days, ln(1 + avg_dwell_min) AS log_avg_dwell_min, morning_share, midday_share, evening_share, night_share, weekend_share, ln(1 + gyration_km) AS log_gyration_km, brand_loyalty_hhi, ln(1 + unique_h3_cells) AS log_unique_h3_cells FROM features),
long AS (UNPIVOT vectors ON COLUMNS(* EXCLUDE (ad_id)) INTO NAME feature VALUE v),
mid AS (SELECT feature, quantile_cont(v, 0.5) AS m FROM long GROUP BY 1),
dev AS (SELECT feature, m, quantile_cont(abs(v - m), 0.5) AS s FROM long JOIN mid USING (feature) GROUP BY 1, 2)
"""


@query(VECTOR_SQL + "SELECT ad_id, feature, round((v - m) / CASE WHEN s > 1e-9 THEN s ELSE 1 END, 6) AS scaled FROM long JOIN dev USING (feature)")
def persona_vectors(t: Tables) -> DataFrame:
    scaled = personas.robust_scale(personas.feature_vector(features(t)))
    return scaled.select("ad_id", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(c, 6).alias("scaled")) for c in personas.VECTOR])))


@query()
def persona_clusters(t: Tables) -> DataFrame:
    """The fit is iterative; tests hold the assignment to the nearest centre and the silhouette to a plain one."""
    return personas.cluster(features(t))[0].select("ad_id", "cluster")


def by_number(rows: DataFrame) -> DataFrame:
    """Three groups that both sides can make, in place of fitted clusters."""
    return rows.select("ad_id", (F.substring("ad_id", 2, 6).cast("long") % 3).alias("cluster"))


def with_brackets(t: Tables, rows: DataFrame) -> DataFrame:
    return rows.join(t.nse.select(F.col("postal_code").alias("home_zip"), compare.bracket(F.col("nse")).alias("nse_bracket")), "home_zip", "left")


GROUPED_SQL = FEATURES_SQL + """,
grouped AS (SELECT CAST(substr(ad_id, 2) AS BIGINT) % 3 AS cluster, * FROM features)
"""
PROFILE_SQL = GROUPED_SQL + """,
plain AS (SELECT cluster, count(*) AS devices, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM features) AS percent_of_base, quantile_cont(total_visits::DOUBLE, 0.5) AS median_total_visits, quantile_cont(avg_dwell_min, 0.5) AS median_avg_dwell_min, quantile_cont(recency_days::DOUBLE, 0.5) AS median_recency_days,
  quantile_cont(weekend_share, 0.5) AS median_weekend_share, quantile_cont(gyration_km, 0.5) AS median_gyration_km, quantile_cont(brand_loyalty_hhi, 0.5) AS median_brand_loyalty_hhi, avg(evening_share) AS evening, avg(midday_share) AS lunch,
  avg(morning_share) AS s1, avg(midday_share) AS s2, avg(afternoon_share) AS s3, avg(evening_share) AS s4, avg(night_share) AS s5 FROM grouped GROUP BY 1)
"""


@query(PROFILE_SQL + """SELECT cluster, devices, round(percent_of_base, 6) AS percent_of_base, CASE greatest(s1, s2, s3, s4, s5) WHEN s1 THEN 'morning' WHEN s2 THEN 'midday' WHEN s3 THEN 'afternoon' WHEN s4 THEN 'evening' ELSE 'night' END AS peak_hour, round(greatest(s1, s2, s3, s4, s5), 6) AS peak_share,
  round(median_total_visits, 6) AS median_total_visits, round(median_avg_dwell_min, 6) AS median_avg_dwell_min, round(median_recency_days, 6) AS median_recency_days, round(median_weekend_share, 6) AS median_weekend_share, round(median_gyration_km, 6) AS median_gyration_km, round(median_brand_loyalty_hhi, 6) AS median_brand_loyalty_hhi FROM plain""")
def cluster_profiles(t: Tables) -> DataFrame:
    rows = features(t)
    p = personas.cluster_profiles(rows, by_number(rows))
    return p.select("cluster", "devices", "peak_hour", *[F.round(c, 6).alias(c) for c in ("percent_of_base", "peak_share", *[f"median_{m}" for m in personas.MEDIANS])])


@query(GROUPED_SQL + """,
counts AS (SELECT cluster, 'zip' AS part, home_zip AS value, count(*) AS n FROM grouped WHERE home_zip <> '' GROUP BY cluster, home_zip QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, home_zip) <= 5
UNION ALL SELECT cluster, 'brand', brand, count(*) FROM grouped JOIN brand_days USING (ad_id) GROUP BY ALL
UNION ALL SELECT cluster, 'nse', CASE WHEN score IS NULL THEN 'unknown' WHEN score < 20 THEN '0-19' WHEN score < 40 THEN '20-39' WHEN score < 60 THEN '40-59' WHEN score < 80 THEN '60-79' ELSE '80-100' END, count(*) FROM grouped LEFT JOIN nse ON home_zip = postal_code GROUP BY ALL)
SELECT cluster, part, value, n FROM counts""")
def cluster_mixes(t: Tables) -> DataFrame:
    rows = with_brackets(t, features(t))
    p = personas.cluster_profiles(rows, by_number(rows))
    part = lambda k: lambda x: F.struct(F.lit(k).alias("part"), x["value"].alias("value"), x["n"].alias("n"))
    each = F.concat(*[F.transform(c, part(k)) for k, c in (("zip", "top_zips"), ("brand", "brand_mix"), ("nse", "nse_histogram"))])
    return p.select("cluster", F.inline(each))


@query(PROFILE_SQL + """,
ends AS (SELECT list_sort(list(total_visits::DOUBLE)) AS a, list_sort(list(avg_dwell_min)) AS b, list_sort(list(recency_days::DOUBLE)) AS c, list_sort(list(gyration_km)) AS d, count(*) AS n FROM features),
e AS (SELECT a[n // 10 + 1] AS a1, a[n * 9 // 10 + 1] AS a9, b[n // 10 + 1] AS b1, b[n * 9 // 10 + 1] AS b9, c[n // 10 + 1] AS c1, c[n * 9 // 10 + 1] AS c9, d[n // 10 + 1] AS d1, d[n * 9 // 10 + 1] AS d9 FROM ends)
SELECT cluster, round(greatest(0, least(1, (median_total_visits - a1) / (a9 - a1))), 6) AS frequency, round(greatest(0, least(1, (median_avg_dwell_min - b1) / (b9 - b1))), 6) AS dwell, round(1 - greatest(0, least(1, CASE WHEN c9 > c1 THEN (median_recency_days - c1) / (c9 - c1) ELSE 0 END)), 6) AS recency,
  round(greatest(0, least(1, (median_gyration_km - d1) / (d9 - d1))), 6) AS mobility, round(median_weekend_share, 6) AS weekend, round(median_brand_loyalty_hhi, 6) AS loyalty, round(evening, 6) AS evening, round(lunch, 6) AS lunch FROM plain, e""")
def cluster_radar(t: Tables) -> DataFrame:
    rows = features(t)
    axes = personas.radar(personas.cluster_profiles(rows, by_number(rows)), rows)
    return axes.select("cluster", *[F.round(c, 6).alias(c) for c in axes.columns if c != "cluster"])


@query()
def cluster_names(t: Tables) -> DataFrame:
    """Names are made on the driver from a few rows; tests hold the rule to cases made by hand."""
    rows = features(t)
    own = by_number(rows)
    found = personas.named(*personas.naming_inputs(rows, own, personas.cluster_profiles(rows, own)))
    return t.spark.createDataFrame([(k, *v) for k, v in found.items()], "cluster long, name string, description string")


@query()
def persona_segments(t: Tables) -> DataFrame:
    """Names, profiles and look-alikes of the fitted clusters; an iterative fit has no SQL form, tests hold its parts to plain ones."""
    out = segments.segments(features(t))
    return out.select("cluster", "name", "description", "devices", F.round("percent_of_base", 6).alias("percent_of_base"), "peak_hour", "examples", *[f"lookalike_{m}" for m in segments.METHODS])


RFM_SQL = FEATURES_SQL + """,
s AS (SELECT list_sort(list(recency_days)) AS r, list_sort(list(total_visits)) AS f, list_sort(list(total_dwell_min)) AS m, count(*) AS n FROM features),
scored AS (SELECT CASE WHEN recency_days <= r[n // 3 + 1] THEN 'high' WHEN recency_days <= r[2 * n // 3 + 1] THEN 'mid' ELSE 'low' END AS r, (CASE WHEN total_visits <= f[n // 3 + 1] THEN 1 WHEN total_visits <= f[2 * n // 3 + 1] THEN 2 ELSE 3 END + CASE WHEN total_dwell_min <= m[n // 3 + 1] THEN 1 WHEN total_dwell_min <= m[2 * n // 3 + 1] THEN 2 ELSE 3 END) / 2.0 AS fm, recency_days, total_visits, total_dwell_min FROM features, s),
cells AS (SELECT r, CASE WHEN fm < 1.7 THEN 'low' WHEN fm < 2.7 THEN 'mid' ELSE 'high' END AS fm, count(*) AS devices, quantile_cont(recency_days::DOUBLE, 0.5) AS a, quantile_cont(total_visits::DOUBLE, 0.5) AS b, quantile_cont(total_dwell_min, 0.5) AS c FROM scored GROUP BY 1, 2),
labels(r, fm, label) AS (VALUES ('high', 'low', 'Promising'), ('high', 'mid', 'Promising'), ('high', 'high', 'Champions'), ('mid', 'low', 'Need Attention'), ('mid', 'mid', 'Loyal'), ('mid', 'high', 'Loyal+'), ('low', 'low', 'Lost'), ('low', 'mid', 'At Risk'), ('low', 'high', 'Can''t Lose')),
grid AS (SELECT r, fm, label, coalesce(devices, 0) AS devices, round(coalesce(devices, 0) * 100.0::DOUBLE / (SELECT count(*) FROM features), 6) AS percent, coalesce(a, 0) AS median_recency, coalesce(b, 0) AS median_frequency, round(coalesce(c, 0), 6) AS median_dwell FROM labels LEFT JOIN cells USING (r, fm))
"""


@query(RFM_SQL + "SELECT * FROM grid")
def rfm_grid(t: Tables) -> DataFrame:
    return personas.rfm(features(t)).withColumns({c: F.round(c, 6) for c in ("percent", "median_dwell")})


COHABIT_SQL = FEATURES_SQL + """,
held AS (SELECT ad_id, brand FROM brand_days WHERE ad_id IN (SELECT ad_id FROM features) AND visits > 0),
sizes AS (SELECT brand, count(*) AS n FROM held GROUP BY 1 HAVING count(*) >= 20),
met AS (SELECT a.brand AS brand_a, b.brand AS brand_b, count(*) AS i FROM held a JOIN held b ON a.ad_id = b.ad_id AND a.brand < b.brand GROUP BY 1, 2),
cohabit AS (SELECT a.brand AS brand_a, b.brand AS brand_b, coalesce(i, 0) AS intersection, round(coalesce(i, 0) / CAST(a.n + b.n - coalesce(i, 0) AS DOUBLE), 6) AS jaccard, round(coalesce(i, 0) / CAST(a.n AS DOUBLE), 6) AS share_a_to_b, round(coalesce(i, 0) / CAST(b.n AS DOUBLE), 6) AS share_b_to_a FROM sizes a JOIN sizes b ON a.brand < b.brand LEFT JOIN met m ON m.brand_a = a.brand AND m.brand_b = b.brand)
"""


def brand_pairs(t: Tables, rows: DataFrame) -> DataFrame:
    days = personas.brand_days(valid(t).join(rows.select("ad_id"), "ad_id", "left_semi"), brand_table(t))
    return personas.cohabitation(days, min_visitors=20)


@query(COHABIT_SQL + "SELECT * FROM cohabit")
def cohabitation(t: Tables) -> DataFrame:
    """At 20 visitors a brand, as the small tables have few devices."""
    return brand_pairs(t, features(t))


@query(FEATURES_SQL + """,
w AS (SELECT list_sort(list(weekend_share)) AS w, list_sort(list(gyration_km)) AS g, count(*) AS n FROM features)
SELECT count(*) AS devices, count(*) FILTER (tier_high_quality) AS high_quality, count(*) FILTER (total_visits >= 8) AS heavy, count(*) FILTER (total_visits BETWEEN 3 AND 7) AS regular, count(*) FILTER (total_visits < 3) AS light, count(*) FILTER (avg_dwell_min >= 30) AS long, count(*) FILTER (avg_dwell_min >= 5 AND avg_dwell_min < 30) AS medium, count(*) FILTER (avg_dwell_min < 5) AS short,
  round(avg(morning_share), 6) AS morning_share, round(avg(midday_share), 6) AS midday_share, round(avg(afternoon_share), 6) AS afternoon_share, round(avg(evening_share), 6) AS evening_share, round(avg(night_share), 6) AS night_share,
  round(any_value(w.w[w.n // 2 + 1]), 6) AS weekend_share_p50, round(any_value(w.w[w.n * 9 // 10 + 1]), 6) AS weekend_share_p90, round(any_value(w.g[w.n // 2 + 1]), 6) AS gyration_km_p50, round(any_value(w.g[w.n * 9 // 10 + 1]), 6) AS gyration_km_p90 FROM features, w""")
def persona_scorecard(t: Tables) -> DataFrame:
    card = personas.scorecard(features(t))
    return card.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in card.dtypes])


@query(RFM_SQL + "," + COHABIT_SQL.replace(FEATURES_SQL, "").lstrip(",\n") + """,
c AS (SELECT count(*) AS total, count(*) FILTER (brand_loyalty_hhi >= 0.7) AS loyalty, count(*) FILTER (weekend_share >= 0.6 AND total_visits >= 3) AS weekend_warriors, count(*) FILTER (night_share >= 0.4) AS late_night, count(*) FILTER (gyration_km > 0 AND gyration_km < 2) AS hyperlocal, count(*) FILTER (gyration_km > 50) AS road_trippers, count(*) FILTER (tier_high_quality) AS high_quality,
  (SELECT sum(devices) FROM grid WHERE label = 'Champions') AS rfm_champions, (SELECT sum(devices) FROM grid WHERE label IN ('At Risk', 'Lost')) AS rfm_at_risk FROM features)
SELECT id, printf('%.1f%%', 100.0::DOUBLE * n / total) AS value FROM (SELECT total, unnest(['loyalty', 'weekend_warriors', 'late_night', 'hyperlocal', 'road_trippers', 'high_quality', 'rfm_champions', 'rfm_at_risk']) AS id, unnest([loyalty, weekend_warriors, late_night, hyperlocal, road_trippers, high_quality, rfm_champions, rfm_at_risk]) AS n FROM c) WHERE n > 0
UNION ALL SELECT 'top_cohab', (SELECT replace(brand_a, '_', ' ') || ' ↔ ' || replace(brand_b, '_', ' ') || ' (Jaccard ' || printf('%.2f', jaccard) || ')' FROM cohabit ORDER BY jaccard DESC, brand_a, brand_b LIMIT 1)""")
def persona_insights(t: Tables) -> DataFrame:
    rows = features(t)
    found = personas.insights(rows, personas.rfm(rows), brand_pairs(t, rows))
    return t.spark.createDataFrame([(x[0], x[2]) for x in found], "id string, value string")


SEED_SQL = ", seed AS (SELECT ad_id FROM features WHERE CAST(substr(ad_id, 2) AS BIGINT) % 3 = 0)\n"


def seed(rows: DataFrame) -> DataFrame:
    return by_number(rows).filter("cluster = 0").select("ad_id")


@query(FEATURES_SQL + SEED_SQL + ", tops AS (SELECT home_zip FROM features JOIN seed USING (ad_id) WHERE home_zip <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)\nSELECT ad_id FROM features WHERE home_zip IN (FROM tops) AND ad_id NOT IN (FROM seed)")
def lookalike_zips(t: Tables) -> DataFrame:
    rows = features(t)
    tops = personas.cluster_profiles(rows, by_number(rows)).filter("cluster = 0").first()["top_zips"]
    return personas.lookalike_zips(rows, seed(rows), [x["value"] for x in tops])


@query(FEATURES_SQL + SEED_SQL + """,
m AS (SELECT quantile_cont(avg_dwell_min, 0.5) AS d, quantile_cont(weekend_share, 0.5) AS w, quantile_cont(recency_days::DOUBLE, 0.5) AS r, quantile_cont(gyration_km, 0.5) AS g, avg(midday_share) AS s FROM features JOIN seed USING (ad_id))
SELECT ad_id FROM features, m WHERE ad_id NOT IN (FROM seed) AND avg_dwell_min BETWEEN d * 0.4 AND d * 1.6 AND weekend_share BETWEEN greatest(0, w - 0.15) AND least(1, w + 0.15) AND recency_days BETWEEN greatest(0, r - 60) AND r + 60 AND gyration_km BETWEEN g * 0.3 AND g * 1.7 AND midday_share >= greatest(0, s - 0.2)""")
def lookalike_traits(t: Tables) -> DataFrame:
    rows = features(t)
    own = rows.join(seed(rows), "ad_id", "left_semi")
    names = ["avg_dwell_min", "weekend_share", "recency_days", "gyration_km"]
    middle = medians(own, names).first()
    return personas.lookalike_traits(rows, seed(rows), {c: middle[c] for c in names}, "midday", own.agg(F.avg("midday_share")).first()[0])


@query(FEATURES_SQL + SEED_SQL + """,
tops AS (SELECT brand FROM brand_days JOIN seed USING (ad_id) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)
SELECT ad_id FROM brand_days WHERE brand IN (FROM tops) AND ad_id IN (SELECT ad_id FROM features) AND ad_id NOT IN (FROM seed) GROUP BY 1 HAVING count(*) >= 3""")
def lookalike_brands(t: Tables) -> DataFrame:
    rows = features(t)
    tops = personas.cluster_profiles(rows, by_number(rows)).filter("cluster = 0").first()["brand_mix"]
    return personas.lookalike_brands(rows, seed(rows), [x["value"] for x in tops[:5]])


@query(FEATURES_SQL + SEED_SQL + "SELECT count(DISTINCT ad_id) AS devices FROM features WHERE ad_id NOT IN (FROM seed) AND weekend_share BETWEEN 0.1 AND 0.5")
def lookalike_count(t: Tables) -> DataFrame:
    rows = features(t)
    found = rows.filter(F.col("weekend_share").between(0.1, 0.5)).join(seed(rows), "ad_id", "left_anti")
    return compare.contribution_count(found.unionByName(found))


@query(FEATURES_SQL + "SELECT ad_id, total_visits, coalesce(CASE WHEN CAST(substr(ad_id, 2) AS BIGINT) % 4 > 0 THEN home_zip END, zipcode) AS home_zip FROM features LEFT JOIN geocode ON CAST(round(home_lat * 10) AS INTEGER) = lat_key AND CAST(round(home_lng * 10) AS INTEGER) = lng_key WHERE total_visits >= 2")
def persona_download(t: Tables) -> DataFrame:
    """The own zip of every fourth device is taken away, so that the cached one is seen."""
    rows = features(t).withColumn("home_zip", F.when(F.substring("ad_id", 2, 6).cast("long") % 4 > 0, F.col("home_zip")))
    return personas.download_rows(rows, t.geocode).select("ad_id", "total_visits", "home_zip")


@query(FEATURES_SQL + "SELECT coalesce(CASE WHEN score < 20 THEN '0-19' WHEN score < 40 THEN '20-39' WHEN score < 60 THEN '40-59' WHEN score < 80 THEN '60-79' WHEN score IS NOT NULL THEN '80-100' END, 'unknown') AS nse_bracket, count(*) AS devices FROM features LEFT JOIN nse ON home_zip = postal_code GROUP BY 1")
def persona_brackets(t: Tables) -> DataFrame:
    return with_brackets(t, features(t)).groupBy(F.coalesce("nse_bracket", F.lit("unknown")).alias("nse_bracket")).agg(F.count(F.lit(1)).alias("devices"))


PCT = "floor(greatest(0, least(100, (rank() OVER (PARTITION BY {p} ORDER BY {v}) - 1 + (count(*) OVER (PARTITION BY {p}, {v}) - 1) / 2.0::DOUBLE + 0.5) / count(*) OVER (PARTITION BY {p}) * 100)) + 0.5)"
ZIP_AFFINITY_SQL = FEATURES_SQL + f""",
src AS (SELECT * REPLACE ('s' || CAST(substr(ad_id, 2) AS BIGINT) % 2 AS source) FROM features),
per AS (SELECT source, home_zip AS zip, count(*) AS devices, round(avg(total_dwell_min) * ln(1 + avg(total_visits)), 9) AS loyal, avg(home_lat) AS lat, avg(home_lng) AS lng FROM src WHERE trim(home_zip) <> '' GROUP BY 1, 2),
far AS (SELECT p.*, population, 2 * 6371 * asin(least(1, sqrt(pow(sin(radians(19.3 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(19.3)) * pow(sin(radians(-99.2 - lng) / 2), 2)))) AS km, sum(devices) OVER (PARTITION BY source) AS every FROM per p LEFT JOIN (SELECT postal_code AS zip, population FROM nse WHERE population >= 200) n USING (zip)),
val AS (SELECT *, round(devices / CAST(population AS DOUBLE), 12) AS dense, round(devices / CAST(every AS DOUBLE) / exp(-km / 30), 9) AS over_ FROM far),
pct AS (SELECT *, {PCT.format(p='source', v='devices')} AS volume_pct, {PCT.format(p='source', v='loyal')} AS loyalty_pct, {PCT.format(p='source', v='over_')} AS lift_pct, CASE WHEN dense IS NOT NULL THEN {PCT.format(p='source, dense IS NULL', v='dense')} END AS density_pct FROM val),
raw AS (SELECT *, floor(exp((ln(greatest(0.5, volume_pct)) + ln(greatest(0.5, loyalty_pct)) + ln(greatest(0.5, lift_pct)) + CASE WHEN density_pct IS NULL THEN 0 ELSE ln(greatest(0.5, density_pct)) END) / CASE WHEN dense IS NULL THEN 3 ELSE 4 END) + 0.5) AS score_raw FROM pct),
apart AS (SELECT a.source, a.zip, b.devices, 2 * 6371 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) AS d FROM per a JOIN per b USING (source)),
heat AS (SELECT source, zip, round(sum(devices * exp(-(d * d) / 288.0::DOUBLE)), 9) AS h FROM apart WHERE d <= 36 GROUP BY 1, 2),
smooth AS (SELECT source, zip, greatest(1, floor(100 * ln(h + 1) / ln(max(h) OVER (PARTITION BY source) + 1) + 0.5)) AS score_smoothed FROM heat)
"""


PERCENTS = ("volume_pct", "density_pct", "loyalty_pct", "lift_pct", "score_raw", "score_smoothed")


@query(ZIP_AFFINITY_SQL + "SELECT source, zip, devices, CAST(volume_pct AS BIGINT) AS volume_pct, CAST(density_pct AS BIGINT) AS density_pct, CAST(loyalty_pct AS BIGINT) AS loyalty_pct, CAST(lift_pct AS BIGINT) AS lift_pct, CAST(score_raw AS BIGINT) AS score_raw, CAST(score_smoothed AS BIGINT) AS score_smoothed FROM raw JOIN smooth USING (source, zip)")
def persona_zip_affinity(t: Tables) -> DataFrame:
    rows = features(t).withColumn("source", F.concat(F.lit("s"), F.substring("ad_id", 2, 6).cast("long") % 2))
    population = t.nse.select(F.col("postal_code").alias("zip"), "population")
    centres = t.spark.createDataFrame([("s0", 19.3, -99.2), ("s1", 19.3, -99.2)], "source string, poi_lat double, poi_lng double")
    out = affinity.source_zip_affinity(rows, population, centres)
    return out.select("source", "zip", "devices", *[F.col(c).cast("long").alias(c) for c in PERCENTS])


@query(ZIP_AFFINITY_SQL + "SELECT source, zip, CAST(score_smoothed AS BIGINT) AS score_smoothed FROM smooth")
def zip_smoothing(t: Tables) -> DataFrame:
    rows = features(t).withColumn("source", F.concat(F.lit("s"), F.substring("ad_id", 2, 6).cast("long") % 2))
    per = rows.groupBy("source", F.col("home_zip").alias("zip")).agg(F.count(F.lit(1)).alias("devices"), F.avg("home_lat").alias("lat"), F.avg("home_lng").alias("lng"))
    return affinity.smoothed(per).select("source", "zip", F.col("score_smoothed").cast("long").alias("score_smoothed"))
