"""Pings, points of interest and small dimensions, derived from the ``events`` and ``part`` tables.

All offsets are multiples of 1/1024 degree, so that every engine computes the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import div


class Tables:
    """The tables of one folder, each read when it is asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def pings(self) -> DataFrame:
        e = self.read("events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
        u = F.col("user_id")
        e = e.withColumns({"hx": u % 10, "hy": div(u, 10) % 10, "px": (u + F.col("k")) % 10, "py": div(u, 3) % 10, "night": (F.hour("ts") >= 19) | (F.hour("ts") < 7)})
        night = F.col("night")
        lat = F.lit(19.25) + F.when(night, F.col("hx") / 64 + 1 / 128).otherwise(F.col("px") / 64 + (F.col("event_id") % 4) / 1024)
        lng = F.lit(-99.25) + F.when(night, F.col("hy") / 64 + 1 / 128).otherwise(F.col("py") / 64)
        zipcode = F.when(night, F.concat(F.lit("1"), "hx", "hy", F.lit("00"))).otherwise(F.concat(F.lit("2"), "px", "py", F.lit("00")))
        poi = F.array(F.concat(F.lit("poi_"), (F.col("px") + 10 * F.col("py")).cast("string")))
        return e.select(
            F.concat(F.lit("u"), F.lpad(u.cast("string"), 6, "0")).alias("ad_id"),
            F.col("ts").alias("utc_timestamp"),
            F.date_format("ts", "yyyy-MM-dd").alias("date"),
            lat.alias("latitude"),
            lng.alias("longitude"),
            F.when(F.col("event_type") != "error", F.col("value") * 4).alias("horizontal_accuracy"),
            F.when(night, F.array().cast("array<string>")).otherwise(poi).alias("poi_ids"),
            F.lit("MX").alias("iso_country_code"),
            F.create_map(F.lit("zipcode"), zipcode, F.lit("region"), F.concat(F.lit("R"), "hx"), F.lit("city"), F.concat(F.lit("C"), "hy"), F.lit("h3_res10"), F.concat(F.lit("h"), "px", F.lit("_"), "py")).alias("geo_fields"),
            F.create_map(F.lit("ping_origin_type"), F.when(F.col("event_type") == "view", "cell").otherwise("gps"), F.lit("ping_circle_score"), (F.col("k") / 50).cast("string")).alias("quality_fields"),
        )

    @property
    def pois(self) -> DataFrame:
        k = F.col("p_partkey")
        categories = F.array(*map(F.lit, ("restaurant", "cafe", "gym", "car_dealer", "supermarket")))
        return self.read("part").select(
            F.concat(F.lit("poi_"), k.cast("string")).alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("brand"),
            F.get(categories, (k % 5).cast("int")).alias("category"),
            (F.lit(19.25) + (k % 10) / 64).alias("latitude"),
            (F.lit(-99.25) + div(k, 10) / 64).alias("longitude"),
            F.lit("MX").alias("country"),
            F.lit(200.0).alias("radius"),
        )

    @property
    def geocode(self) -> DataFrame:
        """lat_key, lng_key (tenths of a degree) and a zip code of each."""
        keys = self.pings.select(F.round(F.col("latitude") * 10).cast("int").alias("lat_key"), F.round(F.col("longitude") * 10).cast("int").alias("lng_key")).distinct()
        n = F.row_number().over(Window.orderBy("lat_key", "lng_key"))  # one row per cell of 11 km
        return keys.select("lat_key", "lng_key", F.concat(F.lit("9"), F.lpad(n.cast("string"), 4, "0")).alias("zipcode"))

    @property
    def nse(self) -> DataFrame:
        """postal_code, population and score (0 to 100) of each zip code."""
        zips = self.pings.select(F.col("geo_fields")["zipcode"].alias("postal_code")).distinct()
        n = F.row_number().over(Window.orderBy("postal_code")).cast("long")  # one row per zip code
        return zips.select("postal_code", (1000 + 137 * n).alias("population"), ((n * 17) % 101).cast("double").alias("nse"))

    @property
    def brands(self) -> DataFrame:
        return self.pois.select(F.col("id").alias("poi_id"), "brand")


#: DuckDB forms of the same tables, as common table expressions.
SQL = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ev2 AS (SELECT *, user_id % 10 AS hx, (user_id // 10) % 10 AS hy, (user_id + k) % 10 AS px, (user_id // 3) % 10 AS py, (hour(ts) >= 19 OR hour(ts) < 7) AS night FROM ev),
raw_pings AS (SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS ad_id, ts AS utc_timestamp, strftime(ts, '%Y-%m-%d') AS date,
  19.25::DOUBLE + CASE WHEN night THEN hx / 64.0::DOUBLE + 1.0::DOUBLE / 128 ELSE px / 64.0::DOUBLE + (event_id % 4) / 1024.0::DOUBLE END AS lat,
  -99.25::DOUBLE + CASE WHEN night THEN hy / 64.0::DOUBLE + 1.0::DOUBLE / 128 ELSE py / 64.0::DOUBLE END AS lng,
  CASE WHEN event_type <> 'error' THEN value * 4 END AS accuracy,
  CASE WHEN night THEN CAST([] AS VARCHAR[]) ELSE ['poi_' || CAST(px + 10 * py AS VARCHAR)] END AS poi_ids,
  CASE WHEN night THEN '1' || hx || hy || '00' ELSE '2' || px || py || '00' END AS zip, 'R' || hx AS region, 'C' || hy AS city, 'h' || px || '_' || py AS h3,
  CASE WHEN event_type = 'view' THEN 'cell' ELSE 'gps' END AS origin_type, k / 50.0::DOUBLE AS circle, 'MX' AS country FROM ev2),
pings AS (SELECT * FROM raw_pings WHERE accuracy IS NULL OR accuracy < 500),
pois AS (SELECT 'poi_' || p_partkey AS id, p_name AS name, p_brand AS brand, ['restaurant','cafe','gym','car_dealer','supermarket'][CAST(p_partkey % 5 AS INTEGER) + 1] AS category,
  19.25::DOUBLE + (p_partkey % 10) / 64.0::DOUBLE AS plat, -99.25::DOUBLE + (p_partkey // 10) / 64.0::DOUBLE AS plng, 200.0::DOUBLE AS radius FROM part),
near AS (SELECT p.*, o.id AS poi_id, o.category, o.plat, o.plng, 111320 * sqrt(pow(p.lat - o.plat, 2) + pow((p.lng - o.plng) * cos(radians((p.lat + o.plat) / 2)), 2)) AS distance
  FROM pings p JOIN pois o ON abs(p.lat - o.plat) < 0.02 AND abs(p.lng - o.plng) < 0.03),
at_poi AS (SELECT DISTINCT ad_id, date, utc_timestamp, lat, lng FROM near WHERE distance <= 200),
dwell AS (SELECT ad_id, date, min(utc_timestamp) AS arrival, max(utc_timestamp) AS departure, count(*) AS n, CAST(date_sub('second', min(utc_timestamp), max(utc_timestamp)) AS DOUBLE) AS seconds FROM at_poi GROUP BY ALL),
geocode AS (SELECT lat_key, lng_key, '9' || lpad(CAST(row_number() OVER (ORDER BY lat_key, lng_key) AS VARCHAR), 4, '0') AS zipcode FROM (SELECT DISTINCT CAST(round(lat * 10) AS INTEGER) AS lat_key, CAST(round(lng * 10) AS INTEGER) AS lng_key FROM raw_pings)),
nse AS (SELECT zip AS postal_code, 1000 + 137 * n AS population, CAST((n * 17) % 101 AS DOUBLE) AS score FROM (SELECT zip, row_number() OVER (ORDER BY zip) AS n FROM (SELECT DISTINCT zip FROM raw_pings)))
"""
