"""The split grid join: the same rows as the plain one, and even tasks where one cell holds a third of the pings."""

import statistics

import pytest
from pyspark.sql import functions as F
from wayfare.functions.geo import as_targets, spatial_join
from wayfare.operators import filters, hot_cells
from wayfare.sources.fixtures import Tables


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def crowd(spark):
    """200,000 pings: 30 % in one cell (a third of these at one spot), the rest over a city and its surroundings."""
    u = spark.range(200_000).select("id", (F.rand(1)).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"))
    hot, spot = F.col("c") < 0.3, F.col("c") < 0.1
    lat = F.when(spot, 19.4342).when(hot, 19.43 + F.col("a") / 100).otherwise(19.0 + F.col("a"))
    lng = F.when(spot, -99.1342).when(hot, -99.14 + F.col("b") / 100).otherwise(-99.6 + F.col("b"))
    pings = u.select(F.concat(F.lit("u"), F.col("id") % 999).alias("ad_id"), F.lit("2024-01-01").alias("date"), "id", lat.alias("lat"), lng.alias("lng")).persist()
    pois = spark.range(800).select(F.concat(F.lit("p"), "id").alias("poi_id"), (19.0 + F.rand(4)).alias("poi_lat"), (-99.6 + F.rand(5)).alias("poi_lng"))
    near = spark.range(40).select(F.concat(F.lit("n"), "id").alias("poi_id"), (19.425 + F.rand(6) / 50).alias("poi_lat"), (-99.145 + F.rand(7) / 50).alias("poi_lng"))
    return pings, pois.unionByName(near).persist()


def test_same_rows(crowd):
    pings, pois = crowd
    want = rows(spatial_join(pings, pois))
    assert len(want) > 10_000
    assert rows(hot_cells.spatial_join_even(pings, pois)) == want
    assert rows(hot_cells.spatial_join_even(pings, pois, most=50)) == want
    assert rows(hot_cells.spatial_join_even(pings, pois, most=10**9)) == want


def test_own_radii_and_the_north(crowd):
    pings, pois = crowd
    far = pois.withColumn("poi_lat", F.col("poi_lat") + 50).withColumn("poi_radius_m", F.when(F.substring("poi_id", 2, 9).cast("int") % 3 == 0, 90.0).when(F.substring("poi_id", 2, 9).cast("int") % 50 == 1, 4000.0).otherwise(F.lit(None)))
    north = pings.withColumn("lat", F.col("lat") + 50).filter("id % 10 = 0")
    assert rows(hot_cells.spatial_join_even(north, far, radius_m=300.0, most=100)) == rows(spatial_join(north, far, radius_m=300.0))


def test_tasks_are_even(spark, crowd):
    """Without broadcasts, the largest partition of the join's left side is at most five times the median."""
    pings, pois = crowd
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(old, ("-1", "false", "32"), strict=True):
        spark.conf.set(k, v)
    try:
        # a distance that all pairs of a key have, so that partitions show all pings
        wide = pois.select("poi_id", "poi_lat", "poi_lng")

        def sizes(join):
            per = join(pings, wide).groupBy(F.spark_partition_id().alias("p"), "ad_id", "id").count().groupBy("p").count().collect()
            return sorted(r["count"] for r in per)

        plain, even = sizes(spatial_join), sizes(hot_cells.spatial_join_even)
        assert max(plain) > 5 * statistics.median(plain)
        assert max(even) <= 5 * statistics.median(even)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_registered_pings(spark, data):
    t = Tables(spark, f"{data}/sf0.01")
    pings, targets = filters.valid_pings(t.pings), as_targets(t.pois, "category")
    assert rows(hot_cells.spatial_join_even(pings, targets)) == rows(spatial_join(pings, targets))


def test_empty(crowd):
    pings, pois = crowd
    assert hot_cells.spatial_join_even(pings.limit(0), pois).collect() == []
    assert hot_cells.spatial_join_even(pings.filter("id < 50"), pois.limit(0)).collect() == []
