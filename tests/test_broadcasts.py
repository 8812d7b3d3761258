"""Sides that grow with the catalogue are not broadcast, whatever the planner takes their size for."""

from pyspark.sql import functions as F
from wayfare.functions import geo


def test_many_cells_are_not_broadcast(spark):
    # the planner takes these for a megabyte; their cells are some hundred thousand rows
    pois = spark.range(40_000).select(F.col("id").alias("poi_id"), (59 + F.col("id") % 200 / 64).alias("poi_lat"), (F.col("id") / 640).alias("poi_lng"))
    pings = pois.filter("poi_id % 1000 = 0").select(F.col("poi_lat").alias("lat"), F.col("poi_lng").alias("lng"), F.col("poi_id").alias("own"))
    met = geo.spatial_join(pings, pois, radius_m=900.0)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert met.filter("own = poi_id").count() == 40
    few = geo.spatial_join(pings, pois.filter("poi_id < 1000"), radius_m=900.0)
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()


def test_long_chain_takes_a_round_for_each_block(spark, monkeypatch):
    from wayfare.operators import poi_sets

    # a street of places in rising order, each within reach of the next two, in eight blocks: it took a round for every third place
    n = 3000
    street = spark.range(n).select("id", F.col("id").alias("position"), F.lit(0.0).alias("latitude"), (F.col("id") * 0.0002).alias("longitude"))
    rounds = []
    monkeypatch.setattr(poi_sets, "append", lambda df, path, f=poi_sets.append: rounds.append(1) or f(df, path))
    got = sorted(r["id"] for r in poi_sets.greedy_distinct(street, radius_m=50.0, sweep_pairs=750).collect())
    assert got == list(range(0, n, 3))
    assert len(rounds) <= 12


def test_places_elsewhere_do_not_shuffle_the_pings(spark):
    # beyond the limit of cells, of which a hundred lie among the pings
    pois = spark.range(120_000).select(F.col("id").alias("poi_id"), (19 + F.col("id") % 10 / 64).alias("poi_lat"), (-99 + F.floor(F.col("id") / 10) / 640).alias("poi_lng"), F.lit("cafe").alias("category"))
    pings = spark.range(1000).select(F.col("id").cast("string").alias("ad_id"), F.lit("2024-01-01").alias("date"), F.expr("timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(0, 0, int(id % 90))").alias("utc_timestamp"), (19 + F.col("id") % 10 / 64).alias("lat"), (-99 + F.col("id") % 7 / 640).alias("lng"))
    met = geo.at_poi_pings(pings, pois)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert met.count() == 1000


def test_places_among_pings_lose_no_pair(spark, monkeypatch):
    # own radii, far north and south, around the middle of the globe, from outside of the box, and pings without a place
    rows = [(i, (i * 37 % 160) - 80 + 0.003 * (i % 7), (i * 53 % 20) - 10 + 0.004 * (i % 5), 100.0 * (1 + i % 40)) for i in range(400)]
    pois = spark.createDataFrame(rows, "poi_id long, poi_lat double, poi_lng double, poi_radius_m double")
    pings = [("a", lat + 0.01 * (i % 3), lng + 0.01 * (i % 4)) for i, lat, lng, _ in rows] + [("b", None, 1.0), ("b", 1.0, None)]
    seen = spark.createDataFrame(pings, "ad_id string, lat double, lng double")
    some = lambda df: sorted(map(tuple, df.select("lat", "lng", "poi_id").collect()))
    for part in (seen, seen.filter("lat between -70 and 20 and lng between -3 and 6.005"), seen.filter("lat > 79"), seen.filter("ad_id = 'b'")):
        want = some(geo.spatial_join(part, pois))
        with monkeypatch.context() as m:
            m.setattr(geo, "MOST_BROADCAST", 0)
            near = geo.among(pois, part)
        assert some(geo.spatial_join(part, near)) == want
        assert near.count() < 400 or part is seen
        assert want or part.filter("ad_id = 'a'").count() == 0


def test_visits_take_their_columns_along(spark):
    from wayfare.operators import reports

    at = lambda t: F.to_timestamp_ntz(F.lit(f"2024-01-01 {t}"))
    ping = lambda who, t, lat: spark.range(1).select(F.lit(who).alias("ad_id"), F.lit("2024-01-01").alias("date"), at(t).alias("utc_timestamp"), F.lit(lat).alias("lat"), F.lit(1.0).alias("lng"))
    pings = ping("a", "10:00:30", 1.0)
    for who, t, lat in (("a", "09:30:00", 1.0), ("a", "09:40:00", 1.001), ("a", "12:00:00", 2.0), ("a", "13:00:00", 1.0), ("a", "11:00:00", 5.0), ("b", "10:30:00", 1.0)):
        pings = pings.unionByName(ping(who, t, lat))
    visits = spark.range(1).select(F.lit("a").alias("ad_id"), F.lit("2024-01-01").alias("date"), at("10:00:00").alias("visit_time"), F.lit(7.5).alias("dwell_minutes"))
    places = spark.createDataFrame([(1, 1.0, 1.0, "gym"), (2, 1.0, 1.0005, "gym"), (3, 2.0, 1.0, "cafe"), (4, 1.0, 1.0, "bar")], "poi_id long, poi_lat double, poi_lng double, category string")
    got = reports.around_visits(pings, visits, places)
    assert got.columns == ["ad_id", "date", "timing", "category", "dwell_minutes"]
    day = ("a", "2024-01-01")
    assert sorted(map(tuple, got.collect())) == [(*day, "after", "cafe", 7.5), (*day, "before", "bar", 7.5), (*day, "before", "gym", 7.5)]
