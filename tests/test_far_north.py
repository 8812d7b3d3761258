"""Joins on the sphere at any latitude, and greedy thinning of long chains."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from wayfare.functions import geo
from wayfare.operators import affinity, poi_sets
from wayfare.plans import QUERIES, SQL


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


PLACES = {"equator": (0.0, 0.0), "mid": (48.0, 11.0), "north": (71.0, 25.0), "far_north": (84.0, 20.0), "pole": (89.9, 100.0), "south": (-72.0, -60.0), "date_line": (66.0, 179.99), "date_line_south": (-17.0, -179.99)}


def around(name, n=60, spread=0.6):
    lat, lng = PLACES[name]
    rng = random.Random(name)
    wrap = lambda x: (x + 180) % 360 - 180
    return [(i, max(-90.0, min(90.0, lat + rng.uniform(-spread, spread))), wrap(lng + rng.uniform(-spread, spread) / max(0.01, math.cos(math.radians(lat)))), float(rng.randrange(1, 9))) for i in range(n)]


@pytest.mark.parametrize("name", PLACES)
def test_gaussian_field(spark, name):
    rows = around(name)
    df = spark.createDataFrame(rows, "id long, lat double, lng double, intensity double")
    got = {r["id"]: r["heat"] for r in geo.gaussian_field(df.select("id", "lat", "lng"), df.select("lat", "lng", "intensity"), sigma_km=8.0).collect()}
    for i, lat, lng, _ in rows:
        want = sum(w * math.exp(-(d * d) / 128) for _, a, b, w in rows if (d := km(lat, lng, a, b)) <= 24)
        assert got[i] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("name", ["mid", "north", "date_line"])
def test_smoothed(spark, name):
    rows = [(f"s{i % 2}", str(i), lat, lng, int(w)) for i, lat, lng, w in around(name)]
    df = spark.createDataFrame(rows, "source string, zip string, lat double, lng double, devices long")
    got = {(r["source"], r["zip"]): r["score_smoothed"] for r in affinity.smoothed(df).collect()}
    heat = {(s, z): round(sum(w * math.exp(-(d * d) / 288) for t, _, a, b, w in rows if t == s and (d := km(lat, lng, a, b)) <= 36), 9) for s, z, lat, lng, _ in rows}
    top = {s: max(v for (t, _), v in heat.items() if t == s) for s in ("s0", "s1")}
    assert got == {(s, z): max(1, math.floor(100 * math.log(h + 1) / math.log(top[s] + 1) + 0.5)) for (s, z), h in heat.items()}


def swept(rows, radius_m):
    kept = []
    for i, _, lat, lng in sorted(rows, key=lambda r: (r[1], r[0])):
        if all(km(lat, lng, a, b) * 1000 > radius_m for _, a, b in kept):
            kept.append((i, lat, lng))
    return sorted(k[0] for k in kept)


def places(spark, rows):
    return spark.createDataFrame(rows, "id string, position long, latitude double, longitude double")


@pytest.mark.parametrize("name", PLACES)
def test_greedy_anywhere(spark, name):
    rows = [(f"p{i}", (i * 37) % 60, lat, lng) for i, lat, lng, _ in around(name, spread=0.2)]
    assert sorted(r["id"] for r in poi_sets.greedy_distinct(places(spark, rows), radius_m=6000.0).collect()) == swept(rows, 6000.0)


def test_a_chain_of_ten_thousand(spark):
    """Each place is within reach of the next only; and a bent chain beside it with other steps."""
    step = 40 / 111_320
    rows = [(f"a{i:05d}", i, 10 + i * step, 20.0) for i in range(10_000)]
    got = sorted(r["id"] for r in poi_sets.greedy_distinct(places(spark, rows)).collect())
    assert got == [f"a{i:05d}" for i in range(0, 10_000, 2)]


def test_components_and_sweep_agree_with_rounds(spark):
    rng = random.Random(3)
    rows = [(f"b{i:04d}", rng.randrange(300), 10 + rng.randrange(80) / 3000, 20 + rng.randrange(80) / 3000) for i in range(1200)]
    want = swept(rows, 60.0)
    df = places(spark, rows)
    for options in ({}, {"rounds": 1}, {"rounds": 1, "sweep_pairs": 6}):
        assert sorted(r["id"] for r in poi_sets.greedy_distinct(df, radius_m=60.0, **options).collect()) == want


def test_distinct_places_beyond_the_globe(spark, data, tmp_path):
    """Longitudes of a large catalogue run beyond 180: the SQL compares them as numbers, so that places 360 degrees apart don't meet."""
    turn = 360 * 64 * 10
    parts = [(k, "small ring", "Brand#1") for k in [*range(40), *range(turn, turn + 40)]]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{data}/sf0.001/events.parquet'")
    want = sorted(r[0] for r in con.execute(SQL["distinct_places"]).fetchall())
    assert sorted(r["id"] for r in QUERIES["distinct_places"](spark, str(tmp_path)).collect()) == want
    assert len(want) == 40


def test_places_meet_across_the_date_line_unless_told(spark):
    rows = places(spark, [("a", 0, 10.0, 179.9999), ("b", 1, 10.0, -179.9999), ("c", 2, 10.0, 539.9999)])
    assert sorted(r["id"] for r in poi_sets.greedy_distinct(rows).collect()) == ["a"]
    assert sorted(r["id"] for r in poi_sets.greedy_distinct(rows, globe=False).collect()) == ["a", "b", "c"]


def test_rounds_take_only_blocks_that_learn_something(spark, monkeypatch):
    """A chain through eight blocks: each is taken once at first, and once when the block before it is decided."""
    n, taken = 3000, []
    street = spark.range(n).select("id", F.col("id").alias("position"), F.lit(0.0).alias("latitude"), (F.col("id") * 0.0002).alias("longitude"))

    def spy(sides, schema, f=poi_sets._swept):
        taken.append(sides.select("here").distinct().count())
        return f(sides, schema)

    monkeypatch.setattr(poi_sets, "_swept", spy)
    assert sorted(r["id"] for r in poi_sets.greedy_distinct(street, radius_m=50.0, sweep_pairs=750).collect()) == list(range(0, n, 3))
    assert 7 <= taken[0] <= 9 and set(taken[1:]) == {1} and len(taken) <= taken[0]
