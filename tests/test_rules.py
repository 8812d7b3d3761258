"""Rules on hand-sized cases, and joins that the registered queries' data do not reach."""

import random
from datetime import datetime, timedelta
from math import asin, cos, radians, sin, sqrt

import pytest
from pyspark.sql import functions as F
from wayfare.functions.geo import planar_m, spatial_join
from wayfare.operators import compare, filters, homes, poi_sets, postal, reports
from wayfare.sources.fixtures import Tables


def pings_of(spark, rows):
    return spark.createDataFrame([(i, str(ts)[:10], ts, 19.0, -99.0) for i, ts in rows], "ad_id string, date string, utc_timestamp timestamp_ntz, lat double, lng double")


def days_of(device, hours, n=15):
    start = datetime(2024, 3, 1)
    return [(device, start + timedelta(days=d, hours=h)) for d in range(n) for h in hours]


def test_employees_and_residents(spark):
    rows = [
        *days_of("worker", (9, 13, 18)),
        *days_of("evening", (15.99, 19.97)),  # before 20h is work, and 238 whole minutes are too few
        *days_of("late", (14, 20)),  # 20h is no work: half of the pings
        *days_of("sleeper", (3, 12, 17)),
        *days_of("five", (5, 9.5, 12)),  # 5h is no night
        *days_of("few", (9, 18), 14),
        *days_of("mixed", (9, 12, 15, 18), 9), *days_of("mixed", (21, 22, 23, 23.9), 9)[36:],
    ]
    df = pings_of(spark, rows)
    assert {r[0] for r in filters.employee_ids(df).collect()} == {"worker", "five"}
    assert {r[0] for r in filters.resident_ids(df).collect()} == {"sleeper"}
    one_night = pings_of(spark, [*days_of("w", (9, 18)), ("w", datetime(2024, 3, 2, 2)), ("w", datetime(2024, 3, 3, 4, 59))])
    assert filters.routine(one_night).first()["overnight_share"] == pytest.approx(2 / 15)


def test_shares_are_means_of_days(spark):
    """A day of one ping weighs as much as one of many."""
    rows = [("d", datetime(2024, 3, 1, 9))] + [("d", datetime(2024, 3, 2, 21, m)) for m in range(9)]
    assert filters.routine(pings_of(spark, rows)).first()["work_share"] == pytest.approx(0.5)


def test_audience_estimate(spark):
    counts = spark.createDataFrame([(1000,), (0,), (3_000_000,)], "maids long")
    year = homes.audience_estimate(counts, first="2024-01-01", last="2024-06-01", now="2024-06-01", kappa=0.8, ceiling_millions=2.0)
    assert [tuple(r) for r in year.orderBy("maids").collect()] == [(0, None, None, None), (1000, 800, 800, False), (3_000_000, 2_400_000, 2_400_000, True)]
    long = homes.audience_estimate(counts, first="2020-01-01", last="2024-01-01", now="2025-01-01", kappa=1.0, ceiling_millions=0.0).filter("maids = 1000").first()
    churn = 1 + (1461 / 30.44 - 12) / 12
    assert long["unique_users"] == round(1000 / churn) and long["users_today"] == round(1000 / churn * 0.5 ** (366 / 30.44 / 12)) and long["over_ceiling"] is False


def plain_m(a, b):
    return 111320 * sqrt((a[0] - b[0]) ** 2 + ((a[1] - b[1]) * cos(radians((a[0] + b[0]) / 2))) ** 2)


@pytest.mark.parametrize("broadcast", [True, False])
def test_own_radii_at_any_latitude(spark, broadcast):
    rng = random.Random(7)
    places = [(i, rng.choice([0.0, 45.0, 64.0, 78.0, -70.0]) + rng.random() / 5, rng.random() / 2, rng.choice([None, 50.0, 900.0, 10_000.0])) for i in range(60)]
    points = [(i, p[1] + rng.uniform(-0.1, 0.1), p[2] + rng.uniform(-0.3, 0.3)) for i, p in enumerate(rng.choices(places, k=3000))]
    pings = spark.createDataFrame(points, "n long, lat double, lng double")
    pois = spark.createDataFrame(places, "poi_id long, poi_lat double, poi_lng double, poi_radius_m double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        if not broadcast:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        met = spatial_join(pings, pois, radius_m=300.0)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoop" not in plan and (broadcast or "BroadcastHashJoin" not in plan)
        got = sorted((r["n"], r["poi_id"]) for r in met.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = sorted((n, k) for n, a, b in points for k, x, y, r in places if plain_m((a, b), (x, y)) <= (r or 300.0))
    assert got == want and len(got) > 500


def test_a_wide_place_from_afar(spark):
    pings = spark.createDataFrame([(1, 19.048, -99.0), (2, 19.2, -99.0)], "n long, lat double, lng double")
    pois = spark.createDataFrame([(19.0, -99.0, 10_000.0)], "poi_lat double, poi_lng double, poi_radius_m double")
    assert [r["n"] for r in spatial_join(pings, pois).collect()] == [1]


def plain_greedy(places, radius):
    def far(a, b):
        h = sin(radians(b[1] - a[1]) / 2) ** 2 + cos(radians(a[1])) * cos(radians(b[1])) * sin(radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371000 * asin(min(1, sqrt(h))) > radius

    kept = []
    for p in sorted(places, key=lambda p: (p[3], p[0])):
        if all(far(p, q) for q in kept):
            kept.append(p)
    return {p[0] for p in kept}


def test_greedy_places(spark):
    rng = random.Random(9)
    places = [(f"p{i}", 40 + rng.random() / 300, 3 + rng.random() / 300, rng.randrange(100)) for i in range(150)]
    df = spark.createDataFrame(places, "id string, latitude double, longitude double, position int")
    assert {r[0] for r in poi_sets.greedy_distinct(df).collect()} == plain_greedy(places, 50)
    street = [(f"s{i:02d}", 40 + i * 0.0003, 3.0, i) for i in range(24)]
    chain = spark.createDataFrame(street, "id string, latitude double, longitude double, position int")
    assert {r[0] for r in poi_sets.greedy_distinct(chain).collect()} == plain_greedy(street, 50)
    # the links that rounds leave are swept by component
    assert {r[0] for r in poi_sets.greedy_distinct(chain, rounds=2).collect()} == plain_greedy(street, 50)


def test_medians_that_users_get(spark, data):
    """The approximate middle of night positions lies within a rank error of a thousandth."""
    t = Tables(spark, f"{data}/sf0.01")
    pings = filters.valid_pings(t.pings, max_accuracy=200.0)
    night = pings.filter("(hour(utc_timestamp) >= 20 or hour(utc_timestamp) < 4) and size(poi_ids) = 0")
    values = {}
    for r in night.select("ad_id", F.round("lat", 4).alias("lat")).collect():
        values.setdefault(r["ad_id"], []).append(r["lat"])
    rows = homes.residential(pings).collect()
    assert len(rows) > 100
    for r in rows:
        own = sorted(values[r["ad_id"]])
        low, high = sum(v < r["home_lat"] for v in own), sum(v <= r["home_lat"] for v in own)
        assert low / len(own) - 0.001 <= 0.5 <= high / len(own) + 0.001
    dwell = spark.createDataFrame([("plain", "x", float(v), f"u{v}") for v in range(1001)], "attr_type string, attr_value string, dwell_minutes double, ad_id string")
    assert abs(compare.master_stats(dwell).first()["median_dwell"] - 500) <= 1


def test_median_visit_times(spark):
    start = datetime(2024, 3, 1, 8)
    marked = pings_of(spark, [("u", start + timedelta(minutes=m)) for m in (0, 10, 30, 31, 90)])
    assert reports.median_visit_times(marked).first()["visit_time"] == start + timedelta(minutes=30)


def test_contribution_count(spark):
    assert compare.contribution_count(spark.createDataFrame([("a",), ("b",), ("a",)], "ad_id string")).first()["devices"] == 2


def test_planar_distance(spark):
    row = spark.range(1).select(planar_m(*[F.lit(x) for x in (19.0, -99.0, 19.001, -99.002)]).alias("m")).first()
    assert row["m"] == pytest.approx(plain_m((19.0, -99.0), (19.001, -99.002)))


def test_first_ping_of_a_day(spark):
    rows = [("u", "2024-03-01", datetime(2024, 3, 1, 23), 1.0, 1.0, "B"), ("u", "2024-03-01", datetime(2024, 3, 1, 6), 2.0, 2.0, "A"), ("u", "2024-03-02", datetime(2024, 3, 2, 7), 3.0, 3.0, "A")]
    df = spark.createDataFrame(rows, "ad_id string, date string, utc_timestamp timestamp_ntz, lat double, lng double, zip string")
    df = df.withColumns({"region": F.lit("R"), "city": F.lit("C"), "h3": F.lit("h"), "origin_type": F.lit("gps"), "circle": F.lit(0.5)})
    got = postal.zip_devices(df, df.select("ad_id"), ["A", "B"]).collect()
    assert [(r["zip"], r["device_days"], r["avg_lat"], r["morning_dd"]) for r in got] == [("A", 2, 2.5, 2)]


def test_summary_of_nothing_and_of_all():
    assert reports.executive_summary(reports.SummaryInput(subject="X")) == {"headline": "X: analysis ready.", "bullets": [], "paragraph": ""}
    got = reports.executive_summary(
        reports.SummaryInput("X", 12345, None, 7, 3, "2024-01-01", "2024-01-01", {70: (10, 70.2), 80: (14, 80.0), 90: (20, 9.96)}, 40, None, (0, 12.5), (7, 9.94), None, 30.5, 2.25, None, None, (5, "Late", 33.3))
    )
    assert got["headline"] == "X: 12,345 unique devices; top 14 zips capture 80%."
    assert got["bullets"] == [
        "**Scale**: 12,345 unique devices across 7 visit-days to 3 POIs (2024-01-01).",
        "**Addressable core**: the top 10 zip codes (25% of 40 measured) hold 70% of the catchment; the top 20 hold 10.0%.",
        "**Timing**: peaks at 12AM (local time) (13% of daily traffic); busiest day is Sunday (9.9% of weekly traffic).",
        "**Engagement**: average dwell 31 min, median repeat frequency of 2.2 visits per device.",
        '**Personas**: 5 distinct audience segments identified; the dominant cluster "*Late*" represents 33% of the base.',
    ]
    assert got["paragraph"].startswith("X reached 12,345 unique devices (7 visit-days) between 2024-01-01. The addressable trade area") and got["paragraph"].endswith("Engagement signals show an average dwell of 31 minutes.")
    top = reports.executive_summary(reports.SummaryInput("X", top_zip=("06010", "", 4.0), device_days=9))
    assert top["bullets"][1] == "**Top zip**: 06010 delivers 4.0% of the catchment." and top["headline"] == "X: 9 device-days."
