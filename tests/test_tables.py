"""Catalogue tables: no shuffle on bucketed keys, single days, streamed rows."""

import csv
import tracemalloc
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from wayfare.functions.geo import as_targets, at_poi_pings, closest_poi
from wayfare.operators import compare, filters, homes, visits
from wayfare.sources import readers, rows, tables
from wayfare.sources.fixtures import Tables


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    """Exchanges of the plan that ran, but for those that bring aggregates of whole tables to one row."""
    return [x for x in plan(df).split("== Initial Plan ==")[0].splitlines() if "Exchange" in x and "SinglePartition" not in x and "ReusedExchange" not in x]


def same(a, b):
    return sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))


@pytest.fixture(scope="module")
def made(spark, data):
    t = Tables(spark, f"{data}/sf0.01")
    pings, targets = filters.valid_pings(t.pings), as_targets(t.pois, "category")
    names = tables.save_visits(pings, targets, base="visits-of", run="a-1", buckets=4)
    half = pings.filter(F.hour("utc_timestamp") < 12)
    other = tables.save_visits(half, targets, base="visits-of", run="b-2", buckets=4)
    yield pings, targets, names, half, other
    names.drop(spark)
    other.drop(spark)


@pytest.fixture(scope="module")
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_saved_visits_are_the_batch_ones(spark, made):
    pings, targets, names, _, _ = made
    assert same(spark.table(names.at_poi), at_poi_pings(pings, targets))
    assert same(spark.table(names.dwell), visits.device_day_dwell(at_poi_pings(pings, targets)))
    assert same(spark.table(names.visits), visits.poi_visits(closest_poi(pings, targets)))


def test_reports_on_bucketed_tables_take_no_shuffle(spark, made, no_broadcast):
    pings, targets, names, half, other = made
    a, b = spark.table(names.ids), spark.table(other.ids)
    at, at_half = at_poi_pings(pings, targets), at_poi_pings(half, targets)
    common = compare.overlap_ids(a, b)
    assert shuffles(common) == []
    assert same(common, compare.overlap_ids(at, at_half))
    counted = compare.overlap(a, b)
    assert shuffles(counted) == []
    assert same(counted, compare.overlap(at, at_half))
    rows_ = spark.table(names.at_poi)
    for df, want in (
        (visits.device_day_dwell(rows_), visits.device_day_dwell(at)),
        (visits.dwell_between(rows_, low=5), visits.dwell_between(at, low=5)),
        (filters.only_humans(rows_), filters.only_humans(at)),
        (filters.employee_ids(rows_, min_days=2, min_dwell=1, work_share=0.1), filters.employee_ids(at, min_days=2, min_dwell=1, work_share=0.1)),
        (filters.without_ids(rows_, b), filters.without_ids(at, at_half.select("ad_id").distinct())),
    ):
        assert shuffles(df) == []
        assert same(df, want)


def test_homes_and_features_on_bucketed_pings(spark, made, no_broadcast):
    pings, _, names, _, _ = made
    saved = tables.save_bucketed(pings, "pings_by_id", buckets=4, sort_by=("utc_timestamp",))
    try:
        met = saved.join(spark.table(names.ids).select("ad_id"), "ad_id", "left_semi")
        assert shuffles(met) == []
        home = homes.first_ping_homes(saved)
        assert shuffles(home) == []
        assert same(home, homes.first_ping_homes(pings))
        joined = home.join(spark.table(names.ids), "ad_id")
        assert shuffles(joined) == [] and joined.count() > 0
    finally:
        tables.drop(spark, "pings_by_id")


def test_names_are_checked(spark):
    assert tables.table_name("od-2h", "job-7") == "temp_od_2h_job_7"
    with pytest.raises(ValueError, match="no name"):
        tables.drop(spark, "x; DROP TABLE y")
    with pytest.raises(ValueError):
        tables.add_day(spark, "x", "2024-13-01")


@pytest.fixture
def dated(spark, data, tmp_path):
    t = Tables(spark, f"{data}/sf0.001")
    text = lambda c: F.col(c).cast("string").alias(c)
    pings = t.pings.select("ad_id", "utc_timestamp", text("horizontal_accuracy"), F.lit("gaid").alias("id_type"), F.lit(None).cast("string").alias("ip_address"), text("latitude"), text("longitude"), "iso_country_code", "poi_ids", "quality_fields", "geo_fields", "date")
    path = f"{tmp_path}/pings"
    readers.write_parquet(pings.filter("date between '2024-01-02' and '2024-01-05' or date = '2024-01-08'"), path, partition_by="date")
    yield pings, path, tables.register(spark, "dated_pings", path, pings.schema)
    tables.drop(spark, "dated_pings")


def stamps(path):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_ino) for p in Path(path).rglob("*.parquet")}


def test_registered_days(spark, dated):
    pings, path, found = dated
    have = ["2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05", "2024-01-08"]
    assert tables.days(spark, "dated_pings") == have
    assert tables.gaps(have) == [("2024-01-06", "2024-01-07")]
    assert same(found.select(*pings.columns), pings.filter(F.col("date").isin(have)))
    one = filters.date_range(spark.table("dated_pings"), "2024-01-03", "2024-01-03")
    assert "PartitionFilters: [isnotnull(date" in plan(one)


def test_a_day_more_and_a_day_replaced(spark, dated, tmp_path):
    pings, path, _ = dated
    before = stamps(path)
    # a folder that no one has registered is not read until it is entered
    elsewhere = f"{tmp_path}/late"
    pings.filter("date = '2024-01-06'").drop("date").write.parquet(elsewhere)
    assert spark.table("dated_pings").filter("date = '2024-01-06'").count() == 0
    tables.add_day(spark, "dated_pings", "2024-01-06", location=elsewhere)
    assert spark.table("dated_pings").filter("date = '2024-01-06'").count() == pings.filter("date = '2024-01-06'").count()
    assert stamps(path) == before
    other = pings.filter("date = '2024-01-04'").withColumn("ad_id", F.lit("corrected")).limit(3)
    tables.replace_day(other, "dated_pings", "2024-01-04")
    after = stamps(path)
    assert {p for p in before if before[p] != after.get(p)} == {p for p in before if "date=2024-01-04" in p}
    assert {p for p in after if p not in before} == {p for p in after if "date=2024-01-04" in p}
    assert [r["ad_id"] for r in spark.table("dated_pings").filter("date = '2024-01-04'").collect()] == ["corrected"] * 3
    tables.replace_day(other, "dated_pings", "2024-01-07")
    assert tables.days(spark, "dated_pings")[-3:] == ["2024-01-06", "2024-01-07", "2024-01-08"]
    tables.drop_day(spark, "dated_pings", "2024-01-07")
    assert spark.table("dated_pings").filter("date = '2024-01-07'").count() == 0
    pings.filter("date = '2024-01-09'").write.mode("append").partitionBy("date").parquet(path)
    assert "2024-01-09" not in tables.days(spark, "dated_pings")
    tables.recover(spark, "dated_pings")
    assert "2024-01-09" in tables.days(spark, "dated_pings")
    tables.replace_day(other.limit(0), "dated_pings", "2024-01-03")
    assert spark.table("dated_pings").filter("date = '2024-01-03'").count() == 0


def test_rows_in_order(spark):
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).alias("k"), F.lit("text").alias("s"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    got = list(rows.stream_rows(df, "k", rows=3000))
    assert [r["k"] for r in got] == list(range(50_000)) and got[0].asDict() == {"k": 0, "s": "text", "m": {"a": 0}}
    assert list(rows.stream_rows(df.limit(0), "k")) == []


def test_memory_stays_flat(spark):
    """Ten times the rows take no more of the driver's memory."""

    def peak(n):
        df = spark.range(n).select("id", F.repeat(F.lit("x"), 200).alias("s"))
        tracemalloc.start()
        taken = sum(1 for _ in rows.stream_rows(df, "id", rows=2000))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert taken == n
        return most

    small, large = peak(20_000), peak(200_000)
    assert large < 1.5 * small + 2_000_000


def test_csv_of_rows(spark, tmp_path):
    df = spark.createDataFrame([(2, 'a "quoted", one'), (1, None), (3, "two\nlines")], "k int, s string")
    with open(tmp_path / "rows.csv", "w", newline="") as out:
        assert rows.write_rows(df, out, "k") == 3
    with open(tmp_path / "rows.csv", newline="") as back:
        assert list(csv.reader(back)) == [["k", "s"], ["1", ""], ["2", 'a "quoted", one'], ["3", "two\nlines"]]


def test_features_join(spark, made, no_broadcast):
    """Features are grouped and joined by device on the bucketed visits."""
    _, _, names, _, _ = made
    v = spark.table(names.visits)
    per = v.groupBy("ad_id").agg(F.count(F.lit(1)).alias("n"), F.sum("dwell_minutes").alias("minutes"))
    joined = per.join(spark.table(names.ids), "ad_id")
    assert shuffles(joined) == []
