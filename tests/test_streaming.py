"""Days fed one by one give the batch query's rows, also after failures and restarts."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from wayfare.functions.geo import as_targets, at_poi_pings, closest_poi
from wayfare.operators import filters, visits
from wayfare.sources import readers
from wayfare.sources.fixtures import Tables
from wayfare.streaming import days


@pytest.fixture(scope="module")
def feed(spark, data, tmp_path_factory):
    """A folder of whole days, and the target places."""
    folder = str(tmp_path_factory.mktemp("feed"))
    t = Tables(spark, f"{data}/sf0.01")
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = t.pings.select("ad_id", "utc_timestamp", text("horizontal_accuracy"), F.lit("gaid").alias("id_type"), F.lit(None).cast("string").alias("ip_address"), text("latitude"), text("longitude"), "iso_country_code", "poi_ids", "quality_fields", "geo_fields", "date")
    # every ping twice, as feeds repeat themselves
    rows = rows.unionByName(rows).filter(F.col("date").between("2024-01-03", "2024-01-06"))
    rows.repartition(3).write.mode("overwrite").partitionBy("date").parquet(folder)
    return folder, as_targets(t.pois, "category")


ALL = ["2024-01-03", "2024-01-04", "2024-01-05", "2024-01-06"]


def bring(feed, to, *names):
    for d in names:
        shutil.copytree(f"{feed[0]}/date={d}", f"{to}/date={d}", dirs_exist_ok=True)


def table(df, *drop):
    return sorted(map(str, df.select(*sorted(set(df.columns) - {"day", *drop})).collect()))


def batch(spark, feed, names):
    pings = filters.valid_pings(readers.read_pings(spark, feed[0])).filter(F.col("date").isin(list(names)))
    return visits.device_day_dwell(at_poi_pings(pings, feed[1])), visits.poi_visits(closest_poi(pings, feed[1]))


@pytest.fixture
def ends(spark, tmp_path):
    """Runs of both streams over a growing folder, each on its own checkpoint."""
    source = f"{tmp_path}/pings"
    (tmp_path / "pings").mkdir()

    def run(feed, late_days=1, **options):
        pings = days.stream_pings(spark, source, late_days=late_days, **options)
        days.run_available(days.stream_dwell(pings, feed[1]), f"{tmp_path}/dwell", f"{tmp_path}/dwell_checkpoint")
        days.run_available(days.stream_visits(pings, feed[1]), f"{tmp_path}/visits", f"{tmp_path}/visits_checkpoint")
        return days.closed_days(spark, f"{tmp_path}/dwell")

    return source, run, f"{tmp_path}/dwell", f"{tmp_path}/visits"


def test_days_one_by_one(spark, feed, ends):
    source, run, dwell, visit = ends
    closed = []
    for d in ALL:
        bring(feed, source, d)
        closed.append(run(feed))
        # a run without new files changes nothing
        assert run(feed) == closed[-1]
    assert closed == [[], ALL[:1], ALL[:2], ALL[:3]]
    want_dwell, want_visits = batch(spark, feed, ALL[:3])
    assert table(spark.read.parquet(dwell).withColumn("date", F.col("date").cast("string"))) == table(want_dwell)
    assert table(spark.read.parquet(visit).withColumn("date", F.col("date").cast("string"))) == table(want_visits)
    # with the open day from its own folder, all days are there
    pings = filters.valid_pings(readers.read_pings(spark, source))
    want_dwell, want_visits = batch(spark, feed, ALL)
    assert table(days.dwell_until_now(pings, feed[1], dwell)) == table(want_dwell)
    assert table(days.visits_until_now(pings, feed[1], visit)) == table(want_visits)
    plan = days.dwell_until_now(pings, feed[1], dwell)._jdf.queryExecution().toString()
    assert "PartitionFilters: [NOT date" in plan


def test_a_day_in_parts_and_one_file_at_a_time(spark, feed, ends, tmp_path):
    """Files of an open day still count; small batches and one large one agree."""
    source, run, dwell, _ = ends
    files = sorted(Path(feed[0], f"date={ALL[0]}").glob("*.parquet"))
    assert len(files) > 1
    (tmp_path / f"pings/date={ALL[0]}").mkdir()
    shutil.copy(files[0], f"{source}/date={ALL[0]}")
    assert run(feed) == []
    bring(feed, source, ALL[1])
    shutil.copy(files[1], f"{source}/date={ALL[0]}")
    for f in files[2:]:
        shutil.copy(f, f"{source}/date={ALL[0]}")
    run(feed, late_days=2, files_per_trigger=1)
    bring(feed, source, *ALL[2:])
    assert run(feed, late_days=2, files_per_trigger=2) == ALL[:2]
    assert table(spark.read.parquet(dwell).withColumn("date", F.col("date").cast("string"))) == table(batch(spark, feed, ALL[:2])[0])


def test_a_failure_after_the_write(spark, feed, tmp_path):
    """A batch that wrote and then failed is tried again, and leaves the same rows once."""
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("pings", "dwell", "checkpoint"))
    bring(feed, source, *ALL[:3])
    put, calls = days.replace_days(out), []

    def failing(rows, k):
        put(rows, k)
        calls.append(rows.count())
        if sum(calls) > 0 and len(calls) < 4:
            raise OSError("lost after the write")

    for _ in range(5):
        stream = days.stream_dwell(days.stream_pings(spark, source), feed[1])
        try:
            days.run_available(stream, out, checkpoint, sink=failing)
            break
        except Exception as lost:
            assert "lost after the write" in str(lost)
    assert len(calls) > 2
    assert days.closed_days(spark, out) == ALL[:2]
    assert table(spark.read.parquet(out).withColumn("date", F.col("date").cast("string"))) == table(batch(spark, feed, ALL[:2])[0])


def test_a_late_file_of_a_closed_day(spark, feed, ends):
    source, run, dwell, _ = ends
    bring(feed, source, *ALL[:3])
    assert run(feed) == ALL[:2]
    before = table(spark.read.parquet(dwell))
    late = readers.read_pings(spark, f"{feed[0]}/date={ALL[0]}").drop("date").withColumn("ad_id", F.lit("late"))
    late.write.mode("append").parquet(f"{source}/date={ALL[0]}")
    assert run(feed) == ALL[:2]
    assert table(spark.read.parquet(dwell)) == before
