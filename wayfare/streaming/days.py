"""Daily ``date=`` folders as a stream: dwell and visits of each day, written once the day is closed.

New folders (and new files in them) are read by Spark's file source, and the checkpoint remembers which were. Rows carry their
folder's day as event time. The state holds the days that are open; a day closes when one more than ``late_days`` later has come, and all
its rows leave the state in one batch. That batch replaces the day's folder of the result, so that a batch that is
tried again after a failure, or a stream that is started again, leaves the same table. Files that come for a closed
day are passed over; :func:`wayfare.sources.tables.replace_day` is for such corrections.

The state of a day has one row for each ping at a place. For feeds beyond the executors' memory set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider; nothing here depends on it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.geo import spatial_join
from ..functions.timeutil import seconds_between
from ..operators.filters import valid_pings
from ..operators.visits import device_day_dwell, poi_visits
from ..sources.schema import MAX_ACCURACY_M, PINGS, POI_RADIUS_M

DAY = "day"


def stream_pings(spark: SparkSession, path: str, *, schema: T.StructType = PINGS, late_days: int = 1, max_accuracy: float = MAX_ACCURACY_M, files_per_trigger: int | None = None) -> DataFrame:
    """Valid pings of a growing folder, with ``day`` as event time; ``late_days`` is how many days stay open behind the newest."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = valid_pings(reader.parquet(path), max_accuracy=max_accuracy)
    return rows.withColumn(DAY, F.to_timestamp("date", "yyyy-MM-dd")).withWatermark(DAY, f"{late_days} days")


def stream_dwell(pings: DataFrame, targets: DataFrame, *, radius_m: float = POI_RADIUS_M) -> DataFrame:
    """day, ad_id, date, arrival, departure, ping_count, dwell_seconds, dwell_minutes: the batch dwell of each closed day."""
    at_poi = spatial_join(pings, targets, radius_m=radius_m).select(DAY, "ad_id", "date", "utc_timestamp", "lat", "lng").dropDuplicates()
    days = at_poi.groupBy(DAY, "ad_id", "date").agg(F.min("utc_timestamp").alias("arrival"), F.max("utc_timestamp").alias("departure"), F.count(F.lit(1)).alias("ping_count"))
    seconds = seconds_between(F.col("arrival"), F.col("departure"))
    return days.withColumns({"dwell_seconds": seconds, "dwell_minutes": F.round(seconds / 60.0, 1)})


def stream_visits(pings: DataFrame, targets: DataFrame, *, radius_m: float = POI_RADIUS_M) -> DataFrame:
    """day, ad_id, date, poi_id, category, start, end, ping_count, dwell_minutes, visit_hour of each closed day, by the nearest place.

    ``targets`` has a category. Two states follow one another: a ping's nearest place, then a place's pings.
    """
    near = spatial_join(pings, targets, radius_m=radius_m)
    nearest = near.groupBy(DAY, "ad_id", "date", "utc_timestamp").agg(F.min(F.struct("distance_m", "poi_id", "category")).alias("best"))
    v = nearest.groupBy(DAY, "ad_id", "date", F.col("best.poi_id").alias("poi_id"), F.col("best.category").alias("category")).agg(F.min("utc_timestamp").alias("start"), F.max("utc_timestamp").alias("end"), F.count(F.lit(1)).alias("ping_count"))
    return v.withColumns({"dwell_minutes": F.round(seconds_between(F.col("start"), F.col("end")) / 60.0, 1), "visit_hour": F.hour("start")})


def replace_days(path: str) -> Callable[[DataFrame, int], None]:
    """A sink of closed days: a batch holds whole days, whose folders it replaces; others stay."""

    def put(batch: DataFrame, _: int) -> None:
        # a day's rows go to few files, and a day of many rows to several
        batch.drop(DAY).repartition("date", F.pmod(F.xxhash64("ad_id"), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)

    return put


def run_available(rows: DataFrame, path: str, checkpoint: str, *, sink: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Take in what has come since the last run, write the days that it closes, and end."""
    query = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink or replace_days(path)).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def closed_days(spark: SparkSession, path: str) -> list[str]:
    """The days in a table of closed days, from its folders alone; none if nothing is written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(n.removeprefix("date=") for n in names if n.startswith("date="))


def _with_open(pings: DataFrame, path: str, schema: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    spark = pings.sparkSession
    days = closed_days(spark, path)
    open_rows = of(pings.filter(~F.col("date").isin(days)) if days else pings)
    if not days:
        return open_rows
    closed = spark.read.schema(f"{schema}, date string").parquet(path).select(*open_rows.columns)
    return closed.unionByName(open_rows)


def dwell_until_now(pings: DataFrame, targets: DataFrame, path: str, *, radius_m: float = POI_RADIUS_M) -> DataFrame:
    """The dwell of all days: closed ones as they are written, and open ones from the valid pings of their folders alone."""
    schema = "ad_id string, arrival timestamp_ntz, departure timestamp_ntz, ping_count long, dwell_seconds long, dwell_minutes double"
    at = lambda p: spatial_join(p, targets, radius_m=radius_m).select("ad_id", "date", "utc_timestamp", "lat", "lng").distinct()
    return _with_open(pings, path, schema, lambda p: device_day_dwell(at(p)))


def visits_until_now(pings: DataFrame, targets: DataFrame, path: str, *, radius_m: float = POI_RADIUS_M) -> DataFrame:
    """The visits of all days, in the same way."""
    from ..functions.geo import closest_poi

    schema = "ad_id string, poi_id string, category string, start timestamp_ntz, end timestamp_ntz, ping_count long, dwell_minutes double, visit_hour int"
    return _with_open(pings, path, schema, lambda p: poi_visits(closest_poi(p, targets, radius_m=radius_m)))
