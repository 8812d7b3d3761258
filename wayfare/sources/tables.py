"""Catalogue tables: bucketed results, registered ``date=`` folders, replacement of single days.

A bucketed table keeps its rows by the hash of a key in a fixed number of sorted files, so that joins and groupings on the key
take no shuffle. A registered table knows its days from the catalogue; a query that names days lists and reads theirs only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]*(\.[A-Za-z][A-Za-z0-9_]*)?")
_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


def table_name(base: str, run: str) -> str:
    """A name of letters, digits and underscores for a run's table."""
    return re.sub(r"[^A-Za-z0-9_]", "_", f"temp_{base}_{run}")


def _checked(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"no name of a table: {name!r}")
    return name


def save_bucketed(df: DataFrame, name: str, *, key: str = "ad_id", buckets: int = 64, sort_by: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in ``buckets`` buckets by ``key``, one sorted file each, and read it.

    A few GB a bucket is a good size; tables that are to be joined need the same number.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("compression", "snappy").bucketBy(buckets, key).sortBy(key, *sort_by)
    (writer.option("path", path) if path else writer).saveAsTable(_checked(name))
    return df.sparkSession.table(name)


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_checked(name)}")


@dataclass(frozen=True)
class VisitTables:
    """Names of the bucketed tables of one dataset."""

    at_poi: str
    dwell: str
    visits: str
    ids: str

    def drop(self, spark: SparkSession) -> None:
        for name in (self.at_poi, self.dwell, self.visits, self.ids):
            drop(spark, name)


def save_visits(pings: DataFrame, targets: DataFrame, *, base: str, run: str, radius_m: float = 200.0, buckets: int = 64, folder: str | None = None) -> VisitTables:
    """Tables by ad_id that the reports of a dataset share: pings at places, device-day dwell, visits, and ids with their visit days.

    Pings at places and nearest places are found once, from the pings; dwell and ids come from the written table, without a shuffle.
    """
    from ..functions.geo import at_poi_pings, closest_poi
    from ..operators.visits import device_day_dwell, poi_visits

    names = VisitTables(*(table_name(f"{base}_{x}", run) for x in ("at_poi", "dwell", "visits", "ids")))
    at = lambda x: f"{folder}/{x}" if folder else None
    rows = save_bucketed(at_poi_pings(pings, targets, radius_m=radius_m), names.at_poi, buckets=buckets, sort_by=("date", "utc_timestamp"), path=at("at_poi"))
    dwell = save_bucketed(device_day_dwell(rows), names.dwell, buckets=buckets, sort_by=("date",), path=at("dwell"))
    save_bucketed(poi_visits(closest_poi(pings, targets, radius_m=radius_m)), names.visits, buckets=buckets, sort_by=("date",), path=at("visits"))
    save_bucketed(dwell.groupBy("ad_id").agg(F.count(F.lit(1)).alias("days"), F.sum("ping_count").alias("pings")), names.ids, buckets=buckets, path=at("ids"))
    return names


def register(spark: SparkSession, name: str, path: str, schema: T.StructType, *, partition: str = "date") -> DataFrame:
    """A table over a folder of ``date=`` folders, with the days that are there now."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name != partition)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_checked(name)} ({columns}, `{partition}` string) USING parquet PARTITIONED BY (`{partition}`) LOCATION '{path}'")
    return recover(spark, name)


def recover(spark: SparkSession, name: str) -> DataFrame:
    """Enter all days whose folders are there."""
    spark.sql(f"ALTER TABLE {_checked(name)} RECOVER PARTITIONS")
    return spark.table(name)


def _day(day: str) -> str:
    if not _DAY.fullmatch(day):
        raise ValueError(f"no day: {day!r}")
    date.fromisoformat(day)
    return day


def add_day(spark: SparkSession, name: str, day: str, *, location: str | None = None) -> None:
    """Enter one day; its folder may be elsewhere. Other days are not looked at."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"ALTER TABLE {_checked(name)} ADD IF NOT EXISTS PARTITION (date='{_day(day)}'){where}")


def drop_day(spark: SparkSession, name: str, day: str) -> None:
    """Forget one day; a registered folder's files stay."""
    spark.sql(f"ALTER TABLE {_checked(name)} DROP IF EXISTS PARTITION (date='{_day(day)}')")


def days(spark: SparkSession, name: str) -> list[str]:
    """The entered days that are dates, in order; from the catalogue alone."""
    found = (r["partition"].removeprefix("date=") for r in spark.sql(f"SHOW PARTITIONS {_checked(name)}").collect())
    return sorted(d for d in found if _DAY.fullmatch(d))


def gaps(found: list[str]) -> list[tuple[str, str]]:
    """First and last missing day of each gap between the days."""
    at = [date.fromisoformat(d) for d in found]
    one = timedelta(days=1)
    return [((a + one).isoformat(), (b - one).isoformat()) for a, b in zip(at, at[1:]) if b - a > one]


def replace_day(df: DataFrame, name: str, day: str) -> None:
    """Write ``df`` in place of one day of a table; files of other days are not touched. An empty one empties the day."""
    spark = df.sparkSession
    columns = spark.table(_checked(name)).columns
    spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION (date='{_day(day)}')")
    rows = df.select(*[F.col(f"`{c}`") for c in columns if c != "date"])
    view = f"replace_{name.replace('.', '_')}_{day.replace('-', '_')}"
    rows.createOrReplaceTempView(view)
    try:
        spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (date='{day}') SELECT * FROM {view}")
    finally:
        spark.catalog.dropTempView(view)
