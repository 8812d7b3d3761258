"""Readers and writers: Parquet, CSV, JSON and GeoJSON, unions of datasets, and file sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import PINGS, POIS


def read_pings(spark: SparkSession, path: str, *, schema: T.StructType = PINGS) -> DataFrame:
    """Pings, partitioned by ``date``; columns that files lack (the basic form) read as null."""
    return spark.read.schema(schema).parquet(path)


def read_pois(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POIS).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """properties (strings by name) and geometry (type, and coordinates as JSON) of each feature of GeoJSON collections.

    Large files are read by several tasks, see :mod:`wayfare.sources.geojson`.
    """
    from .geojson import features_text

    schema = "type string, properties map<string, string>, geometry struct<type: string, coordinates: string>"
    return features_text(spark, path).select(F.from_json("feature", schema).alias("f")).filter("f.type = 'Feature'").select("f.properties", "f.geometry")


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """postal properties and rings (array of rings of [lng, lat]) of each outer shape of GeoJSON collections."""
    point = "array<array<double>>"
    features = read_features(spark, path)
    one = F.array(F.from_json("geometry.coordinates", f"array<{point}>"))
    many = F.from_json("geometry.coordinates", f"array<array<{point}>>")
    return features.select("properties", F.explode(F.when(F.col("geometry.type") == "MultiPolygon", many).otherwise(one)).alias("rings"))


def union_datasets(parts: list[DataFrame]) -> DataFrame:
    """One dataset of several, by name; what a part lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_parquet(df: DataFrame, path: str, *, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, *, partition_by: str | None = None) -> None:
    """One folder, or one per value of a column (such as a bracket)."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(partition_by) if partition_by else writer).csv(path)
