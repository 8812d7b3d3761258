"""The whole persona run on fitted clusters: clusters, names, profiles and look-alikes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import materialize
from . import personas

#: How look-alikes of a cluster are found.
METHODS = ("zips", "traits", "brands")


def assigned_clusters(features: DataFrame, **options: object) -> DataFrame:
    """ad_id, cluster and distance of each device of a written table of features; written once."""
    return materialize(personas.cluster(features, **options)[0], "clusters")


def lookalikes(features: DataFrame, assigned: DataFrame, profiles: DataFrame) -> DataFrame:
    """cluster, method and ad_id: devices outside a cluster that share its places, its habits or its brands.

    A profile is one row a cluster, and there are at most some eight, so that their values become literals of one plan.
    """
    found = []
    for p in profiles.collect():
        seed = assigned.filter(F.col("cluster") == p["cluster"]).select("ad_id")
        medians = {m: p[f"median_{m}"] for m in ("avg_dwell_min", "weekend_share", "recency_days", "gyration_km")}
        brands = [x["value"] for x in (p["brand_mix"] or [])[:5]]
        each = {"zips": personas.lookalike_zips(features, seed, [x["value"] for x in p["top_zips"] or []])}
        if None not in medians.values():
            each["traits"] = personas.lookalike_traits(features, seed, medians, p["peak_hour"], p["peak_share"])
        if brands:
            each["brands"] = personas.lookalike_brands(features, seed, brands)
        found += [df.select(F.lit(p["cluster"]).cast("long").alias("cluster"), F.lit(m).alias("method"), "ad_id") for m, df in each.items()]
    if not found:
        return features.sparkSession.createDataFrame([], "cluster long, method string, ad_id string")
    return reduce(DataFrame.unionByName, found)


def segments(features: DataFrame, **options: object) -> DataFrame:
    """One row a fitted cluster: its name and description, devices and percent of the base, medians, peak hour, top zips and brands, examples, and how many look-alikes each method finds."""
    spark = features.sparkSession
    rows = materialize(features, "features")
    if rows.isEmpty():
        raise ValueError("no devices to cluster")
    assigned = assigned_clusters(rows, **options)
    profiles = materialize(personas.cluster_profiles(rows, assigned), "profiles")
    names = personas.named(*personas.naming_inputs(rows, assigned, profiles))
    told = spark.createDataFrame([(k, *v) for k, v in names.items()], "cluster long, name string, description string")
    counted = lookalikes(rows, assigned, profiles).groupBy("cluster").pivot("method", list(METHODS)).agg(F.count(F.lit(1)))
    like = counted.select("cluster", *[F.col(m).alias(f"lookalike_{m}") for m in METHODS])
    out = profiles.join(F.broadcast(told), "cluster").join(like, "cluster", "left")
    return out.withColumns({f"lookalike_{m}": F.coalesce(f"lookalike_{m}", F.lit(0)) for m in METHODS})
