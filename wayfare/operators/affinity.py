"""Affinity scores of postal codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import gaussian_field, haversine_km, near_cells, own_cell
from ..functions.numbers import average_rank, clip, half_up


def by_zip(rows: DataFrame) -> DataFrame:
    """zip, lat, lng, unique_devices, total_visit_days, avg_dwell, avg_freq, intensity; means are weighted by devices.

    ``rows`` has origin_lat, origin_lng, zip, unique_devices, total_visit_days, avg_dwell_minutes, avg_frequency.
    A zip lies where its first position (by coordinates) is; UNKNOWN is left out.
    """
    n = F.col("unique_devices")
    mean = lambda c: F.coalesce(F.sum(F.col(c) * n) / F.nullif(F.sum(n), F.lit(0)), F.lit(0.0))
    per = rows.filter(F.col("zip") != "UNKNOWN").groupBy("zip").agg(
        F.min(F.struct("origin_lat", "origin_lng")).alias("at"), F.sum(n).alias("unique_devices"), F.sum("total_visit_days").alias("total_visit_days"), mean("avg_dwell_minutes").alias("avg_dwell"), mean("avg_frequency").alias("avg_freq")
    )
    boost = 1 + F.log1p(F.col("avg_dwell") / 30) + F.log1p(F.col("avg_freq") / 2)
    return per.select("zip", F.col("at.origin_lat").alias("lat"), F.col("at.origin_lng").alias("lng"), "unique_devices", "total_visit_days", "avg_dwell", "avg_freq", (F.greatest(F.lit(1), "total_visit_days") * boost).alias("intensity"))


def log_score(heat: Column, top: Column) -> Column:
    """0 to 100 by logarithm, at least 1 where there is any heat."""
    return F.when(heat > 0, F.greatest(F.lit(1), half_up(100 * F.log(heat + 1) / F.log(top + 1)))).otherwise(F.lit(0))


def heat_index(zips: DataFrame, *, sigma_km: float = 12.0, extra: DataFrame | None = None) -> DataFrame:
    """zip, heat and affinity_index of measured zips, and of ``extra`` polygons (zip, lat, lng) without own visits that heat reaches."""
    points = zips.select("zip", "lat", "lng")
    if extra is not None:
        points = points.unionByName(extra.select("zip", "lat", "lng").join(zips.select("zip"), "zip", "left_anti"))
    field = gaussian_field(points, zips, sigma_km=sigma_km, key="zip").filter("heat > 0")
    top = F.greatest(F.max("heat").over(Window.partitionBy()), F.lit(1.0))
    return field.select("zip", F.round("heat", 4).alias("heat"), log_score(F.col("heat"), top).alias("affinity_index"))


def lift_index(zips: DataFrame, baseline: DataFrame, *, sigma_cat: float = 3.0, sigma_base: float = 8.0, eps: float = 0.01, gate: float = 0.05, extra: DataFrame | None = None) -> DataFrame:
    """zip, heat_cat, heat_base, affinity_index: concentration against a baseline (lat, lng, unique_devices).

    The index is 50 at the upper median of the lifts of measured zips with enough baseline, and 20 more for each
    doubling; measured zips with too little baseline score 0. Polygons of ``extra`` are added where they have
    heat, enough baseline and at least half the median lift.
    """
    base = baseline.filter("unique_devices > 0").select("lat", "lng", F.col("unique_devices").cast("double").alias("intensity"))
    own = zips.select("zip", "lat", "lng", F.lit(True).alias("own"))
    points = own if extra is None else own.unionByName(extra.select("zip", "lat", "lng", F.lit(False).alias("own")).join(zips.select("zip"), "zip", "left_anti"))
    cat = gaussian_field(points, zips, sigma_km=sigma_cat, key="zip").withColumnRenamed("heat", "heat_cat")
    both = points.select("zip", "own").join(cat, "zip").join(gaussian_field(points, base, sigma_km=sigma_base, key="zip").withColumnRenamed("heat", "heat_base"), "zip")
    top = F.greatest(F.max(F.when(F.col("own"), F.col("heat_base"))).over(Window.partitionBy()), F.lit(1.0))
    lifted = both.withColumn("top", top).withColumn("lift", F.when(F.col("heat_cat") <= 0, 0.0).otherwise(F.col("heat_cat") / (F.col("heat_base") + F.col("top") * eps)))
    counted = F.col("own") & (F.col("heat_base") >= F.col("top") * gate) & (F.col("lift") > 0)
    order = Window.orderBy("lift", "zip")
    ranked = lifted.filter(counted).select("lift", (F.row_number().over(order) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    median = ranked.filter(F.col("i") == F.floor(F.col("n") / 2)).select(F.col("lift").alias("median"))
    joined = lifted.join(median, F.lit(True), "left").withColumn("median", F.coalesce("median", F.lit(1.0)))
    score = F.when((F.col("lift") <= 0) | (F.col("heat_base") < F.col("top") * gate), 0).otherwise(clip(half_up(50 + 20 * F.log2(F.col("lift") / F.col("median"))), 0, 100))
    shown = F.col("own") | ((F.col("heat_cat") > 0) & (F.col("heat_base") >= F.col("top") * gate) & (F.col("lift") >= F.col("median") * 0.5))
    return joined.filter(shown).select("zip", F.round("heat_cat", 4).alias("heat_cat"), F.round("heat_base", 4).alias("heat_base"), score.cast("long").alias("affinity_index"))


def _pct(value: Column) -> Column:
    """Rank with ties at their mean, over the number of others; 0.5 alone."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return F.when(n == 1, 0.5).otherwise(average_rank(value, Window.orderBy(value)) / (n - 1))


def index_v2(rows: DataFrame, *, weights: tuple[float, float, float, float] = (0.30, 0.25, 0.25, 0.20)) -> DataFrame:
    """Adds affinity_index_v2, 1 to 100: the rank of a mean of ranks of devices, visits (both log), dwell and frequency.

    Rows with a blank or UNKNOWN zip score 0 and are not ranked. One row per zip goes through the windows.
    """
    blank = F.upper(F.trim(F.coalesce("zip", F.lit("")))).isin("", "UNKNOWN")
    safe = lambda c: F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    w = [x / sum(weights) for x in weights]
    values = rows.filter(~blank).withColumns({"v0": F.log1p(safe("unique_devices")), "v1": F.log1p(safe("total_visits")), "v2": safe("avg_dwell"), "v3": safe("avg_frequency")})
    ranked = values.withColumns({f"r{i}": _pct(F.col(f"v{i}")) for i in range(4)})
    mean = ranked.withColumn("c", F.round(sum((F.col(f"r{i}") * w[i] for i in range(4)), F.lit(0.0)), 12))
    scored = mean.withColumn("affinity_index_v2", clip(half_up(_pct(F.col("c")) * 100), 1, 100).cast("long")).drop("c", *[f"{k}{i}" for k in "vr" for i in range(4)])
    return scored.unionByName(rows.filter(blank).withColumn("affinity_index_v2", F.lit(0).cast("long")))


def _percentile(value: Column, part: tuple[Column, ...], when: Column | None = None) -> Column:
    """(mean rank + 1/2) / n * 100 within the part, among rows where ``when`` holds."""
    keys = [*part, when] if when is not None else list(part)
    w = Window.partitionBy(*keys)
    return clip((average_rank(value, w.orderBy(value)) + 0.5) / F.count(F.lit(1)).over(w) * 100, 0, 100)


def source_zip_affinity(features: DataFrame, population: DataFrame, centroids: DataFrame, *, min_population: int = 200, decay_km: float = 30.0, sigma_km: float = 12.0) -> DataFrame:
    """source, zip, devices, volume, density, loyalty and lift percentiles, score_raw (geometric mean) and score_smoothed.

    ``features`` has source, home_zip, home_lat, home_lng, total_dwell_min, total_visits; ``population`` zip and
    population; ``centroids`` source, poi_lat, poi_lng.
    """
    per = features.filter(F.trim("home_zip") != "").groupBy("source", F.trim("home_zip").alias("zip")).agg(F.count(F.lit(1)).alias("devices"), F.avg("total_dwell_min").alias("dwell"), F.avg("total_visits").alias("visits"), F.avg("home_lat").alias("lat"), F.avg("home_lng").alias("lng"))
    rows = per.join(population, "zip", "left").join(centroids, "source", "left")
    share = F.col("devices") / F.sum("devices").over(Window.partitionBy("source"))
    d = haversine_km(F.col("lat"), F.col("lng"), F.col("poi_lat"), F.col("poi_lng"))
    rows = rows.withColumns({"loyal": F.round(F.coalesce("dwell", F.lit(0.0)) * F.log1p(F.coalesce("visits", F.lit(0.0))), 9), "dense": F.when(F.col("population") >= min_population, F.col("devices") / F.col("population")), "over": F.round(share / F.exp(-d / decay_km), 9)})
    src = (F.col("source"),)
    volume = half_up(_percentile(F.col("devices"), src))
    rows = rows.withColumns({"volume_pct": volume, "loyalty_pct": half_up(_percentile(F.col("loyal"), src)), "density_pct": F.when(F.col("dense").isNotNull(), half_up(_percentile(F.col("dense"), src, F.col("dense").isNotNull()))), "lift_pct": F.when(F.col("over").isNotNull(), half_up(_percentile(F.col("over"), src, F.col("over").isNotNull())))})
    rows = rows.withColumn("lift_pct", F.coalesce("lift_pct", "volume_pct"))
    scores = F.filter(F.array("volume_pct", "loyalty_pct", "lift_pct", "density_pct"), lambda x: x.isNotNull())
    logs = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.log(F.greatest(x.cast("double"), F.lit(0.5))))
    rows = rows.withColumn("score_raw", half_up(F.exp(logs / F.size(scores))))
    scored = rows.select("source", "zip", "devices", "volume_pct", "density_pct", "loyalty_pct", "lift_pct", "score_raw")
    return scored.join(smoothed(rows, sigma_km=sigma_km), ["source", "zip"], "left").withColumn("score_smoothed", F.coalesce("score_smoothed", "score_raw"))


def smoothed(rows: DataFrame, *, sigma_km: float = 12.0, cutoff: float = 3.0) -> DataFrame:
    """source, zip, score_smoothed: Gaussian field of devices among the zips of one source, log-normalised in it."""
    reach = sigma_km * cutoff
    have = rows.filter("lat is not null and lng is not null")
    cy, cx = own_cell(F.col("lat"), F.col("lng"), reach)
    src = have.select("source", F.col("lat").alias("b"), F.col("lng").alias("m"), F.col("devices").alias("heat_of"), cy.alias("cy"), cx.alias("cx"))
    ys, xs = near_cells(F.col("lat"), F.col("lng"), reach)
    pts = have.select("source", "zip", "lat", "lng").withColumn("cy", F.explode(ys)).withColumn("cx", F.explode(xs))
    met = pts.join(src, ["source", "cy", "cx"]).withColumn("d", haversine_km(F.col("lat"), F.col("lng"), F.col("b"), F.col("m"))).filter(F.col("d") <= reach)
    heat = met.groupBy("source", "zip").agg(F.sum(F.col("heat_of") * F.exp(-(F.col("d") * F.col("d")) / (2 * sigma_km * sigma_km))).alias("heat"))
    return heat.select("source", "zip", log_score(F.round("heat", 9), F.max(F.round("heat", 9)).over(Window.partitionBy("source"))).alias("score_smoothed"))


def export_columns(rows: DataFrame) -> DataFrame:
    """The nine columns of the affinity export, largest index first."""
    text = lambda c, d: F.coalesce(F.col(c), F.lit(d)).alias(c)
    return rows.select(F.col("zip").alias("zip_code"), text("city", ""), text("country", ""), "affinity_index", "affinity_index_v2", F.col("avg_dwell").alias("avg_dwell_min"), "avg_frequency", "unique_devices", F.col("total_visits").alias("total_visit_days")).orderBy(F.desc("affinity_index"), "zip_code")
