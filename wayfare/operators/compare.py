"""Comparison of datasets, exports, brackets and master lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import spatial_join
from ..functions.numbers import half_up
from ..functions.timeutil import minutes_between, seconds_between
from .reports import tenth_key


def poi_days(pings: DataFrame, *, low: float = 0, high: float | None = None) -> DataFrame:
    """ad_id, date, poi_id, dwell_minutes of marked places, within the dwell limits."""
    ids = pings.select("ad_id", "date", "utc_timestamp", F.explode("poi_ids").alias("poi_id")).filter(F.col("poi_id") != "")
    d = ids.groupBy("ad_id", "date", "poi_id").agg((seconds_between(F.min("utc_timestamp"), F.max("utc_timestamp")) / 60.0).alias("dwell_minutes"), F.count(F.lit(1)).alias("pings"))
    d = d.filter(F.col("dwell_minutes") >= low) if low else d
    return d if high is None else d.filter(F.col("dwell_minutes") <= high)


def side_ids(pings: DataFrame, *, min_visits: int = 2, low: float = 0, kept: DataFrame | None = None) -> DataFrame:
    """ad_id of one side: enough visit days, and a home among the kept positions if they are given (ad_id)."""
    ids = poi_days(pings, low=low).groupBy("ad_id").agg(F.countDistinct("date").alias("n")).filter(F.col("n") >= min_visits).select("ad_id")
    return ids if kept is None else ids.join(kept.select("ad_id").distinct(), "ad_id", "left_semi")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """total_a, total_b, overlap of two sets of ids, in one join on ids, which tables bucketed by ad_id do without a shuffle."""
    one = a.filter("ad_id is not null").select("ad_id").distinct().withColumn("a", F.lit(1))
    met = one.join(b.filter("ad_id is not null").select("ad_id").distinct().withColumn("b", F.lit(1)), "ad_id", "full")
    return met.agg(F.count("a").alias("total_a"), F.count("b").alias("total_b"), F.count(F.col("a") + F.col("b")).alias("overlap"))


def overlap_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("ad_id").distinct().join(b.select("ad_id"), "ad_id", "left_semi")


def poi_overlap(pings: DataFrame, common: DataFrame) -> DataFrame:
    """poi_id and how many of the common devices it saw."""
    ids = pings.join(common, "ad_id", "left_semi").select("ad_id", F.explode("poi_ids").alias("poi_id")).filter(F.col("poi_id") != "")
    return ids.groupBy("poi_id").agg(F.countDistinct("ad_id").alias("overlap_devices"))


def kept_homes(homes: DataFrame, geocode: DataFrame, zips: list[str]) -> DataFrame:
    """ad_id of homes (home_lat, home_lng) whose cached zip code is wanted."""
    keyed = homes.select("ad_id", tenth_key(F.col("home_lat")).alias("lat_key"), tenth_key(F.col("home_lng")).alias("lng_key"))
    return keyed.join(geocode.filter(F.col("zipcode").isin(zips)), ["lat_key", "lng_key"]).select("ad_id").distinct()


def reach(pings: DataFrame, visitors: DataFrame, targets: DataFrame, *, radius_m: float = 200.0, min_pings: int = 2, min_minutes: int = 5) -> DataFrame:
    """ad_id, poi_id, pings, minutes of visitors that were near a target often or long enough."""
    met = spatial_join(pings.join(visitors, "ad_id", "left_semi"), targets, radius_m=radius_m)
    per = met.groupBy("ad_id", "poi_id").agg(F.count(F.lit(1)).alias("pings"), minutes_between(F.min("utc_timestamp"), F.max("utc_timestamp")).cast("long").alias("minutes"))
    return per.filter((F.col("pings") >= min_pings) | (F.col("minutes") >= min_minutes))


def reach_summary(clusters: DataFrame, visitors: DataFrame) -> DataFrame:
    """poi_id and devices of each target, with the share of all visitors (percent, two decimals)."""
    total = visitors.agg(F.countDistinct("ad_id").alias("visitors"))
    per = clusters.groupBy("poi_id").agg(F.countDistinct("ad_id").alias("devices"))
    return per.join(total).select("poi_id", "devices", (half_up(F.col("devices") / F.col("visitors") * 10000) / 100).alias("percent"))


def penetration(rows: DataFrame, population: DataFrame, *, n: int = 20) -> DataFrame:
    """The report's top zips by the share of their population that was seen."""
    joined = rows.join(population.withColumnRenamed("postal_code", "zip"), "zip")
    total = F.sum("devices").over(Window.partitionBy())
    out = joined.select("zip", "devices", "population", (half_up(F.col("devices") / total * 10000) / 100).alias("percent_of_match"), (half_up(F.col("devices") / F.col("population") * 10000) / 100).alias("percent_of_population"))
    return out.orderBy(F.desc("percent_of_population"), "zip").limit(n)


def export_ids(pings: DataFrame, *, min_dwell: float | None = None, min_pings: int = 0) -> DataFrame:
    """ad_id, poi_id, date, pings, dwell_minutes of qualifying visits; a least dwell of 0 asks for more than 0."""
    d = poi_days(pings).filter(F.col("pings") >= min_pings)
    if min_dwell is not None:
        d = d.filter(F.col("dwell_minutes") > 0 if min_dwell == 0 else F.col("dwell_minutes") >= min_dwell)
    return d.select("ad_id", "poi_id", "date", "pings", F.round("dwell_minutes", 1).alias("dwell_minutes"))


def activation(ids: DataFrame, home_keys: DataFrame, geocode: DataFrame) -> DataFrame:
    """Every id with the zip code of its home, UNKNOWN where home or zip is missing."""
    zips = home_keys.join(geocode, ["lat_key", "lng_key"], "left").select("ad_id", "zipcode")
    return ids.select("ad_id").distinct().join(zips, "ad_id", "left").select("ad_id", F.coalesce("zipcode", F.lit("UNKNOWN")).alias("zipcode"))


def coverage(activated: DataFrame) -> DataFrame:
    return activated.agg(F.count(F.lit(1)).alias("devices"), F.count_if(F.col("zipcode") != "UNKNOWN").alias("with_zip"))


def bracket(score: Column) -> Column:
    """Five brackets of a score from 0 to 100."""
    return F.when(score < 20, "0-19").when(score < 40, "20-39").when(score < 60, "40-59").when(score < 80, "60-79").otherwise("80-100")


def bracket_map(geocode: DataFrame, nse: DataFrame, brackets: list[tuple[str, float, float]]) -> DataFrame:
    """lat_key, lng_key, bracket_label: cells whose zip code's score lies in a bracket (both ends in)."""
    spark = geocode.sparkSession
    ranges = spark.createDataFrame(brackets, "bracket_label string, low double, high double")
    scored = geocode.join(nse, geocode["zipcode"] == nse["postal_code"])
    return scored.join(ranges, F.col("nse").between(F.col("low"), F.col("high"))).select("lat_key", "lng_key", "bracket_label")


def bracket_ids(origins: DataFrame, labels: DataFrame) -> DataFrame:
    """ad_id, bracket_label of origins (origin_lat, origin_lng) by their cell."""
    keyed = origins.select("ad_id", tenth_key(F.col("origin_lat")).alias("lat_key"), tenth_key(F.col("origin_lng")).alias("lng_key"))
    return keyed.join(labels, ["lat_key", "lng_key"]).select("ad_id", "bracket_label").distinct()


def bracket_summary(ids: DataFrame, zips: DataFrame) -> DataFrame:
    """bracket_label, maids, and the population of the zip codes in it; ``zips`` has bracket_label and population."""
    people = zips.groupBy("bracket_label").agg(F.sum("population").alias("population"))
    maids = ids.groupBy("bracket_label").agg(F.countDistinct("ad_id").alias("maids"))
    return people.join(maids, "bracket_label", "left").select("bracket_label", "population", F.coalesce("maids", F.lit(0)).alias("maids"))


MASTER = ("ad_id", "attr_type", "attr_value", "dwell_minutes", "postal_code")


def contribution(rows: DataFrame, kind: str, value: str = "") -> DataFrame:
    """One contribution to a master list: plain, category, category_and, nse, catchment, persona or persona_lookalike."""
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    attr = {"category": F.col("category") if "category" in rows.columns else F.lit(value), "nse": F.col("nse_bracket") if "nse_bracket" in rows.columns else F.lit(value)}.get(kind, F.lit(value if kind not in ("plain", "catchment") else ""))
    dwell = F.col("dwell_minutes") if kind in ("category", "category_and") else none
    return rows.select("ad_id", F.lit(kind).alias("attr_type"), attr.alias("attr_value"), dwell.alias("dwell_minutes"), (F.col("postal_code") if kind == "nse" else text).alias("postal_code"))


def legacy_contribution(raw: DataFrame) -> DataFrame:
    """Old text files: rows whose value is a number and that lack a dwell are categories with their dwell in the value."""
    number = F.col("attr_value").try_cast("double")
    old = number.isNotNull() & F.col("dwell_minutes").isNull()
    kind = F.when(old, "category").when(F.coalesce("attr_type", F.lit("")) == "", "plain").otherwise(F.col("attr_type"))
    value = F.when(old, F.col("attr_type")).otherwise(F.coalesce("attr_value", F.lit("")))
    dwell = F.when(old, number).otherwise(F.nullif(F.col("dwell_minutes"), F.lit("")).try_cast("double"))
    good = raw.filter((F.trim("ad_id") != "") & (F.col("ad_id") != "ad_id"))
    return good.select("ad_id", kind.alias("attr_type"), value.alias("attr_value"), dwell.alias("dwell_minutes"), F.nullif(F.col("postal_code"), F.lit("")).alias("postal_code"))


def consolidate(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select(*MASTER)
    for p in parts[1:]:
        out = out.unionByName(p.select(*MASTER))
    return out


def master_stats(master: DataFrame, *, exact: bool = False) -> DataFrame:
    """attr_type, attr_value, maid_count, avg_dwell, median_dwell (one decimal)."""
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY dwell_minutes)") if exact else F.percentile_approx("dwell_minutes", 0.5)
    return master.groupBy("attr_type", "attr_value").agg(F.countDistinct("ad_id").alias("maid_count"), F.round(F.avg("dwell_minutes"), 1).alias("avg_dwell"), F.round(middle, 1).alias("median_dwell"))


def master_total(master: DataFrame) -> DataFrame:
    return master.agg(F.countDistinct("ad_id").alias("total"))


def dwell_distribution(master: DataFrame) -> DataFrame:
    """category and distinct devices by dwell band."""
    d = F.col("dwell_minutes")
    bands = {"dwell_2_10": (d >= 2) & (d < 10), "dwell_10_30": (d >= 10) & (d < 30), "dwell_30_60": (d >= 30) & (d < 60), "dwell_60_180": (d >= 60) & (d < 180), "dwell_180_plus": d >= 180}
    rows = master.filter((F.col("attr_type") == "category") & d.isNotNull())
    return rows.groupBy(F.col("attr_value").alias("category")).agg(*[F.countDistinct(F.when(c, F.col("ad_id"))).alias(k) for k, c in bands.items()])


def postal_top(master: DataFrame, *, n: int = 100) -> DataFrame:
    """The report's largest postal codes."""
    rows = master.filter(F.coalesce("postal_code", F.lit("")) != "")
    return rows.groupBy("postal_code").agg(F.countDistinct("ad_id").alias("maid_count")).orderBy(F.desc("maid_count"), "postal_code").limit(n)


def latest_contributions(index: DataFrame) -> DataFrame:
    """The latest entry of each source, type and value."""
    w = Window.partitionBy("source", "attr_type", "attr_value").orderBy(F.desc("created_at"), F.desc("entry_id"))
    return index.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").drop("rn_")


def cluster_ids(parts: list[DataFrame]) -> DataFrame:
    """Distinct ids over contributions."""
    out = parts[0].select("ad_id")
    for p in parts[1:]:
        out = out.unionByName(p.select("ad_id"))
    return out.distinct()


def contribution_count(ids: DataFrame) -> DataFrame:
    """devices: how many different ids a contribution or a list of look-alikes has."""
    return ids.agg(F.countDistinct("ad_id").alias("devices"))
