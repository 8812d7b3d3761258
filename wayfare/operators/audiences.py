"""Categories, recipes and audiences."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import spatial_join
from ..functions.numbers import half_up
from ..functions.timeutil import in_hours, in_hours_half_open, local_time, minutes_between, seconds_between
from ..sources.schema import POI_RADIUS_M
from .reports import first_by

#: Groups of categories, and words that a category of the group is or holds. Callers may pass their own, such as :func:`groups_of` a catalogue.
GROUPS = {
    k: tuple(v.split())
    for k, v in {
        "food_and_beverage": "restaurant cafe coffee bar pub bakery fast_food food pizza ice_cream juice deli brewery winery donut bagel sandwich burrito sushi ramen thai chinese italian mexican indian steak seafood bbq brunch breakfast lunch dinner tapas bistro brasserie cerveceria tavern",
        "retail": "store shop mall supermarket grocery market boutique outlet clothing fashion shoe jewel gift book toy hardware florist department_store convenience discount thrift antique retail",
        "automotive": "gas_station fuel car_wash car_dealer car_repair auto parking ev_charging tire motor vehicle",
        "beauty": "beauty salon spa barber hair nail cosmetic tattoo massage wellness",
        "healthcare": "hospital clinic doctor dentist pharmacy optician veterinar medical health urgent_care lab",
        "finance": "bank atm insurance accounting tax financial credit_union money",
        "sports": "gym fitness sport yoga swimming tennis golf stadium arena athletic",
        "entertainment": "cinema movie theater theatre museum gallery amusement zoo aquarium nightclub karaoke bowling arcade escape_room concert casino",
        "accommodation": "hotel motel hostel resort inn bed_and_breakfast lodging campground airbnb",
        "education": "school university college library tutor academy kindergarten preschool training",
        "transport": "airport train_station bus_station subway metro ferry taxi transit rail port",
        "attractions": "park garden beach monument landmark temple church mosque synagogue cathedral castle palace fountain plaza square viewpoint trail national_park",
        "government": "government post_office police fire_station courthouse embassy consulate city_hall municipal",
    }.items()
}


def groups_of(catalogue: DataFrame) -> dict[str, tuple[str, ...]]:
    """Groups from a catalogue (group, categories), in its order: a dimension of a few dozen rows."""
    return {r["group"]: tuple(r["categories"]) for r in catalogue.select("group", "categories").collect()}


def exact_group(category: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """The first group that lists the category, else other."""
    out = F.when(F.lit(False), F.lit(""))
    for g, parts in groups.items():
        out = out.when(category.isin(*parts), g)
    return out.otherwise("other")


def category_group(category: Column, groups: dict[str, tuple[str, ...]] = GROUPS) -> Column:
    """The group that names the category, else the first with a word within it, else other."""
    c = F.lower(F.trim(category))
    out = F.when(F.lit(False), F.lit(""))
    for g, parts in groups.items():
        out = out.when(c.isin(*parts), g)
    for g, parts in groups.items():
        out = out.when(c.rlike("|".join(parts)), g)
    return out.otherwise("other")


def category_dwell(pings: DataFrame, pois: DataFrame, categories: list[str], *, radius_m: float = POI_RADIUS_M, low: float = 0, high: float | None = None, hours: tuple[int, int] | None = None, zone: str = "UTC") -> DataFrame:
    """ad_id, category, dwell_minutes: the longest day of each device at places of each category."""
    if hours:
        pings = pings.filter(in_hours(F.hour(local_time(F.col("utc_timestamp"), zone)), *hours))
    met = spatial_join(pings, pois.filter(F.col("category").isin(categories)), radius_m=radius_m)
    days = met.groupBy("ad_id", "date", "category").agg((seconds_between(F.min("utc_timestamp"), F.max("utc_timestamp")) / 60.0).alias("m")).filter(F.col("m") >= low)
    days = days if high is None else days.filter(F.col("m") <= high)
    return days.groupBy("ad_id", "category").agg(F.round(F.max("m"), 1).alias("dwell_minutes"))


def with_all_categories(rows: DataFrame, n: int) -> DataFrame:
    """Rows of devices that have n different categories."""
    ids = rows.groupBy("ad_id").agg(F.countDistinct("category").alias("n_")).filter(F.col("n_") == n).select("ad_id")
    return rows.join(ids, "ad_id", "left_semi")


def category_label(rows: DataFrame) -> DataFrame:
    """ad_id with its categories as one sorted, comma-joined value."""
    return rows.groupBy("ad_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


def poi_counts(pois: DataFrame, categories: list[str], country: str | None = None) -> DataFrame:
    found = pois.filter(F.col("category").isin(categories))
    if country:
        found = found.filter(F.upper("country") == country.upper())
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("pois"))


def visitor_origins(pings: DataFrame, visitors: DataFrame) -> DataFrame:
    """ad_id, date and where the day of a visitor starts (4 decimals)."""
    met = pings.join(visitors.select("ad_id").distinct(), "ad_id", "left_semi")
    return met.groupBy("ad_id", "date").agg(F.round(first_by(F.col("lat")), 4).alias("origin_lat"), F.round(first_by(F.col("lng")), 4).alias("origin_lng"))


@dataclass(frozen=True)
class Step:
    """What a visit must be like; hours are half-open."""

    categories: tuple[str, ...]
    hours: tuple[int, int] | None = None
    min_dwell: float | None = None
    max_dwell: float | None = None
    min_frequency: int = 1

    def holds(self, *, with_most: bool = True) -> Column:
        c = F.col("category").isin(*self.categories)
        if self.hours:
            c = c & in_hours_half_open(F.col("visit_hour"), *self.hours)
        if self.min_dwell is not None:
            c = c & (F.col("dwell_minutes") >= self.min_dwell)
        if with_most and self.max_dwell is not None:
            c = c & (F.col("dwell_minutes") <= self.max_dwell)
        return c


@dataclass(frozen=True)
class Recipe:
    name: str
    steps: tuple[Step, ...] = field(default_factory=tuple)
    logic: str = "OR"
    ordered: bool = False


def _parts(recipe: Recipe, prefix: str) -> tuple[list[Column], Column, Column, Column, Column]:
    """(aggregates over a device's visits, matched steps, whether they are in order, whether the recipe holds, visits that match a step)."""
    steps = recipe.steps
    counts = [F.count_if(s.holds()).alias(f"{prefix}n{i}") for i, s in enumerate(steps)]
    firsts = [F.min(F.when(s.holds(with_most=False), F.col("date"))).alias(f"{prefix}d{i}") for i, s in enumerate(steps)]
    met = [F.col(f"{prefix}n{i}") >= s.min_frequency for i, s in enumerate(steps)]
    order, every, some = F.lit(True), F.lit(True), F.lit(False)
    for i, m in enumerate(met):
        day = F.col(f"{prefix}d{i}")
        order = order & day.isNotNull() & (F.lit(True) if i == 0 else day >= F.col(f"{prefix}d{i - 1}"))
        every, some = every & m, some | m
    holds = some if recipe.logic == "OR" else every & order if recipe.ordered else every
    matched = sum((m.cast("long") for m in met), F.lit(0).cast("long"))
    return [*counts, *firsts], matched, order, holds, sum((F.col(f"{prefix}n{i}") for i in range(len(steps))), F.lit(0).cast("long"))


def step_counts(visits: DataFrame, recipe: Recipe) -> DataFrame:
    """ad_id, matched_steps, total_visits, avg_dwell, in_order and whether the recipe holds, in one aggregation.

    The order compares the first qualifying dates; it looks at the least dwell but not at the longest one.
    """
    parts, matched, order, holds, _ = _parts(recipe, "")
    per = visits.groupBy("ad_id").agg(*parts, F.count(F.lit(1)).alias("total_visits"), F.avg("dwell_minutes").alias("mean"))
    return per.select("ad_id", matched.alias("matched_steps"), "total_visits", (half_up(F.col("mean") * 10) / 10).alias("avg_dwell"), order.alias("in_order"), holds.alias("holds"))


def segment(visits: DataFrame, recipe: Recipe) -> DataFrame:
    return step_counts(visits, recipe).filter("holds").drop("holds", "in_order")


def audience_recipe(name: str, categories: tuple[str, ...], **step: object) -> Recipe:
    """One step, any visit of it."""
    return Recipe(name, (Step(categories, **step),))


#: Audiences, their categories, and what else a visit must be (hours, least dwell in minutes, visits).
AUDIENCES = {
    "moviegoers": ("cinema drive_in_theater outdoor_movies film_festival", {}),
    "sports_event_attendees": ("stadium_arena", {}),
    "nightlife": ("bar pub dance_club comedy_club karaoke casino", {"hours": (18, 6)}),
    "live_music_fans": ("music_venue theatre", {}),
    "gym_visitors": ("gym yoga_studio pilates_studio martial_arts_club rock_climbing_gym", {"min_dwell": 15}),
    "golfers": ("golf_course", {"min_dwell": 30}),
    "swimmers": ("swimming_pool", {"min_dwell": 15}),
    "students": ("school college", {"min_dwell": 30}),
    "fast_food_visitors": ("fast_food_restaurant", {}),
    "fine_diners": ("wine_bar cocktail_bar champagne_bar", {"min_dwell": 45}),
    "coffee_lovers": ("coffee_shop cafe", {"min_frequency": 3}),
    "metro_users": ("metro_station", {}),
    "bus_users": ("bus_station", {}),
    "train_commuters": ("train_station", {}),
    "air_travelers": ("airport", {"min_dwell": 30}),
    "car_shoppers": ("car_dealer used_car_dealer", {}),
    "ev_adopters": ("ev_charging_station", {}),
    "luxury_shoppers": ("jewelry_store watch_store designer_clothing antique_store", {}),
    "home_improvers": ("home_improvement_store furniture_store garden_center", {}),
    "supermarket_shoppers": ("supermarket convenience_store", {}),
    "spa_wellness": ("spa massage medical_spa day_spa health_spa", {}),
    "pet_owners": ("pet_store pet_grooming pet_boarding dog_park", {}),
    "family_entertainment": ("zoo aquarium amusement_park botanical_garden", {}),
    "gamers": ("arcade esports_league esports_team virtual_reality_center internet_cafe video_game_store", {}),
    "museum_goers": ("museum landmark_and_historical_building castle monument", {}),
    "coworkers": ("coworking_space", {"min_dwell": 60}),
}


def catalogue_recipes(wanted: list[str] | None = None) -> list[Recipe]:
    """Recipes of the catalogue's audiences, or of those that are wanted."""
    return [audience_recipe(k, tuple(c.split()), **rest) for k, (c, rest) in AUDIENCES.items() if wanted is None or k in wanted]


def all_categories(recipes: list[Recipe]) -> list[str]:
    """Every category that a recipe names, once: what a shared join of many audiences needs."""
    return list(dict.fromkeys(c for r in recipes for s in r.steps for c in s.categories))


def audience_batch(visits: DataFrame, recipes: list[Recipe]) -> DataFrame:
    """audience, devices, visits (that match a step) of many audiences over one table of visits, in one aggregation per device."""
    parts = [_parts(r, f"a{i}_") for i, r in enumerate(recipes)]
    per = visits.groupBy("ad_id").agg(*[c for p in parts for c in p[0]])
    rows = F.array(*[F.struct(F.lit(r.name).alias("audience"), p[3].alias("holds"), p[4].alias("n")) for r, p in zip(recipes, parts, strict=True)])
    return per.select(F.inline(rows)).filter("holds").groupBy("audience").agg(F.count(F.lit(1)).alias("devices"), F.sum("n").alias("visits"))


def zip_category(visits: DataFrame) -> DataFrame:
    """zip, category, visits, devices, dwell (sum) of visits with a zip."""
    return visits.groupBy("zip", "category").agg(F.count(F.lit(1)).alias("visits"), F.countDistinct("ad_id").alias("devices"), F.sum("dwell_minutes").alias("dwell"))


def affinity_records(visits: DataFrame, *, min_visits: int = 5, concentration_cap: float = 5, frequency_cap: float = 16, dwell_cap: float = 120) -> DataFrame:
    """zip, category, visits, unique_devices, avg_dwell_minutes, frequency, total_visits, three scores and affinity_index.

    Concentration (40 %) is the category's share in the zip over its share everywhere; frequency (35 %) is
    logarithmic; dwell (25 %) is the mean over its cap, whatever the category's mean is.
    """
    zc = zip_category(visits)
    by_zip, by_cat, every = Window.partitionBy("zip"), Window.partitionBy("category"), Window.partitionBy()
    t = zc.withColumns({"zip_total": F.sum("visits").over(by_zip), "cat_total": F.sum("visits").over(by_cat), "cat_dwell": F.sum("dwell").over(by_cat), "total": F.sum("visits").over(every)}).filter(F.col("zip_total") >= min_visits)
    avg, freq = F.col("dwell") / F.col("visits"), F.col("visits") / F.col("devices")
    ratio = (F.col("visits") / F.col("zip_total")) / (F.col("cat_total") / F.col("total"))
    mean = F.when(F.col("cat_dwell") == 0, 1.0).otherwise(F.col("cat_dwell") / F.col("cat_total"))
    concentration = half_up(F.least(ratio / concentration_cap, F.lit(1.0)) * 100)
    frequency = half_up(F.least(F.greatest(F.log2(freq) / F.log2(F.lit(float(frequency_cap))), F.lit(0.0)), F.lit(1.0)) * 100)
    dwell = half_up(F.least((avg / mean) / (dwell_cap / mean), F.lit(1.0)) * 100)
    scored = t.withColumns({"concentration_score": concentration, "frequency_score": frequency, "dwell_score": dwell})
    return scored.select(
        "zip", "category", "visits", F.col("devices").alias("unique_devices"), (half_up(avg * 10) / 10).alias("avg_dwell_minutes"), (half_up(freq * 100) / 100).alias("frequency"), F.col("zip_total").alias("total_visits"),
        "concentration_score", "frequency_score", "dwell_score", half_up(0.4 * F.col("concentration_score") + 0.35 * F.col("frequency_score") + 0.25 * F.col("dwell_score")).alias("affinity_index"),
    )


def zip_profiles(records: DataFrame) -> DataFrame:
    """zip, total_visits, top_category, top_affinity and the dominant group (of the highest mean index)."""
    top = records.groupBy("zip").agg(F.max("total_visits").alias("total_visits"), F.max(F.struct("affinity_index", "category")).alias("t"))
    groups = records.groupBy("zip", category_group(F.col("category")).alias("group")).agg(F.avg("affinity_index").alias("mean")).groupBy("zip").agg(F.max(F.struct("mean", "group"))["group"].alias("dominant_group"))
    return top.join(groups, "zip").select("zip", "total_visits", F.col("t.category").alias("top_category"), F.col("t.affinity_index").alias("top_affinity"), "dominant_group")


def category_stats(records: DataFrame, visits: DataFrame) -> DataFrame:
    """category, visits, unique_devices (distinct), percent_of_total, zips, avg_affinity, max_affinity."""
    total = F.sum("visits").over(Window.partitionBy())
    per = records.groupBy("category").agg(F.sum("visits").alias("visits"), F.countDistinct("zip").alias("zips"), half_up(F.avg("affinity_index")).alias("avg_affinity"), F.max("affinity_index").alias("max_affinity"))
    devices = visits.groupBy("category").agg(F.countDistinct("ad_id").alias("unique_devices"))
    shares = per.withColumn("percent_of_total", half_up(F.col("visits") / total * 10000) / 100)
    return shares.join(devices, "category").select("category", "visits", "unique_devices", "percent_of_total", "zips", "avg_affinity", "max_affinity")


def hotspots(records: DataFrame, *, least: int = 60, n: int = 25) -> DataFrame:
    """The report's top records."""
    return records.filter(F.col("affinity_index") >= least).orderBy(F.desc("affinity_index"), F.desc("visits"), "zip", "category").limit(n)


def category_affinity(dwell: DataFrame, homes: DataFrame) -> DataFrame:
    """Per home position: devices, visit days, mean dwell and frequency of a category's device-days."""
    per = dwell.groupBy("ad_id").agg(F.avg("dwell_minutes").alias("d"), F.count(F.lit(1)).alias("n"))
    return per.join(homes, "ad_id").groupBy(F.col("home_lat").alias("origin_lat"), F.col("home_lng").alias("origin_lng")).agg(F.count(F.lit(1)).alias("unique_devices"), F.sum("n").alias("total_visit_days"), F.round(F.avg("d"), 3).alias("avg_dwell_minutes"), F.round(F.avg("n"), 6).alias("avg_frequency"))


def sample_ids(ids: DataFrame, n: int) -> DataFrame:
    """The same n ids each time, by a hash."""
    return ids.select("ad_id").distinct().orderBy(F.md5("ad_id"), "ad_id").limit(n)


def around_stays(pings: DataFrame, at_poi: DataFrame, catalogue: DataFrame, *, devices: int, radius_m: float = POI_RADIUS_M) -> tuple[DataFrame, DataFrame]:
    """(stays of a sample of devices, places they are near outside their stay, with direction before/after)."""
    stays = at_poi.groupBy("ad_id", "date").agg(F.min("utc_timestamp").alias("arrival"), F.max("utc_timestamp").alias("departure"))
    stays = stays.join(sample_ids(stays, devices), "ad_id", "left_semi")
    out = pings.join(stays, ["ad_id", "date"]).filter((F.col("utc_timestamp") < F.col("arrival")) | (F.col("utc_timestamp") > F.col("departure")))
    near = out.withColumn("direction", F.when(F.col("utc_timestamp") < F.col("arrival"), "before").otherwise("after"))
    return stays, spatial_join(near.select("ad_id", "date", "utc_timestamp", "direction", "lat", "lng"), catalogue, radius_m=radius_m)


def sankey(pings: DataFrame, at_poi: DataFrame, catalogue: DataFrame, *, devices: int = 10_000) -> DataFrame:
    """direction, category, devices, visits (device-days) of categories met before and after the stay."""
    met = around_stays(pings, at_poi, catalogue, devices=devices)[1].select("ad_id", "date", "direction", "category").distinct()
    return met.groupBy("direction", "category").agg(F.countDistinct("ad_id").alias("devices"), F.count(F.lit(1)).alias("visits"))


def sample_routes(pings: DataFrame, at_poi: DataFrame, catalogue: DataFrame, *, devices: int = 1000) -> DataFrame:
    """ad_id, date, first_ts, direction, category, dwell_minutes: the stops of a sample of devices, the stay among them."""
    stays, near = around_stays(pings, at_poi, catalogue, devices=devices)
    stops = near.groupBy("ad_id", "date", "direction", "category").agg(F.min("utc_timestamp").alias("first_ts"), F.round(seconds_between(F.min("utc_timestamp"), F.max("utc_timestamp")) / 60.0, 1).alias("dwell_minutes"))
    during = stays.select("ad_id", "date", F.lit("during").alias("direction"), F.lit("target").alias("category"), F.col("arrival").alias("first_ts"), minutes_between(F.col("arrival"), F.col("departure")).cast("double").alias("dwell_minutes"))
    return stops.unionByName(during)
