"""Report operators over pings and visits."""

from __future__ import annotations

from dataclasses import dataclass
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import among, spatial_join
from ..functions.numbers import half_up
from ..functions.timeutil import iso_day, local_time, minutes_between
from ..sources.schema import POI_RADIUS_M


def first_by(value: Column) -> Column:
    return F.min_by(value, F.struct("utc_timestamp", "lat", "lng"))


def last_by(value: Column) -> Column:
    return F.max_by(value, F.struct("utc_timestamp", "lat", "lng"))


def day_ends(pings: DataFrame) -> DataFrame:
    """First and last ping of each device-day."""
    return pings.groupBy("ad_id", "date").agg(
        first_by(F.col("lat")).alias("origin_lat"), first_by(F.col("lng")).alias("origin_lng"), F.min("utc_timestamp").alias("first_seen"), last_by(F.col("lat")).alias("dest_lat"), last_by(F.col("lng")).alias("dest_lng")
    )


def origin_destination(pings: DataFrame, at_poi: DataFrame, *, zone: str = "UTC", mark_starts: bool = False, limit: int | None = 100_000) -> DataFrame:
    """Flows of visitor device-days: where the day starts and ends (4 decimals), the hours of departure and of arrival at the place.

    With ``mark_starts`` the arrival hour is -1 where the day starts at the place. ``limit`` is the report's size.
    """
    arrival = at_poi.groupBy("ad_id", "date").agg(F.min("utc_timestamp").alias("arrival"))
    days = day_ends(pings).join(arrival, ["ad_id", "date"])
    hour = F.hour(local_time(F.col("arrival"), zone)).cast("long")
    if mark_starts:
        hour = F.when(F.col("arrival") == F.col("first_seen"), F.lit(-1)).otherwise(hour)
    flows = days.select(*[F.round(c, 4).alias(c) for c in ("origin_lat", "origin_lng", "dest_lat", "dest_lng")], F.hour(local_time(F.col("first_seen"), zone)).cast("long").alias("departure_hour"), hour.alias("poi_arrival_hour"))
    keys = flows.columns
    out = flows.groupBy(*keys).agg(F.count(F.lit(1)).alias("device_days"))
    return out.orderBy(F.desc("device_days"), *keys).limit(limit) if limit else out


def activity(rows: DataFrame, *keys: Column) -> DataFrame:
    """pings and devices by the keys."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("pings"), F.countDistinct("ad_id").alias("devices"))


def hourly(at_poi: DataFrame, *, zone: str = "UTC") -> DataFrame:
    return activity(at_poi, F.hour(local_time(F.col("utc_timestamp"), zone)).cast("long").alias("touch_hour"))


def day_hour(at_poi: DataFrame, *, zone: str = "UTC") -> DataFrame:
    ts = local_time(F.col("utc_timestamp"), zone)
    return activity(at_poi, iso_day(ts).cast("long").alias("dow"), F.hour(ts).cast("long").alias("hour"))


def daily(rows: DataFrame) -> DataFrame:
    return activity(rows, F.col("date"))


def total_devices(rows: DataFrame) -> DataFrame:
    return rows.agg(F.countDistinct("ad_id").alias("total_unique_devices"))


def hours_filled(hours: DataFrame) -> DataFrame:
    """All 24 hours, zero where nothing was seen."""
    spine = hours.sparkSession.range(24).select(F.col("id").alias("touch_hour"))
    return spine.join(hours, "touch_hour", "left").select("touch_hour", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pings", "devices")])


def catchment_first_ping(pings: DataFrame, at_poi: DataFrame, *, min_pings: int = 1, zone: str = "UTC") -> DataFrame:
    """First position of each visitor's day, 4 decimals, and the hour it is left."""
    visits = at_poi.groupBy("ad_id", "date").agg(F.count(F.lit(1)).alias("n_")).filter(F.col("n_") >= min_pings)
    days = day_ends(pings).join(visits, ["ad_id", "date"], "left_semi")
    return days.groupBy(F.round("origin_lat", 4).alias("origin_lat"), F.round("origin_lng", 4).alias("origin_lng"), F.hour(local_time(F.col("first_seen"), zone)).cast("long").alias("departure_hour")).agg(F.count(F.lit(1)).alias("device_days"))


def catchment_home(homes: DataFrame, visitors: DataFrame) -> DataFrame:
    """Homes of visitors by 4-decimal position; hour 0, the least zip code of the position."""
    met = homes.join(visitors.select("ad_id").distinct(), "ad_id", "left_semi")
    return met.groupBy(F.round("home_lat", 4).alias("origin_lat"), F.round("home_lng", 4).alias("origin_lng")).agg(F.lit(0).cast("long").alias("departure_hour"), F.min("home_zip").alias("native_zip"), F.count(F.lit(1)).alias("device_days"))


def best_home(homes: DataFrame) -> DataFrame:
    """One home for each device over several datasets: most nights, then latitude and longitude."""
    w = Window.partitionBy("ad_id").orderBy(F.desc("n_nights"), "home_lat", "home_lng")
    return homes.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").drop("rn_")


def mobility(pings: DataFrame, visit_times: DataFrame, catalogue: DataFrame, *, minutes: int = 120, radius_m: float = POI_RADIUS_M) -> DataFrame:
    """timing (before/after), category, device_days, hits: what visitors are near within the window around their visit."""
    met = around_visits(pings, visit_times, catalogue, minutes=minutes, radius_m=radius_m)
    return met.groupBy("timing", "category").agg(F.count(F.lit(1)).alias("device_days"), F.count(F.lit(1)).alias("hits"))


def around_visits(pings: DataFrame, visit_times: DataFrame, catalogue: DataFrame, *, minutes: int = 120, radius_m: float = POI_RADIUS_M) -> DataFrame:
    """Distinct ad_id, date, timing and category of places near pings within the window around a visit.

    ``visit_times`` has ad_id, date, visit_time, a row for each; its other columns follow. Pings within the visit's own
    minute don't count. Pings meet places first, so that only those near one are shuffled to their device-day's visit.
    """
    apart = minutes_between(F.col("visit_time"), F.col("utc_timestamp"))
    near = spatial_join(pings, among(catalogue, pings, radius_m=radius_m), radius_m=radius_m).select("ad_id", "date", "utc_timestamp", "category")
    around = near.join(visit_times, ["ad_id", "date"]).filter((F.abs(apart) > 0) & (F.abs(apart) <= minutes))
    timing = F.when(F.col("utc_timestamp") < F.col("visit_time"), "before").otherwise("after").alias("timing")
    return around.select("ad_id", "date", timing, "category", *[c for c in visit_times.columns if c not in ("ad_id", "date", "visit_time")]).distinct()


def visit_times(at_poi: DataFrame) -> DataFrame:
    return at_poi.groupBy("ad_id", "date").agg(F.min("utc_timestamp").alias("visit_time"))


def median_visit_times(marked: DataFrame, *, accuracy: int = 10_000) -> DataFrame:
    """The middle of each device-day's marked pings, where no positions of places are known."""
    seconds = F.percentile_approx(F.unix_seconds(F.col("utc_timestamp").cast("timestamp")), 0.5, accuracy)
    return marked.groupBy("ad_id", "date").agg(F.timestamp_seconds(seconds).cast("timestamp_ntz").alias("visit_time"))


def mobility_top(mob: DataFrame, *, each: int = 25, merged: int = 50) -> DataFrame:
    """timing, rank, category, device_days, hits: the top before and after, and both together."""
    both = mob.groupBy("category").agg(F.sum("device_days").alias("device_days"), F.sum("hits").alias("hits")).withColumn("timing", F.lit("both"))
    w = Window.partitionBy("timing").orderBy(F.desc("device_days"), "category")
    ranked = mob.unionByName(both).withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.filter(F.col("rank") <= F.when(F.col("timing") == "both", merged).otherwise(each)).select("timing", "rank", "category", "device_days", "hits")


def nse_origins(pings: DataFrame, at_poi: DataFrame, *, decimals: int = 1, visit_days_only: bool = False) -> DataFrame:
    """ad_id and the rounded position of a visitor's first ping, ever or over visit days."""
    visitors = at_poi.select("ad_id", *["date"] * visit_days_only).distinct()
    met = pings.join(visitors, ["ad_id", *["date"] * visit_days_only], "left_semi")
    return met.groupBy("ad_id").agg(F.round(first_by(F.col("lat")), decimals).alias("origin_lat"), F.round(first_by(F.col("lng")), decimals).alias("origin_lng"))


def affinity_input(homes: DataFrame, dwell: DataFrame) -> DataFrame:
    """Per home position (4 decimals): visit days, devices, mean dwell and visits a device."""
    met = dwell.join(homes, "ad_id")
    return met.groupBy(F.round("home_lat", 4).alias("origin_lat"), F.round("home_lng", 4).alias("origin_lng")).agg(
        F.count(F.lit(1)).alias("total_visits"), F.countDistinct("ad_id").alias("unique_devices"), F.round(F.avg("dwell_minutes") + 1e-9, 3).alias("avg_dwell"), F.round(F.count(F.lit(1)) / F.countDistinct("ad_id"), 6).alias("avg_frequency")
    )


def poi_usage(pings: DataFrame) -> DataFrame:
    """poi_id, pings and devices of each marked place."""
    ids = pings.select("ad_id", F.explode("poi_ids").alias("poi_id")).filter(F.col("poi_id") != "")
    return activity(ids, F.col("poi_id"))


def visits_by_poi(pings: DataFrame, qualified: DataFrame | None = None) -> DataFrame:
    """poi_id, visits (device-days) and devices, over qualified device-days if given."""
    if qualified is not None:
        pings = pings.join(qualified.select("ad_id", "date"), ["ad_id", "date"], "left_semi")
    ids = pings.select("ad_id", "date", F.explode("poi_ids").alias("poi_id")).filter(F.col("poi_id") != "").distinct()
    return ids.groupBy("poi_id").agg(F.count(F.lit(1)).alias("visits"), F.countDistinct("ad_id").alias("devices"))


def summary(pings: DataFrame) -> DataFrame:
    pois = pings.select(F.explode("poi_ids").alias("p")).filter(F.col("p") != "").agg(F.countDistinct("p").alias("pois"))
    return pings.agg(F.count(F.lit(1)).alias("pings"), F.countDistinct("ad_id").alias("devices"), F.countDistinct("date").alias("days")).join(pois)


def daily_filled(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Every date of the range, zero where nothing was seen."""
    spine = rows.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("date"))
    return spine.join(daily(rows), "date", "left").select("date", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pings", "devices")])


def weekly(days: DataFrame) -> DataFrame:
    from ..functions.timeutil import week_start

    return days.groupBy(week_start(F.col("date")).alias("week_start")).agg(F.sum("pings").alias("pings"), F.sum("devices").alias("devices"))


def monthly(days: DataFrame) -> DataFrame:
    return days.groupBy(F.substring("date", 1, 7).alias("month")).agg(F.sum("pings").alias("pings"), F.sum("devices").alias("devices"))


def by_weekday(days: DataFrame) -> DataFrame:
    """0 (Sunday) to 6, with rounded means over the dates; zero where no date is."""
    spine = days.sparkSession.range(7).select(F.col("id").alias("day"))
    means = days.groupBy((F.dayofweek(F.to_date("date")) - 1).cast("long").alias("day")).agg(half_up(F.avg("pings")).alias("avg_pings"), half_up(F.avg("devices")).alias("avg_devices"))
    return spine.join(means, "day", "left").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("avg_pings", "avg_devices")])


def tenth_key(x: Column) -> Column:
    """Key of the geocode cache: tenths of a degree."""
    return F.round(x * 10).cast("int")


def with_zip(rows: DataFrame, geocode: DataFrame, *, lat: str = "origin_lat", lng: str = "origin_lng", name: str = "zip") -> DataFrame:
    """Adds the zip code of a position by the cache; UNKNOWN where it has none."""
    keyed = geocode.select(F.col("lat_key").alias("a_"), F.col("lng_key").alias("b_"), F.col("zipcode").alias("z_"))
    met = rows.join(keyed, (tenth_key(F.col(lat)) == F.col("a_")) & (tenth_key(F.col(lng)) == F.col("b_")), "left")
    return met.withColumn(name, F.coalesce("z_", F.lit("UNKNOWN"))).drop("a_", "b_", "z_")


def od_by_zip(flows: DataFrame, geocode: DataFrame) -> DataFrame:
    """side (origin/destination), zip and device_days."""
    ends = [with_zip(flows, geocode, lat=f"{c}_lat", lng=f"{c}_lng").groupBy("zip").agg(F.sum("device_days").alias("device_days")).withColumn("side", F.lit(side)) for c, side in (("origin", "origin"), ("dest", "destination"))]
    return ends[0].unionByName(ends[1]).select("side", "zip", "device_days")


def od_hours(flows: DataFrame) -> DataFrame:
    """hour 0 to 23 with device-days that depart and arrive in it, zero-filled."""
    spine = flows.sparkSession.range(24).select(F.col("id").alias("hour"))
    dep = flows.groupBy(F.col("departure_hour").alias("hour")).agg(F.sum("device_days").alias("departures"))
    arr = flows.filter("poi_arrival_hour >= 0").groupBy(F.col("poi_arrival_hour").alias("hour")).agg(F.sum("device_days").alias("arrivals"))
    return spine.join(dep, "hour", "left").join(arr, "hour", "left").select("hour", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("departures", "arrivals")])


def capture_rings(zips: DataFrame) -> DataFrame:
    """zip, device_days, share_percentage and capture_ring: the first of 70, 80, 90 % that the larger zips had not filled.

    One row per zip code goes through one window.
    """
    order = Window.orderBy(F.desc("device_days"), "zip").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("device_days").over(Window.partitionBy())
    ranked = zips.withColumns({"before_": F.coalesce(F.sum("device_days").over(order), F.lit(0)), "total_": total})
    cum = (F.col("before_") + F.col("device_days")) / F.col("total_")
    ring = F.when((cum <= 0.7) | (F.col("before_") < F.col("total_") * 0.7), 70).when((cum <= 0.8) | (F.col("before_") < F.col("total_") * 0.8), 80).when((cum <= 0.9) | (F.col("before_") < F.col("total_") * 0.9), 90)
    return ranked.select("zip", "device_days", (half_up(F.col("device_days") / F.col("total_") * 10000) / 100).alias("share_percentage"), ring.cast("long").alias("capture_ring"))


def ring_totals(rings: DataFrame) -> DataFrame:
    """ring, zips and device_days; rings hold one another."""
    sizes = F.filter(F.array(F.lit(70), F.lit(80), F.lit(90)), lambda r: F.col("capture_ring") <= r)
    each = rings.filter("capture_ring is not null").select("device_days", F.explode(sizes).alias("ring"))
    return each.groupBy(F.col("ring").cast("long").alias("ring")).agg(F.count(F.lit(1)).alias("zips"), F.sum("device_days").alias("device_days"))


def normal_postal(raw: Column, country: str) -> Column:
    """Upper case without spaces and country prefix; Mexican digits padded to five."""
    s = F.regexp_replace(F.upper(F.trim(raw)), r"\s+", "")
    s = F.when(s.rlike("^[A-Z]{2}-"), F.substring(s, 4, 1000)).otherwise(s)
    if country.upper() != "MX":
        return s
    digits = F.regexp_replace(s, "[^0-9]", "")
    return F.when(F.char_length(digits).between(1, 5), F.lpad(digits, 5, "0")).otherwise(s)


def zip_shares(classified: DataFrame, total: int) -> DataFrame:
    """zip, devices, percent of all devices and of the classified ones (two decimals)."""
    per = classified.groupBy("zip").agg(F.countDistinct("ad_id").alias("devices"))
    known = F.sum(F.when(F.col("zip") != "UNKNOWN", F.col("devices"))).over(Window.partitionBy())
    percent = lambda of: half_up(F.col("devices") / of * 10000) / 100
    return per.select("zip", "devices", percent(F.lit(float(total))).alias("percent_of_total"), F.when(F.col("zip") != "UNKNOWN", percent(known)).otherwise(F.lit(0.0)).alias("percent_of_classified"))


def movements_sample(pings: DataFrame, *, devices: int = 50, per_device: int = 2000) -> DataFrame:
    """The first pings of a sample of devices, which is the same each time."""
    chosen = pings.select("ad_id").distinct().orderBy(F.md5("ad_id"), "ad_id").limit(devices)
    w = Window.partitionBy("ad_id").orderBy("utc_timestamp", "lat", "lng")
    return pings.join(chosen, "ad_id", "left_semi").withColumn("rn_", F.row_number().over(w)).filter(F.col("rn_") <= per_device).select("ad_id", "date", "utc_timestamp", "lat", "lng")


def affinity_v1(rows: DataFrame) -> DataFrame:
    """zip, total_visits, unique_devices, avg_dwell, avg_frequency, affinity_index: visits 40 %, dwell 30 % (to 60 min), frequency 30 % (log, to 10)."""
    mean = lambda c: F.sum(F.col(c) * F.col("total_visits")) / F.sum("total_visits")
    per = rows.groupBy("zip").agg(F.sum("total_visits").alias("total_visits"), F.sum("unique_devices").alias("unique_devices"), mean("avg_dwell").alias("d_"), mean("avg_frequency").alias("f_"))
    top = F.greatest(F.max("total_visits").over(Window.partitionBy()), F.lit(1))
    visits, dwell = F.col("total_visits") / top * 100, F.least(F.col("d_") / 60, F.lit(1.0)) * 100
    freq = F.least(F.log2(F.greatest(F.col("f_"), F.lit(1.0))) / F.log2(F.lit(10.0)), F.lit(1.0)) * 100
    return per.select("zip", "total_visits", "unique_devices", (half_up(F.col("d_") * 10) / 10).alias("avg_dwell"), (half_up(F.col("f_") * 100) / 100).alias("avg_frequency"), half_up(0.4 * visits + 0.3 * dwell + 0.3 * freq).alias("affinity_index"))


def catchment_polygons(catchment: DataFrame, polygons: DataFrame) -> DataFrame:
    """Each polygon with the least capture ring and the device-days of its zip code; postal codes are normalised on both sides.

    ``catchment`` and ``polygons`` have zip and country; rows of an unknown country join by the code alone.
    """
    key = F.regexp_replace(F.upper(F.trim("zip")), r"[\s-]", "")
    c = catchment.select(key.alias("key"), F.upper("country").alias("c_"), "device_days", "capture_ring")
    p = polygons.withColumns({"key": key, "p_": F.upper("country")})
    met = p.join(c, ["key"], "inner").filter((F.col("c_") == F.col("p_")) | (F.col("c_") == "UNKNOWN"))
    names = [x for x in polygons.columns if x not in ("rings",)]
    return met.groupBy(*names).agg(F.min("capture_ring").alias("capture_ring"), F.sum("device_days").alias("device_days"))


def heat_contrast(cells: DataFrame, *, value: str = "pings", blend: float = 0.5) -> DataFrame:
    """Adds ``intensity``: the value between least and most, blended with its rank."""
    every = Window.partitionBy()
    low, high = F.min(value).over(every), F.max(value).over(every)
    n = F.count(F.lit(1)).over(every)
    linear = F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.lit(0.0))
    rank = F.when(n > 1, (F.rank().over(Window.orderBy(value)) - 1) / (n - 1)).otherwise(F.lit(0.0))
    return cells.withColumn("intensity", F.round((1 - blend) * linear + blend * rank, 6))


def headline(hours: DataFrame, mob: DataFrame) -> DataFrame:
    """peak_hour and its share of pings, and the category of most device-days."""
    total = hours.agg(F.max_by("touch_hour", F.struct("pings", -F.col("touch_hour"))).alias("peak_hour"), F.round(F.max("pings") / F.sum("pings"), 6).alias("peak_share"))
    both = mob.groupBy("category").agg(F.sum("device_days").alias("n"))
    # ties go to the later name
    return total.join(both.agg(F.max(F.struct("n", "category"))["category"].alias("top_category")))


#: Days by their ISO number.
DAYS = ("", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


@dataclass(frozen=True)
class SummaryInput:
    """Headline numbers of a report, any of which may be missing; shares are in percent."""

    subject: str = "This analysis"
    devices: int | None = None
    device_days: int | None = None
    visit_days: int | None = None
    pois: int | None = None
    first: str | None = None
    last: str | None = None
    rings: dict[int, tuple[int, float]] | None = None  # for 70, 80 and 90: zip codes and their share
    zips: int | None = None
    top_zip: tuple[str, str, float] | None = None
    peak_hour: tuple[int, float] | None = None
    peak_day: tuple[int, float] | None = None
    weekend_share: float | None = None
    avg_dwell: float | None = None
    median_frequency: float | None = None
    repeat_share: float | None = None
    top_category: tuple[str, float] | None = None
    personas: tuple[int, str, float] | None = None


def _percent(x: float) -> str:
    return f"{floor(x + 0.5)}%" if x >= 10 else f"{x:.1f}%"


def _hour(h: int) -> str:
    return f"{h % 12 or 12}{'AM' if h < 12 else 'PM'} (local time)"


# The wording of the headline, the bullets and the paragraph is that of the report that is reproduced.
def executive_summary(m: SummaryInput) -> dict[str, str | list[str]]:
    """headline, bullets and paragraph about a report; what is not known is left out. Texts on the driver, from a few numbers."""
    known = lambda *pairs: [text() for value, text in pairs if value is not None]
    span = "" if not (m.first or m.last) else (m.first or "") if not m.last or m.first == m.last else f"{m.first} to {m.last}" if m.first else f" to {m.last}"
    days = known((m.device_days, lambda: f"{m.device_days:,} device-days")) or known((m.visit_days, lambda: f"{m.visit_days:,} visit-days"))
    scale = [*known((m.devices, lambda: f"{m.devices:,} unique devices")), *days]
    bullets = []
    if scale:
        places = f" to {m.pois:,} POIs" if m.pois and m.pois > 1 else ""
        bullets.append(f"**Scale**: {' across '.join(scale)}{places}{f' ({span})' if span else ''}.")
    if m.rings and m.zips:
        (core, held), (most, reach) = m.rings[70], m.rings[90]
        bullets.append(f"**Addressable core**: the top {core:,} zip codes ({floor(core / m.zips * 100 + 0.5)}% of {m.zips:,} measured) hold {_percent(held)} of the catchment; the top {most:,} hold {_percent(reach)}.")
    elif m.top_zip:
        code, city, share = m.top_zip
        bullets.append(f"**Top zip**: {code}{f' ({city})' if city else ''} delivers {_percent(share)} of the catchment.")
    timing = known(
        (m.peak_hour, lambda: f"peaks at {_hour(m.peak_hour[0])} ({_percent(m.peak_hour[1])} of daily traffic)"),
        (m.peak_day, lambda: f"busiest day is {DAYS[m.peak_day[0]]} ({_percent(m.peak_day[1])} of weekly traffic)"),
        (m.weekend_share, lambda: f"{_percent(m.weekend_share)} of visits fall on weekends"),
    )
    engaged = known(
        (m.avg_dwell, lambda: f"average dwell {floor(m.avg_dwell + 0.5)} min"),
        (m.median_frequency, lambda: f"median repeat frequency of {m.median_frequency:.1f} visits per device"),
        (m.repeat_share, lambda: f"{_percent(m.repeat_share)} of devices return 3+ times"),
    )
    bullets += [f"**{title}**: {sep.join(parts)}." for title, sep, parts in (("Timing", "; ", timing), ("Engagement", ", ", engaged)) if parts]
    if m.top_category:
        bullets.append(f"**Adjacent behavior**: the top destination category within ±2h of the POIs is *{m.top_category[0]}* ({_percent(m.top_category[1])} of mobility traffic).")
    if m.personas:
        n, name, share = m.personas
        bullets.append(f'**Personas**: {n} distinct audience segments identified; the dominant cluster "*{name}*" represents {_percent(share)} of the base.')
    short = (scale[:1] if m.devices is not None or m.device_days is not None else []) + ([f"top {m.rings[80][0]:,} zips capture {_percent(m.rings[80][1])}"] if m.rings else [])
    told = []
    if scale:
        told.append(f"{m.subject} reached {' ('.join(scale)}{')' if len(scale) > 1 else ''}{f' between {span}' if span else ''}.")
    if m.rings:
        told.append(f"The addressable trade area is highly concentrated: the top {m.rings[70][0]:,} zip codes cumulatively account for {_percent(m.rings[70][1])} of all device-days, and {m.rings[90][0]:,} zips for {_percent(m.rings[90][1])}.")
    if m.peak_hour:
        weekends = "" if m.weekend_share is None else f" with {_percent(m.weekend_share)} of traffic falling on weekends"
        told.append(f"Visit timing peaks at {_hour(m.peak_hour[0])}{weekends}.")
    signs = known((m.avg_dwell, lambda: f"an average dwell of {floor(m.avg_dwell + 0.5)} minutes"), (m.repeat_share, lambda: f"{_percent(m.repeat_share)} of devices returning 3+ times"))
    if signs:
        told.append(f"Engagement signals show {' and '.join(signs)}.")
    return {"headline": f"{m.subject}: {'; '.join(short) if short else 'analysis ready'}.", "bullets": bullets, "paragraph": " ".join(told)}
