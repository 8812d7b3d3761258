"""Distances, cells and the grid join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schema import BOX_MARGIN_DEG, CELL_DEG, EARTH_M, METERS_PER_DEG, POI_RADIUS_M


def planar_m(lat: Column, lng: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on the local plane."""
    dx = (lng - lng2) * F.cos(F.radians((lat + lat2) / 2))
    return METERS_PER_DEG * F.sqrt(F.pow(lat - lat2, 2) + F.pow(dx, 2))


def _half_chord(lat: Column, lng: Column, lat2: Column, lng2: Column) -> Column:
    return F.pow(F.sin(F.radians(lat2 - lat) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng) / 2), 2)


def haversine_m(lat: Column, lng: Column, lat2: Column, lng2: Column) -> Column:
    a = _half_chord(lat, lng, lat2, lng2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_km(lat: Column, lng: Column, lat2: Column, lng2: Column) -> Column:
    """Kilometres, by the clamped arc sine."""
    return 2 * EARTH_M / 1000 * F.asin(F.least(F.lit(1.0), F.sqrt(_half_chord(lat, lng, lat2, lng2))))


def cell(x: Column, size: float = CELL_DEG) -> Column:
    return F.floor(x / size).cast("long")


def ring_cells(lng: Column, low: Column | float, high: Column | float, size: float) -> Column:
    """Numbers of the meridian strips, about ``size`` degrees wide, that lie from ``low`` west to ``high`` east of a longitude, each once, around the globe."""
    n = max(1, int(360 / size))
    first, last = (F.floor((lng + 180 + d) * (n / 360)).cast("long") for d in (low, high))
    return F.transform(F.sequence(first, F.least(last, first + (n - 1))), lambda c: F.pmod(c, F.lit(n).cast("long")))


def line_cells(lng: Column, low: Column | float, high: Column | float, size: float) -> Column:
    """As :func:`ring_cells`, with longitudes as numbers on a line: no strip meets another one around the globe, and longitudes beyond 180 lie further east."""
    return F.sequence(cell(lng + low, size), cell(lng + high, size))


def near_cells(lat: Column, lng: Column, reach_km: float, *, globe: bool = True) -> tuple[Column, Column]:
    """Arrays of the cells, south to north and west to east, that may hold what is within reach (on the sphere) of a point.

    A degree of longitude is shorter at a higher latitude, and where the pole is within reach all of them are. Without
    ``globe`` longitudes don't meet across the date line.
    """
    size = reach_km / 111.0
    up = reach_km / (EARTH_M / 1000) * 180 / 3.141592653589793 * (1 + 1e-9)
    top = F.abs(lat) + up
    across = F.when(top >= 90, F.lit(360.0)).otherwise(up / F.cos(F.radians(F.least(top, F.lit(89.999999)))) + 1e-9)
    return F.sequence(cell(lat - up, size), cell(lat + up, size)), (ring_cells if globe else line_cells)(lng, -across, across, size)


def own_cell(lat: Column, lng: Column, reach_km: float, *, globe: bool = True) -> tuple[Column, Column]:
    """The cell of a point, as :func:`near_cells` numbers them."""
    size = reach_km / 111.0
    return cell(lat, size), (ring_cells if globe else line_cells)(lng, 0.0, 0.0, size)[0]


#: Rows of points by cell that may be broadcast, some ten megabytes. They are counted, as the planner's estimate of a side doesn't know how many cells a point is repeated over.
MOST_BROADCAST = 100_000


def shuffled_if_many(spread: DataFrame, n: int, *, most: int = MOST_BROADCAST) -> DataFrame:
    """``spread``, of ``n`` rows: left to the planner while these are few, and shuffled beyond that, whatever the planner takes its size for."""
    return spread if n <= most else spread.hint("merge")


def _reached(pois: DataFrame, radius_m: float) -> tuple[Column, Column, Column]:
    """The radius of each point and the arrays of the cells, south to north and west to east, that it reaches."""
    reach = F.coalesce(F.col("poi_radius_m"), F.lit(radius_m)) if "poi_radius_m" in pois.columns else F.lit(radius_m)
    up = reach / METERS_PER_DEG
    # the distance takes the cosine at the middle latitude, which is at most half the radius nearer to the pole
    across = up / F.greatest(F.cos(F.radians(F.least(F.abs(F.col("poi_lat")) + up, F.lit(90.0)))), F.lit(1e-3))
    cells = lambda c, deg: F.sequence(cell(F.col(c) - deg - 1e-9), cell(F.col(c) + deg + 1e-9))
    return reach, cells("poi_lat", up), cells("poi_lng", across)


def among(pois: DataFrame, pings: DataFrame, *, radius_m: float = POI_RADIUS_M, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """The points that may lie within reach of a ping: those that reach the box of the pings' cells.

    Beyond :data:`MOST_BROADCAST` cells the pings are read once more for the box, which is four numbers; points that
    lie elsewhere would else be shuffled and sorted with the pings. While there are fewer, all of them are returned.
    """
    _, ys, xs = _reached(pois, radius_m)
    n = pois.agg(F.sum(F.size(ys) * F.size(xs))).first()[0] or 0
    if n <= MOST_BROADCAST:
        return pois
    south, north, west, east = pings.select(cell(F.col(lat)).alias("y"), cell(F.col(lng)).alias("x")).agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    if south is None or west is None:
        return pois.limit(0)
    meets = lambda cells, low, high: (F.get(cells, 0) <= high) & (F.get(cells, F.size(cells) - 1) >= low)
    return pois.filter(meets(ys, south, north) & meets(xs, west, east))


def spatial_join(pings: DataFrame, pois: DataFrame, *, radius_m: float = POI_RADIUS_M, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Pairs of pings and points of interest within the radius, with ``distance_m``.

    An equi-join on grid cells: each point is repeated over the cells that its own radius reaches from where it lies
    (a degree of longitude is shorter at a higher latitude; at the poles all of them are reached), and the true
    distance is the rest of the condition. The points' cells are counted: beyond :data:`MOST_BROADCAST` of them both
    sides are shuffled by cell, so that what the driver holds is bounded; below that the planner broadcasts small ones. ``pois`` needs
    poi_lat and poi_lng, and may have its own poi_radius_m.
    """
    reach, ys, xs = _reached(pois, radius_m)
    n = pois.agg(F.sum(F.size(ys) * F.size(xs))).first()[0] or 0
    spread = shuffled_if_many(pois.withColumn("cy_", F.explode(ys)).withColumn("cx_", F.explode(xs)), n)
    celled = pings.withColumns({"py_": cell(F.col(lat)), "px_": cell(F.col(lng))})
    distance = planar_m(F.col(lat), F.col(lng), F.col("poi_lat"), F.col("poi_lng"))
    met = celled.join(spread, (F.col("py_") == F.col("cy_")) & (F.col("px_") == F.col("cx_")) & (distance <= reach))
    return met.withColumn("distance_m", distance).drop("py_", "px_", "cy_", "cx_")


def as_targets(pois: DataFrame, *extra: str) -> DataFrame:
    """poi_id, poi_lat, poi_lng and further columns of a catalogue."""
    return pois.select(F.col("id").alias("poi_id"), F.col("latitude").alias("poi_lat"), F.col("longitude").alias("poi_lng"), *extra)


def at_poi_pings(pings: DataFrame, targets: DataFrame, *, radius_m: float = POI_RADIUS_M) -> DataFrame:
    """Distinct ad_id, date, utc_timestamp, lat, lng of pings within reach of any target."""
    return spatial_join(pings, among(targets, pings, radius_m=radius_m), radius_m=radius_m).select("ad_id", "date", "utc_timestamp", "lat", "lng").distinct()


def closest_poi(pings: DataFrame, targets: DataFrame, *, radius_m: float = POI_RADIUS_M) -> DataFrame:
    """The nearest target of each ping within reach; of equally near ones the first id."""
    best = Window.partitionBy("ad_id", "utc_timestamp").orderBy("distance_m", "poi_id")
    return spatial_join(pings, among(targets, pings, radius_m=radius_m), radius_m=radius_m).withColumn("rn_", F.row_number().over(best)).filter("rn_ = 1").drop("rn_")


def within_box(pings: DataFrame, targets: DataFrame, *, margin: float = BOX_MARGIN_DEG) -> DataFrame:
    """Pings within the targets' bounding box and a margin; the box is four numbers, so that files can be skipped by it."""
    box = targets.agg(F.min("poi_lat"), F.max("poi_lat"), F.min("poi_lng"), F.max("poi_lng")).first()
    if box[0] is None:
        return pings.limit(0)
    return pings.filter(F.col("lat").between(box[0] - margin, box[1] + margin) & F.col("lng").between(box[2] - margin, box[3] + margin))


def gaussian_field(points: DataFrame, sources: DataFrame, *, sigma_km: float, cutoff: float = 3.0, key: str = "id") -> DataFrame:
    """``key`` and ``heat`` of each point (id, lat, lng): intensities of sources (lat, lng, intensity), weighted by distance.

    Sources further than ``cutoff`` sigmas don't count, so an equi-join on cells of that size, with the points
    repeated over the cells within reach at their latitude, meets every pair that does.
    """
    reach_km = sigma_km * cutoff
    cy, cx = own_cell(F.col("lat"), F.col("lng"), reach_km)
    src = sources.select(F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"), F.col("intensity"), cy.alias("cy_"), cx.alias("cx_"))
    ys, xs = near_cells(F.col("lat"), F.col("lng"), reach_km)
    pts = points.select(key, "lat", "lng").withColumn("py_", F.explode(ys)).withColumn("px_", F.explode(xs))
    d = haversine_km(F.col("lat"), F.col("lng"), F.col("s_lat"), F.col("s_lng"))
    met = pts.join(src, (F.col("py_") == F.col("cy_")) & (F.col("px_") == F.col("cx_"))).withColumn("d_", d).filter(F.col("d_") <= reach_km)
    heat = met.groupBy(key).agg(F.sum(F.col("intensity") * F.exp(-(F.col("d_") * F.col("d_")) / (2 * sigma_km * sigma_km))).alias("heat"))
    return points.select(key).join(heat, key, "left").select(key, F.coalesce("heat", F.lit(0.0)).alias("heat"))
