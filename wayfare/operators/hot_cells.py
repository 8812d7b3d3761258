"""The grid join of pings and places where a few cells hold a large share of all pings.

Pings are counted once by the finest cells of a quadtree. A cell with more than its share of pings is split in four,
and again, down to the finest level; a cell that is still too full there (many pings at one spot) is dealt over salts,
and its places are repeated for each. Both sides then meet on (level, cell, salt) in an equi-join, whose keys hold at
most a known number of pings each. The tree's inner cells are few: at most the inverse of a share for each level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durable import materialize
from ..functions.geo import planar_m
from ..sources.schema import CELL_DEG, METERS_PER_DEG, POI_RADIUS_M

#: Levels below the grid of the plain join: the finest cells are a sixteenth as wide.
LEVELS = 4


def _cell(x: Column, level: int) -> Column:
    """The number of the cell at a level; that of its parent is half of it, rounded down."""
    return F.floor(x / (CELL_DEG / 2**LEVELS)).cast("long") if level == LEVELS else F.shiftright(_cell(x, LEVELS), LEVELS - level)


def crowded(pings: DataFrame, *, most: int | None = None, lat: str = "lat", lng: str = "lng") -> tuple[DataFrame, int]:
    """level, cy, cx and n of the cells with more than ``most`` pings, and that number.

    By default a cell may hold a quarter of an even share of a shuffle partition.
    """
    fine = pings.groupBy(_cell(F.col(lat), LEVELS).alias("cy"), _cell(F.col(lng), LEVELS).alias("cx")).agg(F.count(F.lit(1)).alias("n"))
    fine = materialize(fine, "cells")
    if most is None:
        parts = int(pings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        most = max(1, (fine.agg(F.sum("n")).first()[0] or 0) // (4 * parts))

    def at(level: int) -> DataFrame:
        up = LEVELS - level
        sums = fine.groupBy(F.shiftright("cy", up).alias("cy"), F.shiftright("cx", up).alias("cx")).agg(F.sum("n").alias("n"))
        return sums.filter(F.col("n") > most).select(F.lit(level).alias("level"), "cy", "cx", "n")

    return materialize(reduce(DataFrame.unionByName, [at(k) for k in range(LEVELS + 1)]), "crowded"), most


def spatial_join_even(pings: DataFrame, pois: DataFrame, *, radius_m: float = POI_RADIUS_M, most: int | None = None, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """The rows of :func:`wayfare.functions.geo.spatial_join`, with no key that more than about ``most`` pings share."""
    full, most = crowded(pings, most=most, lat=lat, lng=lng)
    # at most LEVELS + 1 times as many rows as cells of that size can be
    spots = {k: F.broadcast(full.filter(F.col("level") == k).select(F.col("cy").alias(f"y{k}_"), F.col("cx").alias(f"x{k}_"), F.ceil(F.col("n") / most).cast("int").alias(f"s{k}_"))) for k in range(LEVELS + 1)}

    def marked(rows: DataFrame, level: int, y: Column, x: Column) -> DataFrame:
        """Rows with the number of salts of their cell at a level, null where it isn't crowded."""
        return rows.withColumns({"ty_": y, "tx_": x}).join(spots[level], (F.col("ty_") == F.col(f"y{level}_")) & (F.col("tx_") == F.col(f"x{level}_")), "left").drop("ty_", "tx_", f"y{level}_", f"x{level}_")

    left = pings
    for k in range(LEVELS + 1):
        left = marked(left, k, _cell(F.col(lat), k), _cell(F.col(lng), k))
    # the level below the last crowded cell on the way down
    inner = [F.col(f"s{k}_").isNotNull().cast("int") for k in range(LEVELS)]
    level = reduce(lambda a, b: a + b, inner)
    by_level = lambda c: F.element_at(F.array(*[_cell(F.col(c), k) for k in range(LEVELS + 1)]), F.col("level_") + 1)
    salt = F.when(F.col(f"s{LEVELS}_").isNotNull(), F.pmod(F.xxhash64(*pings.columns[:3]), F.col(f"s{LEVELS}_"))).otherwise(F.lit(0)).cast("int")
    left = left.withColumn("level_", level).withColumns({"qy_": by_level(lat), "qx_": by_level(lng), "salt_": salt}).drop(*[f"s{k}_" for k in range(LEVELS + 1)])

    reach = F.coalesce(F.col("poi_radius_m"), F.lit(radius_m)) if "poi_radius_m" in pois.columns else F.lit(radius_m)
    up = reach / METERS_PER_DEG
    across = up / F.greatest(F.cos(F.radians(F.least(F.abs(F.col("poi_lat")) + up, F.lit(90.0)))), F.lit(1e-3))

    def covered(rows: DataFrame, k: int, within: bool) -> DataFrame:
        """Places at each cell of a level within reach; those of inner cells only, if asked for."""
        span = lambda c, deg: F.sequence(_cell(F.col(c) - deg - 1e-9, k), _cell(F.col(c) + deg + 1e-9, k))
        cells = rows.withColumn("cy_", F.explode(span("poi_lat", up))).withColumn("cx_", F.explode(span("poi_lng", across)))
        if within:
            parents = F.broadcast(full.filter(F.col("level") == k - 1).select(F.col("cy").alias("py_"), F.col("cx").alias("px_")))
            cells = cells.join(parents, (F.shiftright("cy_", 1) == F.col("py_")) & (F.shiftright("cx_", 1) == F.col("px_")), "left_semi")
        return marked(cells, k, F.col("cy_"), F.col("cx_"))

    right = []
    for k in range(LEVELS + 1):
        rows = covered(pois, k, k > 0)
        here = F.col(f"s{k}_")
        rows = rows.withColumn("salt2_", F.explode(F.sequence(F.lit(0), F.coalesce(here, F.lit(1)) - 1))) if k == LEVELS else rows.filter(here.isNull()).withColumn("salt2_", F.lit(0))
        right.append(rows.withColumn("lev_", F.lit(k)).drop(f"s{k}_"))
    places = reduce(DataFrame.unionByName, right)
    distance = planar_m(F.col(lat), F.col(lng), F.col("poi_lat"), F.col("poi_lng"))
    keys = (F.col("level_") == F.col("lev_")) & (F.col("qy_") == F.col("cy_")) & (F.col("qx_") == F.col("cx_")) & (F.col("salt_") == F.col("salt2_"))
    met = left.join(places, keys & (distance <= reach)).withColumn("distance_m", distance)
    return met.drop("level_", "qy_", "qx_", "salt_", "lev_", "cy_", "cx_", "salt2_")
