"""Sets of places: target coordinates, greedy thinning, matching, positions, and plans of how to split jobs."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta
from itertools import chain, groupby
from math import ceil
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.durable import append, materialize, new_path
from ..functions.geo import cell, haversine_m, near_cells, own_cell, spatial_join
from ..sources.schema import POI_RADIUS_M


def target_coordinates(jobs: DataFrame) -> DataFrame:
    """poi_lat, poi_lng (4 decimals, each once) and poi_radius_m; a job's own point comes before its list's."""
    lat, lng = F.coalesce("radius_lat", "list_lat"), F.coalesce("radius_lng", "list_lng")
    points = jobs.select(F.round(lat, 4).alias("poi_lat"), F.round(lng, 4).alias("poi_lng"), F.coalesce("radius_m", F.lit(POI_RADIUS_M)).alias("r")).filter("poi_lat is not null and poi_lng is not null")
    return points.groupBy("poi_lat", "poi_lng").agg(F.min("r").alias("poi_radius_m"))


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that is shuffled: written tables take far less than the planner's limit for broadcasts in files, and far more in the driver's memory."""
    return rows.hint("merge")


#: What a row of a sweep says: an id is removed; a place that another block hangs on is decided; a block is done.
REMOVED, TOLD, FINISHED = 0, 1, 2


def _swept(sides: DataFrame, schema: T.StructType) -> DataFrame:
    """What blocks of pairs can tell of their places, see :data:`REMOVED`; ``sides`` are sorted by block and by the order of the first.

    A side is a pair (``here`` is the block it is dealt to, ``own`` whether its first lies there, ``to`` the block of
    its second), or, before the pairs of a place that lies elsewhere, what is known of it (``stays``: 1, 0 or, of
    pairs, -1). What comes first and is not known may yet be removed, so that what it would remove is in doubt, and so
    is what hangs on that. A block tells of its removed ids when none of its own is in doubt; its task holds the ids
    that are removed or in doubt, not its pairs.
    """
    most = 10_000

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = chain.from_iterable(zip(*[b[c] for c in ("here", "position", "id", "pair", "own", "to", "id2", "stays")], strict=True) for b in batches)
        out = []
        frame = lambda x: pd.DataFrame(x, columns=schema.names, dtype=object)
        for here, block in groupby(rows, key=itemgetter(0)):
            gone, doubt, told, last, stays = set(), set(), set(), None, -1
            for _, position, first, pair, own, to, second, said in block:
                if first != last:
                    last, told = first, set()
                    stays = said if not own else -1 if first in doubt else int(first not in gone)
                if not pair:
                    continue
                if to != here:
                    if stays >= 0 and to not in told:
                        told.add(to)
                        out.append((TOLD, to, position, first, stays))
                elif stays and second not in gone:
                    if stays < 0:
                        doubt.add(second)
                    else:
                        gone.add(second)
                        doubt.discard(second)
                if len(out) >= most:
                    yield frame(out)
                    out = []
            if not doubt:
                out.append((FINISHED, here, None, None, None))
                while gone:
                    yield frame(out + [(REMOVED, here, None, gone.pop(), None) for _ in range(min(most, len(gone)))])
                    out = []
        yield frame(out)

    return sides.sortWithinPartitions("here", "position", "id", "pair").mapInPandas(sweep, schema)


def _blocks(live: DataFrame, sweep_pairs: int) -> tuple[DataFrame, int]:
    """The sides of ``live``, each pair dealt to the blocks of both of its places, and the number of blocks, which are ranges of cells with about ``sweep_pairs`` pairs each."""
    n = max(1, ceil(live.count() / sweep_pairs))
    spots = live.select("cx", "cy").unionByName(live.select(F.col("cx2").alias("cx"), F.col("cy2").alias("cy")))
    cells = spots.repartitionByRange(n, "cx", "cy").select("cx", "cy", F.spark_partition_id().alias("block")).distinct()
    cells = materialize(cells, "blocks")
    second = cells.toDF("cx2", "cy2", "block2")
    sides = live.join(shuffled(cells), ["cx", "cy"]).join(shuffled(second), ["cx2", "cy2"]).withColumn("here", F.explode(F.array_distinct(F.array("block", "block2"))))
    sides = sides.select("here", "position", "id", F.lit(True).alias("pair"), (F.col("here") == F.col("block")).alias("own"), F.col("block2").alias("to"), "id2", F.lit(-1).alias("stays"))
    return materialize(sides.repartition(n, "here").sortWithinPartitions("here"), "near"), n


def greedy_distinct(pois: DataFrame, *, radius_m: float = 50.0, rounds: int = 0, sweep_pairs: int = 500_000, globe: bool = True) -> DataFrame:
    """Places that stay when they are taken by ``position`` and each removes the later ones within the radius.

    Near pairs are found by an equi-join on cells; without ``globe`` longitudes are numbers on a line, that don't meet
    across the date line. In each of some plain ``rounds`` a place that is first among its undecided neighbours stays,
    and removes them. Then cells are put into blocks of about ``sweep_pairs`` pairs, which are counted, and a task
    takes a block's pairs in order, as a stream, and decides all that doesn't hang on another block. What is decided
    of places that other blocks hang on is written, and only blocks that learn something by it are taken again: a
    chain takes a round for each block that it passes through, and such a round reads that block alone. No plan grows
    with the rounds, and no side is broadcast: places and removed ones are as many as the catalogue's rows.
    """
    reach_km = radius_m / 1000 * 1.01
    deg = pois.select("id", "position", "latitude", "longitude")
    ys, xs = near_cells(F.col("latitude"), F.col("longitude"), reach_km, globe=globe)
    cy, cx = own_cell(F.col("latitude"), F.col("longitude"), reach_km, globe=globe)
    a = deg.withColumns({"cy": cy, "cx": cx}).withColumn("ny", F.explode(ys)).withColumn("nx", F.explode(xs))
    b = deg.select(F.col("id").alias("id2"), F.col("position").alias("p2"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lng2"), cy.alias("cy2"), cx.alias("cx2"))
    pairs = a.join(shuffled(b), (F.col("ny") == F.col("cy2")) & (F.col("nx") == F.col("cx2")) & (F.struct("position", "id") < F.struct("p2", "id2")))
    pairs = pairs.filter(haversine_m(F.col("latitude"), F.col("longitude"), F.col("lat2"), F.col("lng2")) <= radius_m).select("id", "position", "id2", "cx", "cy", "cx2", "cy2")
    spark = pois.sparkSession
    live, path = materialize(pairs, "near"), new_path(spark, "decided")
    kinds = {f.name: f.dataType for f in deg.schema}
    schema = T.StructType().add("kind", T.IntegerType()).add("here", T.IntegerType()).add("position", kinds["position"]).add("id", kinds["id"]).add("stays", T.IntegerType())
    for _ in range(rounds):
        # the first of a pair stays if no undecided place comes before it; what it removes is decided
        later = live.select(F.col("id2").alias("id")).distinct()
        found = live.join(shuffled(later), "id", "left_anti").select(F.lit(REMOVED).alias("kind"), F.col("id2").alias("id")).distinct()
        gone = append(found, path).select("id")
        # pairs of a removed place, on either side, decide nothing any more; nor do those of one that stays
        live = materialize(live.join(shuffled(gone), "id", "left_anti").join(shuffled(gone.withColumnRenamed("id", "id2")), "id2", "left_anti").select(*live.columns), "near")
    if live.isEmpty() and not rounds:
        return pois.select("id")
    if not live.isEmpty():
        _sweep_all(live, sweep_pairs, path, schema)
    every = spark.read.schema(schema).parquet(path).filter(F.col("kind") == REMOVED).select("id")
    return pois.join(shuffled(every), "id", "left_anti").select("id")


def _sweep_all(live: DataFrame, sweep_pairs: int, path: str, schema: T.StructType) -> None:
    """Sweep blocks until all are done; a row for each block reaches the driver, and one for each that learns something."""
    dealt, n = _blocks(live, sweep_pairs)
    at_work, done, known = None, set(), None
    while at_work is None or at_work:
        sides = dealt
        if at_work is not None:
            news = known.select("here", "position", "id", F.lit(False).alias("pair"), F.lit(False).alias("own"), F.col("here").alias("to"), F.col("id").alias("id2"), "stays")
            sides = dealt.unionByName(news).filter(F.col("here").isin(at_work))
        found = append(_swept(sides.repartition(n if at_work is None else len(at_work), "here"), schema), path)
        done |= {r["here"] for r in found.filter(F.col("kind") == FINISHED).select("here").collect()}
        told = found.filter(F.col("kind") == TOLD)
        fresh = told if known is None else told.join(shuffled(known.select("here", "id")), ["here", "id"], "left_anti")
        at_work = sorted({r["here"] for r in fresh.select("here").distinct().collect()} - done)
        # rows that a block tells again say the same
        known = live.sparkSession.read.schema(schema).parquet(path).filter(F.col("kind") == TOLD)


def best_match(queries: DataFrame, candidates: DataFrame, *, radius_m: float = 100.0, bonus: float = 50.0) -> DataFrame:
    """The best candidate of each query place: nearness (100 less the metres) plus a bonus for the same category."""
    met = spatial_join(queries.select("query_id", F.col("category").alias("wanted"), "lat", "lng"), candidates, radius_m=radius_m)
    score = F.greatest(100 - F.col("distance_m"), F.lit(0.0)) + F.when(F.lower("wanted") == F.lower("category"), bonus).otherwise(0.0)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "poi_id")
    return met.withColumn("score", score).withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").select("query_id", "poi_id", F.round("score", 4).alias("score"))


def positions(ids: DataFrame, *sources: DataFrame) -> DataFrame:
    """poi_id, lat, lng, name of each id from the first source (poi_id, lat, lng, name) that has it."""
    out = ids.select("poi_id").distinct()
    for i, s in enumerate(sources):
        out = out.join(s.select("poi_id", F.struct("lat", "lng", "name").alias(f"s{i}")), "poi_id", "left")
    found = F.coalesce(*[F.col(f"s{i}") for i in range(len(sources))])
    return out.select("poi_id", found["lat"].alias("lat"), found["lng"].alias("lng"), F.coalesce(found["name"], F.col("poi_id")).alias("name"))


def split_plan(first: date, last: date, pois: int, *, most_days: int = 31, most_pois: int = 25_000) -> list[tuple[date, date, int, int]]:
    """(first day, last day, first place, end place) of each sub-job: whole months where the range is too long, and equal shares of places."""
    spans: list[tuple[date, date]] = []
    if (last - first).days + 1 <= most_days:
        spans.append((first, last))
    else:
        at = first
        while at <= last:
            month_end = (at.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)
            spans.append((at, min(month_end, last)))
            at = month_end + timedelta(days=1)
    parts = max(1, ceil(pois / most_pois))
    size = ceil(pois / parts) if pois else 0
    return [(a, b, i * size, min((i + 1) * size, pois)) for a, b in spans for i in range(parts)]


#: Edges that a border cell of a shape has, give or take; and how often the cells' width may be halved for that.
EDGES_IN_CELL, MOST_HALVINGS = 64, 8
#: Where in a cell its reference point lies: off the middle, where round coordinates are unlikely.
_AT = 0.51370418


def _edges(polygons: DataFrame, step: float) -> DataFrame:
    """polygon_id, s (width of its cells) and e (ax, ay, bx, by) of each side of each ring."""
    n_edges = F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r))
    halvings = F.ceil(F.log2(F.greatest(n_edges, F.lit(1)) / EDGES_IN_CELL) / 2)
    s = step / F.pow(F.lit(2.0), F.least(F.greatest(halvings, F.lit(0)), F.lit(MOST_HALVINGS)))
    rings = polygons.select("polygon_id", s.alias("s"), F.explode("rings").alias("r"))
    after = lambda r, i: F.element_at(r, F.when(i + 1 == F.size(r), 1).otherwise(i + 2))
    side = lambda p, i: F.struct(p[0].alias("ax"), p[1].alias("ay"), after(F.col("r"), i)[0].alias("bx"), after(F.col("r"), i)[1].alias("by"))
    return rings.select("polygon_id", "s", F.explode(F.transform("r", side)).alias("e"))


def _x_at(e: Column, y: Column) -> Column:
    return (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]


def _y_at(e: Column, x: Column) -> Column:
    return (e["by"] - e["ay"]) * (x - e["ax"]) / (e["bx"] - e["ax"]) + e["ay"]


def points_in_polygons(points: DataFrame, polygons: DataFrame, *, step: float = 0.1) -> DataFrame:
    """point_id and the polygon (polygon_id, zip, country) that holds each point; of several the one of the smallest box.

    ``polygons`` has rings, an array of rings of [lng, lat]: a point inside an odd number of rings is inside.

    Boxes of polygons, without their rings, are repeated over the grid cells that they reach, and points meet them in
    an equi-join on cells. For the exact test each polygon has cells of its own, the finer the more sides it has. Where its sides cross
    the line through the cells' reference points tells whether such a point is inside; and a point is on the same
    side as its cell's reference point unless an odd number of sides crosses the way between them, upright and then
    level, which only sides that pass through the cell can. So a point meets the few sides of its own cell, or none,
    and all of it is built-in functions on rows that are dealt by polygon and cell.
    """
    flat = F.flatten("rings")
    low = lambda i: F.array_min(F.transform(flat, lambda p: p[i]))
    high = lambda i: F.array_max(F.transform(flat, lambda p: p[i]))
    boxed = polygons.select("polygon_id", low(0).alias("x0"), high(0).alias("x1"), low(1).alias("y0"), high(1).alias("y1"))
    span = lambda a, b: F.explode(F.sequence(cell(F.col(a), step), cell(F.col(b), step)))
    spread = boxed.withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1"))
    celled = points.select("point_id", "lat", "lng", cell(F.col("lng"), step).alias("px"), cell(F.col("lat"), step).alias("py"))
    near = celled.join(spread, (F.col("px") == F.col("cx")) & (F.col("py") == F.col("cy")) & F.col("lng").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1")))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))

    edges = materialize(_edges(polygons, step), "edges")
    e, s = F.col("e"), F.col("s")
    row = lambda y: F.floor(y / s).cast("long")
    rows = edges.withColumn("cy", F.explode(F.sequence(row(F.least(e["ay"], e["by"]) - 1e-12), row(F.greatest(e["ay"], e["by"]) + 1e-12))))
    line = (F.col("cy") + _AT) * s
    crossed = rows.filter((e["ay"] > line) != (e["by"] > line)).groupBy("polygon_id", "cy").agg(F.collect_list(_x_at(e, line)).alias("xs"))
    # the part of a side within a row of cells, and the columns that it passes through
    bottom, top = F.col("cy") * s, (F.col("cy") + 1) * s
    clip = lambda y: F.when(e["ay"] == e["by"], y).otherwise(F.greatest(F.least(y, F.greatest(e["ay"], e["by"])), F.least(e["ay"], e["by"])))
    ends = [F.when(e["ay"] == e["by"], e[x]).otherwise(_x_at(e, clip(y))) for x, y in (("ax", bottom), ("bx", top))]
    columns = F.sequence(row(F.least(*ends) - 1e-9), row(F.greatest(*ends) + 1e-9))
    sides = rows.withColumn("cx", F.explode(columns)).groupBy("polygon_id", "cy", "cx").agg(F.collect_list("e").alias("sides"))

    widths = edges.groupBy("polygon_id").agg(F.first("s").alias("s"))
    own = near.select("polygon_id", "point_id", "lat", "lng", area.alias("area")).join(widths, "polygon_id")
    own = own.withColumns({"cy": row(F.col("lat")), "cx": row(F.col("lng"))})
    met = own.join(crossed, ["polygon_id", "cy"], "left").join(sides, ["polygon_id", "cy", "cx"], "left")
    x, y, xr, yr = F.col("lng"), F.col("lat"), (F.col("cx") + _AT) * s, (F.col("cy") + _AT) * s
    beyond = F.size(F.filter(F.coalesce("xs", F.array().cast("array<double>")), lambda v: v > xr))
    upright = lambda e: ((e["ax"] > xr) != (e["bx"] > xr)) & ((yr < _y_at(e, xr)) != (y < _y_at(e, xr)))
    level = lambda e: ((e["ay"] > y) != (e["by"] > y)) & ((x < _x_at(e, y)) != (xr < _x_at(e, y)))
    ways = lambda e: F.when((e["ax"] > xr) != (e["bx"] > xr), upright(e)).otherwise(F.lit(False)).cast("int") + F.when((e["ay"] > y) != (e["by"] > y), level(e)).otherwise(F.lit(False)).cast("int")
    between = F.when(F.col("sides").isNull(), F.lit(0)).otherwise(F.aggregate("sides", F.lit(0), lambda n, e: n + ways(e)))
    each = met.filter((beyond + between) % 2 == 1).select("polygon_id", "point_id", "area").join(polygons.select("polygon_id", "zip", "country"), "polygon_id")
    best = each.groupBy("point_id").agg(F.min(F.struct("area", "polygon_id", "zip", "country")).alias("b"))
    return best.select("point_id", "b.polygon_id", "b.zip", "b.country")


def classified(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """point_id, zip (UNKNOWN if none) and source: geojson_local or unmatched."""
    found = points_in_polygons(points, polygons).select("point_id", "zip")
    out = points.select("point_id").join(found, "point_id", "left")
    return out.select("point_id", F.coalesce("zip", F.lit("UNKNOWN")).alias("zip"), F.when(F.col("zip").isNull(), "unmatched").otherwise("geojson_local").alias("source"))


def cache_grid(polygons: DataFrame, low: tuple[float, float], high: tuple[float, float], *, per_degree: int = 10) -> DataFrame:
    """lat_key, lng_key, zipcode of each grid point of a box (lat, lng) that a polygon holds."""
    keys = [(round(a * per_degree), round(b * per_degree)) for a, b in zip(low, high, strict=True)]
    spark = polygons.sparkSession
    grid = spark.range(keys[0][0], keys[0][1] + 1).withColumnRenamed("id", "lat_key").select("lat_key", F.explode(F.sequence(F.lit(keys[1][0]).cast("long"), F.lit(keys[1][1]).cast("long"))).alias("lng_key"))
    pts = grid.select(F.struct("lat_key", "lng_key").alias("point_id"), (F.col("lat_key") / per_degree).alias("lat"), (F.col("lng_key") / per_degree).alias("lng"))
    return points_in_polygons(pts, polygons).select(F.col("point_id.lat_key").cast("int").alias("lat_key"), F.col("point_id.lng_key").cast("int").alias("lng_key"), F.col("zip").alias("zipcode"))


def postal_property(properties: Column, country: Column) -> Column:
    """The postal code among a shape's properties, by country."""
    p = lambda *names: F.coalesce(*[properties[n] for n in names])
    return (
        F.when(country == "MX", p("d_cp", "d_codigo", "postal_code"))
        .when(country == "ES", p("COD_POSTAL", "CODPOS", "postal_code"))
        .when(country == "FR", p("codePostal", "postal_code"))
        .when(country == "DE", p("plz", "postal_code"))
        .when(country == "US", p("ZCTA5CE10", "ZCTA5CE20", "postal_code"))
        .otherwise(p("postal_code", "postcode", "zip"))
    )
