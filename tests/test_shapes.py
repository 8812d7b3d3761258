"""Points in polygons against the even-odd rule, and a shape of a hundred thousand sides."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from wayfare.operators import poi_sets

SCHEMA = "polygon_id long, zip string, country string, rings array<array<array<double>>>"


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def plain(points, shapes):
    out = {}
    for i, lat, lng in points:
        held = []
        for k, _, _, rings in shapes:
            xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
            if min(xs) <= lng <= max(xs) and min(ys) <= lat <= max(ys) and inside(lng, lat, rings):
                held.append(((max(xs) - min(xs)) * (max(ys) - min(ys)), k))
        if held:
            out[i] = min(held)[1]
    return out


def found(spark, points, shapes, **options):
    p = spark.createDataFrame(points, "point_id long, lat double, lng double")
    got = poi_sets.points_in_polygons(p, spark.createDataFrame(shapes, SCHEMA), **options).collect()
    assert len(got) == len({r["point_id"] for r in got})
    return {r["point_id"]: r["polygon_id"] for r in got}


def blob(rng, x, y, size, n):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [[x + size * rng.uniform(0.2, 1) * math.cos(t), y + size * rng.uniform(0.2, 1) * math.sin(t)] for t in turns]


@pytest.mark.parametrize("step", [0.03, 0.1, 1.0])
def test_any_shapes(spark, step):
    """Spiky shapes with holes, closed or not, that cross each other and themselves; also tiny and flat ones."""
    rng = random.Random(step)
    shapes = []
    for k in range(40):
        x, y, size = rng.uniform(-2, 2), rng.uniform(40, 42), rng.choice([0.01, 0.2, 1.0])
        rings = [blob(rng, x, y, size, rng.randrange(3, 400))]
        rings += [blob(rng, x, y, size / 3, 9) for _ in range(k % 3)]
        if k % 2:
            rings = [[*r, r[0]] for r in rings]
        shapes.append((k, str(k), "ES", rings))
    shapes.append((90, "flat", "ES", [[[0.0, 41.0], [1.0, 41.0], [0.5, 41.0]]]))
    points = [(i, rng.uniform(39.5, 42.5), rng.uniform(-3, 3)) for i in range(3000)]
    want = plain(points, shapes)
    assert 500 < len(want) < 3000
    assert found(spark, points, shapes, step=step) == want


def test_points_on_borders(spark):
    """Lower and left borders are inside, upper and right ones are not, whatever the cells."""
    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    shapes = [(1, "a", "MX", [square(0.0, 0.0, 0.5)]), (2, "b", "MX", [square(0.5, 0.0, 0.5)]), (3, "c", "MX", [square(-0.25, 0.5, 1.5), square(0.0, 0.75, 0.25)])]
    points = [(i, lat / 16, lng / 16) for i, (lat, lng) in enumerate((a, b) for a in range(-4, 36) for b in range(-8, 24))]
    for step in (0.1, 0.0625, 0.5):
        assert found(spark, points, shapes, step=step) == plain(points, shapes)


def test_a_hundred_thousand_sides(spark):
    """A star-shaped outline around a middle: whether a point is inside follows from the one side in its direction."""
    n, x0, y0 = 100_000, 10.0, 50.0
    t = np.arange(n) * 2 * np.pi / n
    r = 0.6 + 0.2 * np.sin(7 * t) + 0.05 * np.sin(900 * t) + 0.01 * np.random.default_rng(1).random(n)
    ring = np.column_stack([x0 + r * np.cos(t), y0 + r * np.sin(t)])
    shape = spark.createDataFrame([(1, "z", "DE", [ring.tolist()])], SCHEMA)
    points = spark.range(1_000_000).select(F.col("id").alias("point_id"), (y0 - 1 + 2 * F.rand(1)).alias("lat"), (x0 - 1 + 2 * F.rand(2)).alias("lng")).persist()
    began = time.monotonic()
    got = np.array([r["point_id"] for r in poi_sets.points_in_polygons(points, shape).select("point_id").toLocalIterator()])
    took = time.monotonic() - began
    rows = points.toPandas()
    dx, dy = rows["lng"].to_numpy() - x0, rows["lat"].to_numpy() - y0
    k = np.floor(np.mod(np.arctan2(dy, dx), 2 * np.pi) / (2 * np.pi / n)).astype(int) % n
    a, b = ring[k] - [x0, y0], ring[(k + 1) % n] - [x0, y0]
    # the side's line: the middle is on its left
    left = (b[:, 0] - a[:, 0]) * (dy - a[:, 1]) - (b[:, 1] - a[:, 1]) * (dx - a[:, 0])
    sure = np.abs(left) > 1e-12
    held = np.zeros(len(rows), dtype=bool)
    held[np.searchsorted(rows["point_id"].to_numpy(), np.sort(got))] = True
    assert (held == (left > 0))[sure].all()
    assert 100_000 < held.sum() < 900_000
    assert took < 240
    plan = poi_sets.points_in_polygons(points, shape)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    points.unpersist()
