"""Readers and writers: what is written is read, partitions are pruned, columns that files lack are null."""

import json
import threading

import pytest
from pyspark.sql import functions as F
from wayfare.functions import durable
from wayfare.operators import filters, poi_sets
from wayfare.sources import readers
from wayfare.sources.fixtures import Tables


@pytest.fixture(scope="module")
def pings(spark, data):
    p = Tables(spark, f"{data}/sf0.001").pings
    text = lambda c: F.col(c).cast("string").alias(c)
    return p.select("ad_id", "utc_timestamp", text("horizontal_accuracy"), F.lit("gaid").alias("id_type"), F.lit(None).cast("string").alias("ip_address"), text("latitude"), text("longitude"), "iso_country_code", "poi_ids", "quality_fields", "geo_fields", "date")


def test_dated_folders(spark, pings, tmp_path):
    path = f"{tmp_path}/pings"
    readers.write_parquet(pings, path, partition_by="date")
    back = readers.read_pings(spark, path)
    assert back.schema["quality_fields"].dataType == pings.schema["quality_fields"].dataType
    assert sorted(back.select(*pings.columns).toPandas().astype(str).itertuples(index=False)) == sorted(pings.toPandas().astype(str).itertuples(index=False))
    some = filters.date_range(back, "2024-01-03", "2024-01-05")
    assert {r["date"] for r in some.select("date").distinct().collect()} == {"2024-01-03", "2024-01-04", "2024-01-05"}
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date#" in plan and "PushedFilters: []" in plan
    assert filters.date_range(back).count() == back.count() == filters.valid_pings(back, max_accuracy=1e9).count()


def test_basic_files_lack_the_maps(spark, pings, tmp_path):
    path = f"{tmp_path}/basic"
    pings.drop("quality_fields", "geo_fields").write.partitionBy("date").parquet(path)
    back = filters.valid_pings(readers.read_pings(spark, path))
    assert back.filter("zip is not null or circle is not null or origin_type is not null").count() == 0
    assert filters.gps_only(back).count() == back.count() > 0


def test_union_keeps_the_maps(pings):
    basic = pings.drop("quality_fields", "geo_fields")
    both = readers.union_datasets([pings, basic])
    assert both.count() == 2 * pings.count() and both.filter("geo_fields is null").count() == pings.count()


def test_places(spark, data, tmp_path):
    pois = Tables(spark, f"{data}/sf0.001").pois.select("id", "name", "category", F.lit(None).cast("string").alias("city"), F.lit("01000").alias("postal_code"), "country", "latitude", "longitude")
    readers.write_parquet(pois, f"{tmp_path}/pois")
    assert sorted(readers.read_pois(spark, f"{tmp_path}/pois").collect()) == sorted(pois.collect())


def test_csv_keeps_types(spark, tmp_path):
    rows = spark.createDataFrame([(193, -992, "06010"), (194, -991, "=1+1, \"x\""), (195, None, None)], "lat_key int, lng_key int, zipcode string")
    readers.write_csv(rows, f"{tmp_path}/cells")
    back = readers.read_csv(spark, f"{tmp_path}/cells", rows.schema)
    assert back.schema == rows.schema and sorted(back.collect(), key=str) == sorted(rows.collect(), key=str)


def test_one_folder_a_bracket(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "0-19"), ("u2", "20-39"), ("u3", "20-39")], "ad_id string, bracket string")
    readers.write_csv(rows, f"{tmp_path}/brackets", partition_by="bracket")
    assert sorted(p.name for p in tmp_path.joinpath("brackets").iterdir() if p.is_dir()) == ["bracket=0-19", "bracket=20-39"]
    one = readers.read_csv(spark, f"{tmp_path}/brackets/bracket=20-39", "ad_id string")
    assert sorted(r["ad_id"] for r in one.collect()) == ["u2", "u3"]


def test_json_and_polygons(spark, tmp_path):
    square = lambda x, y, s=1.0: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    features = [
        {"type": "Feature", "properties": {"d_cp": "06010"}, "geometry": {"type": "Polygon", "coordinates": [square(0, 0, 2), square(0.5, 0.5)]}},
        {"type": "Feature", "properties": {"d_cp": "06020", "area": 3}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(5, 5)], [square(8, 8)]]}},
    ]
    path = tmp_path / "MX.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    shapes = readers.read_polygons(spark, str(path))
    polygons = shapes.select(F.monotonically_increasing_id().alias("polygon_id"), poi_sets.postal_property(F.col("properties"), F.lit("MX")).alias("zip"), F.lit("MX").alias("country"), "rings")
    assert polygons.count() == 3
    points = [("in", 0.2, 0.2), ("hole", 1.0, 1.0), ("one", 5.5, 5.5), ("two", 8.5, 8.5), ("out", 3.0, 3.0)]
    at = spark.createDataFrame(points, "point_id string, lat double, lng double")
    got = {r["point_id"]: (r["zip"], r["source"]) for r in poi_sets.classified(at, polygons).collect()}
    none = ("UNKNOWN", "unmatched")
    assert got == {"in": ("06010", "geojson_local"), "hole": none, "one": ("06020", "geojson_local"), "two": ("06020", "geojson_local"), "out": none}
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"country": "MX", "radius": 200}, indent=1))
    assert readers.read_json(spark, str(config)).first().asDict() == {"country": "MX", "radius": 200}


@pytest.mark.parametrize("split", [300, 1000, 1 << 20])
@pytest.mark.parametrize("indent", [None, 1])
def test_features_of_a_split_file(spark, tmp_path, split, indent):
    """Every feature once, wherever the parts of a file begin: also within strings that hold braces, quotes and the word Feature."""
    shape = lambda i: {"type": "Polygon", "coordinates": [[[i, 0], [i + 1, 0], [i + 1, 1], [i, 0]]]}
    odd = ['x"}, {"type": "Feature", "a": [', "plain", "back\\slash\\", "é漢 {[", "}" * 9]
    features = [{"type": "Feature", "properties": {"id": str(i), "name": odd[i % 5], "n": i}, "geometry": shape(i) if i % 7 else None} for i in range(60)]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "name": "{\"features\": [", "features": features}, indent=indent, ensure_ascii=False))
    (tmp_path / "b.geojson").write_text(json.dumps({"features": features[:1], "crs": {"type": "name"}}))
    (tmp_path / "c.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert split != 1000 or spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 5
        rows = readers.read_features(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(int(r["properties"]["id"]) for r in rows) == sorted([*range(60), 0])
    for r in rows:
        i = int(r["properties"]["id"])
        assert r["properties"] == {"id": str(i), "name": odd[i % 5], "n": str(i)}
        assert (r["geometry"] is None) == (i % 7 == 0) or i == 0
        if r["geometry"]:
            assert json.loads(r["geometry"]["coordinates"]) == shape(i)["coordinates"]


def test_scratch_tables_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(durable, "shared_dir", lambda _: str(tmp_path))
    with durable.scratch(spark):
        assert durable.materialize(spark.range(3), "x").count() == 3
        assert list(tmp_path.joinpath("wayfare").iterdir())
        path = durable.new_path(spark, "y")
        assert durable.append(spark.range(2), path).count() == 2 and spark.read.parquet(path).count() == 2
    assert not list(tmp_path.joinpath("wayfare").iterdir())


def test_scratch_of_another_thread(spark, tmp_path, monkeypatch):
    """What a second query writes while the first one's scratch is open stays when the first one ends."""
    monkeypatch.setattr(durable, "shared_dir", lambda _: str(tmp_path))
    kept = []
    with durable.scratch(spark):
        durable.materialize(spark.range(3), "own")
        other = threading.Thread(target=lambda: kept.append(durable.materialize(spark.range(5), "other")))
        other.start()
        other.join()
    assert [p.name.split("-")[0] for p in tmp_path.joinpath("wayfare").iterdir()] == ["other"]
    assert kept[0].count() == 5


@pytest.mark.parametrize("master", ["spark://somewhere:7077", "local-cluster[3,2,1024]", "yarn"])
def test_a_cluster_needs_a_shared_folder(master, monkeypatch):
    monkeypatch.setattr(durable, "_own", {})

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            pass

    Session.sparkContext.master = master
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        durable.shared_dir(Session)
