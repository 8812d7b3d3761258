"""Schemas and constants of the device-mobility model."""

from __future__ import annotations

from pyspark.sql import types as T

_text = T.StringType()
PINGS = T.StructType(
    [T.StructField("ad_id", _text), T.StructField("utc_timestamp", T.TimestampNTZType())]
    + [T.StructField(c, _text) for c in ("horizontal_accuracy", "id_type", "ip_address", "latitude", "longitude", "iso_country_code")]
    + [T.StructField("poi_ids", T.ArrayType(_text)), T.StructField("quality_fields", T.MapType(_text, _text)), T.StructField("geo_fields", T.MapType(_text, _text)), T.StructField("date", _text)]
)
POIS = T.StructType([T.StructField(c, _text) for c in ("id", "name", "category", "city", "postal_code", "country")] + [T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())])

#: Fixed values of the domain.
MAX_ACCURACY_M = 500.0
HOME_ACCURACY_M = 1000.0
RESIDENTIAL_ACCURACY_M = 200.0
COMPARE_ACCURACY_M = 100.0
CELL_DEG = 0.01
METERS_PER_DEG = 111320.0
EARTH_M = 6371000.0
POI_RADIUS_M = 200.0
HUMAN_DAYS = 2
DWELL_BUCKETS = (0, 2, 5, 10, 15, 30, 60, 120, 180)
BOX_MARGIN_DEG = 0.02
