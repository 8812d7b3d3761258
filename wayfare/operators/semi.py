"""Semi-joins of two large sides behind a filter of the smaller side's ids.

The ids set bits of a table by their hash, some sixteen for each id, kept as bitmaps of 32,768 bits; the table is broadcast, since its
size is bounded. Rows of the large side whose bit isn't set have no partner and go before they are shuffled; of the
others about one in sixteen is there by chance, and the join takes it out. Beyond the bound the table gets denser and
lets more rows pass; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durable import materialize

#: Bits for each id, bits of one bitmap, and most bits of a table (8 MB).
PER_ID, PER_MAP, MOST_BITS = 16, 1 << 15, 1 << 26


def _place(key: Column, bits: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(bits - 1))


def bit_table(ids: DataFrame, key: str = "ad_id", *, most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """map_ and bitmap_ of the ids (written), and the number of bits."""
    n = ids.count()
    bits = min(most_bits, max(PER_MAP, 1 << max(0, PER_ID * n - 1).bit_length()))
    place = _place(F.col(key), bits)
    # made in part before the shuffle: at most bits / PER_MAP rows a task
    table = ids.filter(F.col(key).isNotNull()).select((F.shiftright(place, 15)).alias("map_"), place.bitwiseAND(PER_MAP - 1).alias("bit_")).groupBy("map_").agg(F.bitmap_construct_agg("bit_").alias("bitmap_"))
    return materialize(table, "bits"), bits


def may_be_in(rows: DataFrame, table: DataFrame, bits: int, key: str = "ad_id") -> DataFrame:
    """The rows whose key's bit is set: all that have a partner, and few others."""
    place = _place(F.col(key), bits)
    marked = rows.withColumns({"map_": F.shiftright(place, 15), "bit_": place.bitwiseAND(PER_MAP - 1).cast("int")})
    byte = F.conv(F.hex(F.substring("bitmap_", F.shiftright("bit_", 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, bit_ & 7)")) != 0
    return marked.join(F.broadcast(table), "map_").filter(is_set).select(*rows.columns)


def filtered_semi(rows: DataFrame, ids: DataFrame, key: str = "ad_id", *, most_bits: int = MOST_BITS) -> DataFrame:
    """``rows`` whose key is among ``ids``, as a left semi-join gives them; ids are written once."""
    kept = materialize(ids.select(key).distinct(), "ids")
    # each id is there once, so that an inner join is a semi-join; the optimizer would move one below the filter
    return may_be_in(rows, *bit_table(kept, key, most_bits=most_bits), key).join(kept, key).select(*rows.columns)
