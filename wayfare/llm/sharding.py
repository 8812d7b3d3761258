"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order of their key; a keyed Feistel network over a grid of a x b cells
(a = ceil(sqrt n), b = ceil(n / a)) permutes the numbers, and numbers that fall outside 0..n-1 are permuted
again (cycle walking). Row number p after the permutation lies in shard ``p % shards`` at slot ``p // shards``:
shard sizes differ by one row at most, slots have no gaps, and anybody who knows n and the seed can compute a
row's place, or the row at a place, without the data.

Only DataFrame functions run here. Shuffled are narrow rows (key, size, checksum), never texts.

Defined results: a null text has size 1 and the checksum of the empty text; null ids come first in the order;
rows with equal ids are ordered by checksum and size, and rows equal in these too are interchangeable; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from math import ceil, isqrt, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, text_or_empty

PRIME = 2**31 - 1
ROUNDS = 8
#: The chance, as a power of two, that some walk is cut short; a row that still is raises an error.
SAFE_BITS = 128


def grid(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid with at least n cells."""
    a = max(1, isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def round_keys(seed: int, n: int) -> list[tuple[int, int, int]]:
    """Per round: two constants below 2**30 and the side that the round changes."""
    a, b = grid(n)
    out = []
    for i in range(ROUNDS):
        h = hashlib.sha256(f"feistel:{seed}:{i}".encode()).digest()
        out.append((int.from_bytes(h[:4], "little") >> 2, int.from_bytes(h[4:8], "little") >> 2, (a, b)[i % 2]))
    return out


def walk_steps(n: int) -> int:
    """How often a walk may be continued: enough for every walk, or for all but a share of 2**-SAFE_BITS of them."""
    a, b = grid(n)
    over = a * b - n
    return min(over, ceil(SAFE_BITS * log(2) / log(a * b / over))) if over else 0


def permute_one(x: int, n: int, seed: int) -> int:
    """The place of row number x, in plain Python: the rule that the columns below follow."""
    b = grid(n)[1]
    while True:
        left, right = divmod(x, b)
        for add, shift, side in round_keys(seed, n):
            left, right = right, (left + (right * (right + add) + shift) % PRIME) % side
        x = left * b + right
        if x < n:
            return x


def invert_one(p: int, n: int, seed: int) -> int:
    """The row number at place p."""
    b = grid(n)[1]
    while True:
        left, right = divmod(p, b)
        for add, shift, side in reversed(round_keys(seed, n)):
            left, right = (right - (left * (left + add) + shift) % PRIME) % side, left
        p = left * b + right
        if p < n:
            return p


def permuted(number: Column, n: int, seed: int) -> Column:
    """Column form of :func:`permute_one`."""
    b = F.lit(grid(n)[1]).cast("long")
    keys = F.array(*[F.struct(F.lit(x).cast("long").alias("add"), F.lit(y).cast("long").alias("shift"), F.lit(m).cast("long").alias("side")) for x, y, m in round_keys(seed, n)])

    def one_round(at: Column, key: Column) -> Column:
        mixed = (at["right"] * (at["right"] + key["add"]) + key["shift"]) % F.lit(PRIME)
        return F.struct(at["right"].alias("left"), ((at["left"] + mixed) % key["side"]).alias("right"))

    def once(x: Column) -> Column:
        # exact for x < 2**52, as the double quotient of a multiple of b is
        start = F.struct(((x - x % b) / b).cast("long").alias("left"), (x % b).alias("right"))
        return F.aggregate(keys, start, one_round, lambda at: at["left"] * b + at["right"])

    if n < 2:
        return number
    first, steps = once(number), walk_steps(n)
    if not steps:
        return first
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda at, _: F.when(at < n, at).otherwise(once(at)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a Feistel walk did not end")).cast("long"))


def number_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Adds ``row_number``, 0..n-1 in the given order, and returns n.

    The rows are range-partitioned and sorted once and written; the second pass adds each partition's offset,
    the sum of the counts before it. Only one count per partition meets in one place.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in order]
    row = F.monotonically_increasing_id()
    held = materialize(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumns({"part_": F.spark_partition_id(), "row_": row.bitwiseAND((1 << 33) - 1)}), "numbered")
    counts = held.groupBy("part_").agg(F.count(F.lit(1)).alias("rows_"))
    n = counts.agg(F.sum("rows_")).first()[0] or 0
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part_", F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("offset_"))
    # one row per partition: bounded by the number of partitions
    return held.join(F.broadcast(offsets), "part_").withColumn("row_number", F.col("row_") + F.col("offset_")).drop("part_", "row_", "offset_"), n


def shard(docs: DataFrame, *, shards: int = 16, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, row_number, place, shard, slot of every row of ``docs`` (doc_id, text)."""
    text = text_or_empty()
    sized = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    numbered, n = number_rows(sized, ["doc_id", "text_crc32", "size"])
    placed = numbered.withColumn("place", permuted(F.col("row_number"), n, seed))
    shard_of = F.col("place") % shards
    return placed.withColumns({"shard": shard_of.cast("int"), "slot": ((F.col("place") - shard_of) / shards).cast("long")})


def locate(row_number: int, n: int, *, shards: int = 16, seed: int = 0) -> tuple[int, int]:
    """(shard, slot) of a row, from its number alone."""
    slot, at = divmod(permute_one(row_number, n, seed), shards)
    return at, slot


def row_at(shard_id: int, slot: int, n: int, *, shards: int = 16, seed: int = 0) -> int:
    """The number of the row at (shard, slot)."""
    return invert_one(slot * shards + shard_id, n, seed)
