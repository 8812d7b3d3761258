"""Column helpers for numbers, ranks and quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .durable import materialize


def div(a: Column, b: int) -> Column:
    """Whole quotient of numbers that aren't negative, exact below 2**53."""
    return ((a - a % b) / b).cast("long")


def half_up(x: Column) -> Column:
    """Rounded to a whole number, halves towards plus infinity."""
    return F.floor(x + 0.5)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def average_rank(value: Column, over: WindowSpec) -> Column:
    """Rank from 0, with ties at the mean of their places; ``over`` is ordered by the value."""
    ties = F.count(F.lit(1)).over(over.rangeBetween(0, 0))
    return F.rank().over(over) - 1 + (ties - 1) / 2


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def value_ranks(rows: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, column, value, n (rows with the value), before (rows with a smaller one) and total, without nulls.

    Equal values are counted before they are moved, the counts are range-partitioned, and each partition adds what
    the partitions before it hold: no task sees all values of a column.
    """
    long = rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))).filter("value is not null")
    by = [*keys, "column"]
    counted = long.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(counted.repartitionByRange(parts, *by, "value").withColumn("part", F.spark_partition_id()), "ranks")
    # as many rows as partitions and keys
    held = ranged.groupBy(*by, "part").agg(F.sum("n").alias("m"))
    w = Window.partitionBy(*by)
    starts = held.select(*by, "part", F.coalesce(F.sum("m").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("m").over(w).alias("total"))
    same = Window.partitionBy(*by, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("within", F.coalesce(F.sum("n").over(same), F.lit(0)))
    return within.join(starts, [*by, "part"]).select(*by, "value", "n", (F.col("start") + F.col("within")).alias("before"), "total")


def _at(place: Column) -> Column:
    return (F.col("before") <= place) & (place < F.col("before") + F.col("n"))


def medians(rows: DataFrame, columns: list[str], keys: tuple[str, ...] = (), *, prefix: str = "") -> DataFrame:
    """One row for each of the keys with the exact median of each column (the mean of the two in the middle)."""
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    mid = value_ranks(rows, columns, keys).filter(_at(low) | _at(high))
    return mid.groupBy(*keys).agg(*[F.avg(F.when(F.col("column") == c, F.col("value"))).alias(f"{prefix}{c}") for c in columns])


def at_places(rows: DataFrame, columns: list[str], shares: dict[str, tuple[int, int]]) -> DataFrame:
    """One row with the value at place ``floor(n * a / b)`` (n - 1 at most) of each sorted column, for each name's (a, b)."""
    ranks = value_ranks(rows, columns)
    place = lambda a, b: F.least(F.floor(F.col("total") * a / b), F.col("total") - 1)
    return ranks.agg(*[F.max(F.when((F.col("column") == c) & _at(place(*f)), F.col("value"))).alias(f"{c}_{name}") for c in columns for name, f in shares.items()])
