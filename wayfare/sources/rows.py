"""Results to a caller, row by row and in order, with bounded memory."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.durable import materialize

#: Rows that the driver holds at once, about.
ROWS = 20_000


def stream_rows(df: DataFrame, *order: str, rows: int = ROWS) -> Iterator[Row]:
    """The rows of ``df`` by ``order``, ties by all columns; the driver holds one partition of about ``rows`` rows at a time.

    The result is computed once and written; range partitions of bounded size are then fetched one after the other, none before the
    caller has taken the one before. Rows that are equal in every column may share a larger partition.
    """
    written = materialize(df, "rows")
    ties = [F.col(c) for c in written.columns if c not in order and not dict(written.dtypes)[c].startswith("map")]
    by = [*[F.col(c) for c in order], *ties]
    parts = max(1, -(-written.count() // rows))
    dealt = written.repartitionByRange(parts, *by) if parts > 1 else written.coalesce(1)
    yield from dealt.sortWithinPartitions(*by).toLocalIterator(prefetchPartitions=False)


def write_rows(df: DataFrame, out: TextIO, *order: str, rows: int = ROWS) -> int:
    """The rows as CSV with a header line to an open text file; the number of rows."""
    writer = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n")
    writer.writerow(df.columns)
    n = 0
    for row in stream_rows(df, *order, rows=rows):
        writer.writerow(["" if v is None else v for v in row])
        n += 1
    return n
