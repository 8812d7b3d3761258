"""Removal of lines that many documents share, by range-partitioned line hashes.

Steps: (1) each line's key, as two 64-bit hashes, is written once with its document and position, and goes to a range
partition, sorted by hash, then by document from the largest down; (2) a stream over each partition sees the copies
of a key side by side, the largest document first, and gives out the lines to drop as soon as enough documents were
seen, so that it holds no key; the first and last key of a partition may continue next door, so their undecided
lines are given out open, with a few witnesses (one row each of its largest documents), and are decided by a table of
these witnesses; (3) the dropped positions of a document become a compressed bitmap of the lines to keep, and only
bitmaps, never texts, leave this stage. A key that a third of all lines hold is spread over as many partitions as it
fills. Held at once are an Arrow batch and the lines of a key in fewer than ``min_docs`` documents.

Defined results: a null or empty text is one empty line; texts are taken whole at any length; ids may be of any type
that sorts; a null id counts as one document, smaller than all others; rows that repeat an id count as one document,
and each keeps its own bitmap by its text; a key is told by 128 bits of hash; an empty table gives no rows; other
columns are passed through by :func:`dedup_lines`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, UPPER, materialize, text_or_empty, unused

#: What a row of the stream is: a line to drop, one to drop if its key is decided so, a witness of a document.
DROP, OPEN, WITNESS = 0, 1, 2


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, doc, row, pos of each line whose key is long enough; ``row`` tells rows with the same id apart."""
    text = text_or_empty()
    cut = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = cut.select("doc", "row", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "row", "pos")


def _same_as_before(column: pa.Array, before: pa.Array | None) -> np.ndarray:
    """Whether each value equals the one before it; nulls are equal to each other."""
    if before is None:
        first, rest = np.zeros(1, dtype=bool), (column[:-1], column[1:])
    else:
        first, rest = np.empty(0, dtype=bool), (pa.concat_arrays([before, column[:-1]]), column)
    equal = pc.fill_null(pc.equal(*rest), False)
    return np.r_[first, pc.or_(equal, pc.and_(pc.is_null(rest[0]), pc.is_null(rest[1]))).to_numpy(zero_copy_only=False)]


def _stream(min_docs: int):  # noqa: ANN202
    """Over one sorted partition: rows (h1, h2, doc, row, pos) with what they are."""

    def chosen(batch: pa.RecordBatch, which: np.ndarray) -> pa.RecordBatch:
        return batch.filter(pa.array(which))

    def told(rows: pa.RecordBatch, what: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(rows.num_rows, what, dtype=np.int32))], names=[*rows.schema.names, "what"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: pa.RecordBatch | None = None  # the row before
        place, opening = 0, True  # place of its document in its key; whether its key is the partition's first
        held: list[pa.RecordBatch] = []  # its key's lines outside the largest document, until min_docs are seen
        seen: list[pa.RecordBatch] = []  # its key's witnesses
        for batch in batches:
            if not batch.num_rows:
                continue
            same = lambda c, b=batch, e=before: _same_as_before(b.column(c), None if e is None else e.column(c))
            same_key = same("h1") & same("h2")
            new_doc = ~(same_key & same("doc"))
            goes_on = bool(same_key[0])
            starts = np.flatnonzero(np.r_[True, ~same_key[1:]])
            key = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, batch.num_rows]))
            docs = np.cumsum(new_doc)
            places = docs - (docs[starts] - new_doc[starts])[key] + np.where(key == 0, place if goes_on else 0, 0)
            enough = np.maximum.reduceat(places, starts) >= min_docs
            opening = opening and (before is None or goes_on)
            if not goes_on and before is not None:
                # the key before has ended: too few documents hold what is still held
                if was_opening:
                    yield from (told(x, WITNESS) for x in seen)
                held, seen = [], []
            elif held and enough[0]:
                yield from (told(x, DROP) for x in held)
                held = []
            first = (key == 0) & opening
            yield told(chosen(batch, ~first & (places > 1) & enough[key]), DROP)
            yield told(chosen(batch, first), OPEN)
            witness, last = new_doc & (places <= min_docs), key == key[-1]
            if len(starts) > 1:
                if opening:
                    yield from (told(x, WITNESS) for x in [*seen, chosen(batch, witness & first)])
                held, seen, opening = [], [], False
            seen.append(chosen(batch, witness & last))
            if not opening and not enough[-1]:
                held.append(chosen(batch, last & (places > 1)))
            place, before, was_opening = int(places[-1]), batch.slice(batch.num_rows - 1), opening
        yield from (told(x, OPEN) for x in held)
        yield from (told(x, WITNESS) for x in seen)

    return stream


def dropped_lines(docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc, row, pos of each line whose key is in at least ``min_docs`` documents, but for those in the largest of them."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc_nulls_last(), F.col("row"), F.col("pos")]
    # written, as the range partitioner reads its input twice
    lines = materialize(_lines(docs, min_chars), "keys")
    ranged = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kind = dict(docs.dtypes)["doc_id"]
    found = materialize(ranged.mapInArrow(_stream(min_docs), f"h1 long, h2 long, doc {kind}, row long, pos int, what int"), "lines")
    # of each range partition at most two keys, with min_docs witnesses each
    edge = found.filter(F.col("what") == WITNESS).groupBy("h1", "h2").agg(F.countDistinct(F.struct("doc")).alias("docs"), F.max("doc").alias("last"))
    decided = found.filter(F.col("what") == OPEN).join(F.broadcast(edge.filter(F.col("docs") >= min_docs)), ["h1", "h2"]).filter(~F.col("doc").eqNullSafe(F.col("last")))
    return found.filter(F.col("what") == DROP).select("doc", "row", "pos").unionByName(decided.select("doc", "row", "pos"))


def encode_bitmap(n_lines: int, dropped: np.ndarray) -> bytes:
    """Compressed bits, most significant first; bit i is 1 if line i stays."""
    keep = np.ones(n_lines, dtype=bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def decode_bitmap(n_lines: int, bitmap: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc, row, bits (lines the bitmap covers; those after it stay), bitmap: one row per document that loses lines."""

    @F.pandas_udf("binary")
    def bitmap(positions: pd.Series) -> pd.Series:
        return positions.map(lambda p: encode_bitmap(int(p.max()) + 1, p))

    lost = dropped_lines(docs, min_chars=min_chars, min_docs=min_docs)
    # a repeated row repeats its positions
    per_doc = lost.groupBy("doc", "row").agg(F.collect_set("pos").alias("positions"))
    return per_doc.select("doc", "row", (F.array_max("positions") + 1).alias("bits"), bitmap("positions").alias("bitmap"))


def dedup_lines(docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the text of the lines kept, and n_lines and n_dropped; the join is on ids, for the texts that change."""

    @F.pandas_udf("struct<kept string, n_dropped long>")
    def apply(text: pd.Series, bits: pd.Series, bitmap: pd.Series) -> pd.DataFrame:
        kept, lost = [], []
        for t, n, b in zip(text, bits, bitmap, strict=True):
            if b is None:
                kept.append(t)
                lost.append(0)
                continue
            keep, lines = decode_bitmap(int(n), b), t.split("\n")
            kept.append("\n".join([x for x, k in zip(lines, keep, strict=False) if k] + lines[len(keep) :]))
            lost.append(int(len(keep) - keep.sum()))
        return pd.DataFrame({"kept": kept, "n_dropped": lost})

    text = text_or_empty()
    doc, row, bits, bitmap, result = unused(docs, "doc_", "row_", "bits_", "bitmap_", "done_")
    maps = keep_bitmaps(docs, min_chars=min_chars, min_docs=min_docs).toDF(doc, row, bits, bitmap)
    here = unused(docs, "here_")[0]
    keyed = docs.withColumn(here, F.xxhash64(text))
    joined = keyed.join(maps.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col(doc)) & (F.col(here) == F.col(row)), "left")
    done = joined.withColumn(result, apply(text, bits, bitmap))
    n_lines = (F.char_length(text) - F.char_length(F.translate(text, "\n", "")) + 1).cast("long")
    out = done.select(*[docs[c] for c in docs.columns if c not in ("text", "n_lines", "n_dropped")], F.col(f"{result}.kept").alias("text"), n_lines.alias("n_lines"), F.col(f"{result}.n_dropped").alias("n_dropped"))
    return out
