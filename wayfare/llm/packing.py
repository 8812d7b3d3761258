"""Concatenate-and-cut packing of documents into sequences of fixed length.

Pass 1 tokenizes every document once, as Spark deals the input, and writes the ids with the document's offset
within its partition. The partitions' totals (one row each) are summed to global offsets. Pass 2 reads the ids
back, adds the offset and cuts at the multiples of the sequence length; a document that crosses a window's or a
partition's border leaves a boundary record (piece) on either side. Nothing is shuffled but the totals, every
window is full, and only the very last sequence is padded.

Defined results: a null or empty text is the separator alone; null ids and repeated rows are documents like any
other; a text of any length is cut as it comes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, text_or_empty

Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]

def _byte_ranks(vocab: dict[str, int], special: list[str]) -> dict[bytes, int]:
    """The vocabulary by bytes. Byte-level files write bytes that don't print as the characters from 256 on, in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(prints)]
    byte_of = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(odd)}
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}


@lru_cache(maxsize=1)
def byte_bpe_encoder(tokenizer_file: str) -> Encoder:
    """Texts to (ids of all, number of ids of each), as ``Tokenizer.encode(add_special_tokens=False)`` gives them.

    The vocabulary and ranks come from the given file, and tiktoken merges with them: the ids are the same (the
    tests compare both) in a fifth of the time. Texts that hold a special token's string, which the file's own
    library reads as that token, go to that library, which is loaded again for the first of them.

    A Python worker builds it once and keeps it for its later tasks: what it would build and free for each of them
    leaves its memory in pieces, which an idle worker goes on holding beside the stages that follow.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    library = cache(lambda: Tokenizer.from_file(tokenizer_file))
    special = [t.content for t in library().get_added_tokens_decoder().values()]
    merge = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_byte_ranks(library().get_vocab(), special), special_tokens={})
    library.cache_clear()

    def one(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(library().encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return merge.encode_to_numpy(text, disallowed_special=())

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [one(t) for t in texts]
        return np.concatenate([np.empty(0, np.uint32), *got]), np.fromiter(map(len, got), dtype=np.int64, count=len(got))

    return encode


def tokenize(docs: DataFrame, tokenizer_file: str, *, separator: int = 0, slice_rows: int = 1000) -> DataFrame:
    """doc_id, part, start (ids before the document in its partition), n, ids (little-endian unsigned 32-bit), written once.

    The separator's id follows each document's. ``slice_rows`` bounds what is encoded at once.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, start = byte_bpe_encoder(tokenizer_file), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                rows = batch.slice(at, slice_rows)
                ids, n = encode(rows.column(1).to_pylist())
                n_all = n + 1
                ids = np.insert(ids, np.cumsum(n), separator).astype("<u4", copy=False)
                ends = np.cumsum(n_all)
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.r_[0, ends * 4].astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(n), part, np.int64)), pa.array(start + ends - n_all), pa.array(n_all), data.cast(pa.binary())], names=["doc_id", "part", "start", "n", "ids"])
                start += int(ends[-1])

    return materialize(docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, part long, start long, n long, ids binary"), "tokens")


def with_offsets(tokens: DataFrame) -> DataFrame:
    """Adds ``begin``, the ids before a document in the whole corpus."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: bounded by the number of partitions
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    return tokens.join(F.broadcast(offsets), "part").withColumn("begin", F.col("start") + F.col("before")).drop("part", "start", "before")


def _cut(length: int, slice_rows: int, *, with_ids: bool):  # noqa: ANN202
    """Over documents' ids and places in the corpus (doc_id, begin, n, ids): their pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(at, slice_rows)
                begin, n = (batch.column(k).to_numpy() for k in ("begin", "n"))
                first = begin // length
                pieces = (begin + n - 1) // length - first + 1
                row = np.repeat(np.arange(len(n)), pieces)
                sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.maximum(sequence * length, begin[row]) - begin[row]
                end = np.minimum((sequence + 1) * length - begin[row], n[row])
                # the pieces of a slice lie end to end in its ids, which are only looked at, not copied
                ids = batch.column("ids").cast(pa.large_binary())
                held, bounds = ids.buffers()[2], np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset : ids.offset + len(n) + 1]
                cuts = np.r_[bounds[row] + start * 4, bounds[-1]]
                crc = np.fromiter(map(zlib.crc32, (memoryview(held)[a:b] for a, b in itertools.pairwise(cuts.tolist()))), dtype=np.int64, count=len(row))
                cols = [batch.column("doc_id").take(pa.array(row)), start, end - start, crc, n[row], sequence, begin[row] + start - sequence * length]
                data = [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(cuts), held]).cast(pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols] + data, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + with_ids])

    return run


def pack(docs: DataFrame, tokenizer_file: str, *, length: int = 1024, separator: int = 0, with_ids: bool = True, slice_rows: int = 1000) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids. ``slice_rows`` bounds what is encoded or cut at once."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return with_offsets(tokenize(docs, tokenizer_file, separator=separator, slice_rows=slice_rows)).select("doc_id", "begin", "n", "ids").mapInArrow(_cut(length, slice_rows, with_ids=with_ids), schema)


def sequences(pieces: DataFrame, *, length: int = 1024, pad: int = 0) -> DataFrame:
    """sequence_id, tokens (before padding), ids: the packed sequences, from pieces with ids.

    Only the last sequence can be short; it is padded to ``length``, except if its own length is a power of two.
    """
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("hex")))), lambda x: x["hex"]), "").alias("hex"))
    short = (F.col("tokens") < length) & (F.col("tokens").bitwiseAND(F.col("tokens") - 1) != 0)
    filled = F.when(short, F.rpad("hex", length * 8, pad.to_bytes(4, "little").hex().upper())).otherwise(F.col("hex"))
    return per.select("sequence_id", "tokens", F.unhex(filled).alias("ids"))
