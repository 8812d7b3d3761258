"""Grouping of words with their spelling variants by broadcast trie shards.

Words are counted by Spark. The counted words are range-partitioned and sorted; each range becomes a shard of bounded
size: a trie listed depth-first, each word as the number of characters it shares with the word before and the rest.
Waves of shards of bounded size are broadcast. In a wave every task takes its share of the words and opens one shard
after the other; each word's Levenshtein automaton of distance one runs over the shard's trie depth-first: states
without an edit follow the word itself, and at each node the three edits lead to states that must spell the rest of
the word. Accepted neighbours are reduced to their number and the best form before anything is written, one row for
each word and wave. Chains of forms are followed by doubling, and a form has twice its word's count at least, so that
a chain is no longer than the logarithm of the largest count.

Defined results: null and empty texts have no words; a null id is written as nothing in front of the colon; repeated
rows count each; texts and words are taken whole at any length; of forms with equally many occurrences the smallest in
code-point order is taken; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, text_or_empty

#: Maximal runs of these are words.
LETTERS = "[A-Za-zÀ-ÿ]+"
#: One in so many runs, by hash, loses a character.
SPOILED = 97


def spoiled(doc_id: Column, run: Column) -> Column:
    """A lower-cased run, less one character where 97 divides the hash of document and run."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % SPOILED == 0, cut).otherwise(run)


def count_words(docs: DataFrame, *, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """word and n of the words that are long and frequent enough."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text_or_empty(), F.lit(LETTERS), F.lit(0))).alias("run"))
    words = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run")).select(spoiled(F.col("doc_id"), F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


# A node is a dict from a character to a node or to a leaf, (rest of the only word there, n); under "" it has the n of
# the word that ends there.


def _shared(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    return next(i for i, (x, y) in enumerate(zip(a, b)) if x != y) if not a.startswith(b) else len(b)


def list_trie(words: list[tuple[str, int]]) -> bytes:
    """Sorted words and counts as a compact depth-first listing: characters shared with the word before, the rest, n."""
    before, keep, rest = "", [], []
    for word, _ in words:
        k = _shared(before, word)
        keep.append(k)
        rest.append(word[k:])
        before = word
    table = pa.table({"keep": pa.array(keep, pa.int32()), "rest": rest, "n": pa.array([n for _, n in words], pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def open_trie(listing: bytes) -> dict:
    table = pa.ipc.open_stream(listing).read_all()
    rows = zip(*(c.to_pylist() for c in table.columns), strict=True)
    root: dict = {}
    path = [root]  # the nodes along the last word, from the root on
    word = ""
    for keep, rest, n in rows:
        del path[keep + 1 :]
        node, depth = path[-1], len(path) - 1
        while depth < keep:  # the last word's leaf hides the characters that are shared
            tail, count = node[word[depth]]
            inner = {tail[0]: (tail[1:], count)} if tail else {"": count}
            node[word[depth]] = inner
            path.append(inner)
            node, depth = inner, depth + 1
        word = word[:keep] + rest
        if rest:
            node[rest[0]] = (rest[1:], n)
        else:
            node[""] = n
    return root


def _spelled(node: dict | tuple, word: str, at: int) -> int:
    """The count of the word that spells ``word[at:]`` from a node on, or 0."""
    last = len(word)
    while type(node) is dict:
        if at == last:
            return node.get("", 0)
        node = node.get(word[at])
        if node is None:
            return 0
        at += 1
    return node[1] if node[0] == word[at:] else 0


def _one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = _shared(a, b)
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def neighbours(root: dict, word: str) -> Iterator[tuple[str, int]]:
    """The trie's words, with counts, that differ from ``word`` by exactly one inserted, deleted or replaced character."""
    node, last = root, len(word)
    for at in range(last + 1):
        if type(node) is not dict:
            rest, n = node
            if _one_edit(rest, word[at:]):
                yield word[:at] + rest, n
            return
        here = word[at] if at < last else ""
        for letter, child in node.items():
            if not letter:
                continue
            if letter != here:
                if at < last and (n := _spelled(child, word, at + 1)):
                    yield word[:at] + letter + word[at + 1 :], n
                # inserted before an equal character is the same as inserted after it
                if n := _spelled(child, word, at):
                    yield word[:at] + letter + word[at:], n
        # of equal characters in a row the last is deleted
        if at < last and (at + 1 == last or word[at + 1] != here) and (n := _spelled(node, word, at + 1)):
            yield word[:at] + word[at + 1 :], n
        if at == last or (node := node.get(here)) is None:
            return


def shards_of(words: DataFrame, count: int, chars: int, *, shard_words: int = 100_000, shard_chars: int = 4_000_000) -> DataFrame:
    """part, k, listing: sorted ranges of the words as tries of at most ``shard_words`` words, and of ``shard_chars`` but for the last word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([list_trie(held)], pa.binary())], names=["part", "k", "listing"])

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((word, n))
                size += len(word)
                if len(held) >= shard_words or size >= shard_chars:
                    yield shard()
                    k, held, size = k + 1, [], 0
        if held:
            yield shard()

    parts = max(1, -(-count // shard_words), -(-chars // shard_chars))
    return words.select("word", "n").repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(run, "part int, k int, listing binary")


def _met(listings: list[bytes], words: Iterable[str]) -> Iterator[tuple[str, int, str, int]]:
    """word, number of neighbours, count and spelling of the best of them, for the words that have any."""
    words = list(words)
    number: dict[str, int] = {}
    best: dict[str, tuple[int, str]] = {}
    for listing in listings:
        root = open_trie(listing)
        for word in words:
            for other, n in neighbours(root, word):
                number[word] = number.get(word, 0) + 1
                if word not in best or (-n, other) < best[word]:
                    best[word] = (-n, other)
    return ((word, k, best[word][1], -best[word][0]) for word, k in number.items())


def near_words(words: DataFrame, *, shard_words: int = 100_000, wave_bytes: int = 32_000_000, task_words: int = 25_000, task_chars: int = 1_000_000) -> DataFrame:
    """word, n_near, form and form_n (the best neighbour) of the words that have neighbours; ``words`` is a written table of word and n."""
    count, chars = words.agg(F.count("*"), F.coalesce(F.sum(F.char_length("word")), F.lit(0))).first()
    shards = materialize(shards_of(words, count, chars, shard_words=shard_words), "shards")
    # one small row for each shard_words words
    sizes = sorted((r["part"], r["k"], r["size"]) for r in shards.select("part", "k", F.octet_length("listing").alias("size")).collect())
    waves: list[list[tuple[int, int]]] = []
    room = 0
    for part, k, size in sizes:
        if size > room or not waves:
            waves.append([])
            room = wave_bytes
        waves[-1].append((part, k))
        room -= size
    dealt = words.select("word").repartition(max(1, -(-count // task_words), -(-chars // task_chars)), "word")
    schema = "word string, n_near long, form string, form_n long"
    found = []
    for wave in waves:
        first, last = wave[0], wave[-1]
        at = F.struct("part", "k")
        inside = (at >= F.struct(F.lit(first[0]), F.lit(first[1]))) & (at <= F.struct(F.lit(last[0]), F.lit(last[1])))
        # at most wave_bytes, or one shard
        listings = [bytes(r["listing"]) for r in shards.filter(inside).select("listing").collect()]
        shared = words.sparkSession.sparkContext.broadcast(listings)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            mine = (word for batch in batches for word in batch.column(0).to_pylist())
            rows = list(_met(shared.value, mine))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "n_near", "form", "form_n"])

        found.append(materialize(dealt.mapInArrow(run, schema), "near"))
        shared.unpersist()
    if not found:
        return words.sparkSession.createDataFrame([], schema)
    if len(found) == 1:
        return found[0]
    union = found[0]
    for other in found[1:]:
        union = union.unionByName(other)
    best = union.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    return best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def follow(links: DataFrame) -> DataFrame:
    """word and root of a written table of word and root, each root replaced by the last that its chain leads to."""
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "chains")
        if moved.filter("went").isEmpty():
            return moved.select("word", "root")
        links = moved.select("word", "root")


def group(words: DataFrame, *, times: int = 2, **limits: int) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of word and n."""
    words = materialize(words.select("word", "n"), "words")
    near = near_words(words, **limits)
    taken = F.col("form_n") >= times * F.col("n")
    told = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("form")).alias("form"), F.when(taken, F.col("form_n")).alias("form_n"))
    told = materialize(told, "forms")
    roots = follow(told.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, *, min_chars: int = 5, min_count: int = 3, times: int = 2) -> DataFrame:
    """The words of documents, each with its form, root and counts."""
    return group(count_words(docs, min_chars=min_chars, min_count=min_count), times=times)
