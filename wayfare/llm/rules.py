"""Quality rules whose cutoffs adapt to language and source, from mergeable quantile sketches.

Each document gets counts (words, symbols, repeated lines, repeated word triples). A sketch of each count's share is
kept per language and source: the number of documents in each of ``BINS`` equal bins from 0 to 1. Sketches are merged
upwards, by adding, to languages and to the corpus; the sums don't depend on the order or the partitions, so that a
rerun gives the same fences. A quantile is the lower edge of the bin that holds it, less than ``1 / BINS`` below the
exact one. The quartiles of the smallest group that holds enough documents set its fences: a document fails beyond
``upper quartile + reach * max(spread, least spread)``. The fences join back to the documents' counts; texts take
no part in any shuffle.

Only DataFrame functions run here. Groups are pre-aggregated into bins before they are shuffled, so a source that
holds a third of all rows costs at most ``BINS`` + 1 rows a share and task.

Defined results: a null or empty text has no words and fails; texts are taken whole at any length; a share that equals
its fence passes; null languages and sources are groups of their own; null ids and repeated rows each give their row;
an empty table gives no rows; other columns are ignored. A group of fewer than ``least_docs`` documents takes its
language's fences, and a language of fewer the corpus's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, materialize, text_or_empty, words

SYMBOLS = "#*$%&|<>"
#: Shares that are fenced, and the least spread of each: a group of documents that are all alike rejects none for less.
#: Where both quartiles are 0, as mostly, six of them are the fence. They lie below half of the words, which fail anyway,
#: at published cutoffs: 0.18 for repeated triples and 0.30 for repeated lines.
LEAST_SPREAD = {"symbol_share": 0.05, "repeat_share": 0.03, "dup_line_share": 0.05}
#: Bins of a sketch.
BINS = 4096
#: Bits that hold a word's position within one text; the others hold its hash.
POSITION_BITS = 31


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.col("text")
    keep = ["doc_id", "lang", "source"]
    gone = lambda chars: (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")
    with_word = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    # one step for each array, so that none is made twice
    split = docs.select(*keep, text_or_empty().alias("text")).select(*keep, "text", words(text).alias("words"))
    measured = split.select(*keep, F.size("words").cast("long").alias("n_words"), (F.char_length(text) - gone(SPACE)).alias("word_chars"), gone(SYMBOLS).alias("n_symbols"), with_word.alias("lines"), window_hashes(F.col("words")).alias("hashes"))
    low = (1 << POSITION_BITS) - 1
    # hash prefixes with positions below them sort as plain numbers: equal windows become neighbours
    ordered = measured.withColumn("keyed", F.sort_array(F.transform("hashes", lambda h, i: h.bitwiseAND(~low).bitwiseOR(i.cast("long")))))
    place = lambda x: x.bitwiseAND(low).cast("int")
    same = lambda x, y: F.get("hashes", place(x)) == F.get("hashes", place(y))
    last = F.size("keyed") - 1
    twice = F.filter("keyed", lambda x, i: ((i > 0) & same(x, F.get("keyed", i - 1))) | ((i < last) & same(x, F.get("keyed", i + 1))))
    # different hashes with one prefix could keep equal windows apart: such texts are sorted by the whole hash
    near = lambda x, y: x.bitwiseXOR(y).bitwiseAND(~low) == 0
    mixed = F.size(F.filter("keyed", lambda x, i: (i > 0) & near(x, F.get("keyed", i - 1)) & ~same(x, F.get("keyed", i - 1)))) > 0
    pairs = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    end = F.size("pairs") - 1
    equal = lambda x, i: F.coalesce(x["h"] == F.get("pairs", i)["h"], F.lit(False))
    twice_pairs = F.transform(F.filter("pairs", lambda x, i: ((i > 0) & equal(x, i - 1)) | ((i < end) & equal(x, i + 1))), lambda x: x["i"])
    found = ordered.withColumn("pairs", F.when(mixed, pairs)).withColumn("twice", F.when(F.col("pairs").isNotNull(), twice_pairs).otherwise(F.transform(twice, place)))
    found = found.withColumn("places", F.sort_array("twice"))
    covered = F.aggregate("places", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"].cast("long"))
    n_lines = F.size("lines").cast("long")
    return found.select(*keep, "n_words", "word_chars", "n_symbols", (n_lines - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), covered.alias("n_repeat_words"), n_lines.alias("n_lines"))


def window_hashes(found: Column) -> Column:
    """64-bit hashes of all windows of three words, by position."""
    n = F.size(found) - 2
    return F.when(n < 1, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2))))


def shares(counted: DataFrame) -> DataFrame:
    return counted.withColumns(
        {
            "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        }
    )


def fences(counted: DataFrame, *, reach: float = 6.0, least_docs: int = 100) -> DataFrame:
    """lang, source and, for each share, the largest value that passes; taken from the group, its language or the corpus."""
    names = list(LEAST_SPREAD)
    binned = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.floor(F.col(c) * BINS).cast("int").alias("bin")) for c in names])).alias("b")
    known = counted.filter("n_words > 0").select("lang", "source", binned)
    by_source = materialize(known.groupBy("lang", "source", "b.name", "b.bin").agg(F.count("*").alias("n")), "sketches")

    def limits(sketches: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        """The keys, the number of documents and, for each share, the fence that the quartiles set."""
        group = Window.partitionBy(*keys, "name")
        # a group has at most BINS + 1 rows
        ranked = sketches.withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "all": F.sum("n").over(group)})
        quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("bin"))) / F.lit(float(BINS))
        quartiles = ranked.groupBy(*keys, "name").agg(F.max("all").alias("docs"), quartile(1).alias("low"), quartile(3).alias("high"))
        least = F.element_at(F.create_map(*[F.lit(x) for c in names for x in (c, LEAST_SPREAD[c])]), F.col("name"))
        fenced = quartiles.withColumn("fence", F.col("high") + reach * F.greatest(F.col("high") - F.col("low"), least))
        return fenced.groupBy(*keys).agg(F.max("docs").alias(f"{prefix}n"), *[F.max(F.when(F.col("name") == c, F.col("fence"))).alias(f"{prefix}{c}") for c in names])

    def merged(*keys: str) -> DataFrame:
        return by_source.groupBy(*keys, "name", "bin").agg(F.sum("n").alias("n"))

    own = limits(by_source, ["lang", "source"], "s_")
    # both are as small as the number of languages and one row; tables without any word have no sketch and no fences
    langs = limits(merged("lang"), ["lang"], "l_").withColumnRenamed("lang", "lang_")
    corpus = limits(merged(), [], "c_").filter("c_n > 0")
    joined = own.join(langs, F.col("lang").eqNullSafe(F.col("lang_"))).join(F.broadcast(corpus))
    pick = {f"max_{c}": F.when(F.col("s_n") >= least_docs, F.col(f"s_{c}")).when(F.col("l_n") >= least_docs, F.col(f"l_{c}")).otherwise(F.col(f"c_{c}")) for c in names}
    return joined.select("lang", "source", *[v.alias(k) for k, v in pick.items()])


def judge(docs: DataFrame, *, min_words: int = 50, reach: float = 6.0, least_docs: int = 100, broadcast_groups: int = 100_000) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row of ``docs`` (doc_id, text, lang, source).

    The fences are broadcast while there are at most ``broadcast_groups`` of them, which is counted first; beyond
    that the counts are shuffled to them.
    """
    counted = shares(materialize(counts(docs), "counts"))
    limits = materialize(fences(counted, reach=reach, least_docs=least_docs).withColumnsRenamed({"lang": "lang_", "source": "source_"}), "fences")
    limits = F.broadcast(limits) if limits.count() <= broadcast_groups else limits
    joined = counted.join(limits, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    beyond = [F.coalesce(F.col(c) > F.col(f"max_{c}"), F.lit(False)) for c in LEAST_SPREAD]
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~(failed | beyond[0] | beyond[1] | beyond[2])).alias("kept"))
