"""Benchmark decontamination by templates.

Texts become words in canonical form: lower case without punctuation, with numbers, units that follow a number, and
names (capitalised words but function words, also where a sentence begins) as typed placeholders. Windows of five
words of the benchmark are hash-joined with the windows of the documents, so that a question stays recognisable when
its numbers, names or units are replaced. A window with placeholders and fewer than two different literal words is
closed: it is keyed by what its placeholders stand for, so that lists of numbers or names meet only their own copies.

First pass: a document and an item are a candidate if the windows they share, each counted as often as both have it,
could reach what is asked for; one row for each document, item and key. Only candidates go on. Second pass: for
matched open windows with placeholders the fillings are compared within one occurrence (matches whose position in the
document less that in the item is nearly the same): each filling of the item must map to one filling in the document
and no two to the same one (a consistent re-parameterisation), and windows that break the mapping don't count. Windows
that are filled as in the item always count; beside them, those of the fullest occurrence do. A document holds an item
if at least ``share`` of the item's windows match, or ``passage`` of them (nine windows of five are what a passage of
thirteen words has), or, where at least half of an item's windows are open, ``share`` of these.

Only DataFrame functions run here. A document's windows are made as an array of hashes; those that a small table of
bits (made of the benchmark's hashes, of bounded size) doesn't rule out become rows, with their fillings. The
benchmark is the query side: its window table is broadcast while it has at most ``broadcast_windows`` rows, which is
counted first; beyond that both sides are shuffled by window key. Documents' windows carry their fillings, never
texts; matches are aggregated per document and item.

Defined results: null or empty texts and items match nothing; texts are taken whole at any length; an item shorter
than a window is one window of its length and matches only documents as short; of mappings with equally many windows
the one to the item's own filling is taken, then the greatest filling, and of two fillings of the item that become
one, the one with more windows keeps it, then the own, then the greatest; null ids are ids like any other; rows that
repeat an id are told apart by their text, equal rows count as one; an empty table on either side gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, unused, words

#: Marks of placeholders for names, numbers and units, and the mark that ends what they stand for.
NAME, NUMBER, UNIT, END = "\x01", "\x02", "\x03", "\x04"
#: Capitalised words that are no names. What stands around a word plays no part, so that an item and its
#: copies are always typed alike. Words that are names as well (Will, May, Mark) are not among them.
FUNCTION_WORDS = (
    "a an the this that these those there here he she it we you they his her its our your their my me him them us and or but nor so yet if when while where who whom whose which what why how "
    "is are was were be been am do does did has have had can could shall should would might must not no yes of in on at by for from to into onto with without within over under after before during about above below between through "
    "as than then all any both each every few many much more most some such other another only also just now once since until because although though however "
    "der die das den dem des ein eine einer eines einem einen und oder aber wenn als ob weil dass ich du er sie es wir ihr sein seine ihre ist sind war waren hat haben hatte wird werden kann in im an am auf aus bei mit nach von vom zu zum zur wie was wer wo wann warum welche welcher welches nicht kein keine jeder jede jedes dieser diese dieses "
    "le la les un une des du de et ou mais donc si quand comme que qui quoi dont où il elle on nous vous ils elles ce cet cette ces son sa ses leur leurs est sont était a ont dans sur sous avec sans pour par en au aux combien chaque tous toutes "
    "el los las una unos unas y o pero cuando como cual cuanto cuantos cuantas quien donde yo tú él ella nosotros ellos ellas su sus es son era fue hay ha han con sin para por del al cada todos todas este esta estos estas si no"
).split()
#: The forms that become placeholders.
NAME_FORM = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{Nd}}])(?!(?:{'|'.join(sorted({w.capitalize() for w in FUNCTION_WORDS}))})(?!\p{{L}}))\p{{Lu}}\p{{Ll}}+"
NUMBER_FORM = r"[$]?[0-9][0-9.,:/]*%?"
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hrs hours minutes seconds days weeks months years meters metres miles feet inches dollars euros cents percent kph mph"
UNIT_FORM = rf"(?<={END}\x20)(?:{UNITS.replace(' ', '|')})(?![\p{{L}}\p{{N}}])"
PUNCTUATION = ".,;:!?\"'()[]{}`*#&%$|<>_~^=+/\\-"


def marked_text(text: Column) -> Column:
    """The text in canonical form, in which placeholders still hold what they stand for."""
    marked = F.regexp_replace(text, NAME_FORM, f"{NAME}$0{END}")
    marked = F.regexp_replace(marked, NUMBER_FORM, f"{NUMBER}$0{END}")
    marked = F.regexp_replace(marked, UNIT_FORM, f"{UNIT}$0{END}")
    return F.translate(F.lower(marked), PUNCTUATION, "")


def canonical_words(rows: DataFrame, id_columns: list[str]) -> DataFrame:
    """The ids, marked (the canonical words with what placeholders stand for) and hashes (of the words without it)."""

    def hashed(word: Column) -> Column:
        """A word's hash; its lowest bit tells placeholders."""
        held = F.regexp_replace(word, f"([{NAME}{NUMBER}{UNIT}])[^{END}]*{END}", "$1")
        return F.when(F.contains(word, F.lit(END)), F.xxhash64(held).bitwiseOR(F.lit(1))).otherwise(F.xxhash64(word).bitwiseAND(F.lit(-2)))

    # one step for each form, so that none is made twice
    marked = rows.select(*id_columns, marked_text(F.col("text")).alias("canonical")).select(*id_columns, words(F.col("canonical")).alias("marked"))
    return marked.select(*id_columns, "marked", F.transform("marked", hashed).alias("hashes"))


def windows(rows: DataFrame, id_columns: list[str], size: int, *, met: Callable[[Column], Column] | None = None) -> DataFrame:
    """The ids, h (hash of a window), fill (its words with what placeholders stand for; null without placeholders) and at (its position).

    Windows are made as hashes alone; only those for which ``met`` may hold become rows.
    """
    # no filter on what is made here: it would be pushed below, and arrays made once for each window
    every = F.when(F.size("hashes") > 0, F.sequence(F.lit(0), F.greatest(F.size("hashes") - size, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    hashed = canonical_words(rows, id_columns).select("*", F.transform(every, lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(size)])).alias("h"))
    places = F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1)).otherwise(F.array().cast("array<int>"))
    kept = hashed.select("*", (F.filter(places, lambda i: met(F.get("h", i))) if met else places).alias("places"))

    def window(i: Column) -> Column:
        filled = reduce(lambda a, b: a | b, [F.coalesce(F.get("hashes", i + k), F.lit(0)).bitwiseAND(1) == 1 for k in range(size)])
        return F.struct(F.get("h", i).alias("h"), F.when(filled, F.slice("marked", i + 1, size)).alias("fill"), i.alias("at"))

    return kept.select(*id_columns, F.explode(F.transform("places", window)).alias("w")).select(*id_columns, "w.h", "w.fill", "w.at")


def keyed(found: DataFrame, *columns: str) -> DataFrame:
    """The columns, key, fill, at and open of windows; closed windows have the key of their filling, and no filling to compare."""
    literal = F.filter("fill", lambda w: ~F.contains(w, F.lit(END)))
    closed = F.col("fill").isNotNull() & (F.size(F.array_distinct(literal)) < 2)
    key = F.when(closed, F.xxhash64(F.lit("closed"), F.concat_ws(" ", "fill"))).otherwise(F.col("h"))
    return found.select(*columns, key.alias("key"), F.when(~closed, F.col("fill")).alias("fill"), "at", (~closed).alias("open"))


def may_hold(hashes: DataFrame, *, most_bits: int = 1 << 22) -> Callable[[Column], Column]:
    """A test that every one of the hashes (h) passes, and few others: bits of a table of at most ``most_bits``.

    The table is sized by the count of hashes; where that is larger than the bound, more of the others pass, and the
    join that follows takes them out.
    """
    wanted = hashes.select("h").distinct()
    bits = min(most_bits, max(1 << 14, 1 << (16 * wanted.count()).bit_length()))
    slot = F.col("h").bitwiseAND(bits - 1)
    rows = wanted.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.collect_set(slot.bitwiseAND(63)).alias("bits")).collect()
    table = [0] * (bits // 64)
    for r in rows:
        table[r["word"]] = sum(1 << b for b in r["bits"])
    signed = [x - (1 << 64) if x >> 63 else x for x in table]
    # literals, so that nothing is parsed for each window
    constant = lambda xs: F.lit(np.array(xs, dtype=np.int64))
    words_of, masks = constant(signed), constant([1 << i for i in range(63)] + [-(1 << 63)])
    return lambda h: F.get(words_of, F.shiftright(h.bitwiseAND(bits - 1), 6).cast("int")).bitwiseAND(F.get(masks, h.bitwiseAND(63).cast("int"))) != 0


def _enough(n: Column, n_open: Column, share: float, passage: int) -> Column:
    """Whether so many of an item's windows, and of its open ones, are enough to hold it."""
    by_open = (2 * F.col("item_open") >= F.col("n_windows")) & (n_open >= share * F.col("item_open"))
    return (n >= share * F.col("n_windows")) | (n >= passage) | by_open


def matches(docs: DataFrame, benchmark: DataFrame, *, share: float = 0.8, passage: int = 9, size: int = 5, broadcast_windows: int = 500_000) -> DataFrame:
    """doc_id, row, item_id, n_windows and item_open (of the item: all, and open ones), n_matched and n_open (of them, those a document holds with consistent fillings).

    Of documents and items that could be enough.
    """
    bound = lambda df, n: F.broadcast(df) if n <= broadcast_windows else df
    cut = materialize(windows(benchmark.select("item_id", text_or_empty().alias("text")), ["item_id"], size).distinct(), "items")
    items = keyed(cut, "item_id").withColumnsRenamed({"fill": "item_fill", "at": "item_at"})
    counted = items.groupBy(F.col("item_id").alias("item_id_")).agg(F.count("*").alias("n_windows"), F.count_if("open").alias("item_open"))
    # as wide as half an item, so that two copies never share an occurrence; each match is in two that overlap
    width = F.greatest(F.lit(2), F.ceil((F.col("n_windows") + size - 1) / 2)).cast("int").alias("width")
    items = materialize(items.join(counted, F.col("item_id").eqNullSafe(F.col("item_id_"))).select("item_id", "key", "item_fill", "item_at", "open", "n_windows", "item_open", width), "items")
    n_items = items.count()
    keys = materialize(items.groupBy("item_id", "key", "open", "n_windows", "item_open").agg(F.count("*").alias("times")), "keys")

    text = text_or_empty()
    found = windows(docs.select("doc_id", F.xxhash64(text).alias("row"), text.alias("text")), ["doc_id", "row"], size, met=may_hold(cut))
    hits = keyed(found, "doc_id", "row").drop("open")
    hits = materialize(hits.filter(may_hold(keys.select(F.col("key").alias("h")))(F.col("key"))), "hits")
    pair = ["doc_id", "row", "item_id"]
    # equal rows repeat their positions
    per_key = hits.groupBy("doc_id", "row", "key").agg(F.size(F.collect_set("at")).cast("long").alias("doc_times"))
    met = per_key.join(bound(keys, n_items), "key").select(*pair, "open", "n_windows", "item_open", F.least("times", "doc_times").alias("n"))
    per_pair = met.groupBy(*pair, "n_windows", "item_open").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("open"), F.col("n"))), F.lit(0)).alias("n_open"))
    candidates = materialize(per_pair.filter(_enough(F.col("n"), F.col("n_open"), share, passage)).select(F.col("doc_id").alias("doc_id_"), F.col("row").alias("row_"), "item_id"), "candidates")

    of_doc = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("row") == F.col("row_"))
    mine = per_key.join(candidates, of_doc).select("doc_id", "row", F.col("item_id").alias("item_id_"), "key", "doc_times")
    own_keys = F.col("item_id").eqNullSafe(F.col("item_id_")) & (F.col("key") == F.col("key_"))
    # what a key counts, in one row for each candidate and key
    weighed = mine.withColumnRenamed("key", "key_").join(bound(keys, n_items), own_keys).select(*pair, "key", "open", "n_windows", "item_open", F.struct("key", F.least("times", "doc_times").alias("n"), "open").alias("h"))
    weighed = materialize(weighed, "weighed")
    again = lambda df, *names: df.select(*[F.col(c).alias(f"{c}_") for c in names], *[c for c in df.columns if c not in names])
    places = hits.join(again(weighed.select(*pair, "key", "n_windows", "item_open", "h"), "doc_id", "row", "key"), of_doc & (F.col("key") == F.col("key_"))).select(*pair, "n_windows", "item_open", "key", "h", "fill", "at")
    on_item = F.col("item_id").eqNullSafe(F.col("item_id_")) & (F.col("key") == F.col("key_"))
    joined = places.join(bound(again(items.select("item_id", "key", "item_fill", "item_at", "width"), "item_id", "key"), n_items), on_item)
    shift = F.col("at") - F.col("item_at")
    half = F.floor(F.col("width") / 2).cast("int")
    low, high = F.floor(shift / F.col("width")).cast("int") * 2, F.floor((shift + half) / F.col("width")).cast("int") * 2 + 1
    joined = joined.withColumn("low", F.when(F.col("fill").isNotNull(), low)).withColumn("high", F.when(F.col("fill").isNotNull(), high))
    joined = materialize(joined.select(*pair, "n_windows", "item_open", "h", "item_fill", "fill", "low", "high").distinct(), "matches")
    same_fill = F.col("fill").isNull() | (F.col("fill") == F.col("item_fill"))
    # null: windows that count in any occurrence
    always = joined.filter(same_fill).select(*pair, "n_windows", "item_open", "h", F.lit(None).cast("int").alias("place"))
    slots = F.filter(F.arrays_zip(F.col("item_fill").alias("item"), F.col("fill").alias("doc")), lambda x: F.contains(x["item"], F.lit(END)))
    filled = joined.filter("fill is not null").select(*pair, "n_windows", "item_open", "h", slots.alias("slots"), F.explode(F.array("low", "high")).alias("place")).distinct()
    # one vote for each of the item's windows, however often it stands there; of as many votes the item's own filling wins
    votes = filled.select(*pair, "place", "h.key", F.explode("slots").alias("s")).groupBy(*pair, "place", "s.item", "s.doc").agg(F.countDistinct("key").alias("votes"))
    chosen = votes.groupBy(*pair, "place", "item").agg(F.max(F.struct("votes", (F.col("item") == F.col("doc")).alias("own"), "doc")).alias("best"))
    # and no two fillings of the item become one of the document
    single = chosen.groupBy(*pair, "place", "best.doc").agg(F.max(F.struct("best.votes", "best.own", "item")).alias("best"))
    # at most one entry for each slot of an item
    maps = single.groupBy(*pair, "place").agg(F.map_from_entries(F.collect_list(F.struct("best.item", "doc"))).alias("map"))
    same = of_doc & F.col("item_id").eqNullSafe(F.col("item_id_")) & (F.col("place") == F.col("place_"))
    held = filled.join(again(maps, *pair, "place"), same).filter(F.forall("slots", lambda s: F.element_at("map", s["item"]) == s["doc"])).select(*pair, "n_windows", "item_open", "h", "place")
    # an item has few windows, so that the sets are small
    per = always.unionByName(held).groupBy(*pair, "n_windows", "item_open", "place").agg(F.collect_set("h").alias("hs"))
    nothing = F.array().cast("array<struct<key:bigint,n:bigint,open:boolean>>")
    per = per.groupBy(*pair, "n_windows", "item_open").agg(F.coalesce(F.max(F.when(F.col("place").isNull(), F.col("hs"))), nothing).alias("own"), F.collect_list(F.when(F.col("place").isNotNull(), F.col("hs"))).alias("places"))
    total = lambda hs: F.aggregate(hs, F.lit(0).cast("long"), lambda acc, h: acc + h["n"])
    # what an occurrence adds is all open
    most = F.coalesce(F.array_max(F.transform("places", lambda x: total(F.array_except(x, F.col("own"))))), F.lit(0))
    return per.select(*pair, "n_windows", "item_open", (total(F.col("own")) + most).alias("n_matched"), (total(F.filter("own", lambda h: h["open"])) + most).alias("n_open"))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, share: float = 0.8, passage: int = 9, size: int = 5, broadcast_windows: int = 500_000) -> DataFrame:
    """doc_id, row, item_id, n_matched, n_windows, matched_share: one row per document (by text) and item that it holds."""
    found = matches(docs, benchmark, share=share, passage=passage, size=size, broadcast_windows=broadcast_windows)
    found = found.filter(_enough(F.col("n_matched"), F.col("n_open"), share, passage))
    return found.select("doc_id", "row", "item_id", "n_matched", "n_windows", (F.col("n_matched") / F.col("n_windows")).alias("matched_share"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    row, found_id, found_row = unused(docs, "row_", "found_id_", "found_row_")
    found = contaminated(docs, benchmark, **options).select("doc_id", "row").distinct().toDF(found_id, found_row)
    keyed = docs.withColumn(row, F.xxhash64(text_or_empty()))
    return keyed.join(found, F.col("doc_id").eqNullSafe(F.col(found_id)) & (F.col(row) == F.col(found_row)), "left_anti").select(*docs.columns)
