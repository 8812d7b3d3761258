"""Decontamination: lists of numbers, names and repeated words hold no item but their own, and end soon."""

import random
import time

from wayfare.llm import decontaminate

from . import brute

SYLLABLES = ["ba", "ko", "li", "mer", "nu", "ra", "so", "ti", "vel", "zan"]


def found(spark, docs_of, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["n_matched"] for r in decontaminate.contaminated(docs_of(docs), bench).collect()}


def numbers(rng, n):
    return " ".join(str(rng.randrange(10_000)) for _ in range(n))


def names(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=3)).capitalize() for _ in range(n))


def test_lists_of_numbers(spark, docs_of):
    rng = random.Random(1)
    items = [(i, numbers(rng, 30)) for i in range(100)] + [(200, "Count from 3 to 9 in steps of 2 and write each number into the box of its row")]
    docs = [(1, numbers(rng, 500)), (2, numbers(rng, 50_000)), (3, f"before it {items[7][1]} after it"), (4, " and ".join(numbers(rng, 300).split()))]
    began = time.monotonic()
    got = found(spark, docs_of, docs, items)
    assert time.monotonic() - began < 60
    assert got == {(3, 7): 26}
    assert got == brute.templates(docs, items)


def test_lists_of_names(spark, docs_of):
    rng = random.Random(2)
    items = [(i, names(rng, 30)) for i in range(300)]
    docs = [(i, names(rng, 2000)) for i in range(4)] + [(9, f"we met {items[5][1]} there")]
    began = time.monotonic()
    got = found(spark, docs_of, docs, items)
    assert time.monotonic() - began < 60
    assert got == {(9, 5): 26}
    assert got == brute.templates(docs, items)


def test_repeated_words(spark, docs_of):
    """A window counts as often as both sides have it."""
    items = [(1, "na " * 40), (2, "row 1 and row 2 and row 3 and row 4 and row 5 and row 6 and row 7 and row 8"), (3, "step 1 of the plan then step 2 of the plan then step 3 of the plan then rest")]
    docs = [(1, "they sang na na na na na and left"), (2, "na " * 40), (3, "row 4 and row 6 and row 9 and more"), (4, "now step 7 of the plan then step 8 of the plan then step 9 of the plan then rest"), (5, "step 7 of the plan then")]
    got = found(spark, docs_of, docs, items)
    assert got == brute.templates(docs, items)
    assert set(got) == {(2, 1), (4, 3)}


def test_many_repeats_of_a_template(spark, docs_of):
    """A pair that is no candidate never meets position by position."""
    rng = random.Random(3)
    items = [(i, " ".join(f"page {rng.randrange(99)} of the book" for _ in range(40)) + f" tells of w{i} x{i} y{i} z{i} " * 30) for i in range(50)]
    docs = [(i, " ".join(f"page {rng.randrange(99)} of the book" for _ in range(5000))) for i in range(4)]
    began = time.monotonic()
    got = found(spark, docs_of, docs, [])
    assert got == {}
    got = found(spark, docs_of, docs[:1], items[:2])
    assert time.monotonic() - began < 90
    assert got.keys() == brute.templates(docs[:1], items[:2]).keys()


def test_copies_with_closed_windows(spark, docs_of):
    """A question with many numbers is still found, as it is and with other numbers."""
    item = "Add 12 15 18 21 24 and 30 and then take away 7 from what the pupils found on the board before noon"
    new = item
    for a, b in (("12", "61"), ("15", "62"), ("18", "63"), ("21", "64"), ("24", "65"), ("30", "66"), ("7", "5")):
        new = new.replace(a, b)
    docs = [(1, f"so {item} yes"), (2, f"so {new} yes"), (3, "Add 12 15 18 21 24 to it")]
    got = found(spark, docs_of, docs, [(1, item)])
    assert got == brute.templates(docs, [(1, item)])
    assert set(got) == {(1, 1), (2, 1)}
