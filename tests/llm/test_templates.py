"""Template decontamination against its rule written plainly."""

import random

import __spark_entry__ as entry
from wayfare.llm import decontaminate

from . import brute

ITEM = "At the market Tom buys 12 apples and 30 pears for 5 dollars while his friend Anna counts every coin in the old jar and Tom pays 12 more"
SLOTS = ("Tom", "Anna", "12", "30", "5")


def found(spark, docs_of, docs, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["n_matched"] for r in decontaminate.contaminated(docs_of(docs), bench, **options).collect()}


def filled(values):
    text = ITEM
    for i, s in enumerate(SLOTS):
        text = text.replace(s, f"\x00{i}\x00")
    for i, v in enumerate(values):
        text = text.replace(f"\x00{i}\x00", v)
    return text


def test_whole_tables(spark, data, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/sf0.01/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): r["n_matched"] for r in entry.queries()["op5_decontamination"](spark, f"{data}/sf0.01").collect()}
    assert got == brute.templates(list(documents.items()), items)
    assert len(got) > 5


def test_new_parameters_and_inconsistent_ones(spark, docs_of):
    rng = random.Random(6)
    names = ["Raj", "Lena", "Otto", "Mia", "Ken", "Zoe", "Ida", "Bob"]
    docs = []
    for i in range(50):
        a, b = rng.sample(names, 2)
        x, y, z = rng.sample(range(100, 999), 3)
        docs.append((i, f"{rng.choice(['So', 'Then', 'we read'])} it goes: {filled((a, b, str(x), str(y), str(z)))} and on."))
    for i in range(50, 100):
        # one value for several slots, and another for each time a slot is filled
        docs.append((i, filled(("Raj", "Raj", "7", "7", "7")) if i % 2 else filled(tuple(SLOTS)).replace("Tom", rng.choice(names), 1).replace("12", "81", 1).replace("30", "77").replace("Anna", "Tom")))
    items = [(1, ITEM), (2, "12 and 30 are numbers of Tom and Anna in the old jar"), (3, None), (4, "short one")]
    got = found(spark, docs_of, docs, items)
    assert got == brute.templates(docs, items)
    assert all((i, 1) in got for i in range(50))


def test_one_to_one(spark, docs_of):
    item = "Tom gives Anna 12 coins and 30 stones and 5 shells and Anna gives Tom nothing"
    same = "Raj gives Raj 7 coins and 7 stones and 7 shells and Raj gives Raj nothing"
    other = "Raj gives Lena 7 coins and 8 stones and 9 shells and Lena gives Raj nothing"
    got = found(spark, docs_of, [(1, same), (2, other), (3, item)], [(1, item)], share=0.9, passage=99)
    assert got == {(2, 1): 12, (3, 1): 12} or got.keys() == {(2, 1), (3, 1)}


def test_shuffled_windows_give_the_same(spark, docs_of):
    docs = [(i, filled(("Raj", "Lena", str(i), str(i + 100), str(i + 200)))) for i in range(20)] + [(99, "nothing of it")]
    assert found(spark, docs_of, docs, [(1, ITEM)], broadcast_windows=0) == found(spark, docs_of, docs, [(1, ITEM)]) == brute.templates(docs, [(1, ITEM)])


def test_few_bits_change_nothing(spark, docs_of):
    """A table of bits that is too small lets more windows pass; the join takes them out."""
    rows = spark.range(3000).selectExpr("xxhash64(id) as h")
    test = decontaminate.may_hold(rows, most_bits=1 << 14)
    assert rows.filter(test(rows["h"])).count() == 3000
    wide = decontaminate.may_hold(rows)
    others = spark.range(10_000, 20_000).selectExpr("xxhash64(id) as h")
    assert others.filter(wide(others["h"])).count() < 2000
