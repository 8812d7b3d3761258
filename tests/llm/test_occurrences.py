"""Decontamination: fillings are compared within one occurrence of an item."""

import pytest
from wayfare.llm import decontaminate

ITEM = "in the old town of 12 towers people counted 30 bells before the year 1900 ended"
#: Other numbers in the item's own windows, one window at a time.
NOISE = " ".join(f"we saw it {i % 7} times so the old town of 77 towers people liked and counted 88 bells before the war now" for i in range(20))
OTHER = ITEM.replace("12", "41").replace("30", "55").replace("1900", "1777")


@pytest.fixture(scope="module")
def counted(spark, docs_of):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    texts = [f"{NOISE} {ITEM} {NOISE}", f"{NOISE} {OTHER} {NOISE}", f"{OTHER} then {ITEM}", f"{OTHER} and {OTHER.replace('41', '29')}", NOISE, ITEM.replace("people", "all the people")]
    return {r["doc_id"]: r["n_matched"] for r in decontaminate.contaminated(docs_of(list(enumerate(texts))), bench).collect()}


def test_noise_does_not_outvote_a_copy(counted):
    assert counted[0] == counted[1] == counted[2] == counted[3] == 12


def test_windows_of_other_places_are_no_copy(counted):
    assert 4 not in counted
