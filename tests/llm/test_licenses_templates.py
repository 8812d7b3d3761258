"""Licence rules and template decontamination on small tables and against plain containment."""

import re

import __spark_entry__ as entry
from wayfare.llm import decontaminate, licenses

ITEM = "At the market Tom buys 12 apples and 30 pears for 5 dollars while his friend Anna counts every coin in the old jar"
BENCH = [(1, ITEM)]


def held(spark, docs_of, text):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    return decontaminate.contaminated(docs_of([(9, text)]), bench).count() == 1


def test_exact_and_reparameterised(spark, docs_of):
    lead = "Some words come first and then this follows. "
    assert held(spark, docs_of, lead + ITEM + " And more after it.")
    assert held(spark, docs_of, lead + ITEM.replace("12", "77").replace("30", "41").replace("Tom", "Raj").replace("Anna", "Lena"))
    assert not held(spark, docs_of, lead + "Nothing here is like the question about the market at all, not one bit.")


def test_op5_finds_plain_copies(spark, data, documents):
    plain = lambda s: re.sub(r"\W+", " ", (s or "").lower()).strip()
    items = {r["item_id"]: plain(r["text"]) for r in spark.read.parquet(f"{data}/sf0.01/benchmark.parquet").collect()}
    want = {(d, i) for d, t in documents.items() for i, s in items.items() if s and s in plain(t)}
    got = {(r["doc_id"], r["item_id"]) for r in entry.queries()["op5_decontamination"](spark, f"{data}/sf0.01").collect()}
    assert want and want == got


def test_license_rules(docs_of):
    rows = [
        (1, "intro\nReleased under the MIT License.\nmore"),
        (2, "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
        (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. MIT License."),
        (4, "This text tells about a license in general."),
        (5, "Licensed under CC BY-NC 4.0.\nAll rights reserved."),
    ]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs_of(rows)).collect()}
    assert got == {(1, "MIT"), (2, "MIT"), (5, "CC-BY-NC-4.0")}
