"""Decontamination: names where a sentence, a line or a quotation begins."""

from wayfare.llm import decontaminate

ITEM = "Tom has 12 apples. Tom buys 5 more. How many apples does Tom have now?"
RAJ = ITEM.replace("Tom", "Raj").replace("12", "31").replace("5", "8")


def test_names_at_beginnings(spark, docs_of):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    two_names = "Raj has 31 apples. Lena buys 8 more. How many apples does Otto have now?"
    texts = [RAJ, f'He said: "{RAJ}"', f"some lines\n{RAJ}\nand more", f"we know {ITEM}", two_names, "Raj has a dog. Raj buys it a ball. How old is Raj now?"]
    got = {r["doc_id"]: r["n_matched"] for r in decontaminate.contaminated(docs_of(list(enumerate(texts))), bench).collect()}
    assert got == dict.fromkeys(range(4), 11)
