"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from wayfare.llm import decontaminate, jaccard, licenses, line_dedup, packing, pii, quality, rules, secrets, sharding
from wayfare.llm.queries import tokenizer_file

from . import brute

LONG = " ".join(f"w{i * 7919 % 4001}" for i in range(60_000)) + "\n" + "x" * 100_000 + "1" * 50_000
SHARED = "the same line stands in many documents here"
ROWS = [
    (1, "a plain text\n" + SHARED, "en", "web"),
    (1, "a plain text\n" + SHARED, "en", "web"),
    (2, None, None, None),
    (3, "", "en", None),
    (None, "no id\n" + SHARED, None, "web"),
    (4, LONG, "en", "web"),
    (5, " \t\n\n " + SHARED + " ", "de", "books"),
    (6, SHARED.upper(), "de", "books"),
]
CLASH = ["row", "row_", "doc", "doc_", "h", "h1", "n", "n_lines", "part", "start", "begin", "words", "keys", "score", "x", "item_id", "bits", "bitmap_", "done_", "kept_id_", "found_id_", "label", "quality", "place", "spans", "candidates", "base", "marked", "copies", "class_id"]


def extra(df):
    """With columns whose names the operators use inside."""
    return df.withColumns({c: F.lit("extra") for c in CLASH})


LABELS = "doc_id long, quality int, toxic int"
BENCH = [(1, "How many apples did Tom buy if each of the 12 boxes holds 30 apples and he paid 5 dollars"), (2, None), (None, "a short item"), (3, "")]


@pytest.fixture(scope="module")
def labels(spark):
    return extra(spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, 0), (6, None, 0), (None, 1, 0), (4, 0, 1), (4, 1, 1)], LABELS).drop("quality")).drop("quality").withColumn("quality", F.when(F.col("doc_id") == 1, 1).when(F.col("doc_id") == 3, 0))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string").withColumn("row", F.lit(1)).withColumn("doc_id", F.lit(7))


@pytest.fixture(scope="module")
def runs(labels, bench):
    return {
        "packing": lambda d: packing.pack(d, tokenizer_file()),
        "licenses": licenses.scan,
        "quality": lambda d: quality.score(d, labels),
        "sharding": sharding.shard,
        "decontaminate": lambda d: decontaminate.contaminated(d, bench),
        "line_dedup": line_dedup.dedup_lines,
        "pii": pii.scan,
        "jaccard": jaccard.join,
        "secrets": secrets.scan,
        "rules": rules.judge,
        "keep_good": lambda d: quality.keep_good(d, labels),
        "keep_one": jaccard.keep_one,
        "without_contaminated": lambda d: decontaminate.without_contaminated(d, bench),
        "redact": pii.redact,
    }


NAMES = ["packing", "licenses", "quality", "sharding", "decontaminate", "line_dedup", "pii", "jaccard", "secrets", "rules", "keep_good", "keep_one", "without_contaminated", "redact"]
#: Operators that give a row for each document.
WHOLE = {"quality", "sharding", "line_dedup", "pii", "jaccard", "secrets", "rules", "redact"}


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(docs_of, runs, name):
    df = docs_of(ROWS)
    plain = runs[name](df).collect()
    if name in WHOLE:
        assert len(plain) == len(ROWS)
    full = extra(df)
    clashing = runs[name](full)
    assert len(clashing.collect()) == len(plain)
    if name in ("keep_good", "keep_one", "without_contaminated", "redact"):
        assert clashing.columns == full.columns
        assert all(r["row_"] == "extra" for r in clashing.collect())


def test_values_of_odd_rows(docs_of, runs):
    """The same rows against the plain forms, row by row."""
    df = docs_of(ROWS)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    text = sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0))
    counted = sorted(runs["rules"](df).collect(), key=key)
    assert [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in counted] == [brute.counts(r[1]) for r in text]
    dealt = sorted(runs["sharding"](df).collect(), key=key)
    assert [r["size"] for r in dealt] == [len((r[1] or "").encode()) + 1 for r in text]
    assert [r["text_crc32"] for r in dealt] == [zlib.crc32((r[1] or "").encode()) for r in text]
    assert all(r["slot"] == 0 for r in dealt) and len({r["shard"] for r in dealt}) == len(ROWS)
    tok = Tokenizer.from_file(tokenizer_file())
    ids = sorted((r[0] is None, r[0] or 0, len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in ROWS)
    pieces = runs["packing"](df).collect()
    assert sorted((*key(r), r["doc_tokens"]) for r in pieces if r["start"] == 0) == ids
    assert sum(r["length"] for r in pieces) == sum(n for *_, n in ids)
    bench = [(i, t) for i, t in BENCH]
    held = [*ROWS, (20, f"so {BENCH[0][1]} yes", "en", "web"), (20, f"so {BENCH[0][1]} yes", "en", "web"), (None, BENCH[2][1], None, None)]
    found = {(r["doc_id"], r["item_id"]): r["n_matched"] for r in runs["decontaminate"](docs_of(held)).collect()}
    assert found == brute.templates([r[:2] for r in held], bench)
    assert set(found) == {(20, 1), (None, None)}
    told = [(30, "Released under the MIT License."), (30, "Released under the MIT License."), (None, "Licensed under CC BY 4.0.\nAll rights reserved."), (31, LONG + "\nReleased under CC0 1.0.")]
    got = sorted(map(tuple, runs["licenses"](docs_of([*ROWS, *told])).collect()), key=str)
    assert got == sorted(brute.licences(dict.fromkeys([r[:2] for r in ROWS] + told)), key=str) and len(got) == 3
    redacted = sorted(runs["redact"](df).collect(), key=key)
    plain = [(r[1] or "") for r in text]
    assert [r["text"] == t for r, t in zip(redacted, plain, strict=True)] == [not brute.pii(t) for t in plain]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs_of, runs, name):
    assert runs[name](docs_of(ROWS).limit(0)).collect() == []


def test_no_labels_and_no_benchmark(spark, docs_of, labels, bench):
    docs = docs_of(ROWS)
    assert {r["score"] for r in quality.score(docs, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    assert decontaminate.contaminated(docs, bench.limit(0)).collect() == []
    assert decontaminate.without_contaminated(docs, bench.limit(0)).count() == len(ROWS)


def test_line_dedup_odd(docs_of):
    got = {(r["doc_id"], r["text"]): r["n_dropped"] for r in line_dedup.dedup_lines(docs_of(ROWS)).collect()}
    # ids null, 1, 5 and 6 hold the line; the largest keeps it
    assert got[(6, SHARED.upper())] == 0
    assert got[(5, " \t\n\n ".rpartition("\n")[0])] == 1
    assert got[(1, "a plain text")] == 1
    assert got[(None, "no id")] == 1


def test_jaccard_odd(docs_of):
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in jaccard.join(docs_of([r for r in ROWS if r[0] in (1, 2, 3, 4)])).collect())
    assert [x[1:] for x in got] == [(1, 1, 1), (1, 1, 1), (2, 2, 0), (3, 3, 0), (4, 4, 0)]
    kept = jaccard.keep_one(docs_of(ROWS)).collect()
    assert sum(r["doc_id"] == 1 for r in kept) == 1


def test_pii_and_secrets_long(docs_of):
    text = " ".join(f"w{i * 7919 % 4001}" for i in range(30_000)) + "x" * 3000 + "1" * 3000 + " mail me at " + "a" * 5000 + "@host.example.org or +1 (555) 010-2030 and token = " + "Z" * 9000 + " 192.168.0.1"
    r = pii.scan(docs_of([(1, text)])).first()
    base = brute.pii(text)
    assert r["base_sha256"] == brute.digest(base, ("email", "ip", "card", "phone"))
    s = secrets.scan(docs_of([(1, text)])).first()
    assert s["base_sha256"] == brute.digest(brute.secrets(text), ("assign", "access", "hex"))


def test_pipeline_on_odd_rows(spark, docs_of, data, tmp_path):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline

    extra(docs_of(ROWS)).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[0] == "doc_id"
