"""The registered queries against plain forms of their contracts, over a whole small table."""

import struct
import zlib
from collections import defaultdict

import __spark_entry__ as entry
import pytest
from tokenizers import Tokenizer
from wayfare.llm.queries import tokenizer_file

from . import brute

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def run(spark, data):
    return lambda name: QUERIES[name](spark, f"{data}/sf0.01").collect()


def test_op1(run, documents):
    tok = Tokenizer.from_file(tokenizer_file())
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in documents.items()}
    rows = run("op1_packing")
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for d, parts in by_doc.items():
        assert brute.tiles(parts) == len(ids[d])
    filled = [brute.tiles(parts) for _, parts in sorted(by_sequence.items())]
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert set(filled[:-1]) == {1024} and 0 < filled[-1] <= 1024


def test_op3(spark, data, run, documents):
    rows = run("op3_quality_classifier")
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/sf0.01/labels.parquet").collect()}
    held = [(r["score"], marks[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert brute.auc(held) > 0.9


def test_op4(run, documents):
    rows = run("op4_sharding")
    size = {d: len((t or "").encode()) + 1 for d, t in documents.items()}
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        assert r["size"] == size[r["doc_id"]] and r["text_crc32"] == zlib.crc32((documents[r["doc_id"]] or "").encode())
        slots[r["shard"]].append(r["slot"])
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    assert sorted(slots) == list(range(16))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op6(run, documents):
    got = sorted(tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in run("op6_line_dedup"))
    assert got == sorted(brute.line_dedup(list(documents.items())))
    assert sum(r[2] for r in got) > 50


def test_op7(run, documents):
    kinds = ("email", "ip", "card", "phone")
    rows = run("op7_pii")
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        base = brute.pii(documents[r["doc_id"]])
        assert tuple(r[f"n_{k}"] for k in kinds) == tuple(sum(s[0] == k for s in base) for k in kinds)
        assert r["base_sha256"] == brute.digest(base, kinds)
        listed = r["spans"].split(",")
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(listed)


def test_op8(run, documents):
    want = brute.near(list(documents.items()))
    got = {r["doc_id"]: (r["class_id"], r["copy_id"], r["n_links"]) for r in run("op8_jaccard_join")}
    assert got == want
    assert sum(v[2] > 0 for v in got.values()) > 20


def test_op9(run, documents):
    kinds = ("assign", "access", "hex")
    rows = run("op9_secret_scan")
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        base = brute.secrets(documents[r["doc_id"]])
        assert tuple(r[f"n_{k}"] for k in kinds) == tuple(sum(s[0] == k for s in base) for k in kinds)
        assert r["base_sha256"] == brute.digest(base, kinds)
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r["spans"].split(","))


def test_op10(run, documents):
    rows = run("op10_quality_rules")
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        n = brute.counts(documents[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["base_failed"] and r["kept"])
    passed = [r for r in rows if not r["base_failed"]]
    assert sum(r["kept"] for r in passed) > 0.9 * len(passed)
