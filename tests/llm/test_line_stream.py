"""The stream over sorted line hashes, cut anywhere, drops what the whole table says."""

import random
from collections import defaultdict

import pyarrow as pa
from wayfare.llm import line_dedup
from wayfare.llm.line_dedup import DROP, OPEN, WITNESS

from . import brute


def plain(rows, min_docs):
    docs = defaultdict(set)
    for h, d, _ in rows:
        docs[h].add(d)
    top = {h: max(d, key=lambda x: (x is not None, x)) for h, d in docs.items()}
    return {(d, p) for h, d, p in rows if len(docs[h]) >= min_docs and d != top[h]}


def streamed(parts, min_docs, sizes):
    found = []
    for part, size in zip(parts, sizes, strict=True):
        batches = [
            pa.RecordBatch.from_arrays([pa.array([r[0] for r in b], pa.int64()), pa.array([0] * len(b), pa.int64()), pa.array([r[1] for r in b], pa.int64()), pa.array([0] * len(b), pa.int64()), pa.array([r[2] for r in b], pa.int32())], names=["h1", "h2", "doc", "row", "pos"])
            for b in (part[i : i + size] for i in range(0, len(part), size))
        ]
        for out in line_dedup._stream(min_docs)(iter(batches)):
            found += [tuple(r.values()) for r in out.to_pylist()]
    holders = defaultdict(set)
    for h, _, d, _, _, what in found:
        if what == WITNESS:
            holders[h].add(d)
    last = {h: max(d, key=lambda x: (x is not None, x)) for h, d in holders.items()}
    open_ = {(d, p) for h, _, d, _, p, what in found if what == OPEN and len(holders[h]) >= min_docs and d != last[h]}
    witnesses = sum(what == WITNESS for *_, what in found)
    assert witnesses <= 2 * min_docs * len(parts)
    return open_ | {(d, p) for _, _, d, _, p, what in found if what == DROP}


def test_any_cut():
    rng = random.Random(4)
    for _ in range(400):
        keys, docs = rng.randrange(1, 6), rng.randrange(1, 9)
        rows = {(rng.randrange(keys), rng.choice([None, *range(docs)]), p) for p in range(rng.randrange(0, 40))}
        rows = sorted(rows, key=lambda r: (r[0], r[1] is None, -(r[1] or 0), r[2]))
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(rng.randrange(0, 4)))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        for min_docs in (2, 3, 4):
            assert streamed(parts, min_docs, [rng.randrange(1, 12) for _ in parts]) == plain(rows, min_docs)


def test_text_ids(spark):
    line = "a line of more than twenty characters"
    rows = [("b", f"{line}\nx"), ("a", line), ("é", f"y\n{line.upper()} "), (None, line), ("b", f"{line}\nx")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r["doc_id"] or "", r["text"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs).collect())
    assert got == [("", "", 1), ("a", "", 1), ("b", "x", 1), ("b", "x", 1), ("é", f"y\n{line.upper()} ", 0)]


def test_null_and_least_id_are_two(spark):
    line = "a line of more than twenty characters"
    docs = spark.createDataFrame([(None, line), (-(2**63), line), (5, line)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {None: 1, -(2**63): 1, 5: 0}


def test_one_line_in_most_documents(docs_of):
    line = "the same footer stands under every page"
    rows = [(i, f"text {i}\n{line}" if i % 3 else f"{line}\n{line}\nother text number {i // 30}, longer than that") for i in range(500)]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs_of(rows)).collect()}
    want = {r[0]: r[1:3] for r in brute.line_dedup(rows)}
    assert got == want
