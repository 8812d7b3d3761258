"""Byte-level BPE against the library of the rank files, and its two tiers on their own."""

import base64
import hashlib
import random

import __spark_entry__ as entry
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from wayfare.llm import bpe
from wayfare.llm.queries import tokenizer_file

from .test_edges import LONG, ROWS, extra

RANKS = tokenizer_file("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_whole_table(spark, data, documents, plain):
    rows = entry.queries()["op11_bpe"](spark, f"{data}/sf0.01").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        text = documents[r["doc_id"]] or ""
        ids = plain.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode()))


def check(vocabulary, plain, texts):
    ids, n = bpe.encode_texts(vocabulary, texts)
    ends = np.r_[0, np.cumsum(n)]
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == plain.encode_ordinary(t), ascii(t[:80])


def test_every_code_point(vocabulary, plain):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    check(vocabulary, plain, [f"a{c}b {c}1{c}'s  {c}" for c in map(chr, points[:0x3100])])
    check(vocabulary, plain, ["".join(f"a{chr(c)}" for c in points[i : i + 2000]) for i in range(0, len(points), 2000)])


def test_odd_texts(vocabulary, plain):
    rng = random.Random(5)
    made = ["".join(rng.choices("ab \n\t'st1é漢  \x00\x1c\x85😀", k=rng.randrange(60))) for _ in range(3000)]
    check(vocabulary, plain, [*made, "", "x" * 30_000, "ab" * 9000, "​" * 5000, "é漢" * 4000, "don't we'll'S <|endoftext|>", LONG])


def test_lists_of_pieces_are_cut_anywhere(vocabulary, plain, monkeypatch):
    texts = ["one two three", "", "a" * 50, "four five six seven eight nine ten " * 9, "z", "eleven twelve " * 30, ""]
    for size in (1, 7, 40, 100):
        monkeypatch.setattr(bpe, "SLICE", size)
        check(vocabulary, plain, texts)


def test_minimal_perfect_hash():
    for n in (0, 1, 2, 1000, 30_000):
        hashes = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
        table = bpe.MinimalHash(hashes)
        assert sorted(table(hashes).tolist()) == list(range(n))
        assert len(table.words) * 64 < 5 * n + 640
        others = table(hashes + np.uint64(1))
        assert others.min(initial=-1) >= -1 and others.max(initial=-1) < max(n, 1)
    with pytest.raises(ValueError, match="same hash"):
        bpe.MinimalHash(np.array([3, 3], dtype=np.uint64))


def test_first_tier_takes_tokens_only(vocabulary):
    tokens = list(vocabulary.ranks)
    near = [t[:-1] + bytes([t[-1] ^ 1]) for t in tokens] + [t + b"\x00" for t in tokens]
    for words in (tokens, near):
        lengths = np.array([len(w) for w in words])
        found = vocabulary.whole(np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths)
        assert found.tolist() == [vocabulary.ranks.get(w, -1) for w in words]


def test_heap_merges_as_plain_rounds(vocabulary):
    def rounds(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            ranked = [(vocabulary.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in vocabulary.ranks]
            if not ranked:
                return [vocabulary.ranks[p] for p in parts]
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(6)
    for _ in range(2000):
        piece = bytes(rng.choices(b"aabest 1\xc3\xa9", k=rng.randrange(1, 30)))
        assert bpe.merge(piece, vocabulary.ranks) == rounds(piece)


def test_memory_of_merges_changes_nothing(vocabulary, plain, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    vocabulary.remembered.clear()
    vocabulary.older.clear()
    check(vocabulary, plain, ["qzxv wqzk zzqx qzxv vvkq"] * 5)


def test_odd_rows(docs_of, vocabulary, plain):
    df = extra(docs_of(ROWS)).withColumn("ids", F.lit("extra"))
    rows = bpe.decode(bpe.encode(df, vocabulary), vocabulary).collect()
    both = bpe.encode(df, vocabulary, with_decoded=True)
    assert sorted(both.columns) == sorted([*df.columns, "decoded"])
    assert sorted((r["ids"], r["decoded"]) for r in both.collect()) == sorted((r["ids"], r["decoded"]) for r in rows)
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["ids"], bytes(r["decoded"])) for r in rows) == sorted((d or 0, t or "", plain.encode_ordinary(t or ""), (t or "").encode()) for d, t, *_ in ROWS)
    assert all(r["row_"] == "extra" for r in rows)
    empty = bpe.decode(bpe.encode(docs_of(ROWS).limit(0), vocabulary), vocabulary)
    assert empty.collect() == [] and empty.columns[-2:] == ["ids", "decoded"]


def test_decode_of_null_and_unknown_ids(spark, vocabulary):
    rows = spark.createDataFrame([(1, [0, 1]), (2, None), (3, [])], "k int, ids array<int>")
    assert {r["k"]: r["decoded"] and bytes(r["decoded"]) for r in bpe.decode(rows, vocabulary).collect()} == {1: b'!"', 2: None, 3: bytearray(b"")}
    with pytest.raises(Exception, match=r"(?i)out of bounds|outside"):
        bpe.decode(spark.createDataFrame([([99_999],)], "ids array<int>"), vocabulary).collect()


def test_missing_byte_is_an_error():
    with pytest.raises(ValueError, match="without a token"):
        bpe.Vocabulary({b"a": 0}, "a")
