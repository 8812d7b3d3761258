"""Repeated word windows, counted exactly."""

import random

from wayfare.llm import rules

from . import brute

#: Two windows whose hashes share their first 33 bits, so that sorted prefixes interleave them.
PREFIX_TWINS = "w41767 x y k1 w343458 x y k2 w41767 x y"


def counted(docs_of, texts):
    rows = rules.counts(docs_of(list(enumerate(texts)))).collect()
    return {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows}


def test_windows_with_equal_hash_prefixes(docs_of):
    texts = [PREFIX_TWINS, PREFIX_TWINS + " " + PREFIX_TWINS, "a b c " + PREFIX_TWINS + " a b c"]
    got = counted(docs_of, texts)
    assert [got[i][4] for i in range(3)] == [brute.counts(t)[4] for t in texts]
    assert got[0][4] == 6


def test_repetitive_texts(docs_of):
    rng = random.Random(5)
    texts = []
    for _ in range(1000):
        size, alphabet = rng.randrange(0, 60), rng.randrange(1, 9)
        texts.append("".join(rng.choice(["a", "b", "ß", "#x", "d$", "e", "ff", "g", "h"][:alphabet]) + rng.choice([" ", "\n", "\t", "  ", "\n\n"]) for _ in range(size)))
    texts.append("x y z " * 20_000)
    got = counted(docs_of, texts)
    assert [got[i] for i in range(len(texts))] == [brute.counts(t) for t in texts]
