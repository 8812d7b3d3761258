"""Spelling variants against all pairs of words, and the trie on its own."""

import random
import re
import zlib
from collections import Counter, defaultdict

import __spark_entry__ as entry
import pytest
from wayfare.llm import spelling

from .test_edges import LONG, ROWS, extra

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def plain_words(docs):
    n = Counter()
    for d, t in docs:
        for run in map(lower, LETTERS.findall(t or "")):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def near(a, b):
    """By the definition: one character inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(n):
    # words at distance one share a form with one character left out at the same or the next place
    by = defaultdict(set)
    for w in n:
        by[w].add(w)
        for i in range(len(w)):
            by[w[:i] + w[i + 1 :]].add(w)
    met = defaultdict(set)
    for ws in by.values():
        for a in ws:
            met[a] |= {b for b in ws if near(a, b)}
    form = {}
    for w in n:
        best = min(met[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(met[w]), n[form[w]] if form[w] else None) for w in n}


def told(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table(spark, data, documents):
    got = told(entry.queries()["op13_spelling_variants"](spark, f"{data}/sf0.01"))
    assert got == plain_groups(plain_words(documents.items()))
    assert sum(v[0] is not None for v in got.values()) > 100
    assert any(v[0] != v[1] for w, v in got.items() if v[0])


@pytest.mark.parametrize("alphabet", ["ab", "abcé", "abcdefghijÿ"])
def test_automaton_and_trie(alphabet):
    rng = random.Random(alphabet)
    words = sorted({"".join(rng.choices(alphabet, k=rng.randrange(1, 9))) for _ in range(600)})
    root = spelling.open_trie(spelling.list_trie([(w, i + 1) for i, w in enumerate(words)]))
    count = {w: i + 1 for i, w in enumerate(words)}
    for w in [*words[:300], *("".join(rng.choices(alphabet, k=5)) for _ in range(100))]:
        got = list(spelling.neighbours(root, w))
        assert len(got) == len(set(got))
        assert dict(got) == {v: count[v] for v in words if near(w, v)}


def test_long_words_in_a_trie():
    a, b, c = "x" * 20_000, "x" * 20_001, "x" * 10_000 + "y" + "x" * 10_000
    root = spelling.open_trie(spelling.list_trie([(w, 3) for w in sorted([a, b, c])]))
    assert {w: {v for v, _ in spelling.neighbours(root, w)} for w in (a, b, c)} == {a: {b, c}, b: {a, c}, c: {a, b}}


def test_shards_and_waves(spark):
    rng = random.Random(9)
    n = {"".join(rng.choices("abcde", k=rng.randrange(5, 8))): rng.randrange(3, 4000) for _ in range(3000)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    want = plain_groups(n)
    assert told(spelling.group(words)) == want
    # many small shards, dealt in several waves and tasks
    assert told(spelling.group(words, shard_words=170, wave_bytes=9000, task_words=400)) == want


def test_a_long_chain_of_forms(spark):
    base, n = "abcdefghijklmnop", {}
    word = base
    for i in range(16):
        n[word] = 3 * 2**i
        word = word[:i] + "z" + word[i + 1 :]
    got = told(spelling.group(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == plain_groups(n)
    assert got[base][1] == "z" * 15 + "p"


def test_ties_and_bounds(spark):
    n = {"words": 5, "wordz": 10, "worda": 10, "wards": 9, "éwords": 10, "xxxxx": 3}
    got = told(spelling.group(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got["words"] == ("worda", "worda", 5, 4, 10)
    assert got["wards"] == (None, "wards", 9, 1, None)
    assert got["xxxxx"] == (None, "xxxxx", 3, 0, None)


def test_odd_rows(docs_of):
    runs = "straße Straße STRASSE naïve naive naives ×÷×÷× "
    rows = [*ROWS, (7, runs * 40), (None, runs * 3), (8, runs.upper() * 5 + "q" * 70_000), (9, "q" * 70_000), (10, "Q" * 70_000), (11, LONG)]
    got = told(spelling.variants(extra(docs_of(rows))))
    assert got == plain_groups(plain_words([r[:2] for r in rows]))
    assert any(len(w) >= 69_999 for w in got)


def test_empty_table(docs_of):
    for rows in ([], [(1, None), (2, ""), (3, "word word word")]):
        df = spelling.variants(docs_of(rows))
        assert df.collect() == []
        assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
