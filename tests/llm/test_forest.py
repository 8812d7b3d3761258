"""The forest: prefix lengths, nodes of sorted labels, recall against all pairs."""

import random
from collections import defaultdict

import numpy as np
from wayfare.llm import jaccard

from . import brute


def test_least_index_by_size():
    def plain(n, t):
        found = [c / (n + m - c) for m in range(1, 3 * n + 3) for c in range(min(n, m) + 1) if (n, c) != (m, n) and c / (n + m - c) >= t - 1e-12]
        return min(found, default=None)

    for t in (0.5, 0.7, 0.8, 0.9):
        for n in range(1, 40):
            got, want = jaccard.least_index(n, t), plain(n, t)
            assert (got is None) == (want is None) and (want is None or abs(got - want) < 1e-12), (n, t)


def test_prefixes_meet_the_recall():
    depths = jaccard.depths_by_size(16, 6, 0.8, 0.9995)
    assert list(depths[:4]) == [0, 0, 0, 0] and depths[-1] == depths[-2] == 4 and max(depths) == 6
    for n, d in enumerate(depths[:-1]):
        assert not d or jaccard.expected_recall(d, 16, jaccard.least_index(n, 0.8)) >= 0.9995


def test_matched_prefixes_of_a_sorted_run():
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 2, (400, 6), dtype=np.uint16)
    tree = rng.integers(0, 2, 400)
    order = np.lexsort([*labels.T[::-1], tree])
    labels, tree = labels[order], tree[order]
    wanted = rng.integers(4, 7, 400)
    got = jaccard.matched_depths(tree, labels, wanted, least=4, small=3)
    nodes = defaultdict(list)
    for i in range(400):
        for d in range(3, 7):
            nodes[(tree[i], d, *labels[i, :d])].append(i)
    edges = {k for k, v in nodes.items() if 0 in v or 399 in v}
    for i in range(400):
        for d in range(3, 7):
            k = (tree[i], d, *labels[i, :d])
            if k in edges and d < 4:
                continue
            if k in edges or len(nodes[k]) <= 3 or min(wanted[j] for j in nodes[k]) <= d or d == 6:
                assert got[i] == (d if k in edges or len(nodes[k]) > 1 else 0)
                break
    # pairs that share the prefix that either wants are matched on one node
    for d in range(3, 7):
        for k, v in nodes.items():
            if k[1] == d and any(wanted[j] <= d for j in v) and len(v) > 1:
                assert len({(got[j], *labels[j, : got[j]]) for j in v}) == 1


def corpus(rng, groups=60):
    """Texts that are copies with some words changed, so that pairs lie on both sides of the thresholds."""
    texts = []
    for _ in range(groups):
        n = rng.choice([6, 9, 14, 40, 120, 300])
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, n // 40 + 2))):
                copy[rng.randrange(n)] = f"v{rng.randrange(9)}"
            texts.append(" ".join(copy))
    return [*texts, None, "", "a", "a", "one two three"]


def test_recall_at_three_thresholds(docs_of):
    rows = list(enumerate(corpus(random.Random(8))))
    for threshold in (0.6, 0.8, 0.9):
        want = brute.near(rows, threshold)
        got = {r["doc_id"]: (r["class_id"], r["copy_id"], r["n_links"]) for r in jaccard.join(docs_of(rows), threshold=threshold).collect()}
        links = sum(v[2] for v in want.values())
        assert links > 200
        assert sum(v[2] for v in got.values()) / links >= 0.99
        assert all(got[d][2] <= want[d][2] for d in want)
        if threshold == 0.8:
            assert got == want


def test_one_large_group_in_blocks(docs_of):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for d in range(150):
        copy = list(base)
        copy[rng.randrange(80)] = f"v{rng.randrange(40)}"
        rows.append((d, " ".join(copy)))
    want = brute.near(rows)
    for options in ({"block_docs": 20}, {"block_docs": 20, "small": 1, "max_depth": 4}, {"block_shingles": 500}):
        got = {r["doc_id"]: (r["class_id"], r["copy_id"], r["n_links"]) for r in jaccard.join(docs_of(rows), **options).collect()}
        assert got == want


def test_links_by_what_sets_have_apart():
    rng = np.random.default_rng(5)
    lead = np.unique(rng.integers(0, 300, 120).astype(np.uint64))
    sets = [lead] + [np.unique(np.r_[rng.permutation(lead)[: rng.integers(60, len(lead))], rng.integers(0, 400, rng.integers(0, 30)).astype(np.uint64)]) for _ in range(60)]
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    parts = [np.setxor1d(lead, s, assume_unique=True) for s in sets]
    for threshold in (0.5, 0.7, 0.8):
        want = {(a, b) for a in range(61) for b in range(a + 1, 61) if (n := len(np.intersect1d(sets[a], sets[b]))) >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9}
        assert 0 < len(want) < 61 * 30
        assert set(map(tuple, jaccard._linked_apart(parts, sizes, threshold).tolist())) == want
        assert set(map(tuple, jaccard._linked(sets, sizes, threshold).tolist())) == want


def test_blocks_that_hold_sets_unlike_their_leaders(docs_of):
    # a chain, each text with another tenth of its words than the one before, so that its ends share nothing
    rng = random.Random(6)
    words, rows = [f"w{i}" for i in range(60)], []
    for d in range(60):
        words = words[2:] + [f"c{d}-{i}" for i in range(2)]
        rows += [(2 * d, " ".join(words)), (2 * d + 1, " ".join(words[: rng.randrange(50, 60)]))]
    rows += [(500, rows[7][1]), (501, rows[7][1]), (501, rows[7][1])]
    want = brute.near([*rows[:-1]])
    for options in ({"block_docs": 3}, {"block_shingles": 150}):
        got = {r["doc_id"]: (r["class_id"], r["copy_id"]) for r in jaccard.join(docs_of(rows), **options).collect()}
        assert got == {d: v[:2] for d, v in want.items()}
