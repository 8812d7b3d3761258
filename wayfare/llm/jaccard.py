"""Similarity join of documents by the Jaccard index of their word shingles, over a MinHash LSH forest.

1. Every document's set of shingles (five words) gets a fingerprint and, for each tree, a label of ``max_depth``
   values. Documents with equal sets are copies of one class and stand behind one representative from here on.
2. Each tree is a trie of labels, kept as sorted labels: range partitions are streamed in order, and the common
   prefix of neighbours tells the nodes. The matched prefix of a node starts at ``max_depth`` and is shortened until
   the recall expected for the least similar partner that its rows can have (by the sizes of their sets) reaches
   ``recall``; a node of at most ``small`` rows is shortened once more, as matching it costs next to nothing. So
   sparse parts of a trie match on shorter prefixes than dense ones, and small sets on longer ones than large sets.
   The rows of a node are a bucket. Buckets that several trees make of the same members are kept once.
3. Buckets that share members make a family. A family is compared as a whole if that takes no more rows than its
   buckets do one by one; else a pair that meets in several buckets counts in the first. What is compared is cut
   into blocks of bounded size. A task streams over sorted blocks, intersects the sets themselves, so that every
   link is exact, and passes on what each set has apart from that of the group's leader (or the set, where it is the
   smaller of the two). Each pair of blocks of a group is then a unit of work on these parts. A unit gives out one row
   a member (its links, and its root among the linked), never pairs.
4. Roots are joined to components by rounds of star contraction, each written to the shared folder.

Shuffled are labels (some hundred bytes a document) and the texts of representatives that share a bucket, once for
each block they are in; other texts are left out by a broadcast table of bits. Work within one group of m different
near copies grows with m squared, as the count of its links does, but is spread over block pairs, which move only what
near copies have apart; copies cost nothing.

Defined results: documents without words (null and empty texts too) have no shingles and no links, and each is its
own class; texts of fewer than five words are one shingle; rows that repeat an id are documents of their own in
the counts, and stand behind one another if their texts are equal too; of classes that could take several ids the
least is taken, and null comes before all others; texts are taken whole at any length; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.semi import bit_table, may_be_in
from .common import materialize, text_or_empty, unused, words

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def expected_recall(depth: int, trees: int, threshold: float) -> float:
    return 1 - (1 - threshold**depth) ** trees


def prefix_depth(trees: int, max_depth: int, threshold: float, recall: float) -> int:
    """The longest prefix that meets the recall, shortening step by step."""
    depth = max_depth
    while depth > 1 and expected_recall(depth, trees, threshold) < recall:
        depth -= 1
    return depth


def least_index(n: int, threshold: float) -> float | None:
    """The least index, of those at or above the threshold, of a set of ``n`` with any other set; None if there is none."""
    found = []
    for m in range(math.ceil(threshold * n - 1e-9), math.floor(n / threshold + 1e-9) + 1):
        common = math.ceil(threshold * (n + m) / (1 + threshold) - 1e-9)
        if common <= min(n, m) - (n == m):
            found.append(common / (n + m - common))
    return min(found, default=None)


def depths_by_size(trees: int, max_depth: int, threshold: float, recall: float, *, largest: int = 512) -> np.ndarray:
    """Prefix length by the size of a set (the last entry: that size and above); 0 for sizes that no other set can match."""
    least = [least_index(n, threshold) for n in range(largest)]
    return np.array([0 if x is None else prefix_depth(trees, max_depth, x, recall) for x in least] + [prefix_depth(trees, max_depth, threshold, recall)])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the windows; one for a shorter text, none for no words."""
    w = word_hashes.astype(np.int64, copy=False).view(np.uint64)
    n = max(1, len(w) - size + 1)
    if not len(w):
        return w
    h = np.zeros(n, dtype=np.uint64)
    for i in range(min(size, len(w))):
        h = mixed(h + w[i : i + n] + np.uint64(i + 1))
    return np.unique(h)


def constants(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, count, dtype=np.uint64), rng.integers(0, 2**64, count, dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray, xor: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Least value of each hash function over the set, some thousands of shingles at a time."""
    out = np.full(len(xor), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        out = np.minimum(out, ((shingles[at : at + 2048, None] ^ xor) * times).min(axis=0))
    return out


def labels_of(sig: np.ndarray) -> bytes:
    """Two bytes of each value, the first byte leading, so that labels sort as bytes."""
    return (mixed(sig) >> np.uint64(48)).astype(">u2").tobytes()


def _word_hashes() -> Column:
    return F.transform(words(F.col("text")), lambda w: F.xxhash64(w))


def signed(docs: DataFrame, *, size: int, trees: int, depth: int, seed: int) -> DataFrame:
    """doc_id, row (hash of the text), f1, f2 (fingerprint of the set), n (its size), labels (of all trees); written once."""
    names = ["doc_id", "row", "f1", "f2", "n", "labels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, times = constants(trees * depth, seed)
        for batch in batches:
            lists = batch.column("hashes")
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            prints, n, labels = np.empty((batch.num_rows, 2), np.int64), [], []
            for i in range(batch.num_rows):
                s = shingle_set(flat[ends[i] - ends[0] : ends[i + 1] - ends[0]], size)
                prints[i] = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64)
                n.append(len(s))
                labels.append(labels_of(signature(s, xor, times)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(n, pa.int64()), pa.array(labels, pa.binary())], names=names)

    hashed = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("row"), _word_hashes().alias("hashes"))
    return materialize(hashed.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, row long, f1 long, f2 long, n long, labels binary"), "signatures")


def matched_depths(tree: np.ndarray, labels: np.ndarray, wanted: np.ndarray, *, least: int, small: int) -> np.ndarray:
    """Length of the prefix on which each row of a sorted run of labels is matched; 0 where it matches none.

    ``wanted`` is the longest prefix that meets the recall for each row and ``least`` the least of these lengths. A
    node at either end may go on beyond it, so its rows aren't counted: its prefix is ``least``.
    """
    count, depth = labels.shape
    same = np.cumprod(labels[1:] == labels[:-1], axis=1).sum(axis=1) if count > 1 else np.empty(0, np.int64)
    common = np.r_[-1, np.where(tree[1:] == tree[:-1], same, -1)]
    out, open_ = np.zeros(count, dtype=np.int64), np.ones(count, dtype=bool)
    for d in range(max(1, least - 1), depth + 1):
        first = common < d
        starts = np.flatnonzero(first)
        node = np.cumsum(first) - 1
        sizes = np.diff(np.r_[starts, count])
        done = (sizes <= small) | (np.minimum.reduceat(wanted, starts) <= d) | (d == depth)
        alone = sizes == 1
        done[[0, -1]], alone[[0, -1]] = d >= least, False
        here = open_ & done[node]
        out[here] = np.where(alone[node[here]], 0, d)
        open_ &= ~here
    return out


def _forest(depths: np.ndarray, trees: int, depth: int, small: int, *, chunk: int = 65_536, hot: int = 262_144):  # noqa: ANN202
    """Streams over labels sorted by tree: rid, n and key (tree and matched prefix) of the rows that may match others."""
    least = int(depths[-1])

    def solve(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        wanted = depths[np.minimum(rows["n"], len(depths) - 1)]
        d = matched_depths(rows["tree"], rows["label"], wanted, least=least, small=small)
        key = mixed((rows["tree"] * (depth + 1) + d).astype(np.uint64))
        for i in range(depth):
            key = np.where(d > i, mixed(key + rows["label"][:, i].astype(np.uint64) + np.uint64(1)), key)
        met = d > 0
        return pa.RecordBatch.from_arrays([pa.array(rows["rid"][met]), pa.array(rows["n"][met]), pa.array(key.view(np.int64)[met])], names=["rid", "n", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("label")
            flat = np.frombuffer(column.buffers()[2], dtype=">u2")[column.offset * depth : (column.offset + batch.num_rows) * depth]
            new = {k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("tree", "rid", "n")} | {"label": flat.reshape(-1, depth).astype(np.uint16)}
            held = new if held is None else {k: np.concatenate([held[k], new[k]]) for k in held}
            if len(held["rid"]) < chunk:
                continue
            # cut where a subtree ends; one that is too large to be held is cut within
            top = held["label"][:, : max(1, least - 1)]
            ends = np.flatnonzero((top[1:] != top[:-1]).any(axis=1) | (held["tree"][1:] != held["tree"][:-1]))
            cut = int(ends[-1]) + 1 if len(ends) else len(top) if len(top) >= hot else 0
            if cut:
                yield solve({k: v[:cut] for k, v in held.items()})
                held = {k: v[cut:] for k, v in held.items()} if cut < len(top) else None
        if held is not None:
            yield solve(held)

    return run


def _linked(sets: list[np.ndarray], sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs (a < b) of sets whose index is at least the threshold."""
    m = len(sets)
    if m <= 6:
        pairs = [(a, b) for a in range(m) for b in range(a + 1, m) if min(sizes[a], sizes[b]) >= threshold * max(sizes[a], sizes[b]) - 1e-9]
        common = [len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in pairs]
        at = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        inter = np.array(common, dtype=np.float64)
    else:
        shared = _shared(sets)
        at = np.argwhere(np.triu(shared > 0, 1))
        inter = shared[at[:, 0], at[:, 1]].astype(np.float64)
    union = sizes[at[:, 0]] + sizes[at[:, 1]] - inter
    return at[inter >= threshold * union - 1e-9]


def _shared(sets: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """How many elements each two sets share, some thousand distinct elements at a time."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    new = np.cumsum(often > 1) - 1
    held = often[column] > 1
    owner, column = owner[held], new[column[held]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((m, m), dtype=np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        part = np.zeros((m, width), dtype=np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out


def _roots(m: int, pairs: np.ndarray) -> np.ndarray:
    """Least member that each member reaches over the pairs."""
    root = np.arange(m)
    while True:
        low = root.copy()
        np.minimum.at(low, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(low, pairs[:, 1], root[pairs[:, 0]])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _linked_apart(parts: list[np.ndarray], sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs (a < b) of sets whose index is at least the threshold, by what each set differs in from one and the same set."""
    own = np.fromiter(map(len, parts), dtype=np.float64, count=len(parts))
    apart = own[:, None] + own[None, :] - 2 * _shared(parts)
    total = sizes[:, None] + sizes[None, :]
    inter = (total - apart) / 2
    return np.argwhere(np.triu(inter >= threshold * (total - inter) - 1e-9, 1))


class Member(NamedTuple):
    """A row in a unit: its set, or (``whole`` is false) the elements that are in either it or the leader's set but not both."""

    block: int
    copies: int
    buckets: list[int]
    n: int
    whole: bool
    part: np.ndarray


def _compared(bucket: int, members: dict[int, Member], lead: np.ndarray | None, threshold: float, *, cross: bool) -> dict[str, np.ndarray]:
    """rid, links and root of the members with links; a link counts in the first bucket in which its two members meet."""
    rids = np.array(sorted(members), dtype=np.int64)
    side, copies, buckets, n, whole, parts = zip(*(members[r] for r in rids.tolist()), strict=True)
    sizes = np.array(n, dtype=np.float64)
    if any(whole):
        pairs = _linked([p if w else np.setxor1d(lead, p, assume_unique=True) for w, p in zip(whole, parts, strict=True)], sizes, threshold)
    else:
        pairs = _linked_apart(list(parts), sizes, threshold)
    if cross and len(pairs):
        at = np.array(side)
        pairs = pairs[at[pairs[:, 0]] != at[pairs[:, 1]]]
    root = _roots(len(rids), pairs)
    earlier = [[b for b in own if b < bucket] for own in buckets]
    if len(pairs) and any(earlier):
        if len(rids) <= 6:
            new = [set(earlier[a]).isdisjoint(earlier[b]) for a, b in pairs.tolist()]
        else:
            met = _shared([np.array(x, dtype=np.int64) for x in earlier])
            new = met[pairs[:, 0], pairs[:, 1]] == 0
        counted = pairs[np.array(new, dtype=bool)]
    else:
        counted = pairs
    links, weight = np.zeros(len(rids), np.int64), np.array(copies, dtype=np.int64)
    np.add.at(links, counted[:, 0], weight[counted[:, 1]])
    np.add.at(links, counted[:, 1], weight[counted[:, 0]])
    some = np.zeros(len(rids), dtype=bool)
    some[pairs.ravel()] = True
    return {"rid": rids[some], "links": links[some], "root": rids[root[some]]}


#: What a streamed block gives out: links found in it, and (of groups of several blocks) its members' parts. The leader's set has block -1.
LINKS, PARTS = "rid long, links long, root long", "bid long, block int, blocks int, copies long, buckets array<long>, n long, whole boolean, part array<long>"


def _lists(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    lists = batch.column(column)
    flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    return (flat[a:b].copy() for a, b in itertools.pairwise(ends - ends[0]))


def _within(size: int, threshold: float):  # noqa: ANN202
    """Streams over blocks (bid, block), sorted: links within each one, and parts of the blocks that are to meet others."""
    long, listed = pa.int64(), pa.list_(pa.int64())
    kinds = {"rid": long, "links": long, "root": long, "bid": long, "block": pa.int32(), "blocks": pa.int32(), "copies": long, "buckets": listed, "n": long, "whole": pa.bool_(), "part": listed}

    def rows_of(columns: dict[str, object], count: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(count, t) for k, t in kinds.items()], names=list(kinds))

    def solve(unit: tuple[int, int, int], sets: dict[int, tuple[int, list[int], np.ndarray]], lead: tuple[int, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        bid, block, blocks = unit
        members = {}
        for rid, (copies, buckets, s) in sets.items():
            part = s if lead is None else np.setxor1d(lead[1], s, assume_unique=True)
            whole = lead is None or len(part) > len(s)
            members[rid] = Member(block, copies, buckets, len(s), whole, s if whole else part)
        if len(members) > 1:
            found = _compared(bid, members, None if lead is None else lead[1], threshold, cross=False)
            yield rows_of(found, len(found["rid"]))
        if lead is not None:
            given = list(members.items())
            if block == 0:
                given.append((lead[0], Member(-1, 0, [], len(lead[1]), True, lead[1])))
            if given:
                columns = {k: [getattr(m, k) for _, m in given] for k in ("block", "copies", "buckets", "n", "whole")}
                same = {"bid": [bid] * len(given), "blocks": [blocks] * len(given)}
                yield rows_of({"rid": [rid for rid, _ in given], **same, **columns, "part": [m.part.view(np.int64) for _, m in given]}, len(given))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sets, lead = None, {}, None
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("bid", "block", "blocks", "leads", "rid", "copies", "buckets")), strict=True)
            for (bid, block, blocks, leads, rid, copies, buckets), hashes in zip(keys, _lists(batch, "hashes"), strict=True):
                if (bid, block, blocks) != unit:
                    if unit:
                        yield from solve(unit, sets, lead)
                    unit, sets, lead = (bid, block, blocks), {}, None
                if leads:
                    lead = (rid, shingle_set(hashes, size))
                else:
                    sets[rid] = (copies, buckets, shingle_set(hashes, size))
        if unit:
            yield from solve(unit, sets, lead)

    return run


def _across(threshold: float):  # noqa: ANN202
    """Streams over pairs of blocks (bid, i, j), sorted: links between the two."""

    def solve(bid: int, members: dict[int, Member], lead: np.ndarray) -> pa.RecordBatch:
        found = _compared(bid, members, lead, threshold, cross=True)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in found.values()], names=list(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, members, lead = None, {}, None
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("bid", "i", "j", "rid", "block", "copies", "buckets", "n", "whole")), strict=True)
            for (bid, i, j, rid, *known), part in zip(keys, _lists(batch, "part"), strict=True):
                if (bid, i, j) != unit:
                    if len(members) > 1:
                        yield solve(unit[0], members, lead)
                    unit, members, lead = (bid, i, j), {}, None
                if known[0] < 0:
                    lead = part.view(np.uint64)
                else:
                    members[rid] = Member(*known, part.view(np.uint64))
        if len(members) > 1:
            yield solve(unit[0], members, lead)

    return run


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, *, most: int = 100_000) -> DataFrame:
    """``rows`` joined with ``groups`` (key, m, ...; written), of which each holds m of the rows.

    Groups of more than a share of 1 / ``most`` of all rows, at most ``most`` of them, are broadcast, so that no large
    group comes to one task; the others are shuffled.
    """
    total = groups.agg(F.sum("m")).first()[0] or 0
    large = F.col("m") > max(1000, total // most)
    hot = groups.filter(large)
    if hot.isEmpty():
        return rows.join(groups, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(~large), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def components(edges: DataFrame, *, most_rounds: int = 50) -> DataFrame:
    """node, root for each node of the edges (a, b): root is the component's least node.

    Star contraction (large-star, then small-star) in rounds until no edge changes.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    e = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        low = materialize(both(e).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"), F.count(F.lit(1)).alias("m")), "neighbours")
        # large-star: each larger neighbour is tied to the least of the neighbourhood
        large = join_by_group(both(e).filter("v > u"), low, "u").select(F.col("v").alias("a"), F.col("least").alias("b")).filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # small-star: each smaller neighbour, and the node, are tied to the least of the smaller ones
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).filter("a != b").distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def buckets_of(reps: DataFrame, *, threshold: float, trees: int, max_depth: int, recall: float, small: int) -> DataFrame:
    """rid, n, key of the representatives (rid, n, labels) that share a node of the forest with others; written once."""
    depths = depths_by_size(trees, max_depth, threshold, recall)
    width = 2 * max_depth
    label = lambda i: F.struct(i.cast("int").alias("tree"), F.substring(F.col("labels"), i * width + 1, F.lit(width)).alias("label"))
    matchable = reps.filter(F.get(F.array(*map(F.lit, depths.tolist())), F.least("n", F.lit(len(depths) - 1)).cast("int")) > 0)
    members = matchable.select("rid", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), label)).alias("l")).select("l.tree", "l.label", "rid", "n")
    order = ["tree", "label", "rid"]
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = members.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(ranged.mapInArrow(_forest(depths, trees, max_depth, small), "rid long, n long, key long"), "forest")


def placed_rows(members: DataFrame, *, block_docs: int, block_shingles: int) -> DataFrame:
    """rid, bid (what it is compared in), leader (one of its rows) and blocks of the rows ``members`` (rid, n, key); bids of families are negative."""
    blocks = lambda m, n: F.greatest(F.ceil(F.col(m) / block_docs), F.ceil(F.col(n) / block_shingles)).cast("int")
    mark = F.xxhash64("rid")
    full = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"), F.bit_xor(mark).alias("x"), F.sum(mark.cast("decimal(20,0)")).alias("s"), F.min("rid").alias("leader")).filter("m > 1")
    once = full.groupBy("m", "shingles", "x", "s").agg(F.min("key").alias("key"), F.min("leader").alias("leader"))
    buckets = materialize(once.select(F.monotonically_increasing_id().alias("bid"), "key", "m", "leader", blocks("m", "shingles").alias("blocks")), "buckets")
    placed = materialize(join_by_group(members, buckets, "key").select("rid", "n", "bid", "leader", "blocks"), "members")
    family = components(placed.filter("rid != leader").select(F.col("rid").alias("a"), F.col("leader").alias("b"))).toDF("rid", "family")
    apart = buckets.join(family, F.col("leader") == F.col("rid")).groupBy("family").agg(F.sum(F.col("m") * F.col("blocks")).alias("apart"))
    whole = placed.select("rid", "n").distinct().join(family, "rid").groupBy("family").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"))
    whole = materialize(whole.join(apart, "family").select("family", "m", blocks("m", "shingles").alias("whole"), (F.col("m") * blocks("m", "shingles") <= F.col("apart")).alias("at_once")), "families")
    dealt = join_by_group(placed.join(family, "rid"), whole, "family")
    at_once = dealt.filter("at_once").select("rid", (-1 - F.col("family")).alias("bid"), F.col("family").alias("leader"), F.col("whole").alias("blocks")).distinct()
    return materialize(at_once.unionByName(dealt.filter("not at_once").select("rid", "bid", "leader", "blocks")), "placed")


def links_of(docs: DataFrame, reps: DataFrame, placed: DataFrame, *, size: int, threshold: float) -> DataFrame:
    """rid, links, root of the representatives that have links, in a row for each unit that finds some.

    Texts go once to the blocks they are in, with their group's leader. There they become sets, of which a group of
    several blocks passes on only what is not as in the leader's; pairs of blocks compare these parts.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = placed.groupBy("rid").agg(F.sort_array(F.collect_list("bid")).alias("buckets"))  # one for each tree at most
    block = F.pmod(F.xxhash64("rid", "bid"), F.col("blocks")).cast("int")
    members = placed.join(own, "rid").select("rid", "bid", "blocks", block.alias("block"), "buckets", F.lit(False).alias("leads"))
    none = F.array().cast("array<long>")
    leaders = placed.filter("blocks > 1").select(F.col("leader").alias("rid"), "bid", "blocks").distinct().select("rid", "bid", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), none.alias("buckets"), F.lit(True).alias("leads"))
    at = F.struct("doc_id", "row")
    known = members.unionByName(leaders).join(reps.select("rid", at.alias("at"), "copies"), "rid")
    # texts without a partner go before they are shuffled; repeated rows are one here
    wanted = reps.join(placed.select("rid").distinct(), "rid").select(F.xxhash64(at).alias("mark"))
    rows = docs.select("doc_id", text_or_empty().alias("text")).select(F.struct("doc_id", F.xxhash64("text").alias("row")).alias("at"), "text")
    text = may_be_in(rows.withColumn("mark", F.xxhash64("at")), *bit_table(wanted, "mark"), "mark").select("at", "text").dropDuplicates(["at"])
    dealt = text.join(known, "at").select("bid", "block", "blocks", "leads", "rid", "copies", "buckets", "text")
    streamed = dealt.repartition(parts, "bid", "block").sortWithinPartitions("bid", "block")
    hashed = streamed.select("bid", "block", "blocks", "leads", "rid", "copies", "buckets", _word_hashes().alias("hashes"))
    found = materialize(hashed.mapInArrow(_within(size, threshold), f"{LINKS}, {PARTS}"), "links")
    open_ = found.filter("part is not null").drop("links", "root")
    pair = ["bid", "i", "j"]
    first, second = F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    met = open_.filter("block >= 0").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).filter("other != block").select("*", first, second).drop("other")
    led = open_.filter("block < 0").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 2)).alias("i")).select("*", F.explode(F.sequence(F.col("i") + 1, F.col("blocks") - 1)).alias("j"))
    units = met.unionByName(led).select(*pair, "rid", "block", "copies", "buckets", "n", "whole", "part")
    across = units.repartition(parts, *pair).sortWithinPartitions(*pair).mapInArrow(_across(threshold), LINKS)
    return found.filter("part is null").select("rid", "links", "root").unionByName(materialize(across, "links"))


def join(docs: DataFrame, *, threshold: float = 0.8, size: int = 5, trees: int = 16, max_depth: int = 6, recall: float = 0.9995, small: int = 4, block_docs: int = 200, block_shingles: int = 400_000, seed: int = 1) -> DataFrame:
    """doc_id, row, n (shingles), class_id, copy_id, n_links of every row of ``docs`` (doc_id, text).

    class_id is the least id of the component, copy_id the least id with the same set of shingles, n_links the
    number of other documents whose index with this one is at least ``threshold``.
    """
    rows = signed(docs, size=size, trees=trees, depth=max_depth, seed=seed)
    # representatives: the first row of each set
    same = rows.filter("n > 0").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "row", "n", "labels")).alias("r"), F.count(F.lit(1)).alias("copies"))
    reps = materialize(same.select(F.monotonically_increasing_id().alias("rid"), "f1", "f2", "copies", "r.doc_id", "r.row", "r.n", "r.labels"), "representatives")
    members = buckets_of(reps, threshold=threshold, trees=trees, max_depth=max_depth, recall=recall, small=small)
    placed = placed_rows(members, block_docs=block_docs, block_shingles=block_shingles)
    found = links_of(docs, reps, placed, size=size, threshold=threshold)
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    root = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    grouped = reps.select("rid", "f1", "f2", "copies", F.col("doc_id").alias("copy_id")).join(links, "rid", "left").join(root, F.col("rid") == F.col("node"), "left")
    grouped = grouped.withColumn("root", F.coalesce("root", "rid"))
    # the least id of a component; a null id counts as the least
    least = grouped.groupBy("root").agg(F.min(F.struct(F.col("copy_id").alias("class_id"))).alias("least"))
    classes = grouped.join(least, "root").select("f1", "f2", F.col("copies") - 1 + F.coalesce("links", F.lit(0)), "copy_id", F.col("least.class_id")).toDF("f1", "f2", "n_links", "copy_id", "class_id")
    out = rows.select("doc_id", "row", "f1", "f2", "n").join(classes, ["f1", "f2"], "left")
    alone = F.col("n") == 0
    return out.select("doc_id", "row", "n", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, **options: float) -> DataFrame:
    """``docs`` without near duplicates: the first row (least id, then hash of the text) of each class stays, once.

    Documents without words are no duplicates of each other, unless the whole row is repeated.
    """
    judged = join(docs, **options)
    row, kept_id, kept_row = unused(docs, "row_", "kept_id_", "kept_row_")
    first = judged.filter("n > 0").groupBy("class_id").agg(F.min(F.struct("doc_id", "row")).alias("r")).select("r.doc_id", "r.row")
    kept = first.unionByName(judged.filter("n = 0").select("doc_id", "row").distinct()).toDF(kept_id, kept_row)
    keyed = docs.withColumn(row, F.xxhash64(text_or_empty()))
    chosen = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(row) == F.col(kept_row)))
    return chosen.dropDuplicates([kept_id, kept_row]).select(*docs.columns)
