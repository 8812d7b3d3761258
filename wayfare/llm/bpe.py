"""Byte-level BPE encoding and decoding with two tiers of lookup.

A text is cut into pre-tokens by the vocabulary's pattern (characters that
tiktoken's version of Unicode puts in another class than ours take a stand-in of that class while it is cut). Tier 1: the distinct pre-tokens of a slice of rows go, all
at once, through a minimal perfect hash of the vocabulary (levels of bits: a key takes the first level on which no
other key hits its bit, and its index is the number of bits before it); a hit counts only if the bytes agree. Tier 2:
pre-tokens that aren't tokens are merged from bytes: a heap holds the ranks of neighbouring pairs, and the tokens of
the piece are linked by position, so that a piece of n bytes takes n log n steps. Merged pieces are remembered up to a
fixed number; this changes no result. Decoding takes the tokens' bytes from one Arrow array.

The table is made once on the driver and broadcast; its size is that of the vocabulary file. Nothing is shuffled.
Texts are cut in pieces of bounded number, so that a long text never stands as one list of strings.

Defined results: a null or empty text has no ids; texts are taken whole at any length; null ids and repeated rows are
documents like any other; null ids to decode give null; an id outside the vocabulary is an error; an empty table gives
no rows; other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, unused

#: Bits of a level for each key that is still without a place.
ROOM = 2
#: Code points that are cut at once; also the most pre-tokens of a list.
SLICE = 1 << 21
#: Merged pieces that a worker remembers in each of two generations.
REMEMBERED = 1 << 18

_PRIME, _STEP = np.uint64(0x100000001B3), 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of the bytes, position by position."""
    order = np.argsort(-lengths, kind="stable")
    starts, longest = starts[order], -lengths[order]
    h = np.full(len(order), 0xCBF29CE484222325, dtype=np.uint64)
    for at in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(longest, -at, side="left"))  # slices longer than ``at``
        h[:n] = (h[:n] ^ data[starts[:n] + at]) * _PRIME
    out = np.empty_like(h)
    out[order] = _mixed(h)
    return out


class MinimalHash:
    """Keys' hashes to 0 .. n-1, without gap or collision; other hashes give -1 or any index."""

    def __init__(self, hashes: np.ndarray) -> None:
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two keys have the same hash")
        levels, bits, left, at = [], [], hashes, 0
        while len(left):
            size = -(-ROOM * len(left) // 64) * 64
            place = self._place(left, len(levels), size)
            hits = np.bincount(place, minlength=size)
            levels.append((at, size))
            bits.append(hits == 1)
            at += size
            left = left[hits[place] > 1]
        self.levels = levels
        set_bits = np.concatenate(bits) if bits else np.zeros(0, dtype=bool)
        self.words = np.packbits(set_bits, bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mixed(hashes + np.uint64(level * _STEP % 2**64)) % np.uint64(size)).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        found = np.full(len(hashes), -1, dtype=np.int64)
        left = np.arange(len(hashes))
        for level, (at, size) in enumerate(self.levels):
            place = at + self._place(hashes[left], level, size)
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            rank = self.before[place >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            found[left[hit]] = rank[hit]
            left = left[~hit]
        return found


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: of all neighbouring pairs the one of least rank is joined, the first of equals, until none has a rank."""
    n, get = len(piece), ranks.get
    end = list(range(1, n + 1))  # of the token that starts here; 0 where none does
    before = list(range(-1, n))  # where the token to the left starts
    # an entry is one number: rank, start, end
    bits = n.bit_length()
    mask = (1 << bits) - 1
    heap = [((r << bits | i) << bits) + i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i, stop = entry >> bits & mask, entry & mask
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the pair was joined to something else
        end[i], end[middle], before[stop] = stop, 0, i
        if i and (r := get(piece[before[i] : stop])) is not None:
            heappush(heap, ((r << bits | before[i]) << bits) + stop)
        if stop < n and (r := get(piece[i : end[stop]])) is not None:
            heappush(heap, ((r << bits | i) << bits) + end[stop])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Vocabulary:
    """Tokens' bytes and ids, the pattern of pre-tokens and the minimal perfect hash."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern
        tokens, ids = list(ranks), np.fromiter(ranks.values(), dtype=np.int32, count=len(ranks))
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing}")
        lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        data, starts = np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(lengths) - lengths
        hashes = _hashes(data, starts, lengths)
        self.hash = MinimalHash(hashes)
        order = np.empty(len(tokens), dtype=np.int64)
        order[self.hash(hashes)] = np.arange(len(tokens))
        self.data, self.starts, self.lengths, self.ids = data, starts[order], lengths[order], ids[order]
        by_id: list[bytes | None] = [None] * (int(ids.max()) + 1)
        for token, i in ranks.items():
            by_id[i] = token
        self.by_id = pa.array(by_id, pa.large_binary())
        self.odd = disagreements()
        self.remembered: dict[bytes, list[int]] = {}
        self.older: dict[bytes, list[int]] = {}

    @classmethod
    def read(cls, ranks_file: str, pattern: str) -> Vocabulary:
        """From lines of a token in base 64 and its rank."""
        with open(ranks_file, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}, pattern)

    def cutter(self) -> Cutter:
        if not hasattr(self, "_cutter"):
            self._cutter = Cutter(self.pattern, self.odd)
        return self._cutter

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_cutter"}

    def whole(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tier 1: the id of each slice that is a token, else -1."""
        out = np.full(len(starts), -1, dtype=np.int32)
        short = np.flatnonzero((lengths > 0) & (lengths <= self.lengths.max()))
        slot = self.hash(_hashes(data, starts[short], lengths[short]))
        maybe = (slot >= 0) & (self.lengths[slot] == lengths[short])
        rows, slot = short[maybe], slot[maybe]
        for at in range(int(lengths[rows].max(initial=0))):
            inside = lengths[rows] > at
            same = ~inside
            same[inside] = data[starts[rows[inside]] + at] == self.data[self.starts[slot[inside]] + at]
            rows, slot = rows[same], slot[same]
        out[rows] = self.ids[slot]
        return out

    def merged(self, piece: bytes) -> list[int]:
        """Tier 2, remembered: what the last two generations haven't met is forgotten."""
        if (found := self.remembered.get(piece)) is None:
            if (found := self.older.get(piece)) is None:
                found = merge(piece, self.ranks)
            if len(piece) <= 64:
                if len(self.remembered) >= REMEMBERED:
                    self.older, self.remembered = self.remembered, {}
                self.remembered[piece] = found
        return found

    def ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and their number for each."""
        codes = {piece: k for k, piece in enumerate(dict.fromkeys(pieces))}
        code = np.fromiter(map(codes.__getitem__, pieces), dtype=np.int32, count=len(pieces))
        distinct = [piece.encode() for piece in codes]
        data, lengths = np.frombuffer(b"".join(distinct), dtype=np.uint8), np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct))
        starts = np.cumsum(lengths) - lengths
        found = self.whole(data, starts, lengths)
        count = np.ones(len(found), dtype=np.int64)
        missed = np.flatnonzero(found < 0)
        parts = [self.merged(distinct[k]) for k in missed.tolist()]
        count[missed] = [len(x) for x in parts]
        first = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), dtype=np.int32)
        hit = np.flatnonzero(found >= 0)
        flat[first[hit]] = found[hit]
        flat[np.repeat(first[missed], count[missed]) + _within(count[missed])] = list(chain.from_iterable(parts))
        n = count[code]
        return flat[np.repeat(first[code], n) + _within(n)], n


def _within(counts: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each count, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


#: Classes of characters in patterns, each with a character of it, and one that is in none.
CLASSES, NO_CLASS = {r"\p{L}": "b", r"\p{N}": "1", r"\s": "\u2003"}, "\ue000"


@cache
def disagreements() -> dict[int, str]:
    """Code points that tiktoken's pattern library, of another version of Unicode, puts in another class than ours does; each with a character of the class it is to have."""
    import regex
    import tiktoken

    points = [range(c, min(c + 0x100, 0xD800 if c < 0xD800 else 0x110000)) for c in range(0, 0x110000, 0x100) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, p)) for p in points]
    out: dict[int, str] = {}
    own = {c: set("".join("".join(regex.findall(c, t)) for t in texts)) for c in CLASSES}
    theirs = {}
    for c in CLASSES:
        # what the pattern doesn't match is left out
        cut = tiktoken.Encoding("class", pat_str=c, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        theirs[c] = set("".join(cut.decode_bytes(cut.encode_ordinary(t)).decode() for t in texts))
    for c in CLASSES:
        out |= {ord(x): NO_CLASS for x in own[c] - theirs[c]}
    for c, stand_in in CLASSES.items():
        out |= {ord(x): stand_in for x in theirs[c] - own[c]}
    return out


class Cutter:
    """Pre-tokens of texts by a pattern, with the classes of characters that tiktoken knows."""

    def __init__(self, pattern: str, odd: dict[int, str]) -> None:
        import regex

        self.pattern, self.odd, self.any_odd = regex.compile(pattern), odd, frozenset(map(chr, odd))

    def _is_odd(self, text: str) -> bool:
        return not (text.isascii() or self.any_odd.isdisjoint(text))

    def cuts(self, text: str) -> Iterator[str]:
        if self._is_odd(text):
            return (text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.odd)))
        return (m[0] for m in self.pattern.finditer(text))

    def all_cuts(self, text: str) -> list[str]:
        return list(self.cuts(text)) if self._is_odd(text) else self.pattern.findall(text)


def _pieces(cutter: Cutter, texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Lists of pre-tokens, with how many of each text, in turn, a list has; a long text takes several lists."""
    pieces: list[str] = []
    counts: list[int] = []
    room = SLICE
    for text in texts:
        if len(text) <= SLICE:
            if len(text) > room:
                yield pieces, counts
                pieces, counts, room = [], [0] * len(counts), SLICE
            cut = cutter.all_cuts(text)
            pieces += cut
            counts.append(len(cut))
            room -= len(text)
            continue
        if pieces:
            yield pieces, counts
        counts = [0] * (len(counts) + 1)
        cuts = cutter.cuts(text)
        while pieces := list(islice(cuts, SLICE)):
            counts[-1] = len(pieces)
            yield pieces, counts
        pieces, counts, room = [], [0] * len(counts), SLICE
    yield pieces, counts


def encode_texts(vocabulary: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and their number for each text."""
    total, ids = np.zeros(len(texts), dtype=np.int64), [np.empty(0, dtype=np.int32)]
    for pieces, counts in _pieces(vocabulary.cutter(), texts):
        if pieces:
            flat, n = vocabulary.ids_of(pieces)
            ids.append(flat)
            ends = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(counts)]]
            total[: len(counts)] += np.diff(ends)
    return np.concatenate(ids), total


def _lists(flat: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat))


def decode_lists(vocabulary: Vocabulary, ids: pa.ListArray) -> pa.Array:
    """The bytes that each list of ids stands for: tokens are taken one after the other, and cut where lists end."""
    tokens = vocabulary.by_id.take(ids.flatten())
    if tokens.null_count:
        raise ValueError("an id outside the vocabulary")
    n = np.asarray(ids.value_lengths().fill_null(0))
    ends = np.frombuffer(tokens.buffers()[1], dtype=np.int64)[: len(tokens) + 1][np.r_[0, np.cumsum(n)]]
    data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.copy()), tokens.buffers()[2]])
    return pa.compute.if_else(ids.is_valid(), data, None).cast(pa.binary())


def encode(docs: DataFrame, vocabulary: Vocabulary, *, text: str = "text", with_decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids``, an array of the text's token ids, and, if asked for, ``decoded``, the bytes of these ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def run(texts: pa.Array) -> pa.Array:
        ids = _lists(*encode_texts(shared.value, texts.to_pylist()))
        decoded = decode_lists(shared.value, ids) if with_decoded else pa.nulls(len(ids), pa.binary())
        return pa.StructArray.from_arrays([ids, decoded], ["ids", "decoded"])

    # marked so that no plan puts it into each projection that uses a part, which would run it once for each
    names = ["ids", "decoded"][: 1 + with_decoded]
    out = unused(docs, "out_")[0]
    made = docs.withColumn(out, run.asNondeterministic()(text_or_empty(text)))
    return made.select(*[docs[c] for c in docs.columns if c.lower() not in names], *[F.col(out)[c].alias(c) for c in names])


def decode(encoded: DataFrame, vocabulary: Vocabulary, *, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("binary")
    def decoded(column: pa.Array) -> pa.Array:
        return decode_lists(shared.value, column)

    return encoded.withColumn("decoded", decoded(ids))
