"""Secret scan: Aho-Corasick keywords, anchored expressions at their hits, then checks of embedded checksums.

One automaton over an ASCII-lower-cased copy of the text (the same length, so offsets hold) finds every keyword;
only at a hit is an expression tried, anchored there. Runs of hexadecimal digits have no keyword and are found by
their own expression. Tokens that carry a checksum (`<prefix>_` + 30 characters + CRC-32 of these in base 62, six
digits) are added only when the checksum is right; a base span is never taken away.

Texts are handled one Arrow batch at a time, each whole; nothing is shuffled.

Defined results: null or empty texts have no spans; null ids and repeated rows each give their row; an empty
table gives no rows; other columns are ignored. Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_or_empty

Span = tuple[str, int, int]

#: Kinds in the order of ties, keywords, and expressions of each keyword's kind.
KINDS = ("assign", "access", "hex", "checked")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CHECKED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
DIGITS_62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum_62(body: str) -> str:
    """Six digits in base 62 of the body's CRC-32."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = DIGITS_62[r] + out
    return out


def ascii_lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def automaton():  # noqa: ANN201
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("checked", CHECKED_WORDS)):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def find_spans(text: str, keywords) -> tuple[list[Span], list[Span]]:  # noqa: ANN001
    """(base spans, added spans). A match that fails its length is dropped, and the search goes on after it."""
    base, added = [], []
    after = dict.fromkeys(KINDS, 0)
    hits = sorted((end - n + 1, kind) for end, (kind, n) in keywords.iter(ascii_lower(text)))
    for start, kind in hits:
        if start < after[kind] or not (m := {"assign": ASSIGN, "access": ACCESS, "checked": CHECKED}[kind].match(text, start)):
            continue
        after[kind] = m.end()
        if kind == "assign" and len(m[1]) >= 6 or kind == "access" and len(m[0]) >= 20:
            base.append((kind, start, m.end()))
        elif kind == "checked" and checksum_62(m[1]) == m[2]:
            added.append((kind, start, m.end()))
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    return base, added


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_checked of every row of ``docs`` (doc_id, text)."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for text in batch.column(1):
                base, added = find_spans(text.as_py(), keywords)
                for k, n in zip(KINDS, counts, strict=True):
                    n.append(sum(x[0] == k for x in base + added))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(base + added))
            arrays = [pa.array(x, pa.int64()) for x in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays[:3], pa.array(digests, pa.string()), pa.array(spans, pa.string()), arrays[3]], names=names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)
