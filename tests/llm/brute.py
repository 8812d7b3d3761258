"""Plain forms of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def line_dedup(docs: list[tuple[int, str | None]], min_chars: int = 20, min_docs: int = 3) -> list[tuple]:
    return [(d, n, lost, hashlib.sha256(kept.encode()).hexdigest()) for d, n, lost, kept in kept_lines(docs, min_chars, min_docs)]


def kept_lines(docs: list[tuple[int, str | None]], min_chars: int = 20, min_docs: int = 3) -> list[tuple]:
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or d == max(holders[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    w, t = words(text), text or ""
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def _spans(kind: str, pattern: str, text: str, good, flags: int = 0) -> list[tuple[str, int, int]]:  # noqa: ANN001
    return [(kind, *m.span()) for m in re.finditer(pattern, text, flags) if good(m)]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def pii(text: str | None) -> list[tuple[str, int, int]]:
    t = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return (
        _spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t, lambda m: True)
        + _spans("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t, lambda m: all(int(x) <= 255 for x in m[0].split(".")))
        + _spans("card", r"[0-9]([\x20-]?[0-9])+", t, lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)))
        + _spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", t, lambda m: 9 <= len(digits(m)) <= 15)
    )


def secrets(text: str | None) -> list[tuple[str, int, int]]:
    t = text or ""
    return (
        _spans("assign", r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, lambda m: len(m[2]) >= 6)
        + _spans("access", r"AKIA[A-Z0-9]+", t, lambda m: len(m[0]) >= 20)
        + _spans("hex", r"[0-9a-f]+", t, lambda m: len(m[0]) >= 24)
    )


def written(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]))))


def digest(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(written(spans, kinds).encode()).hexdigest()


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def tiles(parts: list[tuple[int, int]]) -> int:
    """The length that (start, length) parts cover from 0 on, without gap or overlap."""
    end = 0
    for start, length in sorted(parts):
        assert start == end
        end += length
    return end


def auc(scored: list[tuple[float, int]]) -> float:
    ones, zeros = ([s for s, y in scored if y == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / max(1, len(ones) * len(zeros))


def near(docs: list[tuple[int, str | None]], threshold: float = 0.8) -> dict[int, tuple[int, int, int]]:
    """doc_id: (class, least id with the same shingles, links), by all pairs."""
    sets = {d: s for d, t in docs if (s := shingles(t))}
    order = sorted(sets)
    links, root = Counter(), {d: d for d, _ in docs}

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    by_set = {}
    for d in order:
        by_set.setdefault(sets[d], d)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= threshold * max(len(x), len(y)) and (n := len(x & y)) >= threshold * (len(x) + len(y) - n) - 1e-9:
                links[a] += 1
                links[b] += 1
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {d: (top(d), by_set[sets[d]] if d in sets else d, links[d]) for d, _ in docs}


def canonical(text: str | None) -> list[tuple[str, str]]:
    """(word, word with what its placeholder stands for) by the forms of the decontamination."""
    import regex
    from wayfare.llm import decontaminate as d

    t = regex.sub(d.NAME_FORM, lambda m: f"{d.NAME}{m[0]}{d.END}", text or "")
    t = regex.sub(d.NUMBER_FORM, lambda m: f"{d.NUMBER}{m[0]}{d.END}", t)
    t = regex.sub(d.UNIT_FORM, lambda m: f"{d.UNIT}{m[0]}{d.END}", t)
    marked = words("".join(c for c in t.lower() if c not in d.PUNCTUATION))
    return [(re.sub(f"([{d.NAME}{d.NUMBER}{d.UNIT}])[^{d.END}]*{d.END}", r"\1", w), w) for w in marked]


def template_windows(text: str | None, size: int = 5) -> list[tuple[tuple, tuple | None, bool]]:
    """(key, filling to compare, open) of each window."""
    w = canonical(text)
    out = []
    for i in range(max(1, len(w) - size + 1) if w else 0):
        part = w[i : i + size]
        literal = {full for _, full in part if "\x04" not in full}
        if all("\x04" not in full for _, full in part):
            out.append((tuple(x for x, _ in part), None, True))
        elif len(literal) < 2:
            out.append((("closed", *(full for _, full in part)), None, False))
        else:
            out.append((tuple(x for x, _ in part), tuple(full for _, full in part), True))
    return out


def templates(docs: list[tuple], items: list[tuple], share: float = 0.8, passage: int = 9, size: int = 5) -> dict[tuple, int]:
    """(doc, item): matched windows, of the documents that hold an item."""
    known, times = defaultdict(list), {}
    for i, t in items:
        ws = template_windows(t, size)
        times[i] = Counter((k, is_open) for k, _, is_open in ws)
        for at, (k, fill, is_open) in enumerate(ws):
            known[k].append((i, fill, at, is_open))
    out = {}
    for d, t in docs:
        per_item = defaultdict(list)
        ws = template_windows(t, size)
        doc_times = Counter(k for k, _, _ in ws)
        for at, (k, fill, _) in enumerate(ws):
            for i, item_fill, item_at, is_open in known.get(k, ()):
                per_item[i].append(((k, is_open), item_fill, fill, at - item_at))
        for i, met in per_item.items():
            total = sum(times[i].values())
            total_open = sum(n for (_, is_open), n in times[i].items() if is_open)
            weight = lambda keys, i=i, n=doc_times: sum(min(times[i][k], n[k[0]]) for k in keys)
            width = max(2, -(-(total + size - 1) // 2))
            own = {k for k, a, b, _ in met if b is None or a == b}
            places = defaultdict(set)
            for k, a, b, shift in met:
                if b is not None:
                    places[shift // width * 2].add((k, a, b))
                    places[(shift + width // 2) // width * 2 + 1].add((k, a, b))
            most = 0
            for rows in places.values():
                votes = defaultdict(set)
                for k, a, b in rows:
                    for x, y in zip(a, b, strict=True):
                        if "\x04" in x:
                            votes[x, y].add(k)
                best = {}
                for (x, y), ks in votes.items():
                    best[x] = max(best.get(x, (0, False, "")), (len(ks), x == y, y))
                single = {}
                for x, (n, same, y) in best.items():
                    single[y] = max(single.get(y, (0, False, "")), (n, same, x))
                mapping = {x: y for y, (_, _, x) in single.items()}
                held = {k for k, a, b in rows if all(mapping.get(x) == y for x, y in zip(a, b, strict=True) if "\x04" in x)}
                most = max(most, weight(held - own))
            n, n_open = weight(own) + most, weight(k for k in own if k[1]) + most
            if n >= share * total or n >= passage or (2 * total_open >= total and n_open >= share * total_open):
                out[d, i] = n
    return out


def licences(docs) -> list[tuple[int, str, int, int]]:  # noqa: ANN001
    """(doc, licence, sentences of the fullest rule, first sentence) by reading a text part by part."""
    from wayfare.llm import licenses as m

    known = {m.plain(x): name for name, forms in m.SENTENCES.items() for x in forms}
    out = []
    for d, t in docs:
        t = re.sub(r"SPDX-License-Identifier[\x20\x09-\x0D]*:[\x20\t]*", "\nSPDX-License-Identifier ", t or "", flags=re.I)
        # (part, whether only a line end divides it from the part before)
        parts, at, soft = [], 0, False
        for end in [*re.finditer(r"[\n;:!?]+|\.+(?=[\x20\x09-\x0D]|$)", t), None]:
            parts.append((t[at : end.start() if end else len(t)], soft))
            if end:
                at, soft = end.end(), end[0] == "\n"
                # a comment's mark after a single line end belongs to the line
                if mark := re.fullmatch(r"\n[;!]+", end[0]):
                    soft = t[mark.end() + end.start() : mark.end() + end.start() + 1] in (" ", "\t")
        clean = [re.sub("^ ?(?:dnl|rem) ", "", re.sub("[^a-z0-9]+", " ", p.lower())).strip() for p, _ in parts]
        seen = []
        for i in range(len(parts)):
            if not clean[i]:
                continue
            sentence, j = clean[i], i
            tried = [sentence]
            while j + 1 < len(parts) and parts[j + 1][1] and clean[j + 1] and len(tried) < 120 and len(sentence) < 600:
                j += 1
                sentence = f"{sentence} {clean[j]}".strip()
                tried.append(sentence)
            met = set()
            for x in tried:
                x = re.sub("^neither the name of .+ nor the names of its contributors", "neither the name of the copyright holder nor the names of its contributors", x)
                if x.startswith(m.SPDX):
                    met |= {known.get(f"{m.SPDX} {y}") for y in re.split(" (?:and|with|or(?! later)) ", x[len(m.SPDX) + 1 :])}
                else:
                    met.add(known.get(x))
            seen += [(i, name) for name in met if name]
        found = {}
        for licence, rules in m.RULES.items():
            for rule in rules:
                first = end = min((p for p, name in seen if name == rule[0]), default=None)
                for want in rule[1:]:
                    end = None if end is None else min((p for p, name in seen if name == want and p > end), default=None)
                if end is not None:
                    found[licence] = max(found.get(licence, (0, 0)), (len(rule), -first))
        clauses = [name for _, name in sorted(seen) if name in ("bsd_grant", "bsd_names", "bsd_advert")]
        if not any(x == "bsd_grant" and y not in ("bsd_names", "bsd_advert") for x, y in zip(clauses, [*clauses[1:], ""])):
            found.pop("BSD-2-Clause", None)
        every = set(found)
        out += [(d, x, n, -at) for x, (n, at) in found.items() if not every & set(m.YIELDS.get(x, ()))]
    return out
