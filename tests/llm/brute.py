"""Plain Python forms of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text: str | None) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(nodes, pairs) -> dict:
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {n: root(n) for n in nodes}


def near(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    pairs = []
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                pairs.append((a, b))
    part = components(ids, pairs)
    return {i: (len(sets[i]), part[i]) for i in ids}


def repeats(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k:k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        runs = sum(1 for k, x in enumerate(gone) if x and (not k or not gone[k - 1]))
        out.append((len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    def ok(kind: str, match: str) -> bool:
        digits = re.sub("[^0-9]", "", match)
        return {
            "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in match.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
        }[kind]

    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


def fold(i: int | None, n: int) -> int:
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def unigram(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, float]]:
    tokens = {i: [*words(t), None] for i, t in docs}
    count = Counter(w for i, ws in tokens.items() if fold(i, 7) != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    return {i: (len(ws), sum(count[w] > 0 for w in ws), sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}


def cosine_links(rows: list[tuple[int, list[float] | None, int | None]], threshold: float = 0.98) -> dict[int, tuple[int, int]]:
    def good(x, label) -> bool:
        return label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x) and any(x)

    pairs = []
    for k, (a, x, m) in enumerate(rows):
        for b, y, n in rows[:k]:
            if m == n and good(x, m) and good(y, n) and len(x) == len(y):
                cos = math.fsum(p * q for p, q in zip(x, y)) / math.sqrt(math.fsum(p * p for p in x) * math.fsum(q * q for q in y))
                if cos >= threshold:
                    pairs.append((a, b))
    ids = [r[0] for r in rows]
    part, degree = components(ids, pairs), Counter(x for p in pairs for x in p)
    return {i: (degree[i], part[i]) for i in ids}
