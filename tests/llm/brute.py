"""Plain versions of the corpus operators for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def simhash(text: str | None) -> int:
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = WORD.findall(low)
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    prints = [(i, simhash(t)) for i, t in rows]
    root = {i: i for i, _ in prints}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(prints):
        for j, b in prints[:n]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in prints}


def substring(rows: list[tuple[int, str | None]], window: int = 35) -> dict[int, tuple[int, int, str]]:
    words = [WORD.findall((t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = {}
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out[doc] = len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def suffix(rows: list[tuple[int, str | None]], window: int = 50) -> dict[int, tuple[int, int, int, bytes]]:
    raw = {d: (t or "").encode() for d, t in rows}
    first: dict[bytes, int] = {}
    for d in sorted(raw):
        for i in range(len(raw[d]) - window + 1):
            first.setdefault(raw[d][i:i + window], d)
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i:i + window]] < d:
                gone[i:i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), kept
    return out


def exact(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    return {d: min(g) for g in groups.values() for d in g}


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def runs(words: list[bytes], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal stretch, tried for each period in turn."""
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(doc_id: int | None, text: str | None) -> tuple:
    words = planted(doc_id, WORD.findall((text or "").encode()))
    found = runs(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
    return (len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha(listed.encode()), sha(collapsed(words, found)))


def importance(rows: list[tuple[int, str | None]], target: list[str | None]) -> dict[int, tuple]:
    def features(text: str | None) -> tuple[int, list[int]]:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    docs = {d: features(t) for d, t in rows}
    s, t = Counter(b for _, f in docs.values() for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    out = {}
    for d, (n, f) in docs.items():
        h = int(sha(f"42:{d}".encode())[:8], 16)
        weight = sum(gain[b] for b in f)
        out[d] = n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
    able = sorted((d for d in out if out[d][0] >= 20), key=lambda d: (-out[d][3], d))
    rank = {d: i for i, d in enumerate(able[:5 * len(able) // 100], 1)}
    return {d: (*x[1:], rank.get(d)) for d, x in out.items()}
