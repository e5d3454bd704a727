"""What the corpus operators have to give, written down the slow and plain way."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def spark_hash(parts: list[str]) -> int:
    """``xxhash64`` of the ``xxhash64`` of each of some strings."""
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", xxhash.xxh64_intdigest(p.encode(), 42)), seed)
    return _signed(seed)


def sketch(text: str, n: int = 5, fraction: int = 8) -> list[int]:
    w = words(lower(text))
    every = {spark_hash(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({_signed(_array_hash(w))} if w else set())
    low = {h for h in every if h < -(2**63) + 2**64 // fraction}
    return sorted(low or ({min(every)} if every else set()))


def _array_hash(w: list[str]) -> int:
    """``xxhash64`` of an array of longs."""
    seed = 42
    for p in w:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", xxhash.xxh64_intdigest(p.encode(), 42)), seed)
    return seed


def jaccard(a, b) -> float:
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def repeats(texts: list[str], n: int = 200) -> list[list[tuple[int, int]]]:
    """Maximal ranges of bytes covered by strings of ``n`` bytes that start twice or more."""
    raw = [t.encode() for t in texts]
    count = Counter(t[i : i + n] for t in raw for i in range(len(t) - n + 1))
    out = []
    for t in raw:
        spans: list[list[int]] = []
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + n
                else:
                    spans.append([i, i + n])
        out.append([(a, b) for a, b in spans])
    return out


def cut(text: str, spans) -> bytes:
    raw, edges = text.encode(), [0]
    for a, b in spans:
        edges += [a, b]
    edges.append(len(raw))
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def simhash(text: str, n: int = 4) -> int:
    w = words(lower(text))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints: list[int], ids: list, bits: int) -> list:
    """Smallest id of each fingerprint's class, links at ``bits`` differing bits or fewer."""
    return lowest(ids, [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= bits])


def shingles(text: str | None, n: int) -> frozenset:
    w = words(lower(text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def lowest(ids: list, links) -> list:
    """Smallest id of each place's component; ``links`` are pairs of places."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in links:
        root[find(i)] = find(j)
    low: dict = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(low.get(find(i), x), x)
    return [low[find(i)] for i in range(len(ids))]


def warc(pages: list[tuple]) -> dict:
    first = {}
    for page, html in pages:
        key = (html or "").encode()
        first[key] = min(first.get(key, page), page)
    out = {}
    for page, html in pages:
        key = (html or "").encode()
        again = first[key] != page
        out[page] = (len(key), base64.b32encode(hashlib.sha1(key).digest()).decode(), "revisit" if again else "response", first[key] if again else None)
    return out


def unigrams(rows: list[tuple]) -> dict:
    """``id -> held_out, n_tokens, n_known, train_tokens, base_score``."""
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    tokens = [(i, [*words(lower(t or "")), "\n"]) for i, t in rows]
    c = Counter(w for i, ws in tokens if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tokens}


def quality(text: str | None) -> tuple:
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = defaultdict(list)
    for i in range(len(w) - 7):
        grams[tuple(w[i : i + 8])].append(i)
    inside = {k for at in grams.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def shares(text: str | None, n: int) -> float:
    """Share of word characters inside n-grams found twice or more."""
    w = words(text)
    grams = defaultdict(list)
    for i in range(len(w) - n + 1):
        grams[tuple(w[i : i + n])].append(i)
    inside = {k for at in grams.values() if len(at) > 1 for i in at for k in range(i, i + n)}
    return sum(len(w[k]) for k in inside) / max(1, sum(map(len, w)))


def line_share(text: str | None) -> float:
    lines = [x for x in (text or "").split("\n") if words(x)]
    count = Counter(lines)
    return sum(len("".join(words(x))) for x in lines if count[x] > 1) / max(1, sum(len("".join(words(x))) for x in lines))


KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text: str | None) -> list[tuple]:
    """``start, rank, end, kind, value`` of the base spans."""
    text = text or ""
    out = [(m.start(), 1, m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 2, m.end(), "access", m[0]) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 3, m.end(), "hex", m[0]) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def opaque(text: str | None) -> list[tuple]:
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}(?![A-Za-z0-9+/_-])", text or ""):
        if re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]):
            out.append((m.start(), 4, m.end(), "owned", m[0]))
    return out


def live(rows: list[tuple], max_owners: int = 2, max_repositories: int = 3) -> list[list[tuple]]:
    """Live-looking spans of each row of ``text, owner, repository``."""
    found = [sorted(secrets(t) + opaque(t)) for t, _, _ in rows]
    owners, repositories = defaultdict(set), defaultdict(set)
    for spans, (_, owner, repository) in zip(found, rows):
        for s in spans:
            owners[s[4]].add(owner)
            repositories[s[4]].add((owner, repository))
    return [[s for s in spans if len(owners[s[4]]) <= max_owners and len(repositories[s[4]]) <= max_repositories] for spans in found]


def said(spans) -> str:
    return ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in sorted(spans))


def redact(text: str, spans, mask: str = "[SECRET]") -> str:
    at, out = 0, ""
    for s in sorted(spans):
        if s[0] >= at:
            out += text[at : s[0]] + mask
        at = max(at, s[2])
    return out + text[at:]
