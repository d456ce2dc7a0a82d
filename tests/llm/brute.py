"""Plain versions of the operators, to hold the queries against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def subwords(text: str, buckets: int) -> np.ndarray:
    """How often the runs of one to three characters, word edges as character 0, fall into each bucket."""
    out, mask = np.zeros(buckets, np.int64), (1 << 32) - 1
    shift = 32 - (buckets.bit_length() - 1)
    a = [0]
    for c in text.lower():
        x = ord(c) if c.isalpha() else 0
        if x or a[-1]:
            a.append(x)
    if a[-1]:
        a.append(0)
    mix = lambda x: x * 2654435761 & mask
    for x in a:
        if x:
            out[(mix(x) * 0x85EBCA6B & mask) >> shift] += 1
    for x, y in zip(a, a[1:], strict=False):
        out[((mix(x) * 31 & mask ^ mix(y)) * 0xC2B2AE35 & mask) >> shift] += 1
    for x, y, z in zip(a, a[1:], a[2:], strict=False):
        if y:
            out[(((mix(x) * 31 & mask ^ mix(y)) * 131 & mask ^ mix(z)) * 0x27D4EB2F & mask) >> shift] += 1
    return out


def substrings(docs: list[tuple], window: int = 50) -> list[tuple]:
    first: dict[tuple, int] = {}
    words = [WORD.findall(text or "") for _, text in docs]
    for (doc, _), w in zip(docs, words, strict=True):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def simhash(text: str | None, width: int = 4) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs: list[tuple], most: int = 4) -> list[tuple]:
    prints = np.array([simhash(t) for _, t in docs], np.uint64)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= most).tolist():
            root[find(i)] = find(j)
    members = defaultdict(list)
    for i, (doc, _) in enumerate(docs):
        members[find(i)].append(doc)
    least = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return [(doc, f"{int(p):016x}", least[find(i)]) for i, ((doc, _), p) in enumerate(zip(docs, prints, strict=True))]


def base_spans(text: str | None) -> list[tuple]:
    text, out = text or "", []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for k, (kind, pattern, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def licenses(text: str | None) -> tuple:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = []
    for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")):
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def license_labels(text: str | None, base: tuple, more: tuple, gap: int, long: int, share: float, stretch: float, reach: int) -> tuple[str, float]:
    """All labels and the score: every stretch of neighbouring diagonals of every template, tried one by one."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    labels, score = set(), 0.0
    for t, (label, phrase) in enumerate((*base, *more)):
        p = phrase.split()
        pairs, hits = len(p) - 1, [(i, j) for i in range(len(w) - 1) for j in range(len(p) - 1) if w[i : i + 2] == p[j : j + 2]]
        most = 0
        lines = sorted({i - j for i, j in hits})
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if (b > a and lines[b] - lines[b - 1] > gap) or lines[b] - lines[a] > reach:
                    break
                inside = [(i, j) for i, j in hits if lines[a] <= i - j <= lines[b]]
                if a == b or max(i for i, _ in inside) + 2 - min(i for i, _ in inside) <= len(p) * stretch:
                    most = max(most, len({j for _, j in inside}))
        score = max(score, most / pairs)
        if t < len(base):
            found = any(w[i : i + len(p)] == p for i in range(len(w) - len(p) + 1))
        else:
            found = most >= (pairs if pairs < long else -(-pairs * share // 1))
        if found:
            labels.add(label)
    return ",".join(sorted(labels)), score


def neighbours(rows: list[tuple], k: int = 20, every: int = 20) -> dict[int, list[tuple]]:
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v, float))]
    out = {}
    for i, v in ok:
        if i % every == 0:
            found = sorted(((-float((v * u).sum()), j) for j, u in ok if j != i))[:k]
            out[i] = [(j, -s) for s, j in found]
    return out
