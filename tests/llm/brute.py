"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(parts: list[str]) -> str:
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Each source's target: shares by weight 1, 2, 3 in turn, 3 times its size at most, the excess shared again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def shingle_set(text: str | None, width: int) -> frozenset:
    words = SPACED.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def near(docs: list[tuple[int, str | None]], width: int) -> dict[int, tuple[int, int]]:
    """doc_id to (set size, component): links by an inverted index over shingles, exact."""
    sets = {i: shingle_set(t, width) for i, t in docs}
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for i in sorted(sets):
        common: dict[int, int] = defaultdict(int)
        for s in sets[i]:
            for j in index[s]:
                common[j] += 1
            index[s].append(i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def secrets(text: str | None) -> list[tuple[int, int, int]]:
    text, out = text or "", []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def personal(text: str | None) -> list[tuple[int, int, int]]:
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def named(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> list[str]:
    return [f"{kinds[k]}:{s}:{e}" for s, k, e in spans]


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def licenses(text: str | None) -> tuple[int, int, int | None, int | None, str]:
    """Words, places, first, last, base labels."""
    words = WORD.findall((text or "").translate(LOWER))
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def contamination(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], width: int = 13) -> dict[int, tuple]:
    windows = defaultdict(set)
    for i, text in items:
        words = WORD.findall((text or "").translate(LOWER))
        if words:
            for at in range(max(1, len(words) - width + 1)):
                windows[tuple(words[at : at + width])].add(i)
    lengths, out = {len(w) for w in windows}, {}
    for i, text in docs:
        words = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for at in range(len(words) - n + 1):
                if own := windows.get(tuple(words[at : at + n])):
                    hit.update(range(at, at + n))
                    found |= own
        out[i] = (len(words), len(hit), len(found), sha(sorted(map(str, found))), bool(hit) and 20 * len(hit) >= len(words))
    return out


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def url(value: str | None) -> tuple[str, str, str | None, str | None]:
    """Host, path, rule, and the rule's verdict."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", value or "")
    host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]
