"""Plain versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
from collections import Counter


def repeats(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words(text: str | None) -> list[str]:
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text: str | None, size: int = 5) -> set[tuple]:
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def ngram_components(rows: list[tuple], percent: int = 75) -> dict:
    """doc_id to (n_shingles, component_id), for distinct ids, by comparing texts that share a shingle."""
    from collections import defaultdict

    sets = {i: shingles(t) for i, t in rows}
    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    shared = Counter()
    for ids in at.values():
        for j, a in enumerate(ids):
            for b in ids[:j]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def top_k(vectors: list[tuple], queries: list[tuple], k: int) -> set[tuple]:
    import math

    def quantised(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]

    known = [(i, q) for i, v in vectors if i is not None and (q := quantised(v)) is not None]
    out = set()
    for i, v in queries:
        q = quantised(v)
        if i is None or q is None:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, w)), j) for j, w in known if j != i)[:k]
        out |= {(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)}
    return out


def water_levels(sizes: list[int], most: int = 3) -> list[float]:
    """Targets by sharing out again and again what is above the caps."""
    weights = [1 + i % 3 for i in range(len(sizes))]
    out, left, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        for i in over or free:
            out[i] = float(most * sizes[i]) if over else left * weights[i] / total
        if not over:
            break
        free -= set(over)
        left = sum(sizes) - sum(out)
    return out


def pii_base(text: str | None) -> list[tuple[str, int, int]]:
    import re

    def luhn(d):
        return sum(n if i % 2 == 0 else n * 2 - 9 * (n > 4) for i, n in enumerate(map(int, reversed(d)))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    kinds = [k for k, *_ in rules]
    found = [(k, m.start(), m.end()) for k, p, fine in rules for m in re.finditer(p, text or "") if fine(m[0])]
    return sorted(found, key=lambda s: (s[1], kinds.index(s[0])))
