"""Plain versions of the operators over lists of (doc_id, text)."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i, x in enumerate(zip(w, w[1:], w[2:])):
        if wins[x] > 1:
            hit |= {i, i + 1, i + 2}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def base_scores(docs):
    toks = {i: [*WORD.findall(lower(t)), None] for i, (_, t) in enumerate(docs)}
    held = [zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs]
    c = Counter(x for i, t in toks.items() if not held[i] for x in t)
    n, v = sum(c.values()), len(c)
    return [(d, held[i], len(toks[i]), sum(c[x] > 0 for x in toks[i]), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in toks[i])) for i, (d, _) in enumerate(docs)]


def licenses(text, phrases):
    w = TERM.findall(lower(text))
    found = []
    for p, label in phrases:
        p = p.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def repeats(docs, length=100):
    """docs in the order of their ids."""
    seen, out = set(), []
    for d, t in docs:
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            g = raw[i : i + length]
            if g in seen:
                cover[i : i + length] = b"\1" * length
            seen.add(g)
        kept = bytes(b for b, x in zip(raw, cover) if not x)
        runs = len(re.findall(rb"\x01+", bytes(cover)))
        out.append((d, len(raw), sum(cover), runs, sha(kept)))
    return out


def contamination(docs, items, n=10):
    wins = {}
    for i, t in items:
        w = TERM.findall(lower(t))
        for x in ([tuple(w[a : a + n]) for a in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else []):
            wins.setdefault(x, set()).add(i)
    sizes = {len(x) for x in wins}
    out = []
    for d, t in docs:
        w = TERM.findall(lower(t))
        hit, got = set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (x := tuple(w[a : a + k])) in wins:
                    hit |= set(range(a, a + k))
                    got |= wins[x]
        out.append((d, len(w), len(hit), len(got), sha(",".join(sorted(map(str, got)))), bool(hit)))
    return out


def jaccard(docs, k=5, percent=80):
    sets = []
    for _, t in docs:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    by, root = {}, list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        counts = Counter(j for g in s for j in by.get(g, ()))
        for j, n in counts.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            by.setdefault(g, []).append(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)]


def mix_targets(sizes, weights=(5, 2, 1), most=3):
    """sizes: source -> words; sources by code point, null last."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: float(most * sizes[s]) for s in over}
