"""Plain versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(s: str | bytes) -> str:
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def contamination(docs, items, window=10):
    windows = defaultdict(set)
    for name, text in items:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[k : k + window])].add(str(name))
    sizes = {len(k) for k in windows}
    out = []
    for i, text in docs:
        w, hit, found = ITEM_WORD.findall((text or "").translate(LOWER)), set(), set()
        for s in sizes:
            for k in range(len(w) - s + 1):
                if names := windows.get(tuple(w[k : k + s])):
                    hit |= set(range(k, k + s))
                    found |= names
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def shingle_set(text, words=2):
    w = WORD.findall((text or "").translate(LOWER))
    k = min(words, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def near_groups(docs, words=2):
    """doc_id -> (set size, smallest reachable doc_id); ids must be distinct."""
    sets = {i: shingle_set(t, words) for i, t in docs}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def base_quality(text):
    text = text or ""
    w = WORD.findall(text)
    triples = Counter(zip(w, w[1:], w[2:]))
    hit = {k + j for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(hit), failed


def repeats(texts: list[bytes], window=400):
    count = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone, end = bytearray(len(t)), 0
        for k in range(len(t) - window + 1):
            if count[t[k : k + window]] > 1:
                for q in range(max(k, end), k + window):
                    gone[q] = 1
                end = k + window
        kept = bytes(b for b, x in zip(t, gone) if not x)
        spans = sum(1 for q in range(len(t)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append((len(t), sum(gone), spans, sha(kept)))
    return out


def base_secrets(text):
    text = text or ""
    names = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token"))
    assign = re.compile("(" + names + r"|[aA][pP][iI]_?[kK][eE][yY]" + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    counts = tuple(sum(k == kind for _, k, _ in found) for kind in range(3))
    return *counts, sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)))
