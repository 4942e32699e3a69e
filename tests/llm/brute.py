"""Plain Python versions of the operators, for comparison."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def quality(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)}
    earlier, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in earlier
            earlier.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": len(covered),
            "base_failed": len(w) < 10 or 100 * len(covered) > 20 * len(w)}


def exact(rows):
    """rows: (doc_id, text) -> {doc_id: (keep_id, size, kept, sha)}"""
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    return {i: (max(g), len(g), i == max(g), sha(t)) for t, g in groups.items() for i in g}


def secrets(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    for k, (pattern, least) in enumerate((("AKIA[A-Z0-9]+", 18), ("[0-9a-f]+", 16)), 1):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out)]


def shingles(text):
    w = WORD.findall(fold(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_components(rows):
    """rows: (doc_id, text) -> {doc_id: (n_shingles, component_id)}"""
    sets = [(i, frozenset(shingles(t))) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    tried = set()
    for h in holders.values():
        for a in h:
            for b in h:
                if a < b and (a, b) not in tried:
                    tried.add((a, b))
                    x, y = sets[a][1], sets[b][1]
                    n = len(x & y)
                    if 100 * n >= 80 * (len(x) + len(y) - n):
                        p, q = sorted((find(sets[a][0]), find(sets[b][0])))
                        root[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


def repeats(rows, width):
    """rows: (doc_id, text) -> {doc_id: (n_bytes, n_removed, n_spans, kept bytes)}"""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[i:i + width] for _, b in data for i in range(len(b) - width + 1))
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k:k + width]] > 1:
                gone[k:k + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept)
    return out
