"""Plain restatements of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(rows, min_chars=40, min_docs=5):
    """rows: (id, text); every row is a document. Returns (id, n_lines, n_dropped, text) sorted."""
    key = lambda line: line.strip(BLANK).translate(LOWER)
    order = lambda i: -(2**63) if i is None else i
    holders = defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(order(i))
    gone = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), order(i)) == order(i)]
        out.append((order(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def near_copies(rows, size, percent=80):
    """id to (number of shingles, component), comparing all pairs."""
    sets = {i: shingles(t, size) for i, t in rows}
    ids = sorted(sets)
    component = {i: i for i in ids}

    def top(i):
        while component[i] != i:
            i = component[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = sorted((top(a), top(b)))
                component[v] = u
    return {i: (len(sets[i]), top(i)) for i in ids}


def substring_dedup(rows, window):
    """Per row (id, n_words, n_removed, kept text), sorted."""
    words = [WORD.findall(t or "") for _, t in rows]
    places = defaultdict(list)
    for r, w in enumerate(words):
        for k in range(len(w) - window + 1):
            places[tuple(w[k : k + window])].append((r, k))
    covered = [set() for _ in rows]
    for found in places.values():
        if len(found) > 1:
            for r, k in found:
                covered[r].update(range(k, k + window))
    return sorted(
        ((i, len(w), len(c), " ".join(x for k, x in enumerate(w) if k not in c)) for (i, _), w, c in zip(rows, words, covered, strict=True)), key=str
    )


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    count = Counter(grams)
    repeated = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)
