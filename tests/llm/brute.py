"""Plain Python versions of the operators, row by row, to hold the Spark results against."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    only = lambda m: re.sub("[^0-9]", "", m[0])
    found = {
        "email": list(EMAIL.finditer(text)),
        "ip": [m for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m for m in CARD.finditer(text) if 16 <= len(only(m)) <= 19 and luhn(only(m))],
        "phone": [m for m in PHONE.finditer(text) if 8 <= len(only(m)) <= 15],
    }
    return {k: [(m.start(), m.end()) for m in v] for k, v in found.items()}


def base_sha256(text):
    line = ",".join(f"{k}:{a}:{b}" for k, v in base_spans(text).items() for a, b in v)
    return hashlib.sha256(line.encode()).hexdigest()


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    ws = words(text)
    windows = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(ws), sum(map(len, ws)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(marked),
            len(ws) < 10 or 100 * len(marked) > 20 * len(ws))


def shingles(text, n):
    ws = words(lower(text))
    if not ws:
        return set()
    return {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} or {tuple(ws)}


def components(docs, n, percent):
    """{position: smallest id reachable}; docs: (id, text) pairs."""
    sets = [shingles(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, j in {p for v in by.values() for p in combinations(v, 2)}:
        common = len(sets[i] & sets[j])
        if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            parent[find(i)] = find(j)
    least: dict = {}
    for i, (key, _) in enumerate(docs):
        r = find(i)
        least[r] = min(least.get(r, key), key)
    return [least[find(i)] for i in range(len(docs))], [len(s) for s in sets]


def targets(sizes, weights=(5, 2, 1), epochs=3):
    """{source: target} by repeated resharing."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > epochs * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: epochs * sizes[s] for s in above}
