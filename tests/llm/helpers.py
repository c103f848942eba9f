"""Plain restatements of what the operators must return, for small tables."""

import re
from collections import Counter

import numpy as np


def component_names(nodes, links):
    """The smallest node reachable from each."""
    name = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(name[a], name[b])
            if name[a] != low or name[b] != low:
                name[a] = name[b] = low
                changed = True
    return name


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def near_copies(rows, percent):
    sets = {d: shingles(t) for d, t in rows}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    name = component_names(sets, links)
    return {d: (len(sets[d]), name[d], name[d] == d) for d in sets}


def repeats(rows, length):
    """Of each row's bytes, which are covered by a string of ``length`` bytes that starts elsewhere too."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~covered])
        spans = int((covered & ~np.concatenate(([False], covered[:-1]))).sum()) if len(b) else 0
        out.append((d, len(b), int(covered.sum()), spans, kept))
    return out


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v // 10 + v % 10 for v in values) % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    found = [(m.start(), k, kind, m.end()) for k, (kind, rule, ok) in enumerate(rules) for m in re.finditer(rule, text) if ok(m[0])]
    return [(start, end, kind) for start, _, kind, end in sorted(found)]
