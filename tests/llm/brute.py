"""Plain Python forms of the operators, for small inputs."""

from __future__ import annotations

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def measures(text):
    found, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    covered = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def line_dedup(rows, min_docs):
    key = lambda line: line.strip("\t\n\x0b\x0c\r ").translate(UPPER)
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(doc)
    gone = {k for k, docs in held.items() if k and len(docs) >= min_docs}
    return [(doc, "\n".join(x for x in (text or "").split("\n") if key(x) not in gone)) for doc, text in rows]


def shingle_set(text, width):
    found = words((text or "").translate(UPPER))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1)))


def similar(a, b, percent):
    return bool(a) and 100 * len(a & b) >= percent * len(a | b)


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def shingle_classes(rows, width, percent):
    """Per id: set size of its texts and component."""
    sets = [(doc, shingle_set(text, width)) for doc, text in rows if doc is not None]
    links = [(a, b) for (a, x), (b, y) in combinations(sets, 2) if a != b and similar(x, y, percent)]
    return components({doc for doc, _ in sets}, links)


def repeats(rows, length):
    """Per document in order: spans of bytes covered by strings that start earlier."""
    seen, out = set(), []
    for _, text in rows:
        data, spans = (text or "").encode(), []
        for at in range(len(data) - length + 1):
            if data[at : at + length] in seen:
                if spans and at <= spans[-1][1]:
                    spans[-1][1] = at + length
                else:
                    spans.append([at, at + length])
            seen.add(data[at : at + length])
        out.append(spans)
    return out
