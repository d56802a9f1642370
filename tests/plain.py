"""The search rules as plain loops over small lists, to check the Spark plans against."""

import re

from docsift.functions.text import ROLE_ADJUST

EDGE = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def pieces(name):
    words = re.split(r"[_:-]+", name)
    return [p.lower() for w in words for p in EDGE.split(w) if p]


def common(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(rows[-1][j] + 1 if x == y else max(rows[-1][j + 1], row[-1]))
        rows.append(row)
    return rows[-1][-1]


def similarity(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    best = 0.0
    for s, l in ([(a, b)] if len(a) < len(b) else [(b, a)] if len(b) < len(a) else [(a, b), (b, a)]):
        for start in range(1 - len(s), len(l)):
            window = l[max(start, 0) : start + len(s)]
            best = max(best, 200.0 * common(s, window) / (len(s) + len(window)))
    return best


def term_score(term, name):
    q, whole = term.lower(), name.lower()
    bare = name.partition("(")[0].strip()
    if q in (whole, bare.lower()):
        return 100.0
    parts = pieces(bare)
    if q in parts:
        return 97.0
    if any(p.startswith(q) for p in parts):
        return 94.0
    return 88.0 if q in whole else min(82.0, similarity(q, whole))


def fuzzy_rows(symbols, groups, threshold):
    """Ranked (symbol, score, label) of one source."""
    first_seen, best = {}, {}
    for pos, symbol in enumerate(symbols):
        options = []
        for g, group in enumerate(groups):
            scores = [term_score(t, symbol["group"]) for t in group]
            if min(scores) >= threshold:
                moved = min(scores) + ROLE_ADJUST.get(symbol["role"] or "", 0)
                options.append((-min(max(moved, 0.0), 100.0), g))
        if options:
            key = symbol["url"] if symbol["url"] is not None else ("row", pos)
            first_seen.setdefault(key, pos)
            score, g = min(options)
            if key not in best or score < best[key][0]:
                best[key] = (score, symbol, ",".join(groups[g]))
    ranked = sorted(best, key=lambda k: (best[k][0], first_seen[k]))
    return [(best[k][1], -best[k][0], best[k][2]) for k in ranked]


def boolean_rows(symbols, groups):
    out, taken = [], set()
    for group in groups:
        for pos, symbol in enumerate(symbols):
            key = symbol["url"] if symbol["url"] is not None else ("row", pos)
            if key not in taken and all(t.lower() in symbol["group"].lower() for t in group):
                taken.add(key)
                out.append(symbol)
    return out
