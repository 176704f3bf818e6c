"""Plain Python versions that the operators are held against."""

import re

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k):
    found = words((text or "").translate(LOWER))
    return {tuple(found[i : i + k]) for i in range(max(1, len(found) - k + 1))} if found else set()


def linked(texts, k, percent):
    """id -> smallest id that links reach, by comparing all pairs. texts: id -> text."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return {i: root(i) for i in texts}


def base_spans(text):
    """(kind, start, end) of the plain secret patterns, in code points, straight from their definition."""
    patterns = [
        ("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        ("access", r"AKIA[A-Z0-9]+"),
        ("hex", r"[0-9a-f]+"),
    ]
    found = []
    for order, (kind, pattern) in enumerate(patterns):
        pattern = pattern.replace("(?ai:", "(?i:")
        for m in re.finditer(pattern, text or "", re.ASCII):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def water_fill(sizes, weights, most):
    """Targets by sharing all sizes and resharing what is above a limit, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    rest, open_ = float(sum(sizes.values())), list(names)
    while rest > 1e-9 and open_:
        total, share = sum(weight[s] for s in open_), rest
        rest = 0.0
        for s in open_:
            target[s] += share * weight[s] / total
            if target[s] > most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
        open_ = [s for s in open_ if target[s] < most * sizes[s]]
    return target
