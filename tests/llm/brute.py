"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_classes(rows, percent, gram):
    """{row number: (set size, least linked doc_id)} by comparing all pairs that share a shingle."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[k : k + gram]) for k in range(len(w) - gram + 1)} if len(w) >= gram else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(len(sets[i]), least.get(top(i))) for i in range(len(rows))]


def without_repeats(texts, units, join, window):
    """(units, removed, spans, sha256 of what is kept) of each text."""
    cut = [units(t or "") for t in texts]
    seen = Counter(tuple(u[i : i + window]) for u in cut for i in range(len(u) - window + 1))
    out = []
    for u in cut:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(u), sum(gone), spans, hashlib.sha256(join([x for x, g in zip(u, gone) if not g])).hexdigest()))
    return out


def words(t):
    return WORD.findall(t)
