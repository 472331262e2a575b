"""Plain Python versions of what the operators compute."""

import hashlib
import math
from collections import Counter, defaultdict

SPACE = b" \t\n\x0b\x0c\r"


class Sets:
    """Union-find with the smallest member as root."""

    def __init__(self):
        self.parent = {}

    def root(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.parent[b] = a


def base_facts(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip(SPACE)]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if seen[tuple(words[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    n = len(words)
    return n, sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n


def word_set(text, width):
    w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()


def similar(a, b, percent):
    same = len(a & b)
    return bool(a) and bool(b) and 100 * same >= percent * (len(a) + len(b) - same)


def near(rows, width, percent):
    """doc_id -> (set size, component) by all pairs."""
    sets, found = {i: word_set(t, width) for i, t in rows}, Sets()
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if similar(sets[i], sets[j], percent):
                found.join(i, j)
    return {i: (len(sets[i]), found.root(i)) for i in ids}


def removed_lines(rows, width=8, percent=80):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    places, norm = [], {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate((t or "").split("\n")):
            if line.encode().strip(SPACE):
                x = "".join(" " if c in "\t\x0b\x0c\r" else c for c in line.encode().translate(low).decode())
                places.append((i, k, x.rstrip(" ")))
                norm.setdefault(x.rstrip(" "), x)
    sets = {k: frozenset(x[j : j + width] for j in range(len(x) - width + 1)) if len(x) >= width else frozenset([("whole", k)]) for k, x in norm.items()}
    found, keys = Sets(), sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if similar(sets[a], sets[b], percent):
                found.join(a, b)
    first, gone = {}, defaultdict(set)
    for i, k, x in places:
        if first.setdefault(found.root(x), (i, k)) != (i, k):
            gone[i].add(k)
    return gone


def repeated_bytes(rows, length):
    """doc_id -> (bytes, removed, spans, digest of the rest)."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        cut = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                cut[p : p + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k in range(len(cut)) if cut[k] and (k == 0 or not cut[k - 1]))
        out[i] = (len(b), sum(cut), spans, hashlib.sha256(bytes(x for x, c in zip(b, cut, strict=True) if not c)).hexdigest())
    return out


def ppm_bits(text, counts, order):
    """Code length of a text under one language's context counts {context: {byte: n}}."""
    data, total = text.encode(), 0.0
    for i, c in enumerate(data):
        for k in range(min(order, i), -1, -1):
            own = counts.get(data[i - k : i])
            if own and c in own:
                total += math.log2((sum(own.values()) + len(own)) / own[c])
                break
            if own:
                total += math.log2((sum(own.values()) + len(own)) / len(own))
        else:
            total += 8
    return total
