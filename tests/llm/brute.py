"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
from collections import Counter, defaultdict

WHITE = b" \t\n\r\x0b\x0c"


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def lower(text):
    return (text or "").encode().lower().decode()


def shingles(text, k=5):
    w = words(lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def classes(docs, percent=75):
    """docs: (id, text).  (id, set size, class) of each."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(docs)):
        least[find(i)].append(docs[i][0])
    return [(docs[i][0], len(sets[i]), min(least[find(i)])) for i in range(len(docs))]


def without_repeats(docs, size=35):
    split = [words(t) for _, t in docs]
    count = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for (doc_id, _), w in zip(docs, split):
        gone = {j for i in range(len(w) - size + 1) if count[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((doc_id, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def mix_targets(sizes, weights=(3, 1, 2), ratio=1.5, cap=2.0):
    """sizes: source -> words.  Reshares by weight until no source is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, ratio * sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total >= cap * sizes[s] - 1e-9]
        if not full:
            target.update({s: left * weight[s] / total for s in open_})
            break
        for s in full:
            target[s] = cap * sizes[s]
            open_.discard(s)
        left -= sum(target[s] for s in full)
    return target
