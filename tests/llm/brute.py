"""Plain Python versions of the contracts, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    raw = (text or "").encode()
    if lower:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    return WORD.findall(raw)


def shingles(text, k=5):
    w = words(text, True)
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def near(docs, k=5, percent=75):
    """{doc_id: (n_shingles, component_id, kept)}"""
    sets = {d: shingles(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    classes = defaultdict(list)
    for d, s in sets.items():
        if s:
            classes[frozenset(s)].append(d)
    for same in classes.values():
        for d in same[1:]:
            join(same[0], d)
    index = defaultdict(list)
    for s, (d, *_) in classes.items():
        shared = Counter()
        for x in s:
            shared.update(index[x])
            index[x].append(d)
        for e, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                join(d, e)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def repeats(docs, n=20):
    """{doc_id: (n_words, n_removed, kept_sha256)}"""
    seen, out = set(), {}
    for d, t in sorted(docs):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if key in seen:
                gone[i : i + n] = [True] * n
            seen.add(key)
        kept = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def attention(p, ids, block):
    """Log probability of every id of one run, position by position, over the full softmax."""
    n = len(p["embed"]) - 1
    inputs, out = [n, *ids[:-1]], []
    for t, target in enumerate(ids):
        lo = max(0, t // block * block - block)
        x = p["embed"][inputs[t]]
        scores = [(x @ p["q"]) @ (p["embed"][inputs[j]] @ p["k"]) / math.sqrt(len(x)) + p["near"][t - j] for j in range(lo, t + 1)]
        top = max(scores)
        shares = [math.exp(s - top) for s in scores]
        a = sum(w * (p["embed"][inputs[j]] @ p["v"]) for w, j in zip(shares, range(lo, t + 1))) / sum(shares)
        h = x + a @ p["o"]
        g = h + (h @ p["up"]).clip(0) @ p["down"]
        group = g @ p["group"] + p["group_prior"][inputs[t]]
        probability = {}
        z = sum(math.exp(v) for v in group)
        for c in range(len(group)):
            member = g @ p["member"][c] + p["member_prior"][inputs[t]][c]
            y = sum(math.exp(v) for v in member)
            for k in range(len(member)):
                probability[c * len(member) + k] = math.exp(group[c]) / z * math.exp(member[k]) / y
        assert abs(sum(probability.values()) - 1) < 1e-9
        out.append(math.log(probability[target]))
    return out
