"""A small causal self-attention model over subword ids, trained and run in numpy.

Texts are laid out in blocks of ``BLOCK`` positions. A block attends to itself and to the
block before it, under a causal mask: overlapping windows of two blocks in which every
position is scored once, with at least ``BLOCK`` positions of context where the text has
them. The softmax has two levels: the group an id belongs to (``MEMBERS`` consecutive ids),
then the id within it, so that a position costs as many logits as there are groups and
members, not ids. Logits of both levels start from bigram probabilities counted over the
corpus; attention and a feed-forward layer add what the longer context tells.
"""

from __future__ import annotations

import numpy as np

BLOCK, WIDTH, HIDDEN, MEMBERS = 16, 16, 16, 16
#: The score of masked keys.
MASKED = np.float32(-1e9)
_DISTANCE = BLOCK + np.arange(BLOCK)[:, None] - np.arange(2 * BLOCK)[None]
_CAUSAL = np.where(_DISTANCE >= 0, np.float32(0), MASKED).astype(np.float32)
_DISTANCE = np.clip(_DISTANCE, 0, 2 * BLOCK - 1)
#: Counted, not trained.
FIXED = ("group_prior", "member_prior")


def initial(counts: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters for ids 0 .. n-1 and the start mark n, from bigram counts (n + 1, n).

    A pair's probability is smoothed towards the id's own: four counts are dealt that way.
    n is a multiple of ``MEMBERS``.
    """
    n = counts.shape[1]
    groups = n // MEMBERS
    single = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * n)
    pairs = (counts + 4 * single).reshape(n + 1, groups, MEMBERS)
    held = pairs.sum(axis=2)
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    return {
        "embed": (rng.standard_normal((n + 1, WIDTH)) * 0.5).astype(np.float32),
        "q": draw(WIDTH, WIDTH), "k": draw(WIDTH, WIDTH), "v": draw(WIDTH, WIDTH), "o": draw(WIDTH, WIDTH),
        "near": np.zeros(2 * BLOCK, np.float32),
        "up": draw(WIDTH, HIDDEN), "down": draw(HIDDEN, WIDTH) * np.float32(0.5),
        "group": np.zeros((WIDTH, groups), np.float32), "member": np.zeros((groups, WIDTH, MEMBERS), np.float32),
        "group_prior": np.log(held / held.sum(axis=1, keepdims=True)).astype(np.float32),
        "member_prior": np.log(pairs / held[..., None]).astype(np.float32),
    }


def _softmax(logits: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of each row's target, probabilities); logits are overwritten."""
    logits -= logits.max(axis=1, keepdims=True)
    at = logits[np.arange(len(target)), target]
    np.exp(logits, out=logits)
    total = logits.sum(axis=1)
    logits /= total[:, None]
    return at - np.log(total), logits


def forward(p: dict[str, np.ndarray], inputs: np.ndarray, before: np.ndarray, first: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, dict]:
    """Log probability of each target (blocks, BLOCK), and what ``backward`` needs.

    ``before`` are the inputs of the preceding block, ignored where ``first``. Queries, keys
    and values depend on the id alone, so they are looked up in tables of all ids.
    """
    n, embed = len(inputs), p["embed"]
    keys = np.concatenate([before, inputs], axis=1)
    queried = embed @ (p["q"] / np.sqrt(WIDTH).astype(embed.dtype))
    looked = embed @ p["k"]
    q, k, v = queried.take(inputs, axis=0), looked.take(keys, axis=0), (embed @ p["v"]).take(keys, axis=0)
    s = q @ k.transpose(0, 2, 1)
    s += p["near"][_DISTANCE] + _CAUSAL
    s[first, :, :BLOCK] = MASKED
    # A bound of all scores tells whether the exponential could overflow.
    bound = np.sqrt((queried * queried).sum(axis=1).max() * (looked * looked).sum(axis=1).max()) + np.abs(p["near"]).max()
    if bound > 60:
        s -= s.max(axis=2, keepdims=True)
    np.exp(s, out=s)
    share = 1 / s.sum(axis=2, keepdims=True)
    a = s @ v
    a *= share
    a = a.reshape(-1, WIDTH)
    ids, target = inputs.reshape(-1), targets.reshape(-1)
    h = a @ p["o"]
    h += embed.take(ids, axis=0)
    u = h @ p["up"]
    np.maximum(u, 0, out=u)
    g = u @ p["down"]
    g += h
    group, member = np.divmod(target, MEMBERS)
    logits = g @ p["group"]
    logits += p["group_prior"].take(ids, axis=0)
    out, group_p = _softmax(logits, group)
    # Rows of one group stand together, so each group's weights meet them in one product.
    order = np.argsort(group.astype(np.int16), kind="stable")
    ends = np.searchsorted(group[order], np.arange(len(p["member"]) + 1))
    sorted_g, logits = g.take(order, axis=0), p["member_prior"].reshape(-1, MEMBERS).take((ids * len(p["member"]) + group)[order], axis=0)
    for c in np.flatnonzero(np.diff(ends)):
        part = slice(ends[c], ends[c + 1])
        logits[part] += sorted_g[part] @ p["member"][c]
    inner, member_p = _softmax(logits, member[order])
    out[order] += inner
    kept = {"keys": keys, "q": q, "k": k, "v": v, "s": s, "share": share, "a": a, "h": h, "u": u, "g": g, "group": group, "member": member, "order": order, "ends": ends, "sorted_g": sorted_g, "group_p": group_p, "member_p": member_p}
    return out.reshape(n, BLOCK), kept


def _by_id(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows summed by id."""
    order = np.argsort(ids.astype(np.int16), kind="stable")
    held, begin = np.unique(ids[order], return_index=True)
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[held] = np.add.reduceat(rows.take(order, axis=0), begin, axis=0)
    return out


def backward(p: dict[str, np.ndarray], inputs: np.ndarray, weight: np.ndarray, t: dict) -> dict[str, np.ndarray]:
    """Gradients of the weighted mean negative log probability of the targets."""
    n, embed = len(inputs), p["embed"]
    w = (weight.reshape(-1) / max(1.0, weight.sum())).astype(embed.dtype)[:, None]
    rows, order, ends = np.arange(len(w)), t["order"], t["ends"]
    dc = t["group_p"]
    dc[rows, t["group"]] -= 1
    dc *= w
    grad = {"group": t["g"].T @ dc, "member": np.zeros_like(p["member"])}
    dg = dc @ p["group"].T
    dm = t["member_p"]
    dm[rows, t["member"][order]] -= 1
    dm *= w[order]
    inner = np.empty_like(dg)
    for c in np.flatnonzero(np.diff(ends)):
        part = slice(ends[c], ends[c + 1])
        grad["member"][c] = t["sorted_g"][part].T @ dm[part]
        inner[part] = dm[part] @ p["member"][c].T
    dg[order] += inner
    grad["down"] = t["u"].T @ dg
    du = (dg @ p["down"].T) * (t["u"] > 0)
    grad["up"] = t["h"].T @ du
    dh = dg + du @ p["up"].T
    grad["o"] = t["a"].T @ dh
    da = dh @ p["o"].T
    mean = (da * t["a"]).sum(axis=1).reshape(n, BLOCK, 1)
    da = da.reshape(n, BLOCK, WIDTH)
    ds = da @ t["v"].transpose(0, 2, 1)
    ds -= mean
    weights = t["s"] * t["share"]
    ds *= weights
    grad["near"] = np.bincount(_DISTANCE.ravel(), weights=ds.sum(axis=0).ravel(), minlength=2 * BLOCK).astype(embed.dtype)
    dv, dk, dq = weights.transpose(0, 2, 1) @ da, ds.transpose(0, 2, 1) @ t["q"], ds @ t["k"]
    own = _by_id(inputs.reshape(-1), np.concatenate([dh, dq.reshape(-1, WIDTH)], axis=1), len(embed))
    met = _by_id(t["keys"].reshape(-1), np.concatenate([dk, dv], axis=2).reshape(-1, 2 * WIDTH), len(embed))
    root = np.sqrt(WIDTH).astype(embed.dtype)
    dq, dk, dv = own[:, WIDTH:] / root, met[:, :WIDTH], met[:, WIDTH:]
    grad["q"], grad["k"], grad["v"] = embed.T @ dq, embed.T @ dk, embed.T @ dv
    grad["embed"] = own[:, :WIDTH] + dq @ p["q"].T + dk @ p["k"].T + dv @ p["v"].T
    return grad


def train(p: dict[str, np.ndarray], inputs: np.ndarray, before: np.ndarray, first: np.ndarray, targets: np.ndarray, weight: np.ndarray, *, batch: int = 256, rate: float = 6e-3, seed: int = 11) -> dict[str, np.ndarray]:
    """Adam once over the given blocks in a random order; the priors stay as counted."""
    order = np.random.default_rng(seed).permutation(len(inputs))
    p = {k: v.copy() for k, v in p.items()}
    m = {k: np.zeros_like(v) for k, v in p.items() if k not in FIXED}
    r = {k: np.zeros_like(v) for k, v in m.items()}
    for step, lo in enumerate(range(0, len(order), batch), 1):
        rows = order[lo : lo + batch]
        _, kept = forward(p, inputs[rows], before[rows], first[rows], targets[rows])
        grads = backward(p, inputs[rows], weight[rows], kept)
        pace = rate * min(1.0, step / 10)
        for k, g in grads.items():
            m[k] += 0.1 * (g - m[k])
            r[k] += 0.01 * (g * g - r[k])
            p[k] -= (pace / (1 - 0.9**step) * m[k] / (np.sqrt(r[k] / (1 - 0.99**step)) + 1e-8)).astype(g.dtype)
    return p


def layout(ids: np.ndarray, at: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, before, first, targets, real) blocks of runs of ids; each run begins anew.

    Inputs are the ids one place later, behind a start mark; places after a run's end hold
    id 0 and are not real.
    """
    size = np.diff(at)
    blocks = -(-size // BLOCK)
    begin = (np.cumsum(blocks) - blocks) * BLOCK
    total = int(blocks.sum())
    place = np.repeat(begin - at[:-1], size) + np.arange(at[0], at[-1])
    targets, inputs, real = np.zeros(total * BLOCK, np.int64), np.zeros(total * BLOCK, np.int64), np.zeros(total * BLOCK, bool)
    targets[place], real[place] = ids, True
    inputs[1:] = targets[:-1]
    inputs[begin[size > 0]] = start
    first = np.zeros(total, bool)
    first[begin[size > 0] // BLOCK] = True
    inputs, targets = inputs.reshape(-1, BLOCK), targets.reshape(-1, BLOCK)
    before = np.concatenate([inputs[:1], inputs[:-1]]) if total else inputs
    return inputs, before, first, targets, real.reshape(-1, BLOCK)


def log_probabilities(p: dict[str, np.ndarray], ids: np.ndarray, at: np.ndarray, step: int = 256) -> np.ndarray:
    """Natural log probability of every id, given what stands before it in its run."""
    inputs, before, first, targets, real = layout(ids, at, len(p["embed"]) - 1)
    out = np.zeros(targets.shape, np.float32)
    for lo in range(0, len(inputs), step):
        part = slice(lo, lo + step)
        out[part] = forward(p, inputs[part], before[part], first[part], targets[part])[0]
    return out[real]
