"""A small causal self-attention language model over subword ids in numpy: one layer, two-level softmax, manual gradients.

An id belongs to a cluster; its probability is that of its cluster times that of the id within it. In either half of the
vocabulary (ids that continue a word, ids that begin one or end the text) the ``HEAD`` most frequent ids share clusters
of ``M`` with weights of their own; the rest are one more cluster within which ids have their smoothed relative frequency.
Sequences are cut into windows of ``W`` positions that overlap by ``W - S``: a window's first ``W - S`` positions are
context alone (before a sequence's start: the start id), so each id is scored once, in batches of masked attention.

Parameters are one flat vector of fixed size, whatever the corpus, so tasks' results can be added and sent around.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

W, S = 32, 24
#: Width of states; ids of one cluster; frequent ids of either half; rows shared by the other ids.
D, M, HEAD, SHARED = 16, 24, 384, 128
#: Clusters of one half; the last holds its rare ids.
HALF_CLUSTERS = HEAD // M + 1
CLUSTERS, ROWS = 2 * HALF_CLUSTERS, 2 * HEAD + SHARED
#: Logits are held within this, so that exponentials need no row maximum, which numpy is slow to find in short rows.
LIMIT = np.float32(60)
_MASK = np.triu(np.full((W, W), -1e9, np.float32), 1)[W - S :]
SHAPES = {
    "E": (ROWS, D), "P": (W, D), "K": (D, D), "A": (D, D),
    "C": (D, CLUSTERS), "c": (CLUSTERS,), "O": (2 * HEAD // M, M, D), "o": (2 * HEAD // M, M),
}
SIZE = sum(math.prod(s) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters as named views into the flat vector."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = math.prod(shape)
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


@dataclass
class Net:
    """Parameters, and what the ids' counts fix: rows, clusters and the log probabilities of rare ids within theirs."""

    flat: np.ndarray
    row: np.ndarray  # of the embedding, by id
    cluster: np.ndarray  # by id
    member: np.ndarray  # place within a cluster of frequent ids
    block: np.ndarray  # which of the weighted clusters; -1: a rare id
    rare: np.ndarray  # log probability within the cluster of rare ids, else 0
    start: int  # the id before a sequence
    p: dict[str, np.ndarray] = field(init=False)

    def __post_init__(self):
        self.p = views(self.flat)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "p"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.p = views(self.flat)

    def having(self, flat: np.ndarray) -> Net:
        return Net(flat, self.row, self.cluster, self.member, self.block, self.rare, self.start)


def fresh(counts: np.ndarray, start: int, seed: int = 11) -> Net:
    """An untrained model whose biases are the log frequencies of ids; the second half of ids are those that begin a word."""
    v = len(counts)
    half, n = v // 2, counts + 0.5
    row, cluster, member, block = (np.zeros(v, np.int64) for _ in range(4))
    rare, block[:] = np.zeros(v, np.float32), -1
    rng = np.random.default_rng(seed)
    flat = np.zeros(SIZE, np.float32)
    p = views(flat)
    for name, scale in (("E", 0.3), ("P", 0.1), ("K", D**-0.5), ("A", 0.5 * D**-0.5), ("C", 0.5 * D**-0.5), ("O", 0.5 * D**-0.5)):
        p[name][:] = rng.standard_normal(p[name].shape) * scale
    p["o"][:] = -20.0  # places of clusters that no id takes
    for side, low in ((0, half), (1, 0)):  # ids that begin a word come first in the clusters
        order = low + np.argsort(-counts[low : low + half], kind="stable")
        head, rest = order[:HEAD], order[HEAD:]
        rank = np.arange(len(head))
        row[head], block[head], member[head] = side * HEAD + rank, side * (HEAD // M) + rank // M, rank % M
        cluster[head] = side * HALF_CLUSTERS + rank // M
        row[rest], cluster[rest] = 2 * HEAD + rest % SHARED, side * HALF_CLUSTERS + HALF_CLUSTERS - 1
        if len(rest):
            rare[rest] = np.log(n[rest] / n[rest].sum())
    by = np.bincount(cluster, n, CLUSTERS)
    p["c"][:] = np.where(by > 0, np.log(np.maximum(by, 0.5) / by.sum()), -40.0)  # the last: clusters without ids
    head = np.flatnonzero(block >= 0)
    p["o"][block[head], member[head]] = np.log(n[head] / by[cluster[head]])
    return Net(flat, row, cluster, member, block, rare, start)


class Windows:
    """The windows over sequences ``ids[first[d]:first[d+1]]``, cut out a batch at a time."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, start: int):
        size = np.diff(first)
        many = -(-size // S)
        doc = np.repeat(np.arange(len(size)), many)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        self.low, self.high = first[doc], first[doc + 1]
        self.at = self.low + number * S - (W - S)
        self.ids = ids
        self.before = np.concatenate([[start], ids]).astype(np.int64)  # the id before each place; at the end one for places outside
        self.before[first[:-1]] = start
        self.before[-1] = start

    def __len__(self) -> int:
        return len(self.at)

    def batch(self, which) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input ids, the places of the last ``S`` positions, and which of these are scored."""
        places = self.at[which][:, None] + np.arange(W)
        inside = places < self.high[which][:, None]
        inputs = self.before.take(np.where(inside & (places >= self.low[which][:, None]), places, -1))
        return inputs, places[:, W - S :], inside[:, W - S :]


def bounded(logits: np.ndarray) -> np.ndarray:
    """Logits within the limits, in place."""
    if not logits.size or (logits.max() < LIMIT and logits.min() > -LIMIT):
        return logits
    return np.clip(logits, -LIMIT, LIMIT, out=logits)


def hidden(net: Net, inputs: np.ndarray, keep: bool = False):
    """States before the softmax of the last ``S`` positions of windows of input ids, a row each."""
    p, rows = net.p, net.row.take(inputs)
    x = p["E"].take(rows, axis=0)
    x += p["P"]
    last = x[:, W - S :].reshape(-1, D)
    q = (last @ (p["K"] * np.asarray(D**-0.5, x.dtype)).T).reshape(-1, S, D)  # K on the side of the fewer rows
    s = bounded(q @ x.transpose(0, 2, 1))
    s += _MASK
    np.exp(s, out=s)
    total = (s.reshape(-1, W) @ np.ones(W, s.dtype))[:, None]
    u = (s @ x).reshape(-1, D)
    u /= total
    z = u @ p["A"]
    z += last
    return (z, (rows, x, last, q, s, total, u)) if keep else z


def by_cluster(net: Net, z: np.ndarray, targets: np.ndarray, used: np.ndarray | None = None):
    """The order of states by their target's weighted cluster, those of rare ids and those not used last; where each cluster
    begins in it and the last one ends; the states in that order, with a column of ones for the biases."""
    block = net.block.take(targets)
    kind = np.where(block >= 0 if used is None else (block >= 0) & used, block, 2 * HEAD // M).astype(np.int16)
    order = np.argsort(kind, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=2 * HEAD // M)[: 2 * HEAD // M])])
    states = np.ones((len(z), D + 1), z.dtype)
    states[:, :D] = z.take(order, axis=0)
    return order, bounds, states


def cluster_exponentials(net: Net, states: np.ndarray) -> np.ndarray:
    """Exponentials of the clusters' logits."""
    e = states @ np.concatenate([net.p["C"], net.p["c"][None]])
    return np.exp(bounded(e), out=e)


def member_exponentials(net: Net, states: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Exponentials of the logits within clusters, of the states that are ordered by weighted cluster."""
    weights = np.concatenate([net.p["O"], net.p["o"][..., None]], axis=2).transpose(0, 2, 1)
    g = np.empty((bounds[-1], M), states.dtype)
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if a < b:
            np.matmul(states[a:b], weights[k], out=g[a:b])
    return np.exp(bounded(g), out=g)


def log_probabilities(net: Net, z: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probabilities of target ids given states, a row each, and of any id that begins a word."""
    order, bounds, states = by_cluster(net, z, targets)
    ts, some = targets.take(order), bounds[-1]
    e = cluster_exponentials(net, states)
    total = np.log(e @ np.ones(CLUSTERS, e.dtype))
    first = np.log(e[:, :HALF_CLUSTERS] @ np.ones(HALF_CLUSTERS, e.dtype)) - total
    own = np.log(e.ravel().take(np.arange(len(z)) * CLUSTERS + net.cluster.take(ts))) - total
    own += net.rare.take(ts)
    g = member_exponentials(net, states, bounds)
    own[:some] += np.log(g.ravel().take(np.arange(some) * M + net.member.take(ts[:some])) / (g @ np.ones(M, g.dtype)))
    out, begins = np.empty_like(own), np.empty_like(first)
    out[order], begins[order] = own, first
    return out, begins


def score(net: Net, ids: np.ndarray, first: np.ndarray, at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of every id given those before it in its sequence, and of any word's beginning at its place."""
    out, begins = np.zeros(len(ids), np.float32), np.zeros(len(ids), np.float32)
    all_of = Windows(ids, first, net.start)
    for k in range(0, len(all_of), at_once):
        inputs, places, use = all_of.batch(slice(k, k + at_once))
        z = np.concatenate([hidden(net, inputs[j : j + 128]) for j in range(0, len(inputs), 128)])  # the arrays of attention stay in the cache
        spots = np.flatnonzero(use.ravel())
        to = places.ravel()[spots]
        out[to], begins[to] = log_probabilities(net, z.take(spots, axis=0), ids.take(to))
    return out, begins


def gradients(net: Net, inputs: np.ndarray, targets: np.ndarray, use: np.ndarray, losses: bool = True) -> tuple[float, np.ndarray]:
    """Mean loss over the used positions of some windows (0 where it is not asked for), and its gradient as a flat vector."""
    p = net.p
    z, (rows, x, last, q, s, total, u) = hidden(net, inputs, keep=True)
    flat = np.zeros_like(net.flat)
    g = views(flat)
    used, ts = use.ravel(), targets.ravel()
    n = np.count_nonzero(used)
    order, bounds, states = by_cluster(net, z, ts, used)
    ts, some = ts.take(order), bounds[-1]
    share = used.take(order).astype(z.dtype) / np.asarray(n, z.dtype)  # of a position in the mean
    e = cluster_exponentials(net, states)
    total_e = e @ np.ones(CLUSTERS, e.dtype)
    pick = np.arange(len(z)) * CLUSTERS + net.cluster.take(ts)
    loss = 0.0
    if losses:
        lost = np.log(e.ravel().take(pick) / total_e + 1e-30)
        lost += net.rare.take(ts)
        loss -= lost.sum(where=share > 0, dtype=np.float64)
    e *= (share / total_e)[:, None]
    e.reshape(-1)[pick] -= share
    of = states.T @ e
    g["C"][:], g["c"][:] = of[:D], of[D]
    back = e @ p["C"].T
    m = member_exponentials(net, states, bounds)
    total_m = m @ np.ones(M, m.dtype)
    pick = np.arange(some) * M + net.member.take(ts[:some])
    if losses:
        loss -= np.log(m.ravel().take(pick) / total_m + 1e-30).sum(dtype=np.float64)
    m *= (share[:some] / total_m)[:, None]
    m.reshape(-1)[pick] -= share[:some]
    of = np.zeros((2 * HEAD // M, M, D + 1), m.dtype)
    within = np.empty((some, D), m.dtype)
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if a < b:
            np.matmul(m[a:b].T, states[a:b], out=of[k])
            np.matmul(m[a:b], p["O"][k], out=within[a:b])
    g["O"][:], g["o"][:] = of[..., :D], of[..., D]
    back[:some] += within
    at = np.empty(len(z), np.int64)
    at[order] = np.arange(len(z))
    dz = back.take(at, axis=0)
    g["A"][:] = u.T @ dz
    du = dz @ p["A"].T
    du /= total
    # with weights w = s / total: ds = w (dw - sum(w dw)), and the sum is that of u du over the columns
    inner = np.einsum("ij,ij->i", u, du)
    du = du.reshape(q.shape)
    ds = du @ x.transpose(0, 2, 1)
    ds -= inner.reshape(*ds.shape[:2], 1)
    ds *= s
    dx = s.transpose(0, 2, 1) @ du
    dx += ds.transpose(0, 2, 1) @ q
    met = (ds @ x).reshape(-1, D)
    scale = np.asarray(D**-0.5, ds.dtype)
    g["K"][:] = (met.T @ last) * scale
    dz += met @ (p["K"] * scale)
    dx[:, W - S :] += dz.reshape(q.shape)
    g["P"][:] = dx.sum(axis=0)
    at = rows.ravel()
    order = np.argsort(at.astype(np.int16), kind="stable")
    at = at[order]
    heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    g["E"][at[heads]] = np.add.reduceat(dx.reshape(-1, D).take(order, axis=0), heads, axis=0)
    return float(loss) / n, flat


def fit(net: Net, parts: Iterable[tuple[np.ndarray, np.ndarray]], most: int = 256, steps: int = 100, rate: float = 0.01, seed: int = 5) -> tuple[Net, int]:
    """One pass of Adam over the windows of all ``(ids, first)`` parts, each part's in a random order; the new model and the number of windows.

    Batches have ``most`` windows, or fewer where a part would else give less than about ``steps`` of them.
    """
    new = net.having(net.flat.copy())
    m, v, t, seen = np.zeros_like(new.flat), np.zeros_like(new.flat), 0, 0
    rng = np.random.default_rng(seed)
    for ids, first in parts:
        own = Windows(ids, first, net.start)
        order = rng.permutation(len(own))
        size = int(min(most, max(16, len(order) // steps)))
        seen += len(order)
        for k in range(0, len(order), size):
            t += 1
            inputs, places, use = own.batch(order[k : k + size])
            _, g = gradients(new, inputs, ids.take(np.where(use, places, 0)), use, losses=False)
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * np.square(g, out=g)
            step = np.sqrt(v, out=g)
            step *= (1 - 0.99**t) ** -0.5
            step += 1e-6
            new.flat -= np.divide(m, step, out=step) * (rate / (1 - 0.9**t))
    return new, seen
