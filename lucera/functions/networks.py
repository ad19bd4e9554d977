"""Graph metrics of small networks (the channels of a montage) and their null models, in numpy."""

from __future__ import annotations

import numpy as np


def hops(adj: np.ndarray) -> np.ndarray:
    """All shortest path lengths of an unweighted graph; inf where there is none."""
    n = len(adj)
    dist = np.where(np.eye(n, dtype=bool), 0.0, np.inf)
    seen, front, k = np.eye(n, dtype=bool), np.eye(n, dtype=bool), 0
    while front.any():
        k += 1
        front = ((front.astype(np.int64) @ adj.astype(np.int64)) > 0) & ~seen
        dist[front] = k
        seen |= front
    return dist


def path_length(adj: np.ndarray) -> float:
    """Mean shortest path; NaN where the graph is not connected."""
    d = hops(adj)[~np.eye(len(adj), dtype=bool)]
    return float(d.mean()) if len(d) and np.isfinite(d).all() else float("nan")


def _efficiency(adj: np.ndarray) -> float:
    if len(adj) < 2:
        return 0.0
    d = hops(adj)[~np.eye(len(adj), dtype=bool)]
    return float((1 / d).mean())


def global_efficiency(adj: np.ndarray) -> float:
    return _efficiency(adj)


def nodal_efficiency(adj: np.ndarray) -> np.ndarray:
    """Mean inverse distance of each node to the others."""
    d = hops(adj)
    np.fill_diagonal(d, np.inf)
    return (1 / d).sum(1) / max(1, len(adj) - 1)


def clustering(adj: np.ndarray) -> np.ndarray:
    a = adj.astype(float)
    k = a.sum(1)
    pairs = k * (k - 1)
    return np.divide(((a @ a) * a).sum(1), pairs, out=np.zeros(len(a)), where=pairs > 0)


def betweenness(adj: np.ndarray) -> np.ndarray:
    """Share of shortest paths through each node, over the pairs of other nodes."""
    n = len(adj)
    d = hops(adj)
    a, paths = adj.astype(float), np.eye(n)
    for k in range(1, int(d[np.isfinite(d)].max()) + 1):
        paths = np.where(d == k, np.where(d == k - 1, paths, 0.0) @ a, paths)
    out = np.zeros(n)
    for v in range(n):
        on = (d[:, [v]] + d[[v], :] == d) & np.isfinite(d) & ~np.eye(n, dtype=bool)
        on[v], on[:, v] = False, False
        share = np.divide(paths[:, [v]] * paths[[v], :], paths, out=np.zeros((n, n)), where=on)
        out[v] = share[on].sum() / 2
    return out / max(1.0, (n - 1) * (n - 2) / 2)


def _draws(rng: np.random.Generator, n: int, steps: int):
    """So many times rng.integers(n, size=2) and rng.random() < 0.5, from the generator's words at once: two
    halves of one make the integers, the top bit of the next the choice. Where a word would be rejected, drawn one by one."""
    bits = rng.bit_generator
    state = bits.state
    if isinstance(bits, np.random.PCG64) and 1 < n < 2**32 and not state["has_uint32"]:
        words = bits.random_raw(2 * steps)
        half = np.uint64(0xFFFFFFFF)
        scaled = np.stack([words[::2] & half, words[::2] >> np.uint64(32)]) * np.uint64(n)
        if not ((scaled & half) < 2**32 % n).any():
            i, j = (scaled >> np.uint64(32)).tolist()
            return zip(i, j, (words[1::2] >> np.uint64(63) == 0).tolist(), strict=True)
        bits.state = state
    return ((*rng.integers(n, size=2).tolist(), rng.random() < 0.5) for _ in range(steps))


def rewired(adj: np.ndarray, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Degree-preserving null: pairs of edges swap ends."""
    e = np.argwhere(np.triu(adj)).tolist()  # python's numbers: a step looks at single cells
    a, n = adj.tolist(), len(e)
    for i, j, straight in _draws(rng, n, rounds * n):
        p, q = e[i]
        r, s = e[j] if straight else e[j][::-1]
        if p == q or p == r or p == s or q == r or q == s or r == s or a[p][s] or a[r][q]:
            continue
        a[p][q] = a[q][p] = a[r][s] = a[s][r] = False
        a[p][s] = a[s][p] = a[r][q] = a[q][r] = True
        e[i], e[j] = [p, s], [r, q]
    return np.array(a)


def model(kind: str, n: int, edges: int, rng: np.random.Generator, p: float = 0.1, m: int = 2) -> np.ndarray:
    """A random graph of so many edges, a rewired ring (small_world), or preferential attachment (scale_free)."""
    a = np.zeros((n, n), bool)
    if kind == "random":
        i, j = np.triu_indices(n, 1)
        pick = rng.choice(len(i), min(edges, len(i)), replace=False)
        a[i[pick], j[pick]] = True
    elif kind == "small_world":
        for step in range(1, max(1, round(edges / n)) + 1):
            for i in range(n):
                j = (i + step) % n
                free = np.flatnonzero(~(a[i] | a[:, i]))
                free = free[free != i]
                if rng.random() < p and len(free):
                    j = rng.choice(free)
                a[i, j] = True
    else:
        ends = list(range(m))
        for v in range(m, n):
            for u in set(int(x) for x in rng.choice(ends, m)):
                a[v, u] = True
                ends += [v, u]
    return a | a.T


def small_worldness(adj: np.ndarray, rng: np.random.Generator, nulls: int = 10) -> dict[str, float]:
    """Clustering and path length against rewired nulls, and their ratio."""
    c, ell = float(clustering(adj).mean()), path_length(adj)
    null = [rewired(adj, rng) for _ in range(nulls)]
    c0, l0 = np.mean([clustering(x).mean() for x in null]), np.nanmean([path_length(x) for x in null])
    gamma, lam = c / c0 if c0 else float("nan"), ell / l0
    return {"gamma": gamma, "lambda": lam, "sigma": gamma / lam}
