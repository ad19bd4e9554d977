"""Cluster inference on lattices and graphs in numpy: components, TFCE, random fields, null maxima."""

from __future__ import annotations

import math

import numpy as np

from lucera.functions.signal import t_sf


def components(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component number from 1 of each node of the mask (0 outside), over edges a - b."""
    root = np.arange(len(mask))
    keep = mask[a] & mask[b]
    a, b = a[keep], b[keep]
    while True:
        old = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == old).all():
            break
    out = np.zeros(len(mask), int)
    out[mask] = np.unique(root[mask], return_inverse=True)[1] + 1
    return out


def cluster_values(stat: np.ndarray, a, b, cut: float, kind: str = "mass") -> tuple[np.ndarray, np.ndarray]:
    """Component of each node above the cut and each component's mass over the cut, or extent."""
    lab = components(stat > cut, a, b)
    w = np.where(lab > 0, stat - cut, 0.0) if kind == "mass" else (lab > 0).astype(float)
    return lab, np.bincount(lab, w, lab.max(initial=0) + 1)[1:]


def tfce(stat: np.ndarray, a, b, e: float = 0.5, h: float = 2.0, step: float = 0.1) -> np.ndarray:
    """Threshold-free enhancement of positive values."""
    out = np.zeros(len(stat))
    for cut in np.arange(step, stat.max(initial=0.0) + step / 2, step):
        lab = components(stat >= cut, a, b)
        size = np.bincount(lab)
        size[0] = 0
        out += size[lab] ** e * cut**h * step * (lab > 0)
    return out


def max_statistic_p(observed: np.ndarray, null_maxima: np.ndarray, exhaustive: bool = False) -> np.ndarray:
    """Family-wise p of each observed value from the null's maxima; an exhaustive null holds the observed one."""
    reach = (null_maxima[None, :] >= observed[:, None] - 1e-12).sum(1)
    return reach / len(null_maxima) if exhaustive else (1 + reach) / (1 + len(null_maxima))


def permutation_inference(t_obs: np.ndarray, t_null: np.ndarray, a, b, cut: float, kind: str = "mass", exhaustive: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Components of one sign (0: none) and the family-wise p of each; kind mass, extent or tfce (a p a node)."""
    if kind == "tfce":
        return np.ones(len(t_obs), int), max_statistic_p(tfce(t_obs, a, b), np.array([tfce(t, a, b).max() for t in t_null]), exhaustive)
    lab, value = cluster_values(t_obs, a, b, cut, kind)
    null = np.array([cluster_values(t, a, b, cut, kind)[1].max(initial=0.0) for t in t_null])
    return lab, max_statistic_p(value, null, exhaustive)


def resel_counts(ijk: np.ndarray, fwhm: float) -> np.ndarray:
    """Intrinsic volumes R0 .. R3 in resels: lattice points, edges, faces and cubes; fwhm in voxels."""
    have = {tuple(v) for v in ijk.tolist()}
    steps = [((1, 0, 0),), ((0, 1, 0),), ((0, 0, 1),)]
    pair = [(0, 1), (0, 2), (1, 2)]

    def count(axes):
        corners = [tuple(sum(1 for ax, on in zip(axes, bits, strict=True) if on and ax == d) for d in range(3)) for bits in np.ndindex(*(2,) * len(axes))]
        return sum(all((i + x, j + y, k + z) in have for x, y, z in corners) for i, j, k in have)

    p = len(have)
    e = [count((d,)) for d in range(len(steps))]
    f = [count(q) for q in pair]
    c = count((0, 1, 2))
    es, fs = sum(e), sum(f)
    return np.array([p - es + fs - c, (es - 2 * fs + 3 * c) / fwhm, (fs - 3 * c) / fwhm**2, c / fwhm**3])


def ec_density_t(u: float, df: float) -> np.ndarray:
    """Euler characteristic densities of a t field in 0 to 3 dimensions, per resel."""
    l4 = 4 * math.log(2)
    tail = (1 + u * u / df) ** (-(df - 1) / 2)
    g = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df / 2)
    return np.array([t_sf(u, df), l4**0.5 / (2 * math.pi) * tail, l4 / (2 * math.pi) ** 1.5 * g * u * tail, l4**1.5 / (2 * math.pi) ** 2 * ((df - 1) / df * u * u - 1) * tail])


def cluster_p_fwe(k: float, u: float, df: float, resels: np.ndarray) -> float:
    """Family-wise p of a cluster of k resels above u: expected clusters times the chance of its size."""
    rho = ec_density_t(u, df)
    expected = max(float(resels @ rho), 1e-300)
    volume = resels[3] * rho[0] / expected if resels[3] > 0 else 1e-12
    beta = (math.gamma(2.5) / max(volume, 1e-300)) ** (2 / 3)
    return -math.expm1(-expected * math.exp(-beta * k ** (2 / 3)))
