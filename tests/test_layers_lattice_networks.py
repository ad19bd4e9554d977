"""Layered media, cluster inference and graph metrics against closed forms and known graphs."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parents[1]))

from lucera.functions import diffusion, lattice, layers, networks  # noqa: E402


def test_equal_layers_are_one_medium():
    for freq in (0.0, 1.1e8):
        one = diffusion.fd_fluence(2.5, 0.1, 10.0, 1.4, freq)
        three = layers.layered_fd(2.5, [0.1] * 3, [10.0] * 3, [0.8, 0.7], 1.4, freq)[0]
        assert abs(three / one - 1) < 1e-9


def test_lower_layer_matters_and_thick_one_does_not():
    one = diffusion.fd_fluence(1.0, 0.1, 10.0, 1.4).real
    assert abs(layers.layered_fd(1.0, [0.1, 0.3], [10.0, 10.0], [6.0], 1.4)[0].real / one - 1) < 1e-6
    assert layers.layered_fd(3.0, [0.1, 0.3], [10.0, 10.0], [0.5], 1.4)[0].real < 0.9 * diffusion.fd_fluence(3.0, 0.1, 10.0, 1.4).real
    # an absorbing layer split in two is the same layer
    two = layers.layered_fd(2.0, [0.1, 0.2], [10.0, 8.0], [0.5], 1.4, 1e8)[0]
    cut = layers.layered_fd(2.0, [0.1, 0.2, 0.2], [10.0, 8.0, 8.0], [0.5, 1.0], 1.4, 1e8)[0]
    assert abs(two / cut - 1) < 1e-9


def test_layered_g1_and_td():
    tau = np.logspace(-7, -3, 9)
    g = layers.layered_g1(2.5, [0.1, 0.1], [10.0, 10.0], [1.0], 1.4, 785.0, tau, [{"adb": 1e-8}] * 2)
    assert np.allclose(g, diffusion.dcs_g1(2.5, 0.1, 10.0, 1.4, 785.0, tau, adb=1e-8), rtol=1e-8)
    t = np.linspace(2e-10, 2e-9, 20)
    assert np.allclose(layers.layered_td(t, 2.0, [0.1], [10.0], [], 1.4, n_freq=2048), diffusion.td_fluence(t, 2.0, 0.1, 10.0, 1.4), rtol=1e-9)


def test_responses():
    t = np.linspace(0, 10, 2001)
    r = layers.emg_response(t, 3.0, 0.2, 0.5)
    assert abs(r.sum() - 1) < 1e-12 and abs((t * r).sum() - 3.5) < 1e-3
    x = np.zeros(2001)
    x[100] = 1
    assert np.allclose(layers.through_response(x, r)[100:], r[:1901])
    assert abs(layers.bessel_j0(np.array([2.404825557695773]))[0]) < 1e-12


def test_layer_arguments():
    p = {"mua_1": 0.1, "mua_2": 0.2, "musp": 9.0, "d_1": 1.0}
    assert layers.layer_arguments(p, 2) == {"mua": [0.1, 0.2], "musp": [9.0, 9.0], "thickness": [1.0]}
    assert set(layers.layer_bounds(2)) == {"mua_1", "mua_2", "musp_1", "musp_2", "d_1"}


LINE = (np.arange(9), np.arange(1, 10))


def test_clusters():
    stat = np.array([3.0, 4, 0, 0, 5, 0, 3, 3, 3, 0])
    lab, mass = lattice.cluster_values(stat, *LINE, 2.0)
    assert lab.tolist() == [1, 1, 0, 0, 2, 0, 3, 3, 3, 0] and mass.tolist() == [3, 3, 3]
    assert lattice.cluster_values(stat, *LINE, 2.0, "extent")[1].tolist() == [2, 1, 3]
    assert lattice.cluster_values(np.zeros(10), *LINE, 2.0)[1].tolist() == []
    one = lattice.tfce(np.array([0, 1.0, 0]), np.array([0, 1]), np.array([1, 2]), step=0.001)
    assert abs(one[1] - 1 / 3) < 2e-3 and one[0] == one[2] == 0


def test_permutation_inference():
    rng = np.random.default_rng(0)
    null = rng.normal(size=(99, 10))
    obs = rng.normal(size=10)
    obs[2:6] += 8
    lab, p = lattice.permutation_inference(obs, null, *LINE, 2.0)
    assert p[lab[3] - 1] == 0.01
    assert lattice.permutation_inference(obs, null, *LINE, 2.0, "tfce")[1][3] == 0.01


def test_random_field():
    cube = np.argwhere(np.ones((4, 5, 6)))
    assert np.allclose(lattice.resel_counts(cube, 1.0), [1, 3 + 4 + 5, 3 * 4 + 3 * 5 + 4 * 5, 60])
    r = lattice.resel_counts(cube, 2.0)
    p = [lattice.cluster_p_fwe(k, 3.0, 20, r) for k in (0.1, 1.0, 5.0)]
    assert 1 >= p[0] > p[1] > p[2] > 0


def test_graphs():
    star = np.zeros((5, 5), bool)
    star[0, 1:] = star[1:, 0] = True
    assert networks.betweenness(star).tolist() == [1, 0, 0, 0, 0]
    assert networks.path_length(star) == (8 * 1 + 12 * 2) / 20 and networks.global_efficiency(star) == (8 + 6) / 20
    assert networks.nodal_efficiency(star)[0] == 1 and networks.clustering(star).sum() == 0
    square = np.zeros((4, 4), bool)
    for i in range(4):
        square[i, (i + 1) % 4] = square[(i + 1) % 4, i] = True
    assert np.allclose(networks.betweenness(square), 1 / 6)
    assert np.isnan(networks.path_length(np.zeros((3, 3), bool))) and networks.global_efficiency(np.zeros((3, 3), bool)) == 0
    rng = np.random.default_rng(1)
    for kind in ("random", "small_world", "scale_free"):
        g = networks.model(kind, 30, 90, rng)
        assert (g == g.T).all() and not g.diagonal().any()
        assert (networks.rewired(g, rng).sum(0) == g.sum(0)).all()
    assert networks.model("random", 30, 90, rng).sum() == 180
    assert networks.small_worldness(networks.model("small_world", 40, 160, rng, p=0.05), rng, 3)["sigma"] > 1
