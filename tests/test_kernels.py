"""Properties of the numpy kernels, against the exact filter and plain definitions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prismgrid.functions import clustering, kernels, lattice, lowrank
from prismgrid.model import Border, Cluster, FilterSpec, Sampler, Smoother, Variant

RNG = np.random.default_rng(3)


def picture(n=48):
    y, x = np.mgrid[:n, :n]
    base = np.stack([127 + 60 * np.sin(x / 7), 127 + 60 * np.cos(y / 9), np.where(x > n // 2, 200.0, 60.0)], 2)
    return base + RNG.normal(0, 8, base.shape)


def db(a, b):
    return 10 * np.log10(255**2 / np.mean((a - b) ** 2))


@given(st.integers(1, 12), st.integers(0, 25), st.sampled_from([Border.REPLICATE, Border.REFLECT, Border.WRAP, Border.REFLECT101]))
@settings(max_examples=60, deadline=None)
def test_remap_is_numpy_pad(n, pad, border):
    mode = {Border.REPLICATE: "edge", Border.REFLECT: "symmetric", Border.WRAP: "wrap", Border.REFLECT101: "reflect"}[border]
    assert (kernels.remap(np.arange(-pad, n + pad), n, border) == np.pad(np.arange(n), pad, mode=mode)).all()


def test_exact_filter_by_definition():
    f, g, r = RNG.random((6, 7, 2)) * 99, RNG.random((6, 7, 3)) * 99, 2
    pf, pg = kernels.padded(f, r, Border.REFLECT101), kernels.padded(g, r, Border.REFLECT101)
    out = kernels.hdgf(pf, pg, r, 1.5, 30.0)
    for y in range(6):
        for x in range(7):
            top = low = 0
            for dy in range(-r, r + 1):
                for dx in range(-r, r + 1):
                    w = np.exp(-(dy * dy + dx * dx) / 4.5 - ((pg[y + r + dy, x + r + dx] - g[y, x]) ** 2).sum() / 1800)
                    top, low = top + w * pf[y + r + dy, x + r + dx], low + w
            assert np.allclose(out[y, x], top / low)


def test_limits_of_the_range_sigma():
    p = picture()
    q = kernels.padded(p, 9, Border.REFLECT101)
    assert np.allclose(kernels.hdgf(q, q, 9, 3.0, 1e9), kernels.smooth(q, 3.0, 9))
    assert np.allclose(kernels.hdgf(q, q, 9, 3.0, 1e-6), p)
    flat = np.full((32, 32, 3), 128.0)
    assert np.allclose(kernels.hdgf(kernels.padded(flat, 9, 4), kernels.padded(flat, 9, 4), 9, 3.0, 40.0), flat)


def test_output_stays_in_range():
    p = picture()
    out = kernels.hdgf(kernels.padded(p, 9, 4), kernels.padded(p, 9, 4), 9, 3.0, 40.0)
    assert out.min() >= p.min() and out.max() <= p.max()


@pytest.mark.parametrize(("order", "most"), [(1, 0.13), (2, 0.011), (3, 0.001), (5, 0.001)])
def test_sliding_cosine_nears_the_gaussian(order, most):
    line = np.zeros((61, 1, 1))
    line[30] = 1
    one = lambda *how: kernels._smooth_first(np.pad(line, ((9, 9), (0, 0), (0, 0))), 3.0, 9, *how)
    a, b = one(Smoother.FIR, 0), one(Smoother.SLIDING_COSINE, order)
    assert np.abs(a - b).max() <= most * a.max()


@pytest.mark.parametrize(("variant", "least"), [(Variant.NYSTROM, 38), (Variant.SOFT, 30), (Variant.INTERPOLATION, 28)])
def test_low_rank_nears_the_exact_filter(variant, least):
    p = picture(64)
    q = kernels.padded(p, 9, 4)
    spec = FilterSpec(sigma_range=40, k=10, variant=variant, order=3)
    out = lowrank.filtered(q, q, lowrank.find_centres(p, spec), spec, 9)
    exact = kernels.hdgf(q, q, 9, 3.0, 40.0)
    assert db(out, exact) > least and db(out, exact) > db(p, exact) - 6


def test_more_centres_are_better():
    p = picture(64)
    q = kernels.padded(p, 9, 4)
    exact = kernels.hdgf(q, q, 9, 3.0, 40.0)
    spec = FilterSpec(sigma_range=40, smoother=Smoother.FIR, cluster=Cluster.KMEANS_PP, sampler=Sampler.NEAREST)
    quality = [db(lowrank.filtered(q, q, lowrank.find_centres(p, spec.but(k=k)), spec, 9), exact) for k in (3, 8, 20)]
    assert quality[0] < quality[1] < quality[2]


def test_low_rank_at_low_resolution():
    p = picture(64)
    q = kernels.padded(p, 9, 4)
    spec = FilterSpec(sigma_range=40, k=10, downsample=2)
    out = lowrank.filtered(q, q, lowrank.find_centres(p, spec), spec, 9)
    assert out.shape == p.shape and db(out, kernels.hdgf(q, q, 9, 3.0, 40.0)) > 28


def test_lattice_and_tree_near_the_exact_filter():
    p = picture(64)
    exact = kernels.hdgf(kernels.padded(p, 9, 4), kernels.padded(p, 9, 4), 9, 3.0, 40.0)
    at, flat, inner = lattice.positions(p, 3.0, 40.0), p.reshape(-1, 3), (slice(12, -12), slice(12, -12))
    for smooth, least in ((lattice.permutohedral, 38), (lattice.kd_tree, 34)):
        out = smooth(at, flat).reshape(p.shape)
        assert db(out[inner], exact[inner]) > least
        assert np.allclose(smooth(at, np.full_like(flat, 7.0)), 7.0)


def test_pca():
    x = RNG.normal(size=(500, 4)) @ np.diag([5, 3, 1, 0.1]) @ RNG.normal(size=(4, 4))
    mean, basis, value = kernels.principal(x, 9)
    assert basis.shape == (4, 4) and (np.diff(value) <= 1e-9).all()
    assert np.allclose(basis.T @ basis, np.eye(4)) and np.allclose(np.cov(x.T, bias=True), basis @ np.diag(value) @ basis.T)
    d = lambda v: ((v[:20, None] - v[None, :20]) ** 2).sum(2)
    assert np.allclose(d(x), d(x @ basis))


def test_full_pca_does_not_change_the_filter():
    p = picture()
    q = kernels.padded(p, 9, 4)
    _, basis, _ = kernels.principal(p.reshape(-1, 3), 3)
    assert np.allclose(kernels.hdgf(q, q, 9, 3.0, 40.0), kernels.hdgf(q, q @ basis, 9, 3.0, 40.0))


@pytest.mark.parametrize("method", list(Cluster))
def test_clusters(method):
    x = np.concatenate([RNG.normal(c, 2, (60, 2)) for c in ((0, 0), (100, 0), (0, 100), (100, 100))])
    spec = FilterSpec(k=4, cluster=method)
    mu = clustering.centres(x, spec, 5)
    assert 1 <= len(mu) <= 4 and np.isfinite(mu).all()
    assert np.allclose(mu, clustering.centres(x, spec, 5))
    if method not in (Cluster.RANDOM_SAMPLE, Cluster.KMEANS):
        assert clustering.distances(x, mu).min(1).mean() < 100


def test_clusters_of_few_rows():
    for method in Cluster:
        assert len(clustering.centres(np.array([[1.0, 2.0]]), FilterSpec(k=4, cluster=method))) == 1
        clustering.centres(np.ones((9, 2)), FilterSpec(k=4, cluster=method))


@pytest.mark.parametrize("how", list(Sampler))
def test_samples(how):
    p = picture(32)
    s = lowrank.sample(p, FilterSpec(sampler=how, rate=0.25))
    assert 0.12 * 1024 < len(s) < 0.4 * 1024 and s.shape[1] == 3


def test_settings_without_a_definition():
    for bad in ({"variant": Variant.INTERPOLATION2}, {"cluster_refine": 1}, {"patch_pca_method": 1}):
        with pytest.raises(NotImplementedError):
            FilterSpec(**bad)
    with pytest.raises(ValueError):
        FilterSpec(sigma_space=0)
