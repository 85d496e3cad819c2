import numpy as np

from tessera.operators import cluster as K
from tessera.operators.resample import allowed_shifts
from tessera.operators.tracking import _assignment

RNG = np.random.default_rng(1)
BLOBS = np.vstack([RNG.normal(c, 0.2, (15, 2)) for c in ((0, 0), (5, 5), (0, 6))])
TRUE = np.repeat([0, 1, 2], 15)


def same(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_methods_recover_planted_groups():
    assert same(K.ward(BLOBS, 3), TRUE)
    assert same(K.lloyd(BLOBS, BLOBS[K.maxmin_seeds(BLOBS, 3)]), TRUE)
    w = np.exp(-((BLOBS[:, None] - BLOBS[None]) ** 2).sum(-1))
    np.fill_diagonal(w, 0)
    assert same(K.spectral(w, 3), TRUE)
    assert same(K.louvain(w), TRUE)
    assert same(K.leiden(w), TRUE)
    assert same(K.hybrid(BLOBS, w), TRUE)
    assert same(K.joint_kmeans(BLOBS, w, 3), TRUE)
    found = K.density_clusters(np.vstack([BLOBS, [[20.0, 20.0]]]), 5)
    assert found[-1] == -1 and same(found[:-1], TRUE)
    assert (K.density_clusters(BLOBS[:3]) == -1).all()
    links = K.modularity_links(w)
    assert same(K.feature_link_clusters(BLOBS, links, K.maxmin_seeds(np.hstack([BLOBS, links]), 3)), TRUE)
    assert len(K.anomalous_patterns(BLOBS)) >= 2


def test_dtw_procrustes_ami():
    t = np.linspace(0, 6, 30)
    assert K.dtw(np.sin(t), np.sin(t), 2) == 0
    assert K.dtw(np.sin(t), np.sin(t + 0.4), 3) < K.dtw(np.sin(t), np.cos(t), 3)
    turn = np.array([[0.0, -1.0], [1.0, 0.0]])
    rotation, fit = K.procrustes(BLOBS, BLOBS @ turn)
    assert abs(fit - 1) < 1e-9 and np.allclose((BLOBS - BLOBS.mean(0)) @ turn @ rotation, BLOBS - BLOBS.mean(0))
    assert abs(K.mutual_information(TRUE, TRUE) - 1) < 1e-9
    assert abs(K.mutual_information(TRUE, np.arange(45) % 3)) < 0.1


def test_assignment_and_shifts():
    from itertools import permutations

    for n in (2, 4, 5):
        cost = RNG.random((n, n + 1)).tolist()
        best = min(sum(cost[i][p[i]] for i in range(n)) for p in permutations(range(n + 1), n))
        assert abs(sum(cost[i][j] for i, j in _assignment(cost)) - best) < 1e-12
    assert allowed_shifts(24, 2, 2) == [4, 5, 6, 7, 8, 16, 17, 18, 19, 20]


def test_rewiring_keeps_degrees():
    w = np.triu((RNG.random((30, 30)) < 0.2) * RNG.random((30, 30)), 1)
    w = w + w.T
    other = K.rewired(w, 500, seed=3)
    assert ((other > 0).sum(0) == (w > 0).sum(0)).all() and np.allclose(other, other.T)
    assert abs(other.sum() - w.sum()) < 1e-9 and (other > 0).sum() == (w > 0).sum() and not np.array_equal(other, w)
