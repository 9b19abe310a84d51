"""Sequential moves of the information bottleneck against a plain loop."""

import numpy as np

from brindle.operators.clustering import sequential_moves


def test_moves_equal_those_by_all_logarithms():
    rng = np.random.default_rng(2)
    x, w, k = rng.dirichlet(np.full(9, 0.3), 120), rng.random(120), 4
    x[x < 0.01] = 0
    x, w, own = x / x.sum(axis=1, keepdims=True), w / w.sum(), rng.integers(0, k, 120)
    got = own.copy()
    sequential_moves(x, w, got, k, 20)

    def loss(labels):
        sums = np.array([(x * w[:, None])[labels == c].sum(axis=0) for c in range(k)])
        p = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300)
        return -(sums * np.log2(np.where(p > 0, p, 1))).sum()

    for _ in range(20):
        before = own.copy()
        for i in range(len(x)):
            losses = [loss(np.where(np.arange(len(x)) == i, c, own)) for c in range(k)]
            if min(losses) < losses[own[i]] - 1e-12:
                own[i] = int(np.argmin(losses))
        if (before == own).all():
            break
    assert (got == own).all() and len(set(got)) > 1
