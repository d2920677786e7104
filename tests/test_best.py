"""The product kernel against brute force, and how it measures."""

import numpy as np
import pytest

from lodestone.operators.search import Best, pair_distances


def brute(metric, q, x, ids, k):
    out = []
    for a in q:
        d = pair_distances(metric, np.repeat(a[None], len(x), 0), x)
        out.append([(int(ids[i]), d[i]) for i in np.lexsort((ids, d))[:k]])
    return out


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine", "cosine_distance"])
@pytest.mark.parametrize("shift", [0.0, 1e4])
def test_best_is_exact(monkeypatch, metric, shift):
    """Near the origin in single precision once limits are known; far from it rounding would hide what is near."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((5000, 16)) + shift
    x[100:130] = x[7]  # ties
    if not shift:
        x[200:203] = 0.0
    q = np.concatenate([x[:300:3], rng.standard_normal((60, 16)) + shift])
    ids = rng.permutation(5000)
    kinds, estimate = [], Best._estimate
    monkeypatch.setattr(Best, "_estimate", lambda self, a, b: kinds.append(str(a.dtype)) or estimate(self, a, b))
    best = Best(metric, q, 6)
    for at in range(0, 5000, 1250):
        best.add(ids[at : at + 1250], x[at : at + 1250])
    order = np.lexsort((best.ids, best.d, best.who))
    got = [[(int(best.ids[i]), best.d[i]) for i in order[best.who[order] == row]] for row in range(len(q))]
    with np.errstate(invalid="ignore"):
        want = brute(metric, q, x, ids, 6)
    same = lambda rows: [[(i, None if np.isnan(d) else d) for i, d in r] for r in rows]
    assert same(got) == same(want)
    assert kinds[0] == "float64"
    if metric == "euclidean" and shift:
        assert set(kinds) == {"float64"}
    if metric == "manhattan" and not shift:
        assert kinds[-1] == "float32"
