import tracemalloc

import numpy as np

from statemill.llm import quality as q


def _rows(n=4000, words=300):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, n)
    each = [np.unique(np.append(rng.zipf(1.3, words) * 2654435761 % 4294967296, 1000 + y[i] if i % 3 == 0 else 7).astype("<u4")) for i in range(n)]
    return np.concatenate(each), np.array(list(map(len, each))), y


def test_the_fit_takes_little_beside_the_hashes():
    flat, sizes, y = _rows()
    tracemalloc.start()
    model = q.fit(flat, sizes, y, q.Settings(rounds=3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {1000, 1001, 1002} <= set(model.weights)
    assert peak < 24 * len(flat)


def test_places_and_counts():
    flat, sizes, y = _rows(500, 50)
    known = q._frequent(flat, 8)
    values, times = np.unique(flat, return_counts=True)
    assert known.tolist() == values[times >= 8].tolist()
    owner, at = q._places(flat, sizes, known)
    kept = np.isin(flat, known)
    assert owner.tolist() == np.repeat(np.arange(500), sizes)[kept].tolist() and known[at].tolist() == flat[kept].tolist()
    low = y <= 0
    assert q._count(at, len(known), owner, low).tolist() == np.bincount(at[low[owner]], minlength=len(known)).tolist()
    assert q._frequent(flat[:0], 8).tolist() == q._frequent(flat[:3], 8).tolist() == []
