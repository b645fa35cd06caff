import tracemalloc

import numpy as np

from folioscan.llm import embeddup as E


def _peak(f) -> float:
    tracemalloc.start()
    f()
    at = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return at


def test_nearest_centres_of_a_batch_are_right_in_little_memory():
    r = np.random.default_rng(1)
    x, c = E.unit(r.normal(size=(10_000, 16))), E.unit(r.normal(size=(2048, 16)))
    assert _peak(lambda: E.nearest_centres(x, c, 3)) < 60
    assert (E.nearest_centres(x, c, 3) == np.sort(np.argsort(-(x @ c.T), axis=1)[:, :3], axis=1)).all()


def test_range_search_of_a_dense_shard_holds_no_vector_of_every_pair():
    r = np.random.default_rng(2)
    x = E.unit(1 + 0.05 * r.normal(size=(2000, 64)))
    near = E.prune(x)
    a, k = np.nonzero(near >= 0)
    links = sorted(zip(np.concatenate([a, near[a, k]]), np.concatenate([near[a, k], a])))
    start = np.searchsorted([n for n, _ in links], np.arange(len(x) + 1))
    flat = np.array([m for _, m in links])
    # every pair is in range: two million
    found = []
    assert _peak(lambda: found.append(E.range_search(x, start, flat, 0.9))) < 350
    assert len(found[0][0]) == 2000 * 1999 // 2
    assert np.allclose(E.dots(x, *found[0]), np.einsum("ij,ij->i", x[found[0][0]], x[found[0][1]]))
