"""An id with many rows in a leaf takes one place only."""

import numpy as np

from runstore.llm.topk import Tree


def test_repeated_id_leaves_its_neighbours():
    ids = np.array([7] * 20 + list(range(100, 115)) + [1] * 20)
    rows = np.array([[1000 + i, 1] for i in range(20)] + [[500 - i, 1] for i in range(15)] + [[2000, 1]] * 20, np.int64)
    order = np.random.default_rng(4).permutation(len(ids))
    q = np.array([1, 0])
    for leaf in (128, 16):
        tree = Tree(ids[order], rows[order], leaf)
        best: list[tuple[int, int]] = []
        tree.search(q, 1, tree.bounds(q[None])[0], best, np.iinfo(np.int64).min, 10)
        assert sorted(best, reverse=True) == [(1019, -7)] + [(500 - i, -100 - i) for i in range(9)]
