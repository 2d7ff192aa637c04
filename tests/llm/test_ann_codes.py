"""Bounds of the vector codes: certain, and so tight that few rows are reranked."""

import numpy as np
from chronoloom.llm import ann


def held(x, queries, k=20):
    turn, centre = ann.rotation(x.shape[1]), x.mean(0)
    with np.errstate(all="ignore"):
        return ann.Codes(x, centre, turn).candidates(queries, np.full(len(queries), -1), k)


def test_few_rows_are_reranked():
    x = np.random.default_rng(1).standard_normal((8192, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = x[:100]
    r, c = held(x, q)
    assert len(r) < 0.01 * len(x) * len(q)
    want = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert {(i, j) for i in range(100) for j in want[i]} <= set(zip(r.tolist(), c.tolist(), strict=True))


def test_no_neighbour_is_lost():
    rng = np.random.default_rng(2)
    for dim in (1, 3, 64):
        x = rng.standard_normal((3000, dim)) * 10.0 ** rng.integers(-3, 4, (3000, 1)) + 5
        x[100:400] = x[100]  # copies
        x[400:500] = x[400] * (1 + 1e-9 * rng.standard_normal((100, 1)))
        q = x[::20]
        r, c = held(x, q)
        exact = q @ x.T
        got = np.zeros(exact.shape, bool)
        got[r, c] = True
        kth = -np.partition(-exact, 19, axis=1)[:, 19:20]
        assert got[exact >= kth].all()


def test_values_beyond_single_precision():
    x = np.random.default_rng(3).standard_normal((200, 8)) * 1e60
    q = x[:10]
    r, c = held(x, q)
    want = np.argsort(-(q / 1e60) @ (x / 1e60).T, axis=1)[:, :20]
    assert {(i, j) for i in range(10) for j in want[i]} <= set(zip(r.tolist(), c.tolist(), strict=True))
