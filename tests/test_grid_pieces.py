"""The grid of a block product copies each side as seldom as memory allows, and works a cell off in strips."""

import numpy as np
import pandas as pd

from stratagraph.operators import nearest


def test_pieces():
    assert [nearest.pieces(n, 2048) for n in (0, 1, 2048, 2049, 12_000, 120_000, 720_000)] == [1, 1, 1, 2, 4, 4, 22]


def test_strips_of_a_cell(monkeypatch):
    rng = np.random.default_rng(3)
    side = lambda n: [v.astype(np.float32) for v in rng.normal(size=(n, 6))]
    left = pd.DataFrame({"id": range(50), "left_vector": side(50)})
    right = pd.DataFrame({"uri": [f"u{k % 40:02}" for k in range(70)], "chunk": range(70), "right_vector": side(70)})
    a, b = (np.stack(x).astype(np.float64) for x in (left["left_vector"], right["right_vector"]))
    cosine = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None, :]
    want = []
    for i in range(50):
        order = sorted((k for k in range(70) if cosine[i, k] >= 0.3), key=lambda k: (-cosine[i, k], right["uri"][k], k))[:4]
        want += [(i, right["uri"][k], k) for k in order]
    for strip in (70 * 7, 1 << 22):
        monkeypatch.setattr(nearest, "STRIP", strip)
        got = nearest._cell(left, right, 4, 0.3)
        assert list(zip(got["id"], got["uri"], got["chunk"])) == want
