"""Language numbers beyond 127."""

import numpy as np
import pytest

from stratagraph.llm.langid import viterbi


@pytest.mark.parametrize("k", [4, 128, 129, 300])
def test_viterbi_of_many_languages(k):
    lengths = np.array([3, 0, 5])
    scores = np.full((8, k), -50, np.float32)
    scores[:3, k - 1] = 0
    scores[3:, k // 2] = 0
    assert viterbi(scores, lengths, 1.0).tolist() == [k - 1] * 3 + [k // 2] * 5
