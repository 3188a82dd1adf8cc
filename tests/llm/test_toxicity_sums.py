"""Sums of the training in chunks, to the last bit."""

import numpy as np

from tidemill.llm import toxicity


def test_sums_in_chunks():
    rng = np.random.default_rng(1)
    for n in (0, 5, 3 * toxicity.CHUNK + 7):
        index, values = rng.integers(0, 50, n).astype(np.int32), rng.normal(size=n)
        assert (toxicity.summed(index, lambda part: values[part], 50) == np.bincount(index, values, 50)).all()
