"""Near duplicates among texts of a few words, where the estimate has little to go by."""

import numpy as np
import pytest

from jobmart.llm import near_dedup


@pytest.mark.parametrize("a,b,shared", [(5, 4, 4), (9, 9, 8), (10, 8, 8), (15, 12, 12)])
def test_estimate_keeps_short_pairs_at_the_threshold(a, b, shared):
    random = np.random.default_rng(7)
    limit = near_dedup.most_differing(0.8 - near_dedup.SLACK)
    for _ in range(1000):
        names = random.integers(0, 2**64, a + b - shared, np.uint64)
        x, y = near_dedup.packed_bits(names[:a]), near_dedup.packed_bits(names[a - shared :])
        apart = (x ^ y)[: near_dedup.PLANE] | (x ^ y)[near_dedup.PLANE :]
        assert np.bitwise_count(apart.view(np.uint64)).sum() <= limit


def test_short_pairs_are_linked(spark):
    """Pairs of 5 words against 4 of them, 0.8 on the sets of single words."""
    rows = []
    for i in range(2000):
        words = [f"w{i}x{k}" for k in range(5)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:4]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.near_duplicates(docs, size=1, threshold=80).collect()
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in found) and len(found) == 4000
