"""Neighbours that only hot buckets bring together."""

import numpy as np
import pytest

from driftmap.llm import packing
from tests.llm.test_llm import neighbour_recall


@pytest.mark.parametrize("n, pool, held", [(600, 6, 4096), (600, 6, 100), (400, 2, 150)])
def test_neighbours_in_hot_buckets(spark, monkeypatch, n, pool, held):
    """Every bucket is far larger than REACH, yet each document has its best partners; some bins are empty, some documents nearly so."""
    monkeypatch.setattr(packing, "HELD", held, raising=False)
    monkeypatch.setattr(packing, "ASKING", 2 * held, raising=False)
    rng = np.random.default_rng(n + pool)
    sk = np.arange(packing.BINS, dtype=np.uint64) * np.uint64(1 << 40) + rng.integers(1, pool + 1, (n, packing.BINS)).astype(np.uint64)
    sk[rng.random(sk.shape) < 0.1] = packing._NONE
    sk[::9, 3:] = packing._NONE
    table = [(i, i, [None if x == packing._NONE else int(x) for x in r], bytearray(s.tobytes())) for i, (r, s) in enumerate(zip(sk, packing.short(sk)))]
    base = spark.createDataFrame(table, "row long, doc_id long, keys array<long>, sketch binary").repartition(3)
    recall, total = neighbour_recall(base, lambda d: True)
    assert total > 7 * n and recall == 1
